"""Queries on report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.catalog.base import LINEITEM_GAPS, PART_LINKS, digits, lineitem_gaps, part_links, query, sales, table
from siftwright.catalog.base import fdr_sql
from siftwright.catalog.checks import PROPOSED, TESTED, order_hypotheses, proposed, settled_links
from siftwright.catalog.packs import CANDIDATES, greedy_sql
from siftwright.catalog.pairs import KEPT
from siftwright.catalog.tables import COUNT_FIELDS, LINEITEM, PROFILED, SPLIT, counts_sql
from siftwright.operators import evidence as E
from siftwright.operators import report as R
from siftwright.operators.fdr import correct
from siftwright.operators.profile import profile
from siftwright.operators.split import train_test_split
from siftwright.operators.validate import ValidationConfig, validate
from siftwright.plans.materialize import small_frame
from siftwright.plans.pipeline import Source, discover

TYPED = f"WITH {LINEITEM_GAPS}, c AS ({counts_sql('lineitem', 'lineitem_gaps', LINEITEM)} UNION ALL {counts_sql('orders', 'orders', PROFILED['orders'])}), p AS (SELECT {COUNT_FIELDS} FROM c)"


def _profiles(spark, sf):
    return profile(lineitem_gaps(spark, sf), "lineitem").unionByName(profile(table(spark, sf, "orders"), "orders"))


@query("report_feature_types", f"{TYPED} SELECT dataset, feature_type, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    return R.feature_type_counts(_profiles(spark, sf))


@query("report_missing", f"""{TYPED} SELECT dataset, "column", missing_rate FROM p WHERE missing_rate > 0 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY missing_rate DESC, "column") <= 20""")
def _(spark, sf):
    return R.top_missing(_profiles(spark, sf))


@query("report_profile", f"""{TYPED} SELECT dataset, "column", feature_type AS type, round(missing_rate * 100, 2) AS missing_percent, n_unique AS "unique" FROM p""")
def _(spark, sf):
    return digits(R.profile_view(_profiles(spark, sf)).drop("skewness", "outlier_percent"))


@query("report_split", f"""WITH {SPLIT} SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) AS total_rows,
  round(100.0 * count(*) FILTER (split = 'test') / count(*))::DOUBLE AS test_percent, 6::INTEGER AS columns FROM split""")
def _(spark, sf):
    return R.split_metrics(train_test_split(table(spark, sf, "orders"), "o_orderkey"))


@query("report_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def _(spark, sf):
    return R.preview(table(spark, sf, "orders").orderBy("o_orderkey"))


@query("report_families", f"WITH {KEPT} SELECT dataset, type, count(*) AS n FROM adjusted GROUP BY ALL UNION ALL SELECT dataset, 'filtered', count(*) FROM kept GROUP BY 1")
def _(spark, sf):
    return R.family_counts(*correct(part_links(spark, sf), large=True))


def histogram_sql(value: str, by: str, bins: int = 50) -> str:
    return f"""e AS (SELECT min({value}) AS a, max({value}) AS b FROM part_links), b AS (SELECT {by}, least(1 + floor({bins} * ({value} - a) / (b - a)), {bins})::INTEGER AS bin, a, (b - a) / {bins} AS step FROM part_links, e WHERE {value} IS NOT NULL)
SELECT {by}, bin, round(any_value(a) + (bin - 1) * any_value(step), 9) AS low, round(any_value(a) + (bin - 1) * any_value(step) + any_value(step), 9) AS high, count(*) AS n FROM b GROUP BY {by}, bin"""


@query("report_effects", f"WITH {PART_LINKS}, {histogram_sql('effect', 'type')}")
def _(spark, sf):
    return digits(R.histogram(part_links(spark, sf), "effect", "type"))


@query("report_p_values", f"WITH {PART_LINKS}, {histogram_sql('p_value', 'dataset')}")
def _(spark, sf):
    return digits(R.histogram(part_links(spark, sf), "p_value", "dataset"))


@query("report_filtered", f"WITH {KEPT} SELECT dataset, var1, var2, type, test, round(effect, 4) AS effect, effect_name, round(adjusted_p, 4) AS adjusted_p, n FROM kept")
def _(spark, sf):
    return R.filtered_view(correct(part_links(spark, sf), large=True)[1])


@query("report_edges", f"""WITH RECURSIVE {CANDIDATES}, {greedy_sql('candidates')} SELECT dataset, 'E' || edge_no AS edge, var1, var2, type, round(effect, 4) AS effect FROM edges""")
def _(spark, sf):
    return R.edge_view(E.edge_records(E.choose_edges(correct(part_links(spark, sf), large=True)[1]))).drop("size", "direction")


@query("report_hypotheses", """SELECT 'H' || o_orderkey AS id, CASE WHEN o_orderkey % 12 = 3 OR o_orderkey % 12 = 4 THEN '' ELSE
  CASE WHEN o_orderkey % 12 = 6 THEN 'grade' WHEN o_orderkey % 12 IN (7, 8) THEN 'size' ELSE 'score' END || ' ~ ' ||
  CASE o_orderkey % 12 WHEN 5 THEN 'zap + nope' WHEN 10 THEN 'c_acctbal + cube' ELSE 'c_acctbal' END END AS formula FROM orders""")
def _(spark, sf):
    return order_hypotheses(spark, sf).select("id", R.formula().alias("formula"))


@query("report_status", f"WITH {TESTED} SELECT dataset, validation_status, count(*) AS n FROM settled GROUP BY ALL")
def _(spark, sf):
    return R.status_counts(settled_links(spark, sf))


@query("report_points", f"""WITH {TESTED} SELECT dataset, id, primary_test, round(effect, 9) AS effect, round(p_value, 9) AS p_value,
  CASE WHEN validation_status = 'final_accepted' THEN 'Accepted' ELSE 'Rejected' END AS result FROM settled WHERE effect IS NOT NULL""")
def _(spark, sf):
    return digits(R.effect_points(settled_links(spark, sf)))


@query("report_results", f"""WITH {TESTED} SELECT dataset, id, claim, primary_test, round(effect, 4) AS effect, round(p_value, 4) AS p_value, validation_status, validation_status = 'final_accepted' AS final_accepted FROM settled""")
def _(spark, sf):
    return R.result_view(settled_links(spark, sf))


@query("report_accepted_text", f"""WITH {TESTED} SELECT dataset, pos, '[HYPOTHESIS]
Outcome: ' || var1 || '
Predictors:
- ' || var2 || ': positive

Original Claim:
' || claim AS block FROM settled WHERE validation_status = 'final_accepted'""")
def _(spark, sf):
    return R.hypothesis_blocks(settled_links(spark, sf))


@query("report_summary", f"""WITH {TESTED}, r AS (SELECT dataset, validation_status, count(*) AS n FROM settled WHERE validation_status <> 'final_accepted' GROUP BY ALL)
SELECT dataset, '# ' || dataset || ' — Pipeline Summary' || chr(10) || chr(10) || '## Overview' || chr(10) || chr(10) || '- **Total hypotheses tested**: ' || sum(n) || chr(10) || '- **Final accepted**: 0' || chr(10) || '- **Acceptance rate**: 0.0%' || chr(10) || chr(10)
  || '## Result' || chr(10) || chr(10) || 'No hypotheses passed all validation criteria.' || chr(10) || chr(10) || '### Failure reasons:' || chr(10) || chr(10)
  || string_agg('- ' || validation_status || ': ' || n, chr(10) ORDER BY n DESC, validation_status) AS summary FROM r GROUP BY dataset""")
def _(spark, sf):
    """Plain summaries where nothing was accepted: failure counts by status."""
    return R.plain_summary(settled_links(spark, sf).filter(~F.col("final_accepted")))


@query("report_summary_accepted")
def _(spark, sf):
    """Summary of a validated batch with its accepted hypotheses."""
    cfg = ValidationConfig(bootstrap_iterations=20)
    return R.plain_summary(validate(sales(spark, sf), proposed(spark), "sales", cfg, key="o_orderkey").results)


@query("report_stages", f"""WITH {PART_LINKS}, {fdr_sql('part_links')}, d AS (SELECT DISTINCT dataset FROM part_links), s AS (SELECT unnest(['data', 'preprocess', 'associations', 'prompt', 'hypotheses', 'validation', 'summary']) AS stage)
SELECT dataset, stage, stage IN ('data', 'associations') OR (stage = 'validation' AND dataset IN (SELECT dataset FROM adjusted WHERE pair_pos % 7 = 0 AND n > 480)) AS done FROM d, s""")
def _(spark, sf):
    links = part_links(spark, sf)
    return R.stage_completion(links, {
        "data": links, "associations": links, "validation": links.filter((F.col("pair_pos") % 7 == 0) & (F.col("n") > 480)),
    })


@query("discover")
def _(spark, sf):
    """The whole run on two tables at once; hypotheses are supplied for one of them."""
    sources = {
        "sales": Source(sales(spark, sf), "o_orderkey", "o_orderstatus"),
        "customer": Source(table(spark, sf, "customer"), "c_custkey"),
    }
    run = discover(sources, small_frame(spark, [("sales", PROPOSED)], "dataset string, response string"))
    return run["results"].select("dataset", "id", "primary_test", "n", "effect", "p_value", "adjusted_p", "validation_status", "final_accepted")
