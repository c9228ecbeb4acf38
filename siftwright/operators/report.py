"""Report tables over the results of a run. Inputs are small: one row per column, pair or hypothesis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.plans.prompt_text import SUMMARY_HEAD
from siftwright.sources.writers import STAGES

BINS = 50
PREVIEW_ROWS = 50
TOP_MISSING = 20


def accepted(results: DataFrame) -> DataFrame:
    if "final_accepted" not in results.columns:
        raise ValueError("result table lacks the column final_accepted")
    return results.filter(F.coalesce(F.col("final_accepted"), F.lit(False)))


def require_accepted(results: DataFrame) -> DataFrame:
    rows = accepted(results)
    if rows.isEmpty():
        raise ValueError("No accepted hypotheses found")
    return rows


def _joined(df: DataFrame, text: str, order: str, sep: str, name: str) -> DataFrame:
    """Texts of a dataset in order, as one text."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy("dataset").agg(F.array_join(F.transform(items, lambda x: x[text]), sep).alias(name))


def hypothesis_blocks(results: DataFrame) -> DataFrame:
    """Text block per accepted hypothesis (dataset, pos, block); rows without a readable spec are left out."""
    spec = F.from_json(
        "validation_spec", "outcome string, predictors array<string>, expected_signs map<string,string>"
    )
    rows = accepted(results).filter(
        F.coalesce(F.schema_of_variant(F.try_parse_json("validation_spec")).startswith("OBJECT"), F.lit(False))
    ).withColumn("s", spec)
    signs = F.coalesce(F.col("s.expected_signs"), F.create_map().cast("map<string,string>"))
    lines = F.transform(
        F.coalesce(F.col("s.predictors"), F.array().cast("array<string>")),
        lambda p: F.concat(F.lit("- "), p, F.lit(": "), F.coalesce(F.try_element_at(signs, p), F.lit("unknown"))),
    )
    block = F.concat(
        F.lit("[HYPOTHESIS]\nOutcome: "), F.coalesce(F.col("s.outcome"), F.lit("None")), F.lit("\nPredictors:\n"),
        F.array_join(lines, "\n"), F.lit("\n\nOriginal Claim:\n"), F.coalesce("claim", F.lit("")),
    )
    return rows.select("dataset", "pos", F.trim(block).alias("block"))


def summary_prompts(results: DataFrame) -> DataFrame:
    """Summary prompt per dataset with accepted hypotheses."""
    texts = _joined(hypothesis_blocks(results), "block", "pos", "\n\n", "blocks")
    return texts.select("dataset", F.concat(F.lit(SUMMARY_HEAD), F.col("blocks")).alias("prompt"))


def clean_text(c: Column) -> Column:
    """Model text without escape characters and outer space."""
    return F.trim(F.regexp_replace(F.translate(c, "\u001b", ""), r"^\s+|\s+$", ""))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset", "validation_status").agg(F.count(F.lit(1)).alias("n"))


def plain_summary(results: DataFrame) -> DataFrame:
    """Markdown summary per dataset without any model: totals, then accepted hypotheses or failure counts."""
    ok = F.coalesce(F.col("final_accepted"), F.lit(False))
    totals = results.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("k"))
    entry = F.concat(
        F.format_string("### %s\n**Claim**: %s\n\n", F.coalesce("id", F.lit("")), F.coalesce("claim", F.lit("N/A"))),
        F.format_string(
            "- Test: `%s` | Effect: `%.4f` | p-value: `%.4e` | Direction: %s\n",
            F.coalesce("primary_test", F.lit("")), F.col("effect"), F.col("p_value"), F.coalesce("direction_expected", F.lit("")),
        ),
    )
    listed = _joined(accepted(results).withColumn("entry", entry), "entry", "pos", "\n", "entries")
    reasons = _joined(
        status_counts(results).select(
            "dataset", (-F.col("n")).alias("rank"),
            F.struct((-F.col("n")).alias("rank"), "validation_status").alias("place"),
            F.format_string("- %s: %s", "validation_status", F.col("n").cast("string")).alias("line"),
        ), "line", "place", "\n", "reasons",
    )
    head = F.concat(
        F.format_string("# %s — Pipeline Summary\n\n## Overview\n\n", "dataset"),
        F.format_string("- **Total hypotheses tested**: %d\n- **Final accepted**: %d\n", "n", "k"),
        F.format_string("- **Acceptance rate**: %.1f%%\n\n", F.col("k") / F.col("n") * 100),
    )
    body = F.when(F.col("k") > 0, F.concat(F.lit("## Accepted Hypotheses\n\n"), F.col("entries"))).otherwise(
        F.concat(F.lit("## Result\n\nNo hypotheses passed all validation criteria.\n\n### Failure reasons:\n\n"), F.col("reasons"))
    )
    return totals.join(listed, "dataset", "left").join(reasons, "dataset", "left").select(
        "dataset", F.concat(head, body).alias("summary")
    )


def split_metrics(split: DataFrame) -> DataFrame:
    train, test = F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "test")
    return split.agg(train.alias("train_rows"), test.alias("test_rows"), F.count(F.lit(1)).alias("total_rows")).select(
        "*", F.round(F.try_divide(F.col("test_rows") * 100, F.col("total_rows")), 0).alias("test_percent"),
        F.lit(len(split.columns) - 1).alias("columns"),
    )


def preview(df: DataFrame) -> DataFrame:
    return df.limit(PREVIEW_ROWS)


def feature_type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dataset", "feature_type").agg(F.count(F.lit(1)).alias("n"))


def top_missing(profile: DataFrame) -> DataFrame:
    """Columns with missing values, highest rate first, at most 20 of each dataset."""
    order = Window.partitionBy("dataset").orderBy(F.col("missing_rate").desc(), "position")
    ranked = profile.filter(F.col("missing_rate") > 0).withColumn("_nth", F.row_number().over(order))
    return ranked.filter(F.col("_nth") <= TOP_MISSING).select("dataset", "column", "missing_rate")


def profile_view(profile: DataFrame) -> DataFrame:
    return profile.select(
        "dataset", "column", F.col("feature_type").alias("type"),
        F.round(F.col("missing_rate") * 100, 2).alias("missing_percent"), F.col("n_unique").alias("unique"),
        "skewness", F.round(F.coalesce(F.col("outlier_rate"), F.lit(0.0)) * 100, 2).alias("outlier_percent"),
    )


def family_counts(full: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs tested per family and pairs kept, per dataset."""
    count = F.count(F.lit(1)).alias("n")
    return full.groupBy("dataset", "type").agg(count).unionByName(
        kept.groupBy("dataset").agg(count).select("dataset", F.lit("filtered").alias("type"), "n")
    )


def histogram(df: DataFrame, value: str, by: str | None = None, bins: int = BINS) -> DataFrame:
    """Counts in equal bins between the least and the greatest value: (by, bin, low, high, n)."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    a, b = ends["a"], ends["b"]
    keys = [by] if by else []
    if a is None or a == b:
        slot = F.lit(1)
        step = 0.0
    else:
        step = (b - a) / bins
        slot = F.least(F.width_bucket(F.col(value), F.lit(a), F.lit(b), F.lit(bins)), F.lit(bins)).cast("int")
    low = F.lit(float(a or 0.0)) + (F.col("bin") - 1) * F.lit(step)
    return rows.groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "bin", low.alias("low"), (low + F.lit(step)).alias("high"), "n"
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def filtered_view(kept: DataFrame) -> DataFrame:
    return rounded(kept.select("dataset", "var1", "var2", "type", "test", "effect", "effect_name", "adjusted_p", "n"))


def edge_view(records: DataFrame) -> DataFrame:
    return records.select(
        "dataset", F.col("edge_id").alias("edge"), "var1", "var2", "type", F.round("effect", 4).alias("effect"),
        F.col("effect_size").alias("size"), "direction",
    )


def node_view(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "dataset", F.col("column").alias("variable"), "feature_type", "dtype", "missing_rate", "n_unique",
        "skewness", "outlier_rate",
    )


def formula(spec: str = "validation_spec") -> Column:
    """The given model formula, or one put together from outcome, predictors and controls."""
    none = F.array().cast("array<string>")
    right = F.concat(F.coalesce(F.col(f"{spec}.predictors"), none), F.coalesce(F.col(f"{spec}.controls"), none))
    built = F.when(
        (F.coalesce(F.col(f"{spec}.outcome"), F.lit("")) != "") & (F.size(F.coalesce(F.col(f"{spec}.predictors"), none)) > 0),
        F.concat(F.col(f"{spec}.outcome"), F.lit(" ~ "), F.array_join(right, " + ")),
    )
    return F.coalesce(F.nullif(F.col(f"{spec}.model_formula"), F.lit("")), built, F.lit(""))


def hypothesis_view(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.select(
        "dataset", "pos", "id", "relationship_type", "claim", formula().alias("formula"),
        F.col("validation_spec.outcome").alias("target"),
        F.array_join("validation_spec.predictors", ", ").alias("predictors"),
        F.col("test_plan.primary_test").alias("test"), "direction",
        F.array_join("supporting_evidence", ", ").alias("evidence"),
    )


def effect_points(results: DataFrame) -> DataFrame:
    return results.filter(F.col("effect").isNotNull()).select(
        "dataset", "id", "primary_test", "effect", "p_value",
        F.when(F.coalesce(F.col("final_accepted"), F.lit(False)), "Accepted").otherwise("Rejected").alias("result"),
    )


def result_view(results: DataFrame) -> DataFrame:
    return rounded(results.select(
        "dataset", "id", "claim", "primary_test", "effect", "p_value", "validation_status", "final_accepted"
    ))


def stage_completion(datasets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, stage, done): whether a stage has rows for the dataset."""
    wanted = datasets.select("dataset").distinct().select(
        "dataset", F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])).alias("s")
    ).select("dataset", "s.*")
    present = [df.select("dataset").distinct().withColumn("stage", F.lit(s)) for s, df in tables.items()]
    if not present:
        return wanted.withColumn("done", F.lit(False)).drop("stage_no")
    have = reduce(DataFrame.unionByName, present).withColumn("done", F.lit(True))
    return wanted.join(have, ["dataset", "stage"], "left").select(
        "dataset", "stage", F.coalesce("done", F.lit(False)).alias("done")
    )
