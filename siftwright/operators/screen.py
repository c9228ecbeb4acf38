"""Test every pair of columns with the test that fits their types."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright import schemas
from siftwright.functions.tails import chi2_p, correlation_p, mann_whitney_p
from siftwright.operators import frequency as V
from siftwright.operators.fdr import EffectLimits, correct
from siftwright.operators.groups import level_sums, pair_tables
from siftwright.operators.moments import correlations
from siftwright.operators.ranks import pair_rank_correlation, pair_rank_sums, rank_rows
from siftwright.plans.materialize import pin, small_frame, with_row_id
from siftwright.plans.together import together

NUMERIC_TYPES = ("numeric_continuous", "numeric_ordinal")
CATEGORY_TYPES = ("categorical_low_cardinality", "categorical_high_cardinality", "binary")
# Aggregate expressions per pass; more would outgrow generated code.
WIDTH = 40


@dataclass(frozen=True)
class ScreenConfig:
    min_n: int = 30
    max_categories: int = 30
    spearman_if_skew_gt: float = 1.0
    spearman_if_outlier_rate_gt: float = 0.10
    min_expected_count: float = 5.0
    sparse_share: float = 0.20
    limits: EffectLimits = field(default_factory=EffectLimits)


def eligible(df: DataFrame, facts: dict[str, dict]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of `df` in column order; columns without a profile are left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kind = {c: facts.get(c, {}).get("feature_type") for c in df.columns}
    numeric = [c for c in df.columns if kind[c] in NUMERIC_TYPES and V.is_numeric(types[c])]
    return numeric, [c for c in df.columns if kind[c] in CATEGORY_TYPES]


def wants_ranks(a: dict, b: dict, cfg: ScreenConfig) -> bool:
    def far(f: dict) -> bool:
        skew, rate = f.get("skewness"), f.get("outlier_rate")
        return (skew is not None and abs(skew) > cfg.spearman_if_skew_gt) or (
            rate is not None and rate > cfg.spearman_if_outlier_rate_gt
        )

    return far(a) or far(b)


@dataclass
class Plan:
    """Which pair goes to which test; decided from the profile and level counts before any pair job."""

    numeric: list[str]
    cats: list[str]
    facts: dict[str, dict]
    total: int
    nulls: dict[str, int]
    levels: dict[str, int]
    #: Sorted levels of the categories that have no more than the cap.
    lists: dict[str, list[str]] = field(default_factory=dict)

    def clean(self, *cols: str) -> bool:
        return all(self.nulls[c] == 0 for c in cols)


def survey(df: DataFrame, numeric: list[str], cats: list[str], facts: dict) -> Plan:
    """Row count, NULL counts and exact level counts of the columns to be screened."""
    cols = numeric + cats
    sizes = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(V.as_double(c) if c in numeric else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(cols)],
    )
    found = V.text_counts(df, list(enumerate(cats))).groupBy("cid").count() if cats else None
    counted, rows = together(df.sparkSession, [sizes.first, lambda: found.collect() if cats else []])
    nulls = {c: counted["n"] - counted[f"k{i}"] for i, c in enumerate(cols)}
    levels = dict.fromkeys(cats, 0) | {cats[r["cid"]]: r["count"] for r in rows}
    return Plan(numeric, cats, facts, counted["n"], nulls, levels)


def level_lists(df: DataFrame, cats: list[str]) -> dict[str, list[str]]:
    """Sorted levels of categories already known to have few of them."""
    if not cats:
        return {}
    exprs = {i: F.col(f"`{c}`").cast("string") for i, c in enumerate(cats)}
    out: dict[str, list[str]] = {c: [] for c in cats}
    for r in V.melt(df, exprs, "level").groupBy("cid", "level").count().collect():
        out[cats[r["cid"]]].append(r["level"])
    return {c: sorted(v) for c, v in out.items()}


def level_code(column: str, levels: list[str]) -> Column:
    """Position of a row's level in the sorted list, 0-based; NULL stays NULL."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(f"`{column}`").cast("string")) - 1


def _coded(plan: Plan, cats: list[str]) -> tuple[dict[str, int], dict[int, tuple[Column, int]]]:
    """Numbers for categories, and the code column and number of levels of each."""
    ids = {c: i for i, c in enumerate(cats)}
    return ids, {i: (level_code(c, plan.lists[c]), len(plan.lists[c])) for c, i in ids.items()}


def _named(sums: DataFrame, plan: Plan, pairs: list, cat_ids: dict[str, int], num_ids: dict[str, int]) -> DataFrame:
    """Rows of `level_sums` that belong to a pair, with its number and the level as text."""
    spark = sums.sparkSession
    link = small_frame(spark, [(p, cat_ids[b], num_ids[a]) for p, a, b in pairs], "pos int, cat int, num int")
    names = small_frame(spark, [(i, k, v) for c, i in cat_ids.items() for k, v in enumerate(plan.lists[c])], "cat int, code int, level string")
    return sums.join(F.broadcast(link), ["cat", "num"]).join(F.broadcast(names), ["cat", "code"])


def _pairs_frame(spark, rows: list[tuple]) -> DataFrame:
    return F.broadcast(small_frame(spark, rows, "pos int, var1 string, var2 string"))


def _rows_of(pairs: DataFrame, stats: DataFrame, **columns) -> DataFrame:
    out = stats.join(pairs, "pos")
    for name, value in columns.items():
        out = out.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return out.select(
        "pos", "var1", "var2", "type", "relationship", "test",
        F.col("effect").cast("double").alias("effect"), "effect_name",
        F.col("p_value").cast("double").alias("p_value"), F.col("n").cast("bigint").alias("n"), "notes",
    )


def pair_sums(df: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """(pos, level, n_g, s, ss) of centred numeric values per level for (pos, number, category) pairs."""
    parts = []
    by_cat: dict[str, list[tuple[int, str]]] = {}
    for pos, num, cat in pairs:
        by_cat.setdefault(cat, []).append((pos, num))
    numbers = sorted({num for _, num, _ in pairs})
    means = df.agg(*[F.avg(V.as_double(c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
    centred = {c: V.as_double(c) - F.lit(means[i] or 0.0) for i, c in enumerate(numbers)}
    for cat, members in by_cat.items():
        for k in range(0, len(members), WIDTH):
            chunk = members[k : k + WIDTH]
            wide = (
                df.filter(F.col(f"`{cat}`").isNotNull())
                .groupBy(F.col(f"`{cat}`").cast("string").alias("level"))
                .agg(
                    *[F.count(centred[c]).alias(f"n{p}") for p, c in chunk],
                    *[F.sum(centred[c]).alias(f"s{p}") for p, c in chunk],
                    *[F.sum(centred[c] * centred[c]).alias(f"q{p}") for p, c in chunk],
                )
            )
            structs = [
                F.struct(F.lit(p).alias("pos"), "level", F.col(f"n{p}").alias("n_g"),
                         F.col(f"s{p}").alias("s"), F.col(f"q{p}").alias("ss"))
                for p, _ in chunk
            ]
            parts.append(wide.select(F.inline(F.array(*structs))).filter(F.col("n_g") > 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def two_group_effect(groups: DataFrame, ties: DataFrame) -> DataFrame:
    """Rank-biserial correlation and U from rank sums of two levels; the first level in string order is group 1."""
    g = groups.groupBy("pos").agg(
        F.min(F.struct("level", "n_g", "rank_sum")).alias("a"),
        F.max(F.struct("level", "n_g", "rank_sum")).alias("b"),
        F.sum("n_g").alias("n"), F.min("n_g").alias("smallest"), F.count(F.lit(1)).alias("k"),
    ).join(ties, "pos")
    n1, n2 = F.col("a.n_g").cast("double"), F.col("b.n_g").cast("double")
    u1 = F.col("a.rank_sum") - n1 * (n1 + 1) / 2
    return g.select(
        "pos", "n", "smallest", "k", "ties", n1.alias("n1"), n2.alias("n2"), u1.alias("u1"),
        (1 - 2 * u1 / (n1 * n2)).alias("effect"),
    )


def rank_anova(groups: DataFrame, ties: DataFrame) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H and degrees of freedom from rank sums."""
    ng = F.col("n_g").cast("double")
    g = groups.groupBy("pos").agg(
        F.sum("n_g").alias("n"), F.min("n_g").alias("smallest"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / ng).alias("rss"),
    ).join(ties, "pos")
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("rss") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    return g.select("pos", "n", "smallest", "k", "ties", F.when(fix > 0, h / fix).alias("h"), (F.col("k") - 1).alias("df"))


def variance_share(sums: DataFrame) -> DataFrame:
    """Eta squared per pair from centred sums per level: (pos, eta2, ss_total)."""
    ng = F.col("n_g").cast("double")
    g = sums.groupBy("pos").agg(
        F.sum(F.col("s") * F.col("s") / ng).alias("within_mean"), F.sum("s").alias("s"),
        F.sum("ss").alias("ss"), F.sum("n_g").cast("double").alias("n"),
    )
    shift = F.col("s") * F.col("s") / F.col("n")
    total = F.col("ss") - shift
    return g.select(
        "pos", total.alias("ss_total"),
        F.when(total > 0, (F.col("within_mean") - shift) / total).otherwise(0.0).alias("eta2"),
    )


def contingency(cells: DataFrame, cfg: ScreenConfig | None = None) -> DataFrame:
    """Chi-square, Cramer's V and sparse note per pair from non-empty cells (pos, a, b, o)."""
    cfg = cfg or ScreenConfig()
    rows = cells.groupBy("pos", "a").agg(F.sum("o").cast("double").alias("ra"))
    cols = cells.groupBy("pos", "b").agg(F.sum("o").cast("double").alias("cb"))
    size = rows.groupBy("pos").agg(F.sum("ra").alias("n"), F.count(F.lit(1)).alias("r"))
    width = cols.groupBy("pos").agg(F.count(F.lit(1)).alias("c"))
    e = F.col("ra") * F.col("cb") / F.col("n")
    o = F.col("o").cast("double")
    # Empty cells add their expected count, which is n minus the expected counts of the others.
    stat = (
        cells.join(rows, ["pos", "a"]).join(cols, ["pos", "b"]).join(size.select("pos", "n"), "pos")
        .groupBy("pos")
        .agg(F.sum((o - e) * (o - e) / e).alias("part"), F.sum(e).alias("seen"))
    )
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    chi2 = F.col("part") + F.greatest(F.col("n") - F.col("seen"), F.lit(0.0))
    denom = F.col("n") * F.least(F.col("r") - 1, F.col("c") - 1)
    return stat.join(size, "pos").join(width, "pos").select(
        "pos", F.col("n").cast("bigint").alias("n"), "r", "c", dof.alias("df"), chi2.alias("chi2"),
        F.when(denom > 0, F.sqrt(chi2 / denom)).otherwise(0.0).alias("v"),
    )


def low_expected_share(cells: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Share of cells, empty ones included, with an expected count below the limit (pos, low).

    Only for tables within the category cap: the margins of one side travel as a short array.
    """
    rows = cells.groupBy("pos", "a").agg(F.sum("o").cast("double").alias("ra"))
    cols = cells.groupBy("pos", "b").agg(F.sum("o").cast("double").alias("cb"))
    side = cols.groupBy("pos").agg(F.collect_list("cb").alias("cs"), F.sum("cb").alias("n"))
    few = F.size(F.filter("cs", lambda x: x * F.col("ra") / F.col("n") < cfg.min_expected_count))
    return rows.join(side, "pos").groupBy("pos").agg((F.sum(few) / F.sum(F.size("cs"))).alias("low"))


def cell_counts(df: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """Non-empty cells (pos, a, b, o) of every listed category pair; levels as text."""
    structs = [
        F.struct(F.lit(p).alias("pos"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b"))
        for p, a, b in pairs
    ]
    return (
        df.select(F.inline(F.array(*structs)))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pos", "a", "b")
        .agg(F.count(F.lit(1)).alias("o"))
    )


def complete_levels(df: DataFrame, pairs: list[tuple[int, str, str]], sides: tuple[str, ...]) -> dict:
    """Exact level counts inside each pair's complete cases: {(pos, side): k} and {(pos, 'n'): n}."""
    structs = [
        F.struct(F.lit(p).alias("pos"), V.text_token(F.col(f"`{a}`").cast("string")).alias("a"),
                 V.text_token(F.col(f"`{b}`").cast("string")).alias("b"))
        for p, a, b in pairs
    ]
    rows = df.select(F.inline(F.array(*structs))).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    out: dict = {}
    for side in sides:
        got = rows.groupBy("pos", side).agg(F.count(F.lit(1)).alias("m")).groupBy("pos").agg(
            F.count(F.lit(1)).alias("k"), F.sum("m").alias("n")
        )
        for r in got.collect():
            out[r["pos"], side], out[r["pos"], "n"] = r["k"], r["n"]
    return out


def _skipped(spark, rows: list[tuple]) -> DataFrame:
    return small_frame(spark, rows, "pos int, var1 string, var2 string, type string, relationship string, test string, "
        "effect double, effect_name string, p_value double, n bigint, notes string",
    )


def screen(
    df: DataFrame,
    profile: DataFrame,
    dataset: str = "dataset",
    config: ScreenConfig | None = None,
    key: str | None = None,
    families: tuple[str, ...] = ("num_num", "num_cat", "cat_cat"),
) -> DataFrame:
    """Association rows for every eligible column pair of a cleaned table.

    `key` names a unique column; without one, the needed columns are written once with a row id.
    The result is small (one row per pair) and pinned; `pair_pos` keeps the pair order.
    """
    cfg = config or ScreenConfig()
    facts = {r["column"]: r.asDict() for r in profile.collect()}
    numeric, cats = eligible(df, facts)
    spark = df.sparkSession
    if not numeric and not cats:
        return small_frame(spark, [], schemas.ASSOCIATIONS + ", pair_pos int")
    keep = [F.col(f"`{key}`")] if key and key not in numeric + cats else []
    slim = df.select(*keep, *[V.as_double(c).alias(c) for c in numeric], *[F.col(f"`{c}`").cast("string").alias(c) for c in cats])
    slim = with_row_id(slim, key)
    plan = survey(slim, numeric, cats, facts)
    plan.lists = level_lists(slim, [c for c in cats if plan.levels[c] <= cfg.max_categories])

    pos, num_num, num_cat, cat_cat = 0, [], [], []
    for a, b in combinations(numeric, 2):
        num_num.append((pos, a, b)); pos += 1
    for a, b in product(numeric, cats):
        num_cat.append((pos, a, b)); pos += 1
    for a, b in combinations(cats, 2):
        cat_cat.append((pos, a, b)); pos += 1

    nn = num_num if "num_num" in families else []
    nc = num_cat if "num_cat" in families else []
    cc = cat_cat if "cat_cat" in families else []
    out = sum(together(spark, [
        lambda: _linear_pairs(slim, plan, cfg, nn),
        lambda: _ranked_pairs(slim, plan, cfg, nn, nc),
        lambda: _category_family(slim, plan, cfg, cc),
    ]), [])
    if not out:
        return small_frame(spark, [], schemas.ASSOCIATIONS + ", pair_pos int")
    rows = _union(out)
    return pin(rows.select(F.lit(dataset).alias("dataset"), *schemas.ASSOCIATION_COLUMNS, F.col("pos").alias("pair_pos")))


def _capped(slim: DataFrame, plan: Plan, cfg: ScreenConfig, pairs: list, sides: tuple[str, ...]):
    """Split pairs into (testable, skipped rows) by the category cap inside complete cases."""
    cap = cfg.max_categories
    in_doubt = [
        p for p in pairs
        if not plan.clean(p[1], p[2]) and any(plan.levels.get(c, 0) > cap for c in p[1:])
    ]
    exact = complete_levels(slim, in_doubt, sides) if in_doubt else {}
    doubt = {p[0] for p in in_doubt}
    keep, skip = [], []
    for pos, a, b in pairs:
        if pos in doubt:
            n, ka, kb = exact.get((pos, "n"), 0), exact.get((pos, "a"), 0), exact.get((pos, "b"), 0)
        else:
            n, ka, kb = plan.total, plan.levels.get(a, 0), plan.levels[b]
        if max(ka, kb) <= cap:
            keep.append((pos, a, b))
        elif n >= cfg.min_n:
            skip.append((pos, a, b, n, ka, kb))
    return keep, skip


def _varying(slim: DataFrame, skipped: list, width: int = 200) -> list:
    """The skipped pairs whose number takes at least two values inside its complete cases; others are no pair at all."""
    out = []
    for s in range(0, len(skipped), width):
        part = skipped[s:s + width]
        values = [F.when(F.col(f"`{p[2]}`").isNotNull(), V.as_double(p[1])) for p in part]
        row = slim.agg(*[(F.min(v) < F.max(v)).alias(f"v{i}") for i, v in enumerate(values)]).first()
        out += [p for i, p in enumerate(part) if row[f"v{i}"]]
    return out


def _linear_pairs(slim: DataFrame, plan: Plan, cfg: ScreenConfig, num_num: list) -> list[DataFrame]:
    """Pearson rows."""
    linear = [p for p in num_num if not wants_ranks(plan.facts[p[1]], plan.facts[p[2]], cfg)]
    if not linear:
        return []
    stats = correlations(slim, linear).filter((F.col("n") >= cfg.min_n) & F.col("r").isNotNull())
    return [_rows_of(
        _pairs_frame(slim.sparkSession, linear), stats, type="num_num", relationship="linear", test="pearsonr",
        effect=F.col("r"), effect_name="r", p_value=correlation_p("r", F.col("n").cast("double")), notes="",
    )]


def _ranked_pairs(slim: DataFrame, plan: Plan, cfg: ScreenConfig, num_num: list, num_cat: list) -> list[DataFrame]:
    """Spearman rows and all number-by-category rows; both need ranks."""
    spark = slim.sparkSession
    parts: list[DataFrame] = []
    ranked = [p for p in num_num if wants_ranks(plan.facts[p[1]], plan.facts[p[2]], cfg)]
    grouped, skipped = _capped(slim, plan, cfg, num_cat, ("b",)) if num_cat else ([], [])
    skipped = _varying(slim, skipped)
    if skipped:
        parts.append(_skipped(spark, [
            (p, a, b, "num_cat", "group_difference", "skipped", None, "eta2", None, n, f"too_many_categories_{k}")
            for p, a, b, n, _, k in skipped
        ]))

    # Columns without NULLs share one rank table; pairs with NULLs rank inside their own cases.
    fast_nn = [p for p in ranked if plan.clean(p[1], p[2])]
    slow_nn = [p for p in ranked if not plan.clean(p[1], p[2])]
    fast_nc = [p for p in grouped if plan.clean(p[1], p[2])]
    slow_nc = [p for p in grouped if not plan.clean(p[1], p[2])]
    rhos: list[DataFrame] = []
    sums: list[DataFrame] = []
    ties: list[DataFrame] = []
    if fast_nn or fast_nc:
        used = [c for c in plan.numeric if any(c in p[1:] for p in fast_nn + fast_nc)]
        cats = [c for c in plan.cats if any(c == p[2] for p in fast_nc)]
        ids = {c: i for i, c in enumerate(used)}
        cat_ids, codes = _coded(plan, cats)
        table, tie_sums = rank_rows(slim, {i: c for c, i in ids.items()}, {k: code for k, (code, _) in codes.items()})
        if fast_nn:
            rhos.append(correlations(table, [(p, f"r{ids[a]}", f"r{ids[b]}") for p, a, b in fast_nn]))
        if fast_nc:
            got = level_sums(table, {k: (F.col(f"g{k}"), size) for k, (_, size) in codes.items()}, {ids[a]: F.col(f"r{ids[a]}") for _, a, _ in fast_nc})
            sums.append(_named(got, plan, fast_nc, cat_ids, ids).select("pos", "level", "n_g", F.col("s").alias("rank_sum")))
            link = small_frame(spark, [(p, ids[a]) for p, a, _ in fast_nc], "pos int, cid int")
            ties.append(tie_sums.join(F.broadcast(link), "cid").select("pos", "ties"))
    if slow_nn:
        structs = [F.struct(F.lit(p).alias("pos"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for p, a, b in slow_nn]
        rows = slim.select(F.inline(F.array(*structs))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        rhos.append(pair_rank_correlation(rows))
    if slow_nc:
        structs = [F.struct(F.lit(p).alias("pos"), F.col(f"`{a}`").alias("y"), F.col(f"`{b}`").alias("level")) for p, a, b in slow_nc]
        rows = slim.select(F.inline(F.array(*structs))).filter(F.col("y").isNotNull() & F.col("level").isNotNull())
        got, tied = pair_rank_sums(rows)
        sums.append(got)
        ties.append(tied)

    if rhos:
        stats = _union(rhos).filter((F.col("n") >= cfg.min_n) & F.col("r").isNotNull())
        parts.append(_rows_of(
            _pairs_frame(spark, ranked), stats, type="num_num", relationship="monotonic", test="spearmanr",
            effect=F.col("r"), effect_name="rho", p_value=correlation_p("r", F.col("n").cast("double")), notes="",
        ))
    if sums:
        groups, tied = pin(_union(sums)), _union(ties)
        n = F.col("n").cast("double")
        testable = (F.col("n") >= cfg.min_n) & (F.col("smallest") >= 2) & (F.col("ties") < n * n * n - n)
        names = _pairs_frame(spark, grouped)
        two = two_group_effect(groups, tied).filter(testable & (F.col("k") == 2))
        parts.append(_rows_of(
            names, two, type="num_cat", relationship="group_difference", test="mannwhitneyu",
            effect_name="rank_biserial", p_value=mann_whitney_p("u1", "n1", "n2", "ties"), notes="nonparametric_preferred",
        ))
        many = rank_anova(groups, tied).filter(testable & (F.col("k") > 2))
        wide = [p for p in grouped if plan.levels[p[2]] > 2]
        if wide:
            many = many.join(variance_share(_value_sums(slim, plan, wide)), "pos")
            parts.append(_rows_of(
                names, many, type="num_cat", relationship="group_difference", test="kruskal",
                effect=F.col("eta2"), effect_name="eta2_approx",
                p_value=chi2_p("h", F.col("df").cast("double")), notes="nonparametric_preferred",
            ))
    return parts


def _value_sums(slim: DataFrame, plan: Plan, pairs: list) -> DataFrame:
    """(pos, level, n_g, s, ss) of centred values: one scan for all categories within the cap, NULLs or not."""
    listed = [p for p in pairs if p[2] in plan.lists]
    rest = [p for p in pairs if p[2] not in plan.lists]  # over the cap, but not inside their complete cases
    parts = [pair_sums(slim, rest)] if rest else []
    if listed:
        cat_ids, codes = _coded(plan, sorted({c for _, _, c in listed}))
        num_ids = {c: i for i, c in enumerate(sorted({c for _, c, _ in listed}))}
        means = slim.agg(*[F.avg(V.as_double(c)).alias(f"m{i}") for c, i in num_ids.items()]).first()
        got = level_sums(slim, codes, {i: V.as_double(c) - F.lit(means[f"m{i}"] or 0.0) for c, i in num_ids.items()})
        parts.append(_named(got, plan, listed, cat_ids, num_ids).select("pos", "level", "n_g", "s", "ss"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _category_family(slim: DataFrame, plan: Plan, cfg: ScreenConfig, pairs: list) -> list[DataFrame]:
    spark = slim.sparkSession
    if not pairs:
        return []
    keep, skipped = _capped(slim, plan, cfg, pairs, ("a", "b"))
    parts = []
    if skipped:
        parts.append(_skipped(spark, [
            (p, a, b, "cat_cat", "association", "skipped", None, "cramers_v", None, n, f"too_many_categories_{ka}x{kb}")
            for p, a, b, n, ka, kb in skipped
        ]))
    if keep:
        listed = [p for p in keep if p[1] in plan.lists and p[2] in plan.lists]
        rest = [p for p in keep if not (p[1] in plan.lists and p[2] in plan.lists)]  # over the cap, but not inside their complete cases
        found = [cell_counts(slim, rest)] if rest else []
        if listed:
            ids, codes = _coded(plan, sorted({c for p in listed for c in p[1:]}))
            found.append(pair_tables(slim, codes, [(p, ids[a], ids[b]) for p, a, b in listed]).select("pos", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "o"))
        cells = pin(_union(found))
        stats = contingency(cells, cfg).join(low_expected_share(cells, cfg), "pos").filter(
            (F.col("n") >= cfg.min_n) & (F.col("r") >= 2) & (F.col("c") >= 2)
        )
        parts.append(_rows_of(
            _pairs_frame(spark, keep), stats, type="cat_cat", relationship="association", test="chi2",
            effect=F.col("v"), effect_name="cramers_v",
            p_value=chi2_p("chi2", F.col("df").cast("double")),
            notes=F.when(F.col("low") > cfg.sparse_share, "sparse_table_expected_counts_low").otherwise(""),
        ))
    return parts


def screen_and_correct(
    df: DataFrame, profile: DataFrame, dataset: str = "dataset", config: ScreenConfig | None = None, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """All pairs with q-values, and those worth keeping."""
    cfg = config or ScreenConfig()
    return correct(screen(df, profile, dataset, cfg, key), cfg.limits)
