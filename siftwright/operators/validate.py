"""Re-test proposed hypotheses on held-out rows, one batched job per kind of test."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright import schemas
from siftwright.functions.numbers import tolerant
from siftwright.functions.tails import chi2_p, correlation_p, mann_whitney_p
from siftwright.functions.weights import Weights
from siftwright.operators import bootstrap as B
from siftwright.operators import frequency as V
from siftwright.operators.fdr import EffectLimits, adjust, adjust_large
from siftwright.operators.intake import _listed
from siftwright.operators.moments import correlations
from siftwright.operators.ranks import pair_rank_correlation, pair_rank_sums
from siftwright.operators.regression import CODED, Design, Term, least_squares, logistic
from siftwright.operators.screen import (
    cell_counts, contingency, level_code, pair_sums, rank_anova, two_group_effect, variance_share,
)
from siftwright.plans.lookup import attach
from siftwright.plans.materialize import pin, small_frame, with_row_id
from siftwright.plans.together import together

PAIRWISE = ["pearsonr", "spearmanr", "mannwhitneyu", "kruskal", "chi2"]
REGRESSIONS = ["linear_regression", "logistic_regression"]
#: Levels of a regression's column that are coded by a join; fewer by an expression.
JOINED_LEVELS = 1_000
RESULT = (
    "pos int, testable boolean, n bigint, observed_test string, effect double, effect_name string, "
    "p_value double, main_predictor_column string, notes string"
)


@dataclass(frozen=True)
class ValidationConfig:
    limits: EffectLimits = field(default_factory=EffectLimits)
    bootstrap_iterations: int = 200
    bootstrap_seed: int = 42
    sign_consistency_min: float = 0.80
    effect_pass_rate_min: float = 0.70
    weights: str = "poisson"
    strict_parity: bool = False


# ---- pre-filter ---------------------------------------------------------------------------------


def two_valued(df: DataFrame, columns: list[str]) -> list[str]:
    """Which columns hold exactly two values; NULL counts as a value of its own in text columns.

    Two scans without a shuffle: extremes first, then whether anything lies between them.
    """
    if not columns:
        return []
    aggs = []
    for i, c in enumerate(columns):
        q = F.col(f"`{c}`")
        aggs += [F.min(q).alias(f"a{i}"), F.max(q).alias(f"b{i}"), F.max(q.isNull()).alias(f"z{i}")]
    ends = df.agg(*aggs).first()
    between = df.agg(*[
        F.max((F.col(f"`{c}`") != F.lit(ends[f"a{i}"])) & (F.col(f"`{c}`") != F.lit(ends[f"b{i}"]))).alias(f"m{i}")
        if ends[f"a{i}"] is not None else F.lit(True).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]).first()
    numeric = {f.name for f in df.schema.fields if V.is_numeric(f.dataType)}
    out = []
    for i, c in enumerate(columns):
        kinds = 0 if ends[f"a{i}"] is None else (1 if ends[f"a{i}"] == ends[f"b{i}"] else 2)
        kinds += 1 if between[f"m{i}"] and kinds == 2 else 0
        kinds += 1 if ends[f"z{i}"] and c not in numeric else 0
        if kinds == 2:
            out.append(c)
    return out


def prefilter(hypotheses: DataFrame, df: DataFrame) -> DataFrame:
    """Add `reason`: why a hypothesis cannot be tested on `df`, NULL if it can; first fault wins."""
    numeric = [f.name for f in df.schema.fields if V.is_numeric(f.dataType)]
    test = F.coalesce(F.col("test_plan.primary_test"), F.lit(""))
    outcome = F.col("validation_spec.outcome")
    asked = [
        r[0] for r in hypotheses.filter(test == "logistic_regression").select(outcome).distinct().collect()
    ]
    binary = two_valued(df, [c for c in asked if c in df.columns])
    predictors = F.coalesce(F.col("validation_spec.predictors"), F.array().cast("array<string>"))
    controls = F.coalesce(F.col("validation_spec.controls"), F.array().cast("array<string>"))

    def among(c: Column, names: list[str]) -> Column:
        return c.isin(names) if names else F.lit(False)

    named = F.array_distinct(F.concat(F.array(outcome), predictors, controls))
    absent = F.array_sort(F.array_except(named, F.array(*[F.lit(c) for c in df.columns])))
    reason = F.coalesce(
        F.when(F.coalesce(F.size("variables"), F.lit(0)) < 2, "invalid_or_too_short_variables"),
        F.when(~test.isin(PAIRWISE + REGRESSIONS), F.concat(F.lit("unsupported_primary_test:"), test)),
        F.when(~F.coalesce(F.col("has_spec"), F.lit(False)), "missing_validation_spec"),
        F.when(F.coalesce(outcome, F.lit("")) == "", "validation_spec_missing_outcome"),
        F.when(~F.col("predictors_listed") | (F.size(predictors) == 0), "validation_spec_missing_predictors"),
        F.when(~F.col("controls_listed"), "validation_spec_controls_not_list"),
        F.when(
            F.size(absent) > 0,
            F.concat(F.lit("validation_spec_variables_missing_in_test_data:"), _listed(absent)),
        ),
        F.when(test.isin(PAIRWISE) & (F.size(predictors) != 1), "pairwise_test_requires_exactly_one_predictor"),
        F.when((test == "logistic_regression") & ~among(outcome, binary), "logistic_regression_outcome_not_binary"),
        F.when((test == "linear_regression") & ~among(outcome, numeric), "linear_regression_outcome_not_numeric"),
    )
    return hypotheses.withColumn("reason", reason)


def rejections(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).select(
        "dataset", "pos", "id", F.coalesce("test_plan.primary_test", F.lit("")).alias("primary_test"), "reason"
    )


# ---- the tests ----------------------------------------------------------------------------------


def level_codes(levels: DataFrame) -> DataFrame:
    """(cid, level, n, code): levels of each column numbered from 0 in their order, without bringing them to one place.

    They are sorted by ranges and written with running ids; the driver sees where the ids of each range begin.
    """
    at = "at"
    placed = pin(levels.repartitionByRange("cid", "level").sortWithinPartitions("cid", "level").withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    ranges = placed.groupBy("cid", part.alias("part")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("cid", "part").collect()
    shifts, before = [], {}
    for r in ranges:
        shifts.append((r["cid"], r["part"], before.get(r["cid"], 0) - r["first"]))
        before[r["cid"]] = before.get(r["cid"], 0) + r["n"]
    shift = small_frame(levels.sparkSession, shifts, "cid int, part bigint, shift bigint")
    joined = placed.withColumn("part", part).join(F.broadcast(shift), ["cid", "part"])
    return pin(joined.select("cid", "level", "n", (F.col(at) + F.col("shift")).alias("code")))


@dataclass(frozen=True)
class Spec:
    pos: int
    test: str
    outcome: str
    predictors: tuple[str, ...]
    controls: tuple[str, ...]


class Bench:
    """Held-out rows narrowed to the columns that the hypotheses use.

    `n<i>` is column i read as a number, `s<i>` as text; `h` is what resampling weights hang on.
    """

    def __init__(self, df: DataFrame, specs: list[Spec], key: str | None, cfg: ValidationConfig):
        self.cfg = cfg
        self.specs = specs
        self.columns = sorted({c for s in specs for c in (s.outcome, *s.predictors, *s.controls)})
        self.at = {c: i for i, c in enumerate(self.columns)}
        types = {f.name: f.dataType for f in df.schema.fields}
        self.numeric = {c for c in self.columns if V.is_numeric(types[c])}
        picked = df.select(*dict.fromkeys([*self.columns, *([key] if key else [])]))
        picked = with_row_id(picked, key)
        exprs: list[Column] = []
        for c, i in self.at.items():
            exprs.append(tolerant(picked, c).alias(f"n{i}"))
            exprs.append(F.col(f"`{c}`").cast("string").alias(f"s{i}"))
        self.frame = picked.select("rid", *exprs)

    def of(self, *tests: str) -> list[Spec]:
        return [s for s in self.specs if s.test in tests]

    def num(self, c: str) -> str:
        return f"n{self.at[c]}"

    def txt(self, c: str) -> str:
        return f"s{self.at[c]}"

    def complete(self) -> dict[int, int]:
        """Complete cases of each pairwise hypothesis, before any reading as numbers."""
        specs = self.of(*PAIRWISE)
        if not specs:
            return {}
        row = self.frame.agg(*[
            F.count_if(F.col(self.txt(s.outcome)).isNotNull() & F.col(self.txt(s.predictors[0])).isNotNull()).alias(f"c{s.pos}")
            for s in specs
        ]).first()
        return {s.pos: row[f"c{s.pos}"] for s in specs}

    def melt(self, specs: list[Spec], left: str, right: str, text_right: bool) -> DataFrame:
        """(pos, left, right) rows: outcome as number, predictor as number or text."""
        structs = [
            F.struct(
                F.lit(s.pos).alias("pos"), F.col(self.num(s.outcome)).alias(left),
                F.col(self.txt(s.predictors[0]) if text_right else self.num(s.predictors[0])).alias(right),
            )
            for s in specs
        ]
        return self.frame.select(F.inline(F.array(*structs))).filter(
            F.col(left).isNotNull() & F.col(right).isNotNull()
        )

    # -- plain sample

    def results(self) -> DataFrame:
        """One row per hypothesis in the layout RESULT."""
        spark = self.frame.sparkSession
        cases = self.complete()
        parts: list[DataFrame] = []
        done = [s.pos for s in self.specs if cases.get(s.pos) == 0]
        parts.append(small_frame(spark, [(p, False, None, "", None, "", None, "", "no_complete_cases") for p in done], RESULT
        ))
        live = {t: [s for s in self.of(t) if s.pos not in done] for t in PAIRWISE}
        families = [
            lambda: self._linear(live["pearsonr"]), lambda: self._monotonic(live["spearmanr"]),
            lambda: self._ranked(live["mannwhitneyu"], live["kruskal"]), lambda: self._tables(live["chi2"]), self._fitted,
        ]
        for got in together(spark, families):
            parts += got
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _linear(self, specs: list[Spec]) -> list[DataFrame]:
        if not specs:
            return []
        stats = correlations(self.frame, [(s.pos, self.num(s.outcome), self.num(s.predictors[0])) for s in specs])
        return [self._row(specs, stats.filter(F.col("r").isNotNull()), "r", F.col("r"),
                          correlation_p("r", F.col("n").cast("double")), F.lit("insufficient_variation_for_pearson"))]

    def _monotonic(self, specs: list[Spec]) -> list[DataFrame]:
        if not specs:
            return []
        stats = pair_rank_correlation(self.melt(specs, "x", "y", False))
        return [self._row(specs, stats.filter(F.col("r").isNotNull()), "rho", F.col("r"),
                          correlation_p("r", F.col("n").cast("double")), F.lit("insufficient_variation_for_spearman"))]

    def _ranked(self, two: list[Spec], many: list[Spec]) -> list[DataFrame]:
        if not two + many:
            return []
        groups, ties = pair_rank_sums(self.melt(two + many, "y", "level", True))
        groups = pin(groups)
        parts = [self._two_groups(two, groups, ties)] if two else []
        return parts + ([self._many_groups(many, groups, ties)] if many else [])

    def _tables(self, specs: list[Spec]) -> list[DataFrame]:
        if not specs:
            return []
        cells = cell_counts(self.frame, [(s.pos, self.txt(s.outcome), self.txt(s.predictors[0])) for s in specs])
        stats = contingency(pin(cells)).filter((F.col("r") >= 2) & (F.col("c") >= 2))
        return [self._row(specs, stats, "cramers_v", F.col("v"), chi2_p("chi2", F.col("df").cast("double")),
                          F.lit("chi2_requires_at_least_2x2_table"))]

    def _fitted(self) -> list[DataFrame]:
        fitted = self.regressions(Weights("ones"))
        if fitted is None:
            return []
        tests = F.create_map(*[x for s in self.of(*REGRESSIONS) for x in (F.lit(s.pos), F.lit(s.test))])
        ok = F.col("note") == ""
        return [fitted.select(
            "pos", ok.alias("testable"), F.when(ok, F.col("n").cast("bigint")).alias("n"),
            F.when(ok, tests[F.col("pos")]).otherwise("").alias("observed_test"),
            F.when(ok, F.col("effect")).alias("effect"), F.when(ok, "coef").otherwise("").alias("effect_name"),
            F.when(ok, F.col("p_value")).alias("p_value"),
            F.coalesce(F.when(ok, F.col("main_column")), F.lit("")).alias("main_predictor_column"),
            F.col("note").alias("notes"),
        )]

    def _row(self, specs: list[Spec], stats: DataFrame, name: str, effect: Column, p: Column, fail: Column) -> DataFrame:
        """Result rows; a hypothesis without a row in `stats` was not testable."""
        spark = self.frame.sparkSession
        base = small_frame(spark, [(s.pos, s.test) for s in specs], "pos int, test string")
        got = stats.select("pos", F.col("n").cast("bigint").alias("n"), effect.alias("effect"), p.alias("p_value"))
        ok = F.col("effect").isNotNull()
        return F.broadcast(base).join(got, "pos", "left").select(
            "pos", ok.alias("testable"), "n", F.when(ok, F.col("test")).otherwise("").alias("observed_test"),
            "effect", F.when(ok, name).otherwise("").alias("effect_name"), "p_value",
            F.lit("").alias("main_predictor_column"), F.when(ok, "").otherwise(fail).alias("notes"),
        )

    def _two_groups(self, specs: list[Spec], groups: DataFrame, ties: DataFrame) -> DataFrame:
        stats = two_group_effect(groups, ties)
        two, big = F.col("k") == 2, F.col("smallest") >= 2
        faults = stats.select("pos", F.when(~two, "mannwhitneyu_requires_exactly_2_groups").when(~big, "mannwhitneyu_groups_too_small").alias("fault"))
        rows = self._row(specs, stats.filter(two & big), "rank_biserial", F.col("effect"),
                         mann_whitney_p("u1", "n1", "n2", "ties"), F.lit(None).cast("string"))
        return self._explain(rows, faults, "mannwhitneyu_requires_exactly_2_groups")

    def _many_groups(self, specs: list[Spec], groups: DataFrame, ties: DataFrame) -> DataFrame:
        n = F.col("n").cast("double")
        anova = rank_anova(groups, ties)
        many, big = F.col("k") >= 2, F.col("smallest") >= 2
        varies = F.col("ties") < n * n * n - n
        faults = anova.select("pos", F.when(~many, "kruskal_requires_2_or_more_groups").when(~big, "kruskal_groups_too_small").when(~varies, "kruskal_outcome_constant").alias("fault"))
        sums = pair_sums(self.frame, [(s.pos, self.num(s.outcome), self.txt(s.predictors[0])) for s in specs])
        stats = anova.filter(many & big & varies).join(variance_share(sums), "pos")
        rows = self._row(specs, stats, "eta2_approx", F.col("eta2"), chi2_p("h", F.col("df").cast("double")), F.lit(None).cast("string"))
        return self._explain(rows, faults, "kruskal_requires_2_or_more_groups")

    @staticmethod
    def _explain(rows: DataFrame, faults: DataFrame, default: str) -> DataFrame:
        return rows.join(faults, "pos", "left").withColumn(
            "notes", F.coalesce("notes", "fault", F.lit(default))
        ).drop("fault")

    # -- regressions

    def designs(self) -> tuple[list[Design], list[Design], DataFrame, list[tuple[int, str]]]:
        """(linear, logistic, coded frame, faults) for the regression hypotheses."""
        specs = self.of(*REGRESSIONS)
        text = sorted({c for s in specs for c in (s.outcome, *s.predictors, *s.controls) if c not in self.numeric})
        numbers = sorted({c for s in specs for c in (s.outcome, *s.predictors, *s.controls) if c in self.numeric})
        coded = self.frame
        for c in text:
            coded = coded.withColumn(self.txt(c), F.coalesce(F.col(self.txt(c)), F.lit("nan")))
        levels: dict[str, tuple[str, ...]] = {}
        sizes: dict[str, int] = {}
        self.coded: dict[str, DataFrame] = {}
        if text:
            found = pin(V.melt(coded, {i: F.col(self.txt(c)) for i, c in enumerate(text)}, "level").groupBy("cid", "level").agg(F.count(F.lit(1)).alias("n")))
            count = {r["cid"]: r["n"] for r in found.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect()}
            sizes = {c: count.get(i, 0) for i, c in enumerate(text)}
            named: dict[int, list[str]] = {}
            few = [i for i, c in enumerate(text) if sizes[c] <= JOINED_LEVELS]
            for r in found.filter(F.col("cid").isin(few)).collect():
                named.setdefault(r["cid"], []).append(r["level"])
            levels = {text[i]: tuple(sorted(named.get(i, []))) for i in few}
            if len(few) < len(text):
                codes = level_codes(found.filter(~F.col("cid").isin(few)))
                self.coded = {c: codes.filter(F.col("cid") == i).drop("cid") for i, c in enumerate(text) if c not in levels}
        moments = {}
        if numbers:
            row = self.frame.agg(*[f(F.col(self.num(c))).alias(f"{tag}_{self.num(c)}") for c in numbers for tag, f in (("m", F.avg), ("d", F.stddev_pop), ("a", F.min), ("b", F.max))]).first()
            moments = {c: tuple(row[f"{t}_{self.num(c)}"] for t in "mdab") for c in numbers}
        linear, logit, faults = [], [], []
        for s in specs:
            terms = []
            for c in (*s.predictors, *s.controls):
                if c in self.numeric:
                    m, d, *_ = moments[c]
                    terms.append(Term(self.num(c), c, (), m or 0.0, d if d else 1.0))
                elif sizes[c] > 1:
                    terms.append(Term(f"c{self.at[c]}", c, levels.get(c, ()), coded=0 if c in levels else sizes[c]))
            if not terms:
                faults.append((s.pos, "empty_design_matrix"))
                continue
            y = s.outcome
            if s.test == "linear_regression":
                if y not in self.numeric:
                    faults.append((s.pos, "linear_regression_requires_numeric_outcome"))
                    continue
                m, d, *_ = moments[y]
                target = Term(self.num(y), y, (), m or 0.0, d if d else 1.0)
                linear.append(Design(s.pos, target, tuple(terms), s.predictors, self.cfg.strict_parity))
                continue
            if y in self.numeric:
                _, _, low, high = moments[y]
                if self.cfg.strict_parity or low is None or low == high:
                    faults.append((s.pos, "logistic_regression_requires_binary_outcome"))
                    continue
                target = Term(self.num(y), y, (), low, high - low)
            elif sizes[y] != 2:
                faults.append((s.pos, "non_numeric_outcome_not_binary"))
                continue
            else:
                target = Term(f"c{self.at[y]}", y)
            logit.append(Design(s.pos, target, tuple(terms), s.predictors, self.cfg.strict_parity))
        keep = [F.col(self.num(c)) for c in numbers]
        for c in text:
            if c in self.coded:
                codes = self.coded[c].select(F.col("level").alias(self.txt(c)), "n", F.col("code").cast("double").alias(f"c{self.at[c]}"))
                coded = attach(coded, codes, [self.txt(c)], "n")
                keep.append(F.col(f"c{self.at[c]}"))
            elif levels[c]:
                keep.append(level_code(self.txt(c), list(levels[c])).cast("double").alias(f"c{self.at[c]}"))
        coded = coded.select("rid", *keep)
        return linear, logit, pin(coded) if self.coded else coded, faults  # rows are not joined with their codes in every scan

    def regressions(self, weights: Weights, only: set[int] | None = None) -> DataFrame | None:
        specs = self.of(*REGRESSIONS)
        if not specs or (only is not None and not only & {s.pos for s in specs}):
            return None
        if not hasattr(self, "_designs"):
            self._designs = self.designs()
        linear, logit, coded, faults = self._designs
        if only is not None:
            linear = [d for d in linear if d.pos in only]
            logit = [d for d in logit if d.pos in only]
            faults = []
        frame = coded.withColumn("h", weights.base(F.col("rid"))).drop("rid")
        parts = []
        if linear:
            parts.append(least_squares(frame, linear, weights))
        if logit:
            held = frame.persist()
            parts.append(logistic(held, logit, weights))
            held.unpersist()
        spark = frame.sparkSession
        parts.append(small_frame(spark, [(p, 0, None, None, None, None, note) for p, note in faults],
            "pos int, rep int, n double, effect double, p_value double, main_column string, note string",
        ))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self._with_names(out) if self.coded else out

    def _with_names(self, fitted: DataFrame) -> DataFrame:
        """Names of levels that solvers know by their codes only."""
        names = None
        for c, codes in self.coded.items():
            mine = codes.select(F.concat(F.lit(f"{CODED}{c}{CODED}"), F.col("code").cast("string")).alias("main_column"), F.concat(F.lit(f"{c}_"), "level").alias("named"))
            names = mine if names is None else names.unionByName(mine)
        fitted = pin(fitted)  # one row per hypothesis and replicate
        return fitted.join(names, "main_column", "left").withColumn("main_column", F.coalesce("named", "main_column")).select(*fitted.columns)

    # -- resampling

    def replicates(self, weights: Weights, only: set[int]) -> DataFrame:
        """(pos, rep, effect, main_column) of every testable replicate."""
        frame = self.frame.withColumn("h", weights.base(F.col("rid"))).drop("rid")

        def specs(test: str, a, b) -> list[tuple[int, str, str]]:
            return [(s.pos, a(s.outcome), b(s.predictors[0])) for s in self.of(test) if s.pos in only]

        def two_groups(got):
            lowest = [F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias(f"g{p}") for p, y, x in got]
            row = self.frame.agg(*lowest).first()
            return B.two_group_effects(frame, got, weights, {p: row[f"g{p}"] for p, _, _ in got})

        def fitted():
            out = self.regressions(weights, only)
            return None if out is None else out.filter(F.col("note") == "")

        families = [
            (specs("pearsonr", self.num, self.num), lambda s: B.linear_effects(frame, s, weights)),
            (specs("spearmanr", self.num, self.num), lambda s: B.monotonic_effects(frame, s, weights)),
            (specs("mannwhitneyu", self.num, self.txt), two_groups),
            (specs("kruskal", self.num, self.txt), lambda s: B.group_effects(frame, s, weights)),
            (specs("chi2", self.txt, self.txt), lambda s: B.table_effects(frame, s, weights)),
        ]
        spark = frame.sparkSession
        tasks = [(lambda fn=fn, got=got: fn(got)) for got, fn in families if got]
        out = small_frame(spark, [], "pos int, rep int, effect double, main_column string")
        for p in together(spark, [*tasks, fitted]):
            if p is not None:
                main = F.col("main_column") if "main_column" in p.columns else F.lit("")
                out = out.unionByName(p.select("pos", "rep", "effect", main.alias("main_column")))
        return out


# ---- verdicts -----------------------------------------------------------------------------------


def direction_ok(expected: Column, effect: Column, test: Column) -> Column:
    """Sign agreement; only correlations and regressions have a direction to miss."""
    want = F.trim(F.coalesce(expected, F.lit("")))
    signed = test.isin("pearsonr", "spearmanr", *REGRESSIONS)
    return (
        F.when(signed & (want == "positive"), effect > 0)
        .when(signed & (want == "negative"), effect < 0)
        .otherwise(True)
    )


def effect_passes(name: Column, effect: Column, lim: EffectLimits) -> Column:
    return (
        F.when(name.isin("r", "rho", "coef"), F.abs(effect) >= lim.min_abs_r)
        .when(name == "cramers_v", effect >= lim.min_cramers_v)
        .when(name == "eta2_approx", effect >= lim.min_eta2)
        .when(name == "rank_biserial", F.abs(effect) >= lim.min_rank_biserial)
        .otherwise(False)
    )


def judge(results: DataFrame, lim: EffectLimits | None = None, large: bool = False) -> DataFrame:
    """q-values over the testable rows of each dataset and the status before resampling.

    `large` is for batches that grow with data rather than with proposals.
    """
    lim = lim or EffectLimits()
    df = results.withColumn(
        "direction_match", F.when(F.col("testable"), direction_ok(F.col("direction_expected"), F.col("effect"), F.col("primary_test")))
    ).withColumn(
        "effect_threshold_pass", F.when(F.col("testable"), effect_passes(F.col("effect_name"), F.col("effect"), lim))
    )
    df = (adjust_large if large else adjust)(df, valid=F.col("testable"))
    df = df.withColumn("bh_significant", F.coalesce(F.col("adjusted_p") < lim.alpha, F.lit(False)))
    status = (
        F.when(F.col("adjusted_p").isNull(), "not_testable")
        .when(F.col("n") < lim.min_n, "failed_min_n")
        .when(~F.col("bh_significant"), "failed_bh")
        .when(~F.col("direction_match"), "failed_direction")
        .when(~F.col("effect_threshold_pass"), "failed_effect_threshold")
        .otherwise("validated")
    )
    return df.withColumn("validation_status", status).withColumn("validated", F.col("validation_status") == "validated")


def settle(judged: DataFrame, boot: DataFrame) -> DataFrame:
    """Final status from the resampling summary; only validated hypotheses were resampled."""
    df = judged.join(boot, "pos", "left")
    tested, stable = F.col("bootstrap_testable"), F.col("bootstrap_stable")
    status = (
        F.when(~F.col("validated"), F.col("validation_status"))
        .when(~F.coalesce(tested, F.lit(False)), "failed_bootstrap_not_testable")
        .when(stable, "final_accepted")
        .otherwise("failed_bootstrap_stability")
    )
    failed = F.col("validated") & ~F.coalesce(tested, F.lit(False))
    return (
        df.withColumn("validation_status", status)
        .withColumn("notes", F.when(failed & (F.col("notes") == ""), F.col("bootstrap_notes")).otherwise(F.col("notes")))
        .withColumn("final_accepted", F.col("validation_status") == "final_accepted")
        .drop("bootstrap_notes")
    )


@dataclass
class Validation:
    """Tables of one validated dataset."""

    results: DataFrame
    rejected: DataFrame
    kept: DataFrame
    summary: DataFrame
    replicates: DataFrame | None = None

    def hypotheses(self, stage: str) -> DataFrame:
        """Hypotheses that reached a stage: 'kept', 'validated' or 'final'."""
        if stage == "kept":
            return self.kept
        flag = {"validated": "validated", "final": "final_accepted"}[stage]
        return self.kept.join(F.broadcast(self.results.filter(flag).select("pos")), "pos", "left_semi")


def validate(
    df: DataFrame,
    hypotheses: DataFrame,
    dataset: str = "dataset",
    config: ValidationConfig | None = None,
    key: str | None = None,
) -> Validation:
    """Test the hypotheses of one dataset on its held-out rows.

    `hypotheses` is what `intake.parse` returns. `key` names a unique column of `df` that resampling
    weights hang on; without one the needed columns are written once with a row id.
    """
    cfg = config or ValidationConfig()
    spark = df.sparkSession
    mine = pin(prefilter(hypotheses.filter(F.col("dataset") == dataset), df))
    kept = mine.filter(F.col("reason").isNull()).drop("reason")
    specs = [
        Spec(r["pos"], r["t"], r["outcome"], tuple(r["predictors"]), tuple(r["controls"] or ()))
        for r in kept.select("pos", F.col("test_plan.primary_test").alias("t"), "validation_spec.*").collect()
    ]
    head = kept.select(
        "dataset", "pos", "id", F.to_json("variables").alias("variables"), "relationship_type",
        F.coalesce("direction", F.lit("unknown")).alias("direction_expected"), "claim",
        F.to_json("supporting_evidence").alias("supporting_evidence"),
        F.col("test_plan.primary_test").alias("primary_test"), F.col("spec_json").alias("validation_spec"),
    )
    if not specs:
        tested = small_frame(spark, [], RESULT)
        boot_summary = small_frame(spark, [], BOOT)
        results = settle(judge(head.join(tested, "pos", "left"), cfg.limits), boot_summary)
        return Validation(_columns(results), rejections(mine), kept, summary(results, mine, cfg))
    bench = Bench(df, specs, key, cfg)
    judged = pin(judge(head.join(F.broadcast(bench.results()), "pos", "left"), cfg.limits))
    winners = {r["pos"] for r in judged.filter("validated").select("pos").collect()}
    n_rows = bench.frame.count()
    effects = None
    if not winners:
        boot = small_frame(spark, [], BOOT)
    elif n_rows < cfg.limits.min_n:
        boot = small_frame(spark, [(p, False, None, None, None, None, None, None, None, None, False, "test_set_too_small_for_bootstrap") for p in winners], BOOT
        )
    else:
        weights = Weights(cfg.weights, cfg.bootstrap_iterations, cfg.bootstrap_seed, n_rows)
        effects = pin(bench.replicates(weights, winners))
        boot = resample_summary(effects, judged, cfg)
    results = pin(settle(judged, boot))
    return Validation(_columns(results), rejections(mine), kept, summary(results, mine, cfg), effects)


BOOT = (
    "pos int, bootstrap_testable boolean, bootstrap_successful_runs bigint, bootstrap_median_effect double, "
    "bootstrap_ci_low double, bootstrap_ci_high double, bootstrap_ci_excludes_zero boolean, "
    "bootstrap_sign_consistency double, bootstrap_effect_pass_rate double, "
    "bootstrap_direction_match_rate double, bootstrap_stable boolean, bootstrap_notes string"
)


def resample_summary(effects: DataFrame, judged: DataFrame, cfg: ValidationConfig) -> DataFrame:
    rules = judged.filter("validated").select("pos", "direction_expected", "primary_test", "effect_name")
    scored = effects.join(F.broadcast(rules), "pos").select(
        "pos", "rep", "effect",
        effect_passes(F.col("effect_name"), F.col("effect"), cfg.limits).alias("effect_pass"),
        direction_ok(F.col("direction_expected"), F.col("effect"), F.col("primary_test")).alias("direction_ok"),
    )
    return B.summarize(scored, rules.select("pos"), cfg.sign_consistency_min, cfg.effect_pass_rate_min)


def _columns(results: DataFrame) -> DataFrame:
    return results.select("dataset", "pos", *schemas.VALIDATION_COLUMNS)


def summary(results: DataFrame, checked: DataFrame, cfg: ValidationConfig | None = None) -> DataFrame:
    """Counts per stage and the two rates, one row per dataset."""
    cfg = cfg or ValidationConfig()
    stages = checked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("generated_hypotheses_raw"),
        F.count_if(F.col("reason").isNull()).alias("hypotheses_after_pre_filter"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected_pre_validation"),
    )
    counts = results.groupBy("dataset").agg(
        F.count_if("testable").alias("testable_hypotheses"),
        F.count_if("validated").alias("validated_hypotheses_before_bootstrap"),
        F.count_if("final_accepted").alias("final_accepted_hypotheses"),
        F.count_if(~F.coalesce(F.col("testable"), F.lit(False))).alias("not_testable_hypotheses"),
    )
    both = stages.join(counts, "dataset", "left").fillna(0)
    v, t, f = (F.col(c) for c in ("validated_hypotheses_before_bootstrap", "testable_hypotheses", "final_accepted_hypotheses"))
    lim = cfg.limits
    return both.select(
        "dataset", "generated_hypotheses_raw", "hypotheses_after_pre_filter", "rejected_pre_validation",
        "testable_hypotheses", "validated_hypotheses_before_bootstrap", "final_accepted_hypotheses",
        (v - f).alias("rejected_after_bootstrap"), "not_testable_hypotheses",
        F.coalesce(F.try_divide(v, t), F.lit(0.0)).alias("validation_rate_among_testable"),
        F.coalesce(F.try_divide(f, v), F.lit(0.0)).alias("final_acceptance_rate_among_validated"),
        F.lit(lim.alpha).alias("alpha"), F.lit(lim.min_n).alias("min_n"),
        F.lit(lim.min_abs_r).alias("min_abs_r"), F.lit(lim.min_cramers_v).alias("min_cramers_v"),
        F.lit(lim.min_eta2).alias("min_eta2"), F.lit(lim.min_rank_biserial).alias("min_rank_biserial"),
        F.lit(cfg.bootstrap_iterations).alias("bootstrap_iterations"),
        F.lit(cfg.sign_consistency_min).alias("bootstrap_sign_consistency_min"),
        F.lit(cfg.effect_pass_rate_min).alias("bootstrap_effect_pass_rate_min"),
    )
