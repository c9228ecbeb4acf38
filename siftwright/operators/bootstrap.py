"""Effects under resampling, for all hypotheses and replicates in a few scans.

Correlations, group and table effects add up weighted sums per replicate. Rank effects sort the
rows once by range and handle all replicates side by side; a tied value that fills several ranges
is stitched together afterwards, so one frequent value never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.weights import Weights
from siftwright.operators.screen import contingency, variance_share
from siftwright.plans.materialize import pin

# Rows handled at once in rank resampling: rows x replicates must fit a task comfortably. Longer
# ranges are cut into pieces of this size; values that reach over a cut are stitched afterwards.
RANGE_ROWS = 10_000


def _melt_pairs(frame: DataFrame, specs: list[tuple[int, str, str]], a: str, b: str) -> DataFrame:
    """(pos, a, b, h) rows of every listed column pair, both present."""
    structs = [
        F.struct(F.lit(p).alias("pos"), F.col(x).alias(a), F.col(y).alias(b)) for p, x, y in specs
    ]
    return frame.select("h", F.inline(F.array(*structs))).filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def linear_effects(frame: DataFrame, specs: list[tuple[int, str, str]], weights: Weights) -> DataFrame:
    """(pos, rep, n, effect): Pearson r of (pos, column, column)."""
    names = sorted({c for _, a, b in specs for c in (a, b)})
    row = frame.agg(*[F.avg(c).alias(c) for c in names]).first()
    centre = {c: row[c] or 0.0 for c in names}
    fields = ["n", "a", "b", "aa", "bb", "ab"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            w = weights.matrix(pdf["h"].to_numpy()).astype(float)
            for pos, a, b in specs:
                x = pdf[a].to_numpy(dtype=float) - centre[a]
                y = pdf[b].to_numpy(dtype=float) - centre[b]
                ok = ~(np.isnan(x) | np.isnan(y))
                x, y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
                part = np.column_stack([ok.astype(float), x, y, x * x, y * y, x * y]).T @ w
                total[pos] = total[pos] + part if pos in total else part
        for pos, s in total.items():
            yield pd.DataFrame({"pos": pos, "rep": np.arange(s.shape[1]), **dict(zip(fields, s))})

    sums = frame.select("h", *names).mapInPandas(
        partial, "pos int, rep int, " + ", ".join(f"{f} double" for f in fields)
    ).groupBy("pos", "rep").agg(*[F.sum(f).alias(f) for f in fields])
    n = F.when(F.col("n") > 1, F.col("n"))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / n, F.col("bb") - F.col("b") * F.col("b") / n
    varies = (va > F.col("aa") * 1e-13) & (vb > F.col("bb") * 1e-13)
    r = (F.col("ab") - F.col("a") * F.col("b") / n) / F.sqrt(va * vb)
    return sums.select("pos", "rep", "n", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("effect"))


def _cells_by_replicate(rows: DataFrame, keys: list[str], values: list[str], weights: Weights, schema: str) -> DataFrame:
    """Weighted counts and sums of `values` per key tuple and replicate, pre-added inside each task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            w = weights.matrix(pdf["h"].to_numpy())
            codes, uniques = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            w = w[order].astype(float)
            parts = [np.add.reduceat(w, starts, axis=0)]
            for v in values:
                x = pdf[v].to_numpy(dtype=float)[order][:, None]
                parts += [np.add.reduceat(w * x, starts, axis=0), np.add.reduceat(w * x * x, starts, axis=0)]
            block = np.stack(parts, axis=2)
            for c, s in zip(codes[order][starts], block):
                key = tuple(uniques[c])
                total[key] = total[key] + s if key in total else s
            if len(total) > 20_000:
                yield from _cell_frames(total, keys, values)
                total = {}
        yield from _cell_frames(total, keys, values)

    names = ["o"] + [f"{p}_{v}" for v in values for p in ("s", "q")]
    return (
        rows.mapInPandas(partial, schema)
        .groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in names])
        .filter(F.col("o") > 0)
    )


def _cell_frames(total: dict, keys: list[str], values: list[str]) -> Iterator[pd.DataFrame]:
    names = ["o"] + [f"{p}_{v}" for v in values for p in ("s", "q")]
    for key, s in total.items():
        yield pd.DataFrame({
            **dict(zip(keys, key)), "rep": np.arange(s.shape[0]), **{c: s[:, i] for i, c in enumerate(names)},
        })


def table_effects(frame: DataFrame, specs: list[tuple[int, str, str]], weights: Weights) -> DataFrame:
    """(pos, rep, n, effect): Cramer's V of (pos, text column, text column)."""
    rows = _melt_pairs(frame, specs, "a", "b")
    cells = pin(_cells_by_replicate(rows, ["pos", "a", "b"], [], weights, "pos int, a string, b string, rep int, o double"))
    one = cells.select((F.col("pos") * weights.reps + F.col("rep")).alias("pos"), "a", "b", "o")
    stats = contingency(one).filter((F.col("r") >= 2) & (F.col("c") >= 2))
    return stats.select(
        F.floor(F.col("pos") / weights.reps).cast("int").alias("pos"),
        (F.col("pos") % weights.reps).cast("int").alias("rep"), F.col("n").cast("double").alias("n"),
        F.col("v").alias("effect"),
    )


def group_effects(frame: DataFrame, specs: list[tuple[int, str, str]], weights: Weights) -> DataFrame:
    """(pos, rep, n, effect): eta squared of (pos, number column, text column)."""
    numbers = sorted({y for _, y, _ in specs})
    means = frame.agg(*[F.avg(c).alias(c) for c in numbers]).first()
    shift = F.create_map(*[x for p, y, _ in specs for x in (F.lit(p), F.lit(means[y] or 0.0))])
    rows = _melt_pairs(frame, specs, "y", "level").withColumn("y", F.col("y") - shift[F.col("pos")])
    cells = _cells_by_replicate(
        rows, ["pos", "level"], ["y"], weights,
        "pos int, level string, rep int, o double, s_y double, q_y double",
    )
    one = cells.select(
        (F.col("pos") * weights.reps + F.col("rep")).alias("pos"), F.col("o").alias("n_g"),
        F.col("s_y").alias("s"), F.col("q_y").alias("ss"),
    )
    fit = one.groupBy("pos").agg(F.min("n_g").alias("smallest"), F.count(F.lit(1)).alias("k"), F.sum("n_g").alias("n"))
    stats = variance_share(one).join(fit, "pos").filter((F.col("k") >= 2) & (F.col("smallest") >= 2) & (F.col("ss_total") > 0))
    return stats.select(
        F.floor(F.col("pos") / weights.reps).cast("int").alias("pos"),
        (F.col("pos") % weights.reps).cast("int").alias("rep"), "n", F.col("eta2").alias("effect"),
    )


# ---- rank effects -------------------------------------------------------------------------------


def _blocks(v: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, v[1:] != v[:-1]])


def _pieces(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Sorted rows of one range in pieces of `size`; piece numbers rise with the order of rows."""
    number = TaskContext.get().partitionId() << 32
    held, rows = [], 0
    for b in batches:
        while len(b):
            take = min(size - rows, len(b))
            held.append(b.iloc[:take])
            rows += take
            b = b.iloc[take:]
            if rows == size:
                yield number, pd.concat(held, ignore_index=True)
                number, held, rows = number + 1, [], 0
    if held:
        yield number, pd.concat(held, ignore_index=True)


def _neighbours(segments: DataFrame, amount: str) -> tuple[Column, Column]:
    """Weight of the same value in earlier and in later ranges."""
    w = Window.partitionBy("pos", "rep", "v").orderBy("pid")
    before = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.coalesce(F.sum(amount).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return before, after


def _segments(parts: DataFrame, columns: list[str]) -> DataFrame:
    """First and last value of every range with their sums: (pos, pid, rep, v, edge, ...)."""

    def edge(name: str, prefix: str) -> Column:
        return F.struct(
            F.col(f"v_{name}").alias("v"), F.lit(name).alias("edge"),
            *[F.col(f"{prefix}_{c}").alias(c) for c in columns],
        )

    both = F.when(F.col("v_first") == F.col("v_last"), F.array(edge("first", "f"))).otherwise(
        F.array(edge("first", "f"), edge("last", "l"))
    )
    return parts.select("pos", "pid", "rep", "off", F.explode(both).alias("e")).select("pos", "pid", "rep", "off", "e.*")


def _with_offsets(parts: DataFrame, total: str) -> DataFrame:
    w = Window.partitionBy("pos", "rep").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("off", F.coalesce(F.sum(total).over(w), F.lit(0.0)))


def two_group_effects(frame: DataFrame, specs: list[tuple[int, str, str]], weights: Weights, first_level: dict[int, str]) -> DataFrame:
    """(pos, rep, n, effect): rank-biserial correlation of (pos, number column, two-level text column)."""
    first = F.create_map(*[x for p, v in first_level.items() for x in (F.lit(p), F.lit(v))])
    rows = _melt_pairs(frame, specs, "v", "level").select(
        "pos", "v", "h", (F.col("level") == first[F.col("pos")]).cast("int").alias("g")
    )
    spread = rows.repartitionByRange("pos", "v", "h").sortWithinPartitions("pos", "v", "h")
    size = RANGE_ROWS
    names = ["u", "t1", "t2", "f_a1", "f_a2", "l_a1", "l_a2"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pid, pos, g in ((i, pos, g) for i, p in _pieces(batches, size) for pos, g in p.groupby("pos", sort=True)):
            v = g["v"].to_numpy()
            w = weights.matrix(g["h"].to_numpy()).astype(float)
            one = g["g"].to_numpy()[:, None]
            at = _blocks(v)
            a1 = np.add.reduceat(w * one, at, axis=0)
            a2 = np.add.reduceat(w * (1 - one), at, axis=0)
            below = np.cumsum(a2, axis=0) - a2
            u = (a1 * (below + a2 / 2)).sum(axis=0)
            yield pd.DataFrame({
                "pos": pos, "pid": pid, "rep": np.arange(w.shape[1]), "v_first": v[0], "v_last": v[-1],
                **dict(zip(names, [u, a1.sum(axis=0), a2.sum(axis=0), a1[0], a2[0], a1[-1], a2[-1]])),
            })

    parts = _with_offsets(pin(spread.mapInPandas(
        partial, "pos int, pid bigint, rep int, v_first double, v_last double, " + ", ".join(f"{c} double" for c in names)
    )), "t2")
    seg = _segments(parts, ["a1", "a2"])
    before, after = _neighbours(seg, "a2")
    tied = seg.withColumn("fix", F.col("a1") * (after - before) / 2).groupBy("pos", "rep").agg(F.sum("fix").alias("fix"))
    sums = parts.groupBy("pos", "rep").agg(
        F.sum(F.col("u") + F.col("t1") * F.col("off")).alias("u"), F.sum("t1").alias("n1"), F.sum("t2").alias("n2")
    ).join(tied, ["pos", "rep"])
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    return sums.filter(ok).select(
        "pos", "rep", (F.col("n1") + F.col("n2")).alias("n"),
        (1 - 2 * (F.col("u") + F.col("fix")) / (F.col("n1") * F.col("n2"))).alias("effect"),
    )


def monotonic_effects(frame: DataFrame, specs: list[tuple[int, str, str]], weights: Weights) -> DataFrame:
    """(pos, rep, n, effect): Spearman rho of (pos, column, column), re-ranked in every replicate.

    Ranks of x are taken range by range for all replicates at once and travel with the row as one
    packed vector to the range of its y, where the products are added up.
    """
    rows = _melt_pairs(frame, specs, "x", "y")
    # The generated id counts rows inside a sorted range, so its multiples cut ranges into pieces.
    spread = pin(
        rows.repartitionByRange("pos", "x", "h").sortWithinPartitions("pos", "x", "h")
        .withColumn("pid", F.floor(F.monotonically_increasing_id() / RANGE_ROWS))
    )
    size = RANGE_ROWS

    def x_totals(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x", kind="stable")
        v = g["x"].to_numpy()
        w = weights.matrix(g["h"].to_numpy()).astype(float)
        at = _blocks(v)
        f = np.add.reduceat(w, at, axis=0)
        return pd.DataFrame({
            "pos": g["pos"].iloc[0], "pid": g["pid"].iloc[0], "rep": np.arange(w.shape[1]),
            "v_first": v[0], "v_last": v[-1], "t": w.sum(axis=0), "f_w": f[0], "l_w": f[-1],
        })

    totals = _with_offsets(pin(spread.groupBy("pos", "pid").applyInPandas(
        x_totals, "pos int, pid bigint, rep int, v_first double, v_last double, t double, f_w double, l_w double"
    )), "t")
    seg = _segments(totals, ["w"])
    before, after = _neighbours(seg, "w")
    fixes = seg.withColumn("fix", after - before).groupBy("pos", "pid", "rep").agg(
        F.first("off").alias("off"),
        F.max(F.when(F.col("edge") == "first", F.col("fix"))).alias("fix_first"),
        F.max(F.when(F.col("edge") == "last", F.col("fix"))).alias("fix_last"),
    )

    def x_ranks(g: pd.DataFrame, fix: pd.DataFrame) -> pd.DataFrame:
        if g.empty:
            return pd.DataFrame({"pos": [], "y": [], "h": [], "rx": []})
        g = g.sort_values("x", kind="stable")
        fix = fix.sort_values("rep")
        v = g["x"].to_numpy()
        w = weights.matrix(g["h"].to_numpy()).astype(float)
        at = _blocks(v)
        f = np.add.reduceat(w, at, axis=0)
        # Twice the rank minus one, so that ties stay whole numbers.
        twice = 2 * (np.cumsum(f, axis=0) - f + fix["off"].to_numpy()) + f
        twice[0] += fix["fix_first"].to_numpy()
        if len(at) > 1:
            twice[-1] += fix["fix_last"].to_numpy()
        packed = np.repeat(twice, np.diff(np.r_[at, len(v)]), axis=0)
        packed = packed.astype(np.int32 if packed.max() < 2**31 else np.int64)
        return pd.DataFrame({
            "pos": g["pos"].to_numpy(), "y": g["y"].to_numpy(), "h": g["h"].to_numpy(),
            "rx": [r.tobytes() for r in packed],
        })

    ranked = spread.groupBy("pos", "pid").cogroup(fixes.groupBy("pos", "pid")).applyInPandas(
        x_ranks, "pos int, y double, h bigint, rx binary"
    )
    names = ["t", "sx", "sxx", "sy", "syy", "sxy", "f_w", "f_x", "f_y", "l_w", "l_x", "l_y"]

    def y_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pid, pos, g in ((i, pos, g) for i, p in _pieces(batches, size) for pos, g in p.groupby("pos", sort=True)):
            v = g["y"].to_numpy()
            w = weights.matrix(g["h"].to_numpy()).astype(float)
            reps = w.shape[1]
            rx = np.stack([
                np.frombuffer(b, dtype=np.int32 if len(b) == 4 * reps else np.int64) for b in g["rx"]
            ]).astype(float)
            at = _blocks(v)
            f = np.add.reduceat(w, at, axis=0)
            wx = w * rx
            fx = np.add.reduceat(wx, at, axis=0)
            ry = 2 * (np.cumsum(f, axis=0) - f) + f
            sums = [
                f.sum(axis=0), fx.sum(axis=0), (wx * rx).sum(axis=0), (f * ry).sum(axis=0),
                (f * ry * ry).sum(axis=0), (fx * ry).sum(axis=0),
                f[0], fx[0], ry[0], f[-1], fx[-1], ry[-1],
            ]
            yield pd.DataFrame({
                "pos": pos, "pid": pid, "rep": np.arange(reps), "v_first": v[0], "v_last": v[-1], **dict(zip(names, sums)),
            })

    by_y = ranked.repartitionByRange("pos", "y", "h").sortWithinPartitions("pos", "y", "h")
    parts = _with_offsets(pin(by_y.mapInPandas(
        y_sums, "pos int, pid bigint, rep int, v_first double, v_last double, " + ", ".join(f"{c} double" for c in names)
    )), "t")
    seg = _segments(parts, ["w", "x", "y"])
    before, after = _neighbours(seg, "w")
    c = F.col("fix")
    tied = seg.withColumn("fix", after - before).groupBy("pos", "rep").agg(
        F.sum(c * F.col("w")).alias("dy"),
        F.sum(c * F.col("x")).alias("dxy"),
        F.sum(2 * c * (F.col("y") + 2 * F.col("off")) * F.col("w") + c * c * F.col("w")).alias("dyy"),
    )
    off = 2 * F.col("off")
    s = parts.groupBy("pos", "rep").agg(
        F.sum("t").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"),
        F.sum(F.col("sy") + off * F.col("t")).alias("sy"),
        F.sum(F.col("syy") + 2 * off * F.col("sy") + off * off * F.col("t")).alias("syy"),
        F.sum(F.col("sxy") + off * F.col("sx")).alias("sxy"),
    ).join(tied, ["pos", "rep"])
    n = F.when(F.col("n") > 1, F.col("n"))
    sy, syy, sxy = F.col("sy") + F.col("dy"), F.col("syy") + F.col("dyy"), F.col("sxy") + F.col("dxy")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, syy - sy * sy / n
    rho = (sxy - F.col("sx") * sy / n) / F.sqrt(vx * vy)
    varies = (vx > F.col("sxx") * 1e-13) & (vy > syy * 1e-13)
    return s.select("pos", "rep", "n", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("effect"))


# ---- summary of replicates ----------------------------------------------------------------------


def summarize(effects: DataFrame, rules: DataFrame, sign_min: float = 0.80, pass_min: float = 0.70) -> DataFrame:
    """Interval, median and stability per hypothesis.

    `effects` is (pos, rep, effect); `rules` is (pos, passes, matches) joined on (pos, effect)
    beforehand, so it must carry `effect_pass` and `direction_ok` per replicate.
    """
    e = F.col("effect")
    got = effects.filter(e.isNotNull() & ~F.isnan(e)).groupBy("pos").agg(
        F.count(F.lit(1)).alias("bootstrap_successful_runs"),
        F.percentile(e, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"),
        F.greatest(F.avg((e > 0).cast("double")), F.avg((e < 0).cast("double"))).alias("bootstrap_sign_consistency"),
        F.avg(F.col("effect_pass").cast("double")).alias("bootstrap_effect_pass_rate"),
        F.avg(F.col("direction_ok").cast("double")).alias("bootstrap_direction_match_rate"),
    )
    low, mid, high = F.col("q")[0], F.col("q")[1], F.col("q")[2]
    clear = ((low > 0) & (high > 0)) | ((low < 0) & (high < 0))
    ok = F.col("bootstrap_successful_runs").isNotNull()
    return rules.join(got, "pos", "left").select(
        "pos", ok.alias("bootstrap_testable"), "bootstrap_successful_runs",
        mid.alias("bootstrap_median_effect"), low.alias("bootstrap_ci_low"), high.alias("bootstrap_ci_high"),
        clear.alias("bootstrap_ci_excludes_zero"), "bootstrap_sign_consistency",
        "bootstrap_effect_pass_rate", "bootstrap_direction_match_rate",
        F.when(ok, clear & (F.col("bootstrap_sign_consistency") >= sign_min)
               & (F.col("bootstrap_effect_pass_rate") >= pass_min)).otherwise(False).alias("bootstrap_stable"),
        F.when(~ok, "no_successful_bootstrap_runs").otherwise("").alias("bootstrap_notes"),
    )
