"""Linear and logistic regressions from sums that one scan can add up.

A task turns its rows into partial sums (cross products for least squares, gradient and curvature
for logistic steps), one packed row per hypothesis and replicate; they are added as they arrive, and the system of each
hypothesis and replicate is solved in a task. Of narrow designs the coefficients, at most WIDE numbers each, come
to the driver. Of wide ones only products that occur are added up, the solver is sparse, and logistic coefficients stay in a table
that rows look their levels up in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.tails import normal_two_sided, t_two_sided
from siftwright.functions.weights import Weights
from siftwright.operators.absorb import absorbed
from siftwright.operators.sparse_solve import Reduced, least_p
from siftwright.plans.materialize import pin, small_frame

NEWTON_STEPS = 35
NEWTON_TOLERANCE = 1e-8
#: Designs of more columns are solved sparsely.
WIDE = 512
#: Rows whose products a task adds up before it sends them, sums kept apart before they are joined, and columns of one block of a coefficient table.
FLUSH_ROWS, KEPT_SUMS, BLOCK = 50_000, 1 << 22, 4096
#: Between the parts of the name of a level that only its code is known of: column, code.
CODED = "\0"
RESULT = "pos int, rep int, n double, effect double, p_value double, main_column string, note string"


@dataclass(frozen=True)
class Term:
    """One source column of a design: a number, or a category with its sorted levels."""

    column: str
    source: str
    levels: tuple[str, ...] = ()
    centre: float = 0.0
    scale: float = 1.0
    #: Levels of a category that is coded in Spark and whose names are not known here.
    coded: int = 0

    @property
    def categories(self) -> int:
        return len(self.levels) or self.coded

    @property
    def width(self) -> int:
        return max(1, self.categories - 1)

    def name(self, at: int) -> str:
        """Name of the column `at` of this term."""
        if self.coded:
            return f"{CODED}{self.source}{CODED}{at + 1}"
        return f"{self.source}_{self.levels[at + 1]}" if self.levels else self.source

    def values(self, pdf: pd.DataFrame) -> np.ndarray:
        col = pdf[self.column].to_numpy(dtype=float)
        if self.categories:
            return (col[:, None] == np.arange(1, self.categories)).astype(float)
        return ((col - self.centre) / self.scale)[:, None]


@dataclass(frozen=True)
class Design:
    """Outcome and terms of one regression hypothesis."""

    pos: int
    outcome: Term
    terms: tuple[Term, ...]
    predictors: tuple[str, ...]
    strict_parity: bool = False

    def name(self, at: int) -> str:
        for t in self.terms:
            if at < t.width:
                return t.name(at)
            at -= t.width
        raise IndexError(at)

    def _spread(self, values: list) -> np.ndarray:
        return np.repeat(np.array(values), [t.width for t in self.terms])

    def scales(self) -> np.ndarray:
        return self._spread([t.scale for t in self.terms])

    def is_predictor(self) -> np.ndarray:
        """Columns of predictors; with `strict_parity` those whose name starts with one. Of a category coded in Spark all levels go by its own name."""
        if not self.strict_parity:
            return self._spread([t.source in self.predictors for t in self.terms])

        def named(n: str) -> bool:
            return any(n == p or n.startswith(f"{p}_") for p in self.predictors)

        return np.concatenate([
            np.full(t.width, named(f"{t.source}_")) if t.coded else np.array([named(t.name(i)) for i in range(t.width)], dtype=bool) for t in self.terms
        ])

    def width(self) -> int:
        return sum(t.width for t in self.terms)

    def starts(self) -> list[int]:
        """First column of each term."""
        return np.concatenate([[0], np.cumsum([t.width for t in self.terms])])[:-1].tolist()

    def block(self) -> tuple[int, int]:
        """Columns of the widest category; no row has two of them."""
        sizes = [t.width for t in self.terms]
        widest = max(range(len(sizes)), key=lambda i: (bool(self.terms[i].categories), sizes[i]))
        return sum(sizes[:widest]), sum(sizes[: widest + 1])

    def entries(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, values, y, complete): the entries of (1, X), one column per term; the same zeroing as `rows`."""
        at, columns, values, ok = 1, [np.zeros(len(pdf), np.int64)], [], np.ones(len(pdf), bool)
        for t in self.terms:
            col = pdf[t.column].to_numpy(dtype=float)
            if t.categories:
                level = np.where(np.isnan(col), 0, col).astype(np.int64)
                columns.append(at + np.maximum(level - 1, 0))
                values.append((level > 0).astype(float))
                at += t.categories - 1
            else:
                ok &= ~np.isnan(col)
                columns.append(np.full(len(pdf), at))
                values.append((col - t.centre) / t.scale)
                at += 1
        y = self.outcome.values(pdf)[:, 0]
        ok &= ~np.isnan(y)
        values = np.column_stack([np.ones(len(pdf)), *values])
        return np.column_stack(columns), np.where(ok[:, None], values, 0.0), np.where(ok, y, 0.0), ok

    def rows(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(X, y, complete) of a batch; incomplete rows are zeroed so they add nothing."""
        x = np.hstack([t.values(pdf) for t in self.terms])
        y = self.outcome.values(pdf)[:, 0]
        ok = ~(np.isnan(x).any(axis=1) | np.isnan(y))
        return np.where(ok[:, None], x, 0.0), np.where(ok, y, 0.0), ok


def _triangle(q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(q)


#: Columns up to which all products of two are written out, and rows done at once then.
FEW, PRODUCT_ROWS = 24, 2048


def _moments(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Triangle of z' W z for every column of weights. Of few columns all products are one matrix, a piece of the rows at a time; else no temporary is wider than z."""
    i, j = _triangle(z.shape[1])
    if z.shape[1] <= FEW:
        out = np.zeros((len(i), w.shape[1]))
        for at in range(0, len(z), PRODUCT_ROWS):
            part = z[at:at + PRODUCT_ROWS]
            out += (part[:, i] * part[:, j]).T @ w[at:at + PRODUCT_ROWS]
        return out
    return np.column_stack([(z.T @ (z * w[:, r : r + 1]))[i, j] for r in range(w.shape[1])])


def _square(tri: np.ndarray, q: int) -> np.ndarray:
    g = np.zeros((q, q))
    g[_triangle(q)] = tri
    return g + np.triu(g, 1).T


#: Sums of one replicate: `s` alone is a whole vector, with `k` the sums at those places.
PARTIAL = "pos int, rep int, k binary, s binary"


def _packed(pos: int, sums: np.ndarray) -> pd.DataFrame:
    """One row per replicate of a (k x rep) array."""
    return pd.DataFrame({"pos": pos, "rep": np.arange(sums.shape[1]), "k": None, "s": [np.ascontiguousarray(c).tobytes() for c in sums.T]})


class Sums:
    """Partial sums of one hypothesis and replicate, added as they come."""

    def __init__(self):
        self.whole, self.parts, self.held = None, [], 0

    def add(self, k: bytes | None, s: bytes) -> None:
        s = np.frombuffer(s)
        if k is None:
            self.whole = s.copy() if self.whole is None else self.whole + s
            return
        self.parts.append((np.frombuffer(k, np.int64), s))
        self.held += len(s)
        if self.held > KEPT_SUMS and len(self.parts) > 1:
            self.parts = [self.places()]
            self.held = max(len(self.parts[0][0]), self.held // 2)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        k, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate([p[1] for p in self.parts]), len(k))


def gathered(partials: DataFrame, groups: int, each: Callable, schema: str) -> DataFrame:
    """Rows that `each(pos, rep, sums)` makes of every hypothesis and replicate. Sums are added one row after the other, so memory does not grow with the number of tasks."""
    n = max(1, min(groups, 4 * partials.sparkSession.sparkContext.defaultParallelism))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, Sums()
        for pdf in batches:
            for pos, rep, k, s in zip(pdf["pos"].tolist(), pdf["rep"].tolist(), pdf["k"], pdf["s"]):
                if (pos, rep) != now:
                    if now is not None:
                        yield pd.DataFrame([each(*now, sums)], columns=names)
                    now, sums = (pos, rep), Sums()
                sums.add(k, s)
        if now is not None:
            yield pd.DataFrame([each(*now, sums)], columns=names)

    return partials.repartition(n, "pos", "rep").sortWithinPartitions("pos", "rep").mapInPandas(run, schema)


def _pairs(columns: np.ndarray, values: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangle index, product, row) of all products of entries of one row that are not 0."""
    keys, products = [], []
    for a in range(columns.shape[1]):
        for b in range(a, columns.shape[1]):
            i, j = np.minimum(columns[:, a], columns[:, b]), np.maximum(columns[:, a], columns[:, b])
            keys.append(i * q - i * (i - 1) // 2 + j - i)
            products.append(values[:, a] * values[:, b])
    rows, keys, products = np.tile(np.arange(len(columns)), len(keys)), np.concatenate(keys), np.concatenate(products)
    some = products != 0
    return keys[some], products[some], rows[some]


def _sparse(pos: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """One row per replicate with its weighted sums by key; each part has row weights of its own."""
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    for r in range(weights[0].shape[1]):
        sums = np.bincount(inverse, np.concatenate([p[1] * w[p[2], r] for p, w in zip(parts, weights)]), len(keys))
        some = sums != 0
        yield pd.DataFrame({"pos": [pos], "rep": [r], "k": [keys[some].tobytes()], "s": [sums[some].tobytes()]})


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to about FLUSH_ROWS rows, so that equal keys meet before they are sent."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= FLUSH_ROWS:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _unpack(k: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of triangle indices."""
    i = np.arange(q, dtype=np.int64)
    first = i * q - i * (i - 1) // 2
    row = np.searchsorted(first, k, side="right") - 1
    return row, k - first[row] + row


def cross_products(frame: DataFrame, designs: list[Design], weights: Weights) -> DataFrame:
    """Weighted sums of products of (1, X, y) per hypothesis and replicate."""

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            w = weights.matrix(pdf["h"].to_numpy()).astype(float)
            for d in (d for d in designs if d.width() <= WIDE):
                x, y, ok = d.rows(pdf)
                part = _moments(np.column_stack([ok.astype(float), x, y]), w)
                total[d.pos] = total[d.pos] + part if d.pos in total else part
        for pos, sums in total.items():
            yield _packed(pos, sums)

    def wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _held(batches):
            w = weights.matrix(pdf["h"].to_numpy())
            for d in (d for d in designs if d.width() > WIDE):
                columns, values, y, _ = d.entries(pdf)
                q = d.width() + 2
                columns = np.column_stack([columns, np.full(len(y), q - 1)])
                yield from _sparse(d.pos, [_pairs(columns, np.column_stack([values, y]), q)], [w])

    parts = [frame.mapInPandas(f, PARTIAL) for f, some in ((narrow, [d for d in designs if d.width() <= WIDE]), (wide, [d for d in designs if d.width() > WIDE])) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _least_squares(tri: np.ndarray, d: Design) -> tuple:
    """(n, effect, p, column, note) from one triangle of cross products."""
    p = d.width()
    g = _square(tri, p + 2)
    n = g[0, 0]
    s = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(n, 1e-300)
    live, wanted, note = _usable(n, np.diag(s)[:p], np.diag(g)[1 : p + 1], d)
    if note:
        return n, None, None, None, note
    sd = np.sqrt(np.diag(s)[live])
    corr = s[np.ix_(live, live)] / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(corr)
    use = values > len(live) * 1e-12 * values.max()
    inverse = (vectors[:, use] / values[use]) @ vectors[:, use].T
    b = inverse @ (s[live, p] / sd)
    left_over = max(s[p, p] - b @ (s[live, p] / sd), 0.0)
    return _estimate(n, b, n - use.sum() - 1, left_over, np.diag(inverse), lambda c: np.diag(inverse)[c], sd, live, wanted, d)


def _usable(n: float, spread: np.ndarray, squares: np.ndarray, d: Design) -> tuple[np.ndarray, np.ndarray, str]:
    """Columns that vary, which of them are predictors, and why there is no estimate."""
    if n < 3:
        return np.zeros(0, int), np.zeros(0, bool), "too_few_complete_cases_for_regression"
    live = np.flatnonzero(spread > 1e-12 * squares)
    wanted = d.is_predictor()[live]
    if len(live) == 0:
        return live, wanted, "all_predictor_columns_constant"
    return live, wanted, "" if wanted.any() else "no_predictor_columns_in_design_matrix"


def _wide_least_squares(k: np.ndarray, s: np.ndarray, d: Design) -> tuple:
    """The same as `_least_squares` from the sums that are not 0."""
    p = d.width()
    q = p + 2
    i, j = _unpack(k, q)
    first, last, diag = np.zeros(q), np.zeros(q), np.zeros(q)
    first[j[i == 0]], last[i[j == q - 1]], diag[i[i == j]] = s[i == 0], s[j == q - 1], s[i == j]
    n = first[0]
    spread = (diag - first**2 / max(n, 1e-300))[1 : p + 1]
    live, wanted, note = _usable(n, spread, diag[1 : p + 1], d)
    if note:
        return n, None, None, None, note
    sd = np.sqrt(spread[live])
    keep, block, scale = np.zeros(p + 1, bool), np.zeros(p + 1, bool), np.ones(p + 1)
    keep[0], keep[live + 1], scale[0], scale[live + 1] = True, True, np.sqrt(n), sd
    lo, hi = d.block()
    block[lo + 1 : hi + 1] = True
    inner = j <= p
    system = Reduced(i[inner], j[inner], s[inner], keep, block, scale)
    null = np.linalg.qr(system.null[live + 1])[0]

    def solved(right: np.ndarray) -> np.ndarray:
        """Least-norm solutions among the columns without the intercept."""
        lifted = np.zeros((p + 1, right.shape[1]))
        lifted[live + 1] = right
        x = system.solve(lifted)[live + 1]
        return x - null @ (null.T @ x)

    right = ((last - first * last[0] / n)[live + 1] / sd)[:, None]
    b = solved(right - null @ (null.T @ right))[:, 0]
    left_over = max(diag[q - 1] - last[0] ** 2 / n - b @ right[:, 0], 0.0)

    def size(columns: np.ndarray) -> np.ndarray:
        ones = -null @ null[columns].T
        ones[columns, np.arange(len(columns))] += 1.0
        return (ones * solved(ones)).sum(0)

    room = np.maximum(1.0 - (null**2).sum(1), 0.0)  # the columns are scaled to 1, so a spread is at least this squared
    return _estimate(n, b, n - (len(live) - null.shape[1]) - 1, left_over, room**2, size, sd, live, wanted, d)


def _estimate(n, b, dof, left_over, low, size: Callable, sd, live, wanted, d: Design) -> tuple:
    """(n, effect, p, column, note) of the predictor with the least p; among equal p (several may be 0) the first column."""
    at, p = least_p(b, wanted, low, size, lambda t2: t_two_sided(dof / (dof + t2), dof) if dof > 0 else np.nan, left_over / dof if dof > 0 else np.nan)
    return n, float(b[at] / sd[at] * (d.outcome.scale / d.scales()[live[at]])), p, d.name(int(live[at])), ""


def least_squares(frame: DataFrame, designs: list[Design], weights: Weights) -> DataFrame:
    """Main coefficient and p per hypothesis and replicate; wide categories of the plain sample are projected out first."""
    by_pos = {d.pos: d for d in designs}

    def solve(pos: int, rep: int, sums: Sums) -> tuple:
        d = by_pos[pos]
        return (pos, rep, *(_wide_least_squares(*sums.places(), d) if d.width() > WIDE else _least_squares(sums.whole, d)))

    done = []
    if weights.kind == "ones":
        for d in designs:
            if d.width() > WIDE and (found := absorbed(frame, d)) is not None:
                done.append((d.pos, 0, *found))
    known = small_frame(frame.sparkSession, done, RESULT)
    rest = [d for d in designs if d.pos not in {r[0] for r in done}]
    return known.unionByName(gathered(cross_products(frame, rest, weights), len(rest) * weights.count(), solve, RESULT)) if rest else known


# ---- logistic -----------------------------------------------------------------------------------

SINGULAR = "regression_fit_failed:LinAlgError:Singular matrix"


def _logistic_note(n: float, ones: float, live: np.ndarray, d: Design) -> str:
    if n < 3:
        return "too_few_complete_cases_for_regression"
    if not live.any():
        return "all_predictor_columns_constant"
    if not (live & d.is_predictor()).any():
        return "no_predictor_columns_in_design_matrix"
    return "" if 0 < ones < n else "binary_outcome_has_less_than_2_classes_after_cleanup"


def _varies(n: float, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (squares - total**2 / n) > 1e-12 * squares


def _logistic_estimate(n: float, beta: np.ndarray, live: np.ndarray, low: np.ndarray, size: Callable, d: Design) -> tuple:
    """(n, effect, p, column, note); `beta` and `low` hold the live columns."""
    at, p = least_p(beta, d.is_predictor()[live], low, size, lambda z2: normal_two_sided(np.sqrt(z2)), 1.0)
    return n, float(beta[at] / d.scales()[np.flatnonzero(live)[at]]), p, d.name(int(np.flatnonzero(live)[at])), ""


def logistic(frame: DataFrame, designs: list[Design], weights: Weights) -> DataFrame:
    """Main coefficient and p per hypothesis and replicate, by Newton's method.

    Narrow designs step together, one scan for all that still move; of them the driver holds the coefficients.
    """
    parts = [_narrow_logistic(frame, some, weights)] if (some := [d for d in designs if d.width() <= WIDE]) else []
    parts += [_wide_logistic(frame, d, weights) for d in designs if d.width() > WIDE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _narrow_logistic(frame: DataFrame, designs: list[Design], weights: Weights) -> DataFrame:
    spark, reps = frame.sparkSession, weights.count()
    widths = {d.pos: d.width() + 1 for d in designs}
    beta = {p: np.zeros((w, reps)) for p, w in widths.items()}
    note, live, cases, moving = {}, {}, {}, {d.pos: np.zeros(reps, bool) for d in designs}
    by_pos = {d.pos: d for d in designs}
    for r in _column_sums(frame, designs, weights).collect():
        pos, rep, w = r["pos"], r["rep"], widths[r["pos"]]
        found = np.frombuffer(r["s"])
        live[pos, rep], cases[pos, rep] = _varies(found[0], found[1:w], found[w + 1 : 2 * w]), found[0]
        note[pos, rep] = _logistic_note(found[0], found[2 * w], live[pos, rep], by_pos[pos])
        moving[pos][rep] = not note[pos, rep]
    for d in designs:  # without any row
        for rep in range(reps):
            if note.setdefault((d.pos, rep), "too_few_complete_cases_for_regression"):
                cases.setdefault((d.pos, rep), 0.0)
    curvature: dict[tuple[int, int], np.ndarray] = {}
    for _ in range(NEWTON_STEPS):
        todo = [d for d in designs if moving[d.pos].any()]
        if not todo:
            break
        for r in _newton_steps(frame, todo, weights, beta, moving, live):
            pos, rep = r["pos"], r["rep"]
            if r["step"] is None:
                note[pos, rep] = SINGULAR
                moving[pos][rep] = False
                continue
            step = np.frombuffer(r["step"])
            beta[pos][np.append(True, live[pos, rep]), rep] += step
            curvature[pos, rep] = np.frombuffer(r["spread"])
            moving[pos][rep] = np.max(np.abs(step)) >= NEWTON_TOLERANCE
    out = []
    for (pos, rep), why in sorted(note.items()):
        if why:
            out.append((pos, rep, cases[pos, rep], None, None, None, why))
            continue
        spread, mine = curvature[pos, rep][1:], live[pos, rep]
        out.append((pos, rep, *_logistic_estimate(cases[pos, rep], beta[pos][1:, rep][mine], mine, spread, lambda c, v=spread: v[c], by_pos[pos])))
    return small_frame(spark, out, RESULT)


def _column_sums(frame: DataFrame, designs: list[Design], weights: Weights) -> DataFrame:
    """(pos, rep, s): weighted sums of (1, X), of their squares, and of y, packed."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            w = weights.matrix(pdf["h"].to_numpy()).astype(float)
            for d in designs:
                x, y, ok = d.rows(pdf)
                z = np.column_stack([ok.astype(float), x])
                part = np.vstack([z.T @ w, (z * z).T @ w, y @ w])
                total[d.pos] = total[d.pos] + part if d.pos in total else part
        for pos, sums in total.items():
            yield _packed(pos, sums)

    return gathered(frame.mapInPandas(partial, PARTIAL), len(designs) * weights.count(), lambda pos, rep, sums: (pos, rep, sums.whole.tobytes()), "pos int, rep int, s binary")


def _newton_steps(frame, designs, weights, beta, moving, live) -> list:
    """Newton step and diagonal of the inverse curvature, per hypothesis and replicate still moving.

    Sums are added and solved per (hypothesis, replicate); a singular system gives no step.
    """
    coefs = {d.pos: beta[d.pos].copy() for d in designs}
    active = {d.pos: np.flatnonzero(moving[d.pos]) for d in designs}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            w_all = weights.matrix(pdf["h"].to_numpy()).astype(float)
            for d in designs:
                x, y, ok = d.rows(pdf)
                z = np.column_stack([ok.astype(float), x])
                w = w_all[:, active[d.pos]] * ok[:, None]
                mu = 1.0 / (1.0 + np.exp(-np.clip(z @ coefs[d.pos][:, active[d.pos]], -500, 500)))
                part = np.vstack([z.T @ (w * (y[:, None] - mu)), _moments(z, w * mu * (1.0 - mu))])
                total[d.pos] = total[d.pos] + part if d.pos in total else part
        for pos, sums in total.items():
            yield _packed(pos, sums)

    def solve(pos: int, nth: int, sums: Sums) -> tuple:
        rep, p = int(active[pos][nth]), len(coefs[pos])
        keep = np.append(True, live[pos, rep])
        h = _square(sums.whole[p:], p)[np.ix_(keep, keep)]
        step = spread = None
        try:
            inverse = np.linalg.inv(h)
            if np.isfinite(inverse).all() and np.linalg.cond(h) <= 1e15:
                step, spread = (inverse @ sums.whole[:p][keep]).tobytes(), np.ascontiguousarray(np.diag(inverse)).tobytes()
        except np.linalg.LinAlgError:
            pass
        return pos, rep, step, spread

    groups = int(sum(len(a) for a in active.values()))
    return gathered(frame.mapInPandas(partial, PARTIAL), groups, solve, "pos int, rep int, step binary, spread binary").collect()


#: What a replicate of a wide design has come to; `beta` holds all columns and the intercept, `live` a byte for each.
STATE = "pos int, rep int, n double, beta binary, live binary, moving boolean, effect double, p_value double, main_column string, note string"


def _wide_logistic(frame: DataFrame, d: Design, weights: Weights) -> DataFrame:
    """Newton's method with coefficients in tables.

    Each step joins the rows with the coefficients of their levels (one packed row of replicates per column), adds up the
    products that occur, and solves each replicate sparsely in a task. The driver sees which replicates still move, and the
    coefficients of numbers.
    """
    reps, p = weights.count(), d.width() + 1
    starts = [s + 1 for s in d.starts()]
    numbers = [0] + [s for s, t in zip(starts, d.terms) if not t.categories]
    levels = [(s, t) for s, t in zip(starts, d.terms) if t.categories]

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _held(batches):
            columns, values, y, _ = d.entries(pdf)
            w, own = weights.matrix(pdf["h"].to_numpy()), np.arange(len(y))
            at = np.repeat(own, columns.shape[1])
            parts = [(columns.ravel(), values.ravel(), at), (p + columns.ravel(), values.ravel() ** 2, at), (np.full(len(y), 2 * p), y, own)]
            yield from _sparse(d.pos, parts, [w] * 3)

    def start(pos: int, rep: int, sums: Sums) -> tuple:
        k, s = sums.places()
        found = np.zeros(2 * p + 1)
        found[k] = s
        live = _varies(found[0], found[1:p], found[p + 1 : 2 * p])
        note = _logistic_note(found[0], found[2 * p], live, d)
        return pos, rep, found[0], np.zeros(p).tobytes(), live.tobytes(), not note, None, None, None, note

    state = pin(gathered(frame.mapInPandas(totals, PARTIAL), reps, start, STATE))
    done = [state.filter(~F.col("moving"))]
    for step in range(NEWTON_STEPS):
        last = step + 1 == NEWTON_STEPS
        state = state.filter("moving")
        active = sorted(r["rep"] for r in state.select("rep").collect())  # numbers of replicates
        if not active:
            break
        few = np.zeros((len(numbers), len(active)))
        rows = frame
        if step:
            few = _few(state, active, numbers)
            table = _by_column(state, active, p)
            for at, t in levels:
                found = table.select(F.col("column").alias("__at"), F.col("values").alias(f"b_{t.column}"))
                rows = rows.join(found, F.col("__at") == F.when(F.col(t.column) > 0, F.col(t.column) + (at - 1)).cast("bigint"), "left").drop("__at")
        sums = rows.mapInPandas(_wide_partial(d, weights, active, few, bool(step)), PARTIAL)
        # the state of a replicate comes first in its group, marked by the key -1
        known = state.select("pos", "rep", F.lit(b"").alias("k"), F.concat("beta", "live").alias("s"), F.lit(0).alias("kind"))
        stream = known.unionByName(sums.withColumn("kind", F.lit(1)))
        state = pin(_stepped(stream, d, last, len(active), state))
        done.append(state.filter(~F.col("moving")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("pos", "rep", "n", "effect", "p_value", "main_column", "note")


def _few(state: DataFrame, active: list[int], numbers: list[int]) -> np.ndarray:
    """Coefficients of the intercept and of numbers, one column per replicate."""
    values = [F.substring("beta", 8 * at + 1, 8).alias(f"v{i}") for i, at in enumerate(numbers)]
    out = np.zeros((len(numbers), len(active)))
    for r in state.select("rep", *values).collect():
        out[:, active.index(r["rep"])] = [np.frombuffer(r[f"v{i}"])[0] for i in range(len(numbers))]
    return out


def _by_column(state: DataFrame, active: list[int], p: int) -> DataFrame:
    """(column, values): the coefficients of each column in all replicates, packed. Vectors are cut into blocks, so no task holds a whole one of each replicate."""
    nth = {rep: i for i, rep in enumerate(active)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep, beta in zip(pdf["rep"].tolist(), pdf["beta"]):
                for at in range(0, p, BLOCK):
                    yield pd.DataFrame({"block": [at // BLOCK], "rep": [rep], "beta": [beta[8 * at : 8 * (at + BLOCK)]]})

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        side = np.zeros((len(group["beta"].iloc[0]) // 8, len(active)))
        for rep, beta in zip(group["rep"].tolist(), group["beta"]):
            side[:, nth[rep]] = np.frombuffer(beta)
        first = int(group["block"].iloc[0]) * BLOCK
        return pd.DataFrame({"column": first + np.arange(len(side)), "values": [r.tobytes() for r in side]})

    return state.select("rep", "beta").mapInPandas(cut, "block bigint, rep int, beta binary").groupBy("block").applyInPandas(turn, "column bigint, values binary")


def _wide_partial(d: Design, weights: Weights, active: list[int], few: np.ndarray, looked_up: bool) -> Callable:
    p, reps = d.width() + 1, len(active)
    narrow = [c for c, t in enumerate(d.terms) if not t.categories]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _held(batches):
            columns, values, y, ok = d.entries(pdf)
            at = np.repeat(np.arange(len(y)), columns.shape[1])
            eta = np.column_stack([values[:, 0], *[values[:, c + 1] for c in narrow]]) @ few
            for t in (t for t in d.terms if t.categories and looked_up):
                some = np.flatnonzero(pdf[f"b_{t.column}"].notna().to_numpy() & ok)
                if len(some):
                    eta[some] += np.frombuffer(b"".join(pdf[f"b_{t.column}"].iloc[some])).reshape(len(some), reps)
            w = weights.matrix(pdf["h"].to_numpy())[:, active] * ok[:, None]
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
            keys, products, rows = _pairs(columns, values, p)
            for part in _sparse(d.pos, [(columns.ravel(), values.ravel(), at), (p + keys, products, rows)], [w * (y[:, None] - mu), w * mu * (1.0 - mu)]):
                yield part.assign(rep=active[int(part["rep"].iloc[0])])

    return run


def _stepped(stream: DataFrame, d: Design, last: bool, groups: int, state: DataFrame) -> DataFrame:
    """The next state of each replicate; those that are done have their estimate."""
    p = d.width() + 1
    cases = {r["rep"]: r["n"] for r in state.select("rep", "n").collect()}  # a number per replicate
    lo, hi = d.block()
    block = np.zeros(p, bool)
    block[lo + 1 : hi + 1] = True

    def each(rep: int, known: bytes, sums: Sums) -> tuple:
        beta, live = np.frombuffer(known[: 8 * p]).copy(), np.frombuffer(known[8 * p :], bool)
        k, s = sums.places()
        gradient = np.zeros(p)
        gradient[k[k < p]] = s[k < p]
        i, j = _unpack(k[k >= p] - p, p)
        h = s[k >= p]
        keep, own = np.append(True, live), np.zeros(p)
        own[i[i == j]] = h[i == j]
        failed = (d.pos, rep, cases[rep], beta.tobytes(), live.tobytes(), False, None, None, None, SINGULAR)
        if own[keep].min() <= 1e-15 * own[keep].max():
            return failed
        scale = np.where(own > 0, np.sqrt(own), 1.0)
        system = Reduced(i, j, h, keep, block, scale)
        if system.null.shape[1]:
            return failed
        step = system.solve((gradient / scale)[:, None])[:, 0] / scale
        if not np.isfinite(step).all():
            return failed
        beta[keep] += step[keep]
        if np.max(np.abs(step[keep])) >= NEWTON_TOLERANCE and not last:
            return d.pos, rep, cases[rep], beta.tobytes(), live.tobytes(), True, None, None, None, ""
        at = np.flatnonzero(live) + 1

        def size(columns: np.ndarray) -> np.ndarray:
            ones = np.zeros((p, len(columns)))
            ones[at[columns], np.arange(len(columns))] = 1.0
            return (ones * system.solve(ones)).sum(0) / scale[at[columns]] ** 2

        _, effect, pv, name, _ = _logistic_estimate(cases[rep], beta[at], live, 1 / own[at], size, d)
        return d.pos, rep, cases[rep], beta.tobytes(), live.tobytes(), False, effect, pv, name, ""

    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, sums = None, b"", Sums()
        for pdf in batches:
            for rep, kind, k, s in zip(pdf["rep"].tolist(), pdf["kind"].tolist(), pdf["k"], pdf["s"]):
                if rep != now:
                    if now is not None:
                        yield pd.DataFrame([each(now, known, sums)], columns=names)
                    now, sums = rep, Sums()
                if kind:
                    sums.add(k, s)
                else:
                    known = s
        if now is not None:
            yield pd.DataFrame([each(now, known, sums)], columns=names)

    n = max(1, min(groups, 4 * stream.sparkSession.sparkContext.defaultParallelism))
    return stream.repartition(n, "rep").sortWithinPartitions("rep", "kind").mapInPandas(run, STATE)
