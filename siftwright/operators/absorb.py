"""Least squares with one or two categories of very many levels, of which no task holds more than a chunk.

The categories are projected out of the other columns (Frisch, Waugh, Lovell). The widest is averaged out level by level. With a second
one, conjugate gradients over its levels do the rest: the cells (level, level) lie in chunks of a fixed size, the vectors in blocks of a table, and each
step sends a chunk just the entries that it has cells for. The driver sees sums of a few numbers per block or chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.tails import t_two_sided
from siftwright.plans.materialize import pin, unpin

#: Levels from which on a category is projected out, and columns that the others may have together.
MANY, DENSE = 256, 64
#: Entries of one block of a vector (65,536 at most), cells of a chunk with sums of two columns, and entries that a block sends at once.
BLOCK, CELLS, DEALT = 4096, 1 << 19, 1 << 19
#: Relative size of what conjugate gradients leave, their steps, and of a column's spread that counts as none.
LEFT, STEPS, FLAT = 1e-10, 400, 1e-8


def _numbers(b: bytes, kind=float) -> np.ndarray:
    return np.frombuffer(b, kind)


def _dense(d, terms: list, pdf: pd.DataFrame) -> np.ndarray:
    """(1, Z, y) of a batch, incomplete rows zeroed."""
    z = np.column_stack([np.ones(len(pdf)), *[t.values(pdf) for t in terms], d.outcome.values(pdf)[:, 0]])
    return np.where(np.isnan(z).any(axis=1)[:, None], 0.0, z)


def _added(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all batches of a small array, one row per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                now = part(pdf)
                total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"s": [np.ascontiguousarray(total).tobytes()]})

    found = [_numbers(r["s"]) for r in rows.mapInPandas(run, "s binary").collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)


def _cells(frame: DataFrame, d, terms: list, keys: list) -> DataFrame:
    """(k0, ..., n, s0, ..., sk): complete rows of each tuple of levels and their sums of Z and y; levels without a name are the first."""
    columns = []
    for t in terms:
        columns += [F.coalesce((F.col(t.column) == i).cast("double"), F.lit(0.0)) for i in range(1, t.categories)] if t.categories else [(F.col(t.column) - t.centre) / t.scale]
    columns.append((F.col(d.outcome.column) - d.outcome.centre) / d.outcome.scale)
    whole = F.lit(True)
    for c in [d.outcome.column, *[t.column for t in terms if not t.categories]]:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    named = [F.coalesce(F.col(t.column), F.lit(0)).cast("bigint").alias(f"k{i}") for i, t in enumerate(keys)]
    rows = frame.filter(whole).select(*named, *[c.alias(f"s{i}") for i, c in enumerate(columns)])
    return rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))])


def absorbed(frame: DataFrame, d) -> tuple | None:
    """(n, effect, p, column, note) of an unweighted design, or None where the general solver has to find it.

    That is where columns are collinear, a predictor is one of two wide categories, there are three of those, or too few rows.
    """
    wide = sorted((t for t in d.terms if t.categories >= MANY), key=lambda t: -t.categories)
    terms = [t for t in d.terms if t.categories < MANY]
    k = sum(t.width for t in terms)
    if not 1 <= len(wide) <= 2 or k > DENSE or d.strict_parity or len({t.column for t in d.terms}) < len(d.terms):
        return None
    wanted = wide[0].source in d.predictors
    if len(wide) == 2 and (wanted or wide[1].source in d.predictors):
        return None
    at = dict(zip([t.column for t in d.terms], d.starts()))
    place = np.array([at[t.column] + i for t in terms for i in range(t.width)], int)
    predictor = np.repeat(np.array([t.source in d.predictors for t in terms], bool), [t.width for t in terms])  # nothing here is as long as a wide category
    scale = np.repeat(np.array([t.scale for t in terms], float), [t.width for t in terms])
    if not wanted and not predictor.any():
        return None
    g = _added(frame.select(d.outcome.column, *[t.column for t in terms if t.column != d.outcome.column]), lambda pdf: (lambda z: z.T @ z)(_dense(d, terms, pdf))).reshape(-1, k + 2)
    if not len(g) or g[0, 0] < 3:
        return None
    n = g[0, 0]
    spread = (np.diag(g) - g[0] ** 2 / n)[1:]
    live = np.flatnonzero(spread[:k] > 1e-12 * np.diag(g)[1 : k + 1])
    if not wanted and not predictor[live].any():
        return None
    cells = pin(_cells(frame, d, terms, wide))
    got = _one(cells, k) if len(wide) == 1 else _two(cells, k)
    if got is None or got[1] < 2:
        return None
    left, rank = g[1:, 1:] - got[0], got[1]
    sd = np.sqrt(spread[live])
    corr = left[np.ix_(live, live)] / np.outer(sd, sd)
    if len(live) and np.linalg.eigvalsh(corr).min() < FLAT:
        return None
    inverse = np.linalg.inv(corr) / np.outer(sd, sd) if len(live) else np.zeros((0, 0))
    b = inverse @ left[live, k]
    dof, rest = n - rank - len(live), left[k, k] - b @ left[live, k]
    if dof <= 0 or not rest > 1e-10 * spread[k]:
        return None
    noise, p_of = rest / dof, lambda t2: t_two_sided(dof / (dof + t2), dof)
    zero = _underflow(p_of)
    own = predictor[live]
    tested = [(t2, c, x) for t2, c, x in zip(b[own] ** 2 / (noise * np.diag(inverse)[own]), place[live][own], b[own] / scale[live][own])]
    if wanted:
        base = cells.filter("k0 = 0").collect()
        if not base:
            return None
        tested += [(t2, at[wide[0].column] + c - 1, x) for t2, c, x in _levels(cells, base[0], live, b, inverse, noise, zero)]
    sure = [x for x in tested if x[0] >= zero]
    t2, column, coef = min(sure, key=lambda x: x[1]) if sure else max(tested, key=lambda x: (x[0], -x[1]))
    return float(n), float(coef * d.outcome.scale), 0.0 if sure else float(p_of(t2)), d.name(int(column)), ""


def _underflow(p_of: Callable) -> float:
    """The t^2 from which on p is 0; infinite if it never is."""
    near, far = 0.0, 1.0
    while p_of(far) > 0:
        if far > 1e300:
            return np.inf
        near, far = far, far * 2
    while far - near > 1e-12 * far:
        middle = (near + far) / 2
        near, far = (near, middle) if p_of(middle) == 0 else (middle, far)
    return far


def _sums(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[[c for c in pdf.columns if c[0] == "s"]].to_numpy(float)


def _one(cells: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """What the level means explain of the products of (Z, y), and how many levels have rows."""

    def part(pdf: pd.DataFrame) -> np.ndarray:
        s = _sums(pdf)
        return np.append((s.T @ (s / pdf["n"].to_numpy()[:, None])).ravel(), len(pdf))

    found = _added(cells, part)
    return found[:-1].reshape(k + 1, k + 1), int(found[-1])


def _levels(cells: DataFrame, base, live: np.ndarray, b: np.ndarray, inverse: np.ndarray, noise: float, zero: float) -> list[tuple]:
    """(t^2, level, coefficient) of the strongest level of each task against the first level, and of its first whose p is 0."""
    base_s = np.array([base[f"s{i}"] for i in range(len(base) - 2)]) / base["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple] = []
        for pdf in batches:
            pdf = pdf[pdf["k0"] > 0]
            if not len(pdf):
                continue
            n, code = pdf["n"].to_numpy(), pdf["k0"].to_numpy()
            off = _sums(pdf) / n[:, None] - base_s
            z = off[:, live]
            coef = off[:, -1] - z @ b
            t2 = coef**2 / (noise * (1 / n + 1 / base["n"] + ((z @ inverse) * z).sum(1)))
            top = np.flatnonzero(t2 == t2.max())
            picks = [top[np.argmin(code[top])]]
            if t2.max() >= zero:
                sure = np.flatnonzero(t2 >= zero)
                picks.append(sure[np.argmin(code[sure])])
            best += [(t2[i], code[i], coef[i]) for i in picks]
            best = [max(best, key=lambda x: (x[0], -x[1]))] + [min(some, key=lambda x: x[1]) for some in [[x for x in best if x[0] >= zero]] if some]
        if best:
            yield pd.DataFrame(best, columns=["t2", "code", "coef"])

    return [tuple(r) for r in cells.mapInPandas(run, "t2 double, code bigint, coef double").collect()]


# ---- two categories -----------------------------------------------------------------------------


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 is linked with by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        a, b = a[ra != rb], b[ra != rb]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


def _chunks(cells: DataFrame, m: int, size: int, parts: int) -> DataFrame:
    """(chunk, names, blocks, ends, local, heads, n, comp, v, fact): whole levels of the first category.

    `names` are the levels of the second that occur, up to `ends` in each of `blocks`; `local` says which each cell has, `comp` which of them
    hang together here. By name, `v` adds up n and the sums less what the first category explains; `fact` has the products so explained, and the number of levels.
    """

    def packed(number: int, pdf: pd.DataFrame) -> pd.DataFrame:
        a, n, s = pdf["k0"].to_numpy(), pdf["n"].to_numpy(), _sums(pdf)
        names, local = np.unique(pdf["k1"].to_numpy(), return_inverse=True)
        new = np.append(True, a[1:] != a[:-1])
        heads, same = np.flatnonzero(new), np.flatnonzero(~new)
        total, of = np.add.reduceat(s, heads, axis=0), np.add.reduceat(n, heads)
        means, owner = total / of[:, None], np.cumsum(new) - 1
        v = np.column_stack([np.bincount(local, c, len(names)) for c in (n, *(s[:, j] - n * means[owner, j] for j in range(m)))])
        comp = joined(len(names), local[same - 1], local[same])
        blocks = names // BLOCK
        ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(names))
        n = n.astype(np.uint32) if n.max() < 1 << 32 else n
        values = [names, blocks[ends - 1], ends, local.astype(np.int32), heads.astype(np.int32), n, comp.astype(np.int32), v, np.append((total.T @ means).ravel(), float(len(heads)))]
        return pd.DataFrame([(number, *[np.ascontiguousarray(x).tobytes() for x in values])], columns=["chunk", "names", "blocks", "ends", "local", "heads", "n", "comp", "v", "fact"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for pdf in batches:
            a = pdf["k0"].to_numpy()
            if rows >= 2 * size and len(pdf):  # a partition holds about `size`
                last = held[-1]["k0"].iloc[-1]
                cut = int(np.searchsorted(a, last, side="right"))
                held.append(pdf.iloc[:cut])
                rows += cut
                if cut < len(pdf):
                    yield packed(number, pd.concat(held, ignore_index=True))
                    number, held, rows = number + 1, [], 0
                pdf = pdf.iloc[cut:]
            if len(pdf):
                held.append(pdf)
                rows += len(pdf)
        if held:
            yield packed(number, pd.concat(held, ignore_index=True))

    made = cells.repartition(parts, "k0").sortWithinPartitions("k0", "k1")
    return pin(made.mapInPandas(run, "chunk bigint, names binary, blocks binary, ends binary, local binary, heads binary, n binary, comp binary, v binary, fact binary"))


def _pieces(row, values: dict[str, np.ndarray]) -> pd.DataFrame:
    """What a chunk has by name, cut by block."""
    blocks, ends = _numbers(row.blocks, np.int64), _numbers(row.ends, np.int64).tolist()
    spans = list(zip([0, *ends[:-1]], ends))
    return pd.DataFrame({"block": blocks, "chunk": row.chunk, **{c: [v[i:j].tobytes() for i, j in spans] for c, v in values.items()}})


def _through(row, x: np.ndarray, m: int) -> np.ndarray:
    """For the entries (names x m) that a chunk was sent: averaged over each level of the first category and added up by name again.

    A column more holds labels; of those each name gets the least that it hangs together with.
    """
    local, heads = _numbers(row.local, np.int32), _numbers(row.heads, np.int32)
    n = _numbers(row.n, np.uint32 if len(row.n) == len(row.local) else float).astype(float)
    owner, of = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(n)))), np.add.reduceat(n, heads)
    out = np.empty(x.shape)
    for j in range(m):
        means = np.add.reduceat(n * x[local, j], heads) / of
        out[:, j] = np.bincount(local, n * means[owner], len(x))
    if x.shape[1] > m:
        comp, least = _numbers(row.comp, np.int32), np.full(len(x), np.inf)
        np.minimum.at(least, comp, x[:, m])
        out[:, m] = least[comp]
    return out


#: What a block of the second category's levels holds: which chunks ask for how many of its entries, and for which; then vectors, a label by level, and sums for the driver.
STATE = "block bigint, chunks binary, sizes binary, at binary, root binary, g binary, x binary, r binary, p binary, q binary, label binary, facts binary"
NAMES = [f.split()[0] for f in STATE.split(", ")]


def _started(pieces: pd.DataFrame, m: int) -> pd.DataFrame:
    """The first state of a block from (chunk, at, v) of all chunks that have cells in it."""
    pieces = pieces.sort_values("chunk")
    at, v = _numbers(b"".join(pieces["at"]), np.uint16), _numbers(b"".join(pieces["v"])).reshape(-1, m + 1)
    found = np.column_stack([np.bincount(at, c, BLOCK) for c in v.T])
    root = np.sqrt(found[:, :1])
    g = np.divide(found[:, 1:], root, out=np.zeros((BLOCK, m)), where=root > 0)
    block = int(pieces["block"].iloc[0])
    label = np.where(root[:, 0] > 0, block * BLOCK + np.arange(BLOCK), -1).astype(float)
    sizes = np.array([len(b) // 2 for b in pieces["at"]], np.int64)
    values = [pieces["chunk"].to_numpy(np.int64), sizes, at, root, g, np.zeros((BLOCK, m)), g, g, np.zeros((BLOCK, m)), label, np.zeros(0)]
    return pd.DataFrame([(block, *[np.ascontiguousarray(x).tobytes() for x in values])], columns=NAMES)


def _moved(row, m: int, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual and direction of a block after a step of conjugate gradients."""
    r, p, q = (_numbers(v).reshape(-1, m) for v in (row.r, row.p, row.q))
    r = r - alpha * q
    return r, r + beta * p


def _dealt(row, v: np.ndarray) -> Iterator[pd.DataFrame]:
    """The entries of a block that each chunk asks for, about DEALT at a time."""
    chunks, ends, at = _numbers(row.chunks, np.int64), np.cumsum(_numbers(row.sizes, np.int64)), _numbers(row.at, np.uint16)
    of = ends // DEALT
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
    for i, j in zip(heads, [*heads[1:], len(chunks)]):
        begins = np.append(ends[i - 1] if i else 0, ends[i:j - 1])
        yield pd.DataFrame({"chunk": chunks[i:j], "block": row.block, "v": [v[at[s:e]].tobytes() for s, e in zip(begins.tolist(), ends[i:j].tolist())]})


def _two(cells: DataFrame, k: int) -> tuple[np.ndarray, int] | None:
    """What two categories explain of the products of (Z, y), and the rank of both.

    That is g'S+g for the matrix S of the second category after the first, scaled to a diagonal of 1; one pass over the chunks
    per step of conjugate gradients. Each part that levels fall into has one direction without an estimate: passes also spread the least label.
    """
    m = k + 1
    count, size = cells.count(), max(1, 3 * CELLS // (m + 1))
    made = _chunks(cells, m, size, max(1, -(-count // size)))
    explained = np.sum([_numbers(r["fact"]) for r in made.select("fact").collect()], axis=0)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                names, v = _numbers(row.names, np.int64), _numbers(row.v).reshape(-1, m + 1)
                yield _pieces(row, {"at": (names % BLOCK).astype(np.uint16), "v": v})

    dealt = made.select("chunk", "names", "blocks", "ends", "v").mapInPandas(pieces, "block bigint, chunk bigint, at binary, v binary")
    state = pin(dealt.groupBy("block").applyInPandas(lambda pdf: _started(pdf, m), STATE))
    chunks = made.drop("names", "v", "fact").repartition(made.count(), "chunk").persist(StorageLevel.DISK_ONLY)
    alpha = beta = np.zeros(m)
    goal, moving, step = None, True, 0
    try:
        while True:
            step += 1
            after = _passed(state, chunks, m, alpha, beta, moving)
            unpin(state)
            state = after
            facts = np.sum([_numbers(r["facts"]) for r in state.select("facts").collect()], axis=0)
            rr, pq, rq, qq = facts[: 4 * m].reshape(4, m)
            moving = moving and facts[-3] > 0
            goal = rr * LEFT**2 if goal is None else goal
            calm = (rr <= goal).all()
            if calm and not moving:
                return (explained[:-1] + facts[4 * m : -3]).reshape(m, m), int(explained[-1] + facts[-2] - facts[-1])
            if not calm and step >= STEPS:
                return None
            go = (rr > goal) & (pq > 0)
            alpha = np.divide(rr, pq, out=np.zeros(m), where=go)
            beta = np.divide(np.maximum(rr - 2 * alpha * rq + alpha**2 * qq, 0.0), rr, out=np.zeros(m), where=go)
    finally:
        chunks.unpersist()
        unpin(state)


def _passed(state: DataFrame, chunks: DataFrame, m: int, alpha: np.ndarray, beta: np.ndarray, moving: bool) -> DataFrame:
    """The state after a step of `alpha` and `beta`, with its product with S; each chunk is sent just the entries that it has cells for."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                root, p = _numbers(row.root)[:, None], _moved(row, m, alpha, beta)[1]
                v = np.divide(p, root, out=np.zeros(p.shape), where=root > 0)
                yield from _dealt(row, np.column_stack([v, _numbers(row.label)]) if moving else v)

    def answered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples(index=False))
        x = _numbers(b"".join(right.sort_values("block")["v"])).reshape(-1, m + moving)
        return _pieces(row, {"v": _through(row, x, m)})

    def times(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples(index=False))
        root, g, at = _numbers(row.root)[:, None], _numbers(row.g).reshape(-1, m), _numbers(row.at, np.uint16)
        x = _numbers(row.x).reshape(-1, m) + alpha * _numbers(row.p).reshape(-1, m)
        r, p = _moved(row, m, alpha, beta)
        v = _numbers(b"".join(right.sort_values("chunk")["v"])).reshape(len(at), -1)
        back = np.column_stack([np.bincount(at, v[:, j], BLOCK) for j in range(m)])
        q = p - np.divide(back, root, out=np.zeros(p.shape), where=root > 0)
        old = _numbers(row.label)
        label = old.copy()
        if moving:
            np.minimum.at(label, at, v[:, m])
        parts = [(label < old).sum(), (label >= 0).sum(), (label == row.block * BLOCK + np.arange(BLOCK)).sum()]
        facts = np.concatenate([(r * r).sum(0), (p * q).sum(0), (r * q).sum(0), (q * q).sum(0), (x.T @ g).ravel(), parts])
        return pd.DataFrame([(row.block, row.chunks, row.sizes, row.at, row.root, row.g, *[np.ascontiguousarray(z).tobytes() for z in (x, r, p, q, label, facts)])], columns=NAMES)

    sent = state.select("block", "chunks", "sizes", "at", "root", "r", "p", "q", "label").mapInPandas(asked, "chunk bigint, block bigint, v binary")
    back = (chunks if moving else chunks.drop("comp")).groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInPandas(answered, "block bigint, chunk bigint, v binary")
    return pin(state.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(times, STATE))
