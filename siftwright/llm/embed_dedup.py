"""Near-duplicate vectors by product quantisation, with an exact cosine test of what it proposes.

Vectors are scaled to length one; equal vectors are one item. Leaders (a bounded sample of items) are the coarse
inverted lists. What is left after subtracting the leader is coded in SUBSPACES parts of up to CODES codewords each, learned
from the same sample. An item is stored in its nearest list and asks every list that a partner may
lie in: a partner within the radius of the threshold lies in another list only if the bisector of the two
leaders is that near, which is a proof, and the bound for vectors that fill few dimensions. Of a deviation spread like the sample's
residuals a bisector sees less, as much as their covariance has in its direction; lists within SIGMAS of that are
asked, and never more than the proof needs. In a list distances come from table look-ups. The length of the coding
error is kept per item, so by the triangle inequality no partner is lost there. Survivors get
the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import pin
from siftwright.llm.components import Forest, components
from siftwright.llm.vectors import matrix, rows_of, usable

THRESHOLD = 0.95
#: Fitted on at most this many items, chosen by hash. Every item is indexed.
SAMPLE_ROWS, MAX_LISTS = 8192, 2048
SUBSPACES, CODES, SIGMAS = 8, 64, 5.0
#: Members of a list that one task compares with; longer lists are cut and their askers sent to every part.
LIST_ROWS = 4096
_PAIRS = 1 << 18


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the first scaling keeps huge and tiny numbers in range."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Leaders and residual codebooks for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, items: int, threshold: float):
        self.dim = sample.shape[1]
        self.lists = int(min(MAX_LISTS, len(sample), max(1, np.sqrt(items))))
        self.leaders = sample[: self.lists].astype(np.float32)
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        rest = sample.astype(np.float32)
        rest = rest - self.leaders[self.nearest(rest)]
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]
        self.spread = (rest.T @ rest / max(1e-12, float((rest * rest).sum()))).astype(np.float32)
        self._reach: np.ndarray | None = None
        self._gaps: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.leaders.T - (self.leaders * self.leaders).sum(1) / 2, axis=1)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they miss."""
        codes, missed = np.empty((len(rest), len(self.parts)), np.uint8), np.zeros(len(rest))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            sub = rest[:, part]
            codes[:, m] = np.argmin((book * book).sum(1) - 2 * sub @ book.T, axis=1)
            missed += ((sub - book[codes[:, m]]).astype(np.float64) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_reach", "_gaps")} | {"_reach": None, "_gaps": None}

    def reach(self) -> np.ndarray:
        """How far a partner can lie beyond each bisector: the radius, or SIGMAS of what residuals have in that direction."""
        if self._reach is None:
            mixed = self.leaders @ self.spread @ self.leaders.T
            own = np.diag(mixed)
            seen = np.sqrt(np.maximum(own[:, None] + own[None] - 2 * mixed, 0.0)) / self._between()
            close = self._between() < 3 * self.radius  # leaders that may be partners themselves
            self._reach = (self.radius * np.where(close, 1.0, np.minimum(1.0, SIGMAS * seen))).astype(np.float32)
        return self._reach

    def _between(self) -> np.ndarray:
        norms = (self.leaders * self.leaders).sum(1)
        return np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * self.leaders @ self.leaders.T, 1e-12))

    def asks(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists after a row's own list that it must ask; the earlier lists ask it."""
        norms = (self.leaders * self.leaders).sum(1)
        far = norms - 2 * x @ self.leaders.T
        own_far = far[np.arange(len(x)), own][:, None]
        if self._gaps is None:
            self._gaps = self._between().astype(np.float32)
        margin = (far - own_far) / (2 * self._gaps[own])
        near = margin <= self.reach()[own]
        row, other = np.nonzero(near & (np.arange(self.lists)[None] > own[:, None]))
        return row, other


def _approximate(q: Quantiser, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of askers (minus the leader) to coded members: sums of table entries."""
    total = np.zeros((len(rest), len(codes)), np.float32)
    for m, (part, book) in enumerate(zip(q.parts, q.books)):
        sub = rest[:, part]
        look_up = (sub * sub).sum(1)[:, None] + (book * book).sum(1) - 2 * sub @ book.T
        total += look_up[:, codes[:, m]]
    return total


def _links(q: Quantiser, cell: int, askers: np.ndarray, members: np.ndarray, codes: np.ndarray, missed: np.ndarray, threshold: float, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (asker, member) with an exact cosine of `threshold` or more."""
    reach = ((q.radius + missed + 1e-4) ** 2).astype(np.float32)
    step = max(1, _PAIRS // max(1, len(members)))
    for s in range(0, len(askers), step):
        part = askers[s:s + step]
        i, j = np.nonzero(_approximate(q, part.astype(np.float32) - q.leaders[cell], codes) <= reach)
        if inside:
            i, j = i[i + s < j], j[i + s < j]
        for at in range(0, len(i), _PAIRS):
            a, b = i[at:at + _PAIRS], j[at:at + _PAIRS]
            good = np.einsum("nd,nd->n", part[a], members[b]) >= threshold
            if good.any():
                yield a[good] + s, b[good]


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `table`.

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths with one another. Repeated rows are vectors like any other. A row without links is its own component; null ids never name a
    component that has another id. Extra columns are not read; an empty table gives no rows.
    """
    spark = table.sparkSession
    v = F.col(f"`{vector_col}`")
    single = isinstance(table.schema[vector_col].dataType.elementType, T.FloatType)
    v = v if single else v.cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    whole = usable("v") & F.exists("v", lambda x: x != 0.0)
    rows = pin(rows.select("id", F.when(whole, F.transform("v", lambda x: x + F.lit(0).cast("float" if single else "double"))).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.col("v").cast("string"), 256))))
    items = pin(rows.filter("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
                .withColumn("item", F.xxhash64("key")).withColumn("dim", F.size("v")))
    counts, edges = [], []
    for r in items.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        found = _near_items(items.filter(F.col("dim") == r["dim"]), int(r["dim"]), int(r["n"]), threshold, np.float32 if single else np.float64)
        edges.append(found.filter("b is not null").select("a", "b"))
        counts.append(found.filter("b is null").select(F.col("a").alias("item"), "n_links"))
    if not edges:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    link, count = edges[0], counts[0]
    for e, c in zip(edges[1:], counts[1:]):
        link, count = link.unionByName(e), count.unionByName(c)
    classes = components(link, "a", "b")
    named = items.join(classes.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = count.groupBy("item").agg(F.sum("n_links").alias("others"))
    facts = named.join(best, "root").join(linked, "item", "left").select(
        "key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    out = rows.select("id", "key").join(facts, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _near_items(items: DataFrame, dim: int, total: int, threshold: float, kind: type) -> DataFrame:
    """Rows (a, null, n_links) that add up to each item's links, and (a, b, null) links that connect the classes."""
    cut = int(min(1.0, SAMPLE_ROWS / total) * (2**62))
    sample = items.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(2**62)) <= cut).orderBy("key").limit(SAMPLE_ROWS).select("v").toPandas()
    q = Quantiser(_unit(np.array(sample["v"].tolist(), np.float64)) if len(sample) else np.eye(1, dim), total, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = np.array(rows_of(part.column(1), kind))
                x = _unit(raw).astype(np.float32)
                own = q.nearest(x)
                codes, missed = q.encode(x - q.leaders[own])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(own, pa.int32()),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed),
                ], ["item", "n", "vec", "cell", "codes", "missed"])

    coded = pin(items.select("item", "v", "n").mapInArrow(encode, "item bigint, n bigint, vec binary, cell int, codes binary, missed double"))
    sizes = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    parts = np.array([-(-sizes.get(c, 0) // LIST_ROWS) for c in range(q.lists)])
    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _unit(matrix(part.column(2).to_pylist(), dim, kind))
                row, cell = q.asks(x.astype(np.float32), np.asarray(part.column(3)))
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(cell, pa.int32()), pa.array(block, pa.int32()),
                    pa.array(np.full(len(row), -1), pa.int32()), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float64()),
                ], ["item", "n", "vec", "cell", "block", "own", "codes", "missed"])

    shape = "item bigint, n bigint, vec binary, cell int, block int, own int, codes binary, missed double"
    asking = coded.select("item", "n", "vec", "cell").mapInArrow(ask, shape)
    placed = coded.withColumn("own", F.pmod(F.xxhash64("item"), many).cast("int"))
    stored = placed.withColumn("block", F.col("own")).select(*asking.columns)
    # members of a cut list also ask the later parts of their own list
    later = placed.filter(F.lit(bool((parts > 1).any())) & (many > F.col("own") + 1)).withColumn("block", F.explode(F.sequence(F.col("own") + 1, many - 1))).select(
        "item", "n", "vec", "cell", "block", F.lit(-1).alias("own"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("missed"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        vec = _unit(matrix(rows["vec"].tolist(), dim, kind))
        is_member = rows["own"].to_numpy() >= 0
        m, a = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        item, n = rows["item"].to_numpy(), rows["n"].to_numpy()
        links, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
        if len(m):
            codes = np.frombuffer(b"".join(rows["codes"].iloc[m]), np.uint8).reshape(len(m), -1)
            missed = rows["missed"].to_numpy()[m]
            for who, inside in ((m, True), (a, False)):
                for i, j in _links(q, cell, vec[who], vec[m], codes, missed, threshold, inside):
                    x, y = who[i], m[j]
                    np.add.at(links, x, n[y])
                    np.add.at(links, y, n[x])
                    forest.add(x, y)
        x, y = forest.spanning()
        hit = np.flatnonzero(links)
        return pd.DataFrame({
            "a": np.concatenate([item[hit], item[x]]), "b": pd.array(np.concatenate([np.zeros(len(hit), np.int64), item[y]]), "Int64"),
            "n_links": pd.array(np.concatenate([links[hit], np.zeros(len(x), np.int64)]), "Int64"),
        }).assign(b=lambda d: d["b"].mask(np.arange(len(d)) < len(hit)))

    every = stored.unionByName(asking).unionByName(later)
    return pin(every.groupBy("cell", "block").applyInPandas(compare, "a bigint, b bigint, n_links bigint"))
