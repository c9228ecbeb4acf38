"""Fill-in-middle by piece tables: a document becomes descriptors over immutable buffers, and only descriptors move.

Buffer 0 is the text, buffer 1 the three sentinels. A descriptor is (buffer, from, to) in bytes. Cutting splits the descriptor
that holds the place, an arrangement permutes descriptors and puts those of sentinels between them, and the inverse
permutation restores the text. No text is copied until the pieces are written out; hashes read one
descriptor after the other.

Cuts fall between units: a word with the white space before it, or white space that ends the text. Which documents are
arranged and where they are cut follows from the SHA-256 of seed and id, so that reruns agree on every cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import chunks, small_batches, words_in

SEED, RATE, SPM_RATE = 42, 50, 80
#: The sentinels, in the order prefix, suffix, middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
TEXT, MARKS = 0, 1
#: Which part (prefix 0, suffix 1, middle 2) comes first, second and third.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


class PieceTable:
    """Descriptors (buffer, from, to) over immutable buffers."""

    def __init__(self, buffers: tuple, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls((text, b"".join(SENTINELS)), [(TEXT, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte `at` of the document; parts may be empty."""
        for i, (buffer, start, end) in enumerate(self.pieces):
            if at <= end - start:
                self.pieces[i:i + 1] = [(buffer, start, start + at), (buffer, start + at, end)]
                return
            at -= end - start
        raise ValueError("the place lies beyond the end")

    def arrange(self, form: str) -> "PieceTable":
        """From prefix, middle, suffix to the order of `form`, each part behind its sentinel."""
        prefix, middle, suffix = self.pieces
        parts, out = (prefix, suffix, middle), []
        for k in ORDERS[form]:
            start = sum(map(len, SENTINELS[:k]))
            out += [(MARKS, start, start + len(SENTINELS[k])), parts[k]]
        return PieceTable(self.buffers, out)

    @classmethod
    def parse(cls, output: bytes, form: str) -> "PieceTable":
        """Descriptors of a written document. Its parts hold no sentinel, and no sentinel overlaps another text, so each is found once."""
        at, pieces = 0, []
        for k in ORDERS[form]:
            found = output.index(SENTINELS[k], at)
            if pieces:
                pieces[-1] = (TEXT, pieces[-1][1], found)
            at = found + len(SENTINELS[k])
            pieces += [(MARKS, 0, 0), (TEXT, at, len(output))]
        return cls((output, b""), pieces)

    def restore(self, form: str) -> "PieceTable":
        """The inverse: sentinels go, parts return to prefix, middle, suffix."""
        parts = [p for p in self.pieces if p[0] == TEXT]
        at = {k: i for i, k in enumerate(ORDERS[form])}
        return PieceTable(self.buffers, [parts[at[k]] for k in (0, 2, 1)])

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, end in self.pieces:
            if end > start:
                yield views[buffer][start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.stream():
            digest.update(piece)
        return digest.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    first = hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16]
    return tuple(int.from_bytes(first[i:i + 4], "big") for i in (0, 4, 8, 12))


def code_points(text: memoryview | bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _schema(rest: DataFrame, name: str, written: bool) -> T.StructType:
    inner = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
             T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    return T.StructType(rest.schema.fields + [T.StructField(name, T.StructType(inner + ([T.StructField("output", T.StringType())] if written else [])))])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, name: str = "fim", written: bool = True) -> DataFrame:
    """All columns of `docs` and a struct `name`: n units, form (plain, psm, spm), prefix_chars, middle_chars, hashes, output.

    `rate` percent of the documents are arranged, `spm_rate` percent of those with the suffix first. `restored_sha256` is that of the
    text rebuilt from the written output and its form. Without `written` the output itself is left out. A column called `name`
    is replaced. Null and empty texts are plain with 0 units; texts that hold a sentinel stay plain; a null id draws as an
    empty one. Rows are independent: repeated rows agree, an empty table stays empty, and a very long text is held as one buffer.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(name)
    names, schema = rest.columns, _schema(rest, name, written)
    source = rest.withColumns({"__key": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "__text": F.col(f"`{text_col}`").cast("string")})
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
                     + ([("output", pa.string())] if written else []))

    def one(text: bytes, key: str, n: int, cut_at) -> dict:
        h1, h2, h3, h4 = draws(seed, key)
        table = PieceTable.of(text)
        if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
            digest = table.sha256()
            return {"n": n, "form": "plain", "output_sha256": digest, "restored_sha256": digest, "output": text}
        form = "spm" if h4 % 100 < spm_rate else "psm"
        low, high = (cut_at(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        table.cut(high)
        table.cut(low)
        output = bytes(arranged := table.arrange(form))
        return {"n": n, "form": form, "prefix_chars": code_points(text[:low]), "middle_chars": code_points(text[low:high]), "output_sha256": arranged.sha256(),
                "restored_sha256": PieceTable.parse(output, form).restore(form).sha256(), "output": output}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            found = words_in(part.column(len(names) + 1))
            rows = []
            for i, key in enumerate(part.column(len(names)).to_pylist()):
                text, ends = found.text(i), found.ends_of(i)
                n = len(ends) + (not len(ends) or ends[-1] < len(text) if text else 0)
                rows.append(one(text, key, int(n), lambda k, e=ends, t=text: 0 if not k else int(e[k - 1]) if k <= len(e) else len(t)))
            made = pa.array([{k: v for k, v in r.items() if written or k != "output"} for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], made], [*names, name])

    return source.mapInArrow(run, schema)


def restore(docs: DataFrame, output_col: str, form_col: str, name: str = "restored") -> DataFrame:
    """All columns of `docs` and `name`, the text that `fill_in_middle` wrote as `output_col` in the given form; null outputs stay null."""
    rest = docs.drop(name)
    names = rest.columns
    source = rest.withColumns({"__form": F.col(form_col), "__text": F.col(output_col).cast("string")})
    schema = T.StructType(rest.schema.fields + [T.StructField(name, T.StringType())])
    small_batches(docs.sparkSession)

    def back(output: str | None, form: str | None) -> str | None:
        if output is None or form not in ORDERS:
            return output
        return bytes(PieceTable.parse(output.encode(), form).restore(form)).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            made = [back(o, f) for f, o in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(made, pa.string())], [*names, name])

    return source.mapInArrow(run, schema)
