"""Fill-in-middle: piece tables, round trips and the query against a plain version."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import fill_in_middle, queries
from siftwright.llm.fill_in_middle import PieceTable

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text), text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text), out)


@given(st.binary(max_size=60).filter(lambda b: not any(s in b for s in fill_in_middle.SENTINELS)), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
@settings(max_examples=200, deadline=None)
def test_arrange_and_restore(text, a, b, form):
    low, high = sorted((min(a, len(text)), min(b, len(text))))
    table = PieceTable.of(text)
    table.cut(high)
    table.cut(low)
    assert bytes(table) == text
    arranged = table.arrange(form)
    assert bytes(arranged.restore(form)) == text
    assert bytes(PieceTable.parse(bytes(arranged), form).restore(form)) == text


def texts(rng):
    pool = ["a", "ß", "🤷", "<P", ">", "<", "P>", "\x1c", " ", "word", " ", "\t", "\n", "\x0b", "  "]
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)]
    return out + ["a <P> b", "x<M>", "<S>"] + ["plain words here and there " * 40] * 5


def test_against_a_plain_version(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts(random.Random(4)))]
    docs = make_docs(rows, fim="old", output="clash", n=1)
    got = fill_in_middle.fill_in_middle(docs)
    assert got.columns == [c for c in docs.columns if c != "fim"] + ["fim"]
    back = fill_in_middle.restore(got.select("doc_id", "text", "fim"), "fim.output", "fim.form").collect()
    found = sorted(((r.doc_id, r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output_sha256, r.fim.restored_sha256, r.fim.output) for r in back), key=repr)
    assert found == sorted((plain_version(r[0], r[1]) for r in rows), key=repr)
    assert all(r.restored == (r.text or "") for r in back)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate,form", [(0, "plain"), (100, "psm")])
def test_rates(spark, make_docs, rate, form):
    rows = fill_in_middle.fill_in_middle(make_docs([(i, f"some words {i}") for i in range(50)]), rate=rate, spm_rate=0, written=False)
    assert {r.fim.form for r in rows.collect()} == {form}
    assert "output" not in rows.schema["fim"].dataType.names


def test_query_on_the_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = {r.doc_id: tuple(r) for r in queries.op12_fill_in_middle(spark, small).select(*names).collect()}
    assert got == {r.doc_id: plain_version(*r)[:7] for r in rows}
