"""Vectors, URLs, pages and the pipeline against brute force, and the rows that tend to break things."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siftwright.llm import embed_dedup, exact_topk, html_main, url_rules

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [None] * 16), (9005, [float("nan")] + [1.0] * 15), (9006, [float("inf")] * 16), (9007, [1.0, 2.0])]


def grouped(rng, n, dim, groups, size, noise):
    x = rng.normal(size=(n, dim))
    for g in range(groups):
        x = np.concatenate([x, rng.normal(size=dim) + noise * rng.normal(size=(size, dim))])
    return x.astype(np.float32)


@pytest.mark.parametrize("list_rows", [4096, 20])
def test_embeddings_against_brute_force(spark, monkeypatch, list_rows):
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", list_rows)
    rng = np.random.default_rng(2)
    x = grouped(rng, 800, 16, 40, 6, 0.18)
    x = np.concatenate([x, np.repeat(x[:1], 30, 0), x[5:9] * 7])
    out = {r.id: r for r in embed_dedup.near_vectors(vectors(spark, [*enumerate(x.tolist()), *ODD])).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert all(out[i].n_links <= n for i, n in enumerate(near.sum(1)))
    assert sum(out[i].n_links for i in range(len(x))) >= 0.98 * near.sum()
    label = np.arange(len(x))
    for _ in range(40):
        label = np.minimum(label, np.where(near, label[None], len(x)).min(1))
    assert np.mean([out[i].component_id == label[i] for i in range(len(x))]) > 0.98
    for i, _ in ODD[:6]:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert len(out) == len(x) + len(ODD)


def test_embeddings_recall_on_the_tables(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    assert embed_dedup.near_vectors(table).count() == table.count()
    assert embed_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 100)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    x = (grouped(rng, 300, 16, 5, 20, 0.02) * scale).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[50:51], 12, 0)])
    out = exact_topk.top_k(vectors(spark, [*enumerate(x.tolist()), *ODD, (None, [1.0] * 16)])).collect()
    whole = [[int(v) for v in r] for r in np.floor(x.astype(np.float64) * 256)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    for q in range(0, len(x), 50):
        score = sorted((-min(max(sum(a * b for a, b in zip(whole[q], whole[c])), -2**63), 2**63 - 1), c) for c in range(len(x)) if c != q)
        assert [got[q, k] for k in range(1, 6)] == [(c, -s) for s, c in score[:5]]
    assert len(out) == 5 * len(range(0, len(x), 50))
    few = exact_topk.top_k(vectors(spark, [(0, [1, 2]), (1, [3, 4]), (2, [5])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, (256 * 256) * 11)]
    assert exact_topk.top_k(vectors(spark, [])).count() == 0


# ---- URLs ------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [h + p for h, p, _ in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["example.org", "WWW.Example.org", "a.example.org", "xexample.org", "org", "b.com", "shop.b.com", "é.net", "", "x.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a/b.html", "/de/", "/de/9#/fr/", "?q=/de/", "#top", "/EN/1", "/a://b/de/"]
    urls = [f"{rng.choice(['http', 'ftp', ''])}://{h}{p}" for h, p in itertools.product(hosts, paths) for _ in range(3)]
    urls += [None, "", "no-scheme.org/es/", "://", "x" * 100_000, "http://" + "a." * 20_000 + "org/" + "b/" * 20_000]
    table = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    out = {r.id: r for r in url_rules.judge(table, min_support=0.01).collect()}
    assert len(out) == len(urls)
    fixed = {h + p: v for h, p, v in url_rules.RULES}
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == fixed[rule] if rule else out[i].verdict in ("allow", "block")
    assert url_rules.judge(table.limit(0)).count() == 0


def test_mined_rules_against_counting(spark):
    rng = random.Random(10)
    baskets = [(sorted(rng.sample("abcdef", rng.randint(1, 4))),) for _ in range(300)]
    baskets = [(b, "block" if "a" in b and "b" in b or rng.random() < 0.1 else "allow") for b, in baskets]
    mined = url_rules.mine(spark.createDataFrame(baskets, "items array<string>, verdict string"), 0.02, 0.7).collect()
    exact = {}
    for n in range(1, 5):
        for combo in itertools.combinations("abcdef", n):
            hit = [v for b, v in baskets if set(combo) <= set(b)]
            for verdict in ("allow", "block"):
                k = hit.count(verdict)
                if k / len(baskets) >= 0.02 and k / len(hit) >= 0.7:
                    exact[combo, verdict] = k / len(hit)
    want = {(c, v): x for (c, v), x in exact.items() if not any(exact.get((c[:i] + c[i + 1:], v), -1) >= x for i in range(len(c)))}
    assert {(tuple(r["items"]), r.verdict): round(r.confidence, 9) for r in mined} == {k: round(x, 9) for k, x in want.items()}


# ---- pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.uniform(-3, 3) for _ in range(n)]
    edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]

    def cost(side):
        return sum(max(o, 0) for o, s in zip(odds, side) if not s) + sum(max(-o, 0) for o, s in zip(odds, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])

    assert abs(cost(html_main.cut(odds, edges)) - min(cost(s) for s in itertools.product([False, True], repeat=n))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><div id="cookie-notice"><p>We use cookies. Accept, please.</p></div>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy now, it is good.</div>
<div class="content"><h1>A &amp; B</h1><p>First   paragraph, with <a href="x">a link</a> and <b>bold</b> text. It goes on for a while.<br>New line.
<script>var s = "</p>";</script><p>Of.<p>Last one: &eacute;&#233; &lt;tag&gt;, and some more words here.</div>
<aside class="sidebar"><p>Related: a long story about something else, told here. With two sentences.</p></aside><form><label>Mail</label><input value="x"><button>Go</button></form>
<div class="comments"><h2>Comments</h2><div class="comment"><p>I read this and liked it very much. Thank you, really.</p></div></div><footer>&copy; 2020 Someone, all rights reserved.</footer></body></html>"""


def test_article_is_separated():
    want = "A & B First paragraph, with a link and bold text. It goes on for a while. New line. Of. Last one: éé <tag>, and some more words here."
    assert html_main.main_text(PAGE) == want
    inside = PAGE.replace('<div class="content">', "<article>").replace("here.</div>\n<aside", "here.</article>\n<aside")
    assert html_main.main_text(inside) == want


def test_pages_odd_rows(spark):
    rows = [None, "", "   ", "plain text, without tags.", "<p", "<p>a <", "<<<>>>", "<a href='x>y' title=\"q>\">t</a>", "<!-- open", "<script>never closed", "<p>" * 5000 + "deep, but a sentence.",
            "<article>" + "<p>word, and more. </p>" * 20_000 + "</article>", "&#x110000; &bogus; &amp;amp; text, here."]
    table = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(rows)], "page_id bigint, url string, html string, main_text string")
    out = {r.page_id: r.main_text for r in html_main.extract(table).collect()}
    assert len(out) == len(rows) and all(out[i] == "" for i in (0, 1, 2, 8, 9)) and out[10] == "deep, but a sentence."
    assert out[11] == " ".join(["word, and more."] * 20_000)
    assert html_main.extract(table.limit(0)).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.pin(after)
        counts.append(docs.count())
    assert 0.9 * 200 < counts[0] <= 200 and counts[1] <= counts[0] and counts[2] == counts[1]
    out = corpus_pipeline.run(spark, small)
    assert out.count() == counts[3] and out.filter("not round_trip").count() == 0


def test_pipeline_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, score=1, dedup="x", mark=2, ids=3)
    once = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert Counter(r.text for r in once)[odd_rows[3][1]] == 1 and Counter(not (r.text or "").strip() for r in once)[True] == 1
    assert corpus_pipeline.without_repeats(spark, docs, "").count() == len(odd_rows)
    assert corpus_pipeline.to_weights(spark, docs, "").columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.to_ids(spark, docs, "").filter("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), "").count() == 0
