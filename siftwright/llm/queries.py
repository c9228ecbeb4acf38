"""The registered queries of the operators in this folder, and SQL where it can state the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import byte_bpe, embed_dedup, exact_topk, fill_in_middle, html_main, language_id, mixing, periodic_runs, sharding, simhash, substring, toxicity, url_rules
from siftwright.llm.common import WORD, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to source weights: what each one gives to the mix."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after every repeated window of 35 words is removed."""
    docs = substring.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes, equal texts together."""
    rows = sharding.shard(table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text, and the bytes they decode to."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    decoded = byte_bpe.with_ids(table(spark, folder, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, bytes_col="decoded").drop("text")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every vector at a cosine of 0.95 or more, and its class."""
    return embed_dedup.near_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every URL."""
    return url_rules.judge(table(spark, folder, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every text."""
    docs = table(spark, folder, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_html_main(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    text = html_main.extract(table(spark, folder, "pages").select("page_id", "url", "html")).withColumnRenamed("main_text", "text")
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Five best inner products for every fiftieth vector."""
    return exact_topk.top_k(table(spark, folder, "embeddings"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by a checksum of the id, the words from some place on repeat. A null id is never chosen."""
    check = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(check % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(check / 10).alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, the strongest of them, and the text with repeats collapsed."""
    rows = periodic_runs.with_runs(with_cycles(table(spark, folder, "documents")))
    best = F.array_max(F.transform("periodic.runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listing = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
    return rows.select("doc_id", "periodic", best.alias("best"), listing.alias("listing")).select(
        "doc_id", F.size("periodic.runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("listing", 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut and arranged for fill-in-middle training, and restored."""
    rows = fill_in_middle.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"), written=False)
    return rows.select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probability that a text is toxic."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_substring_dedup, op3_shards, op4_byte_bpe, op5_embedding_dedup, op6_url_rules, op7_language_id, op8_html_main, op9_simhash_dedup, op10_exact_topk,
    op11_periodic_runs, op12_fill_in_middle, op13_toxicity,
)}

ORACLES = {
    "op2_substring_dedup": r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN again USING (k)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)""",
    "op5_embedding_dedup": """WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = a""",
    "op10_exact_topk": """WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 5""",
    "op12_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
