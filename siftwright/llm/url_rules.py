"""URL filtering by stated host and path rules, and by association rules that FP-growth mines from what those rules label.

Everything is DataFrame work and Spark's own FP-growth. A URL's items are the suffixes of its host, its first path parts,
the kind of its last part and whether it has a query. The number of items does not grow with the URL's length. Rules `items => verdict`
are kept if support and confidence are high enough and no shorter rule with the same verdict is as sure. They match by an inverted
index: item -> rules, and a rule matches if all of its items are met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import pin

#: (host, path, verdict), as stated in the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.005, 0.8, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to `/`, `?`, `#` or the end, lower case; path up to `?`, `#` or the end. Both empty without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def stated(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def items(host: Column, path: Column, url: Column) -> Column:
    """Distinct items of a URL, sorted."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    tokens = F.array(
        *[F.when(n >= k, F.concat(F.lit("host="), F.array_join(F.slice(labels, -k, k), "."))) if k > 1 else F.concat(F.lit("host="), F.element_at(labels, -1)) for k in (1, 2, 3)],
        F.when(n > 3, F.concat(F.lit("sub="), labels[0])),
        F.concat(F.lit("dir="), F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))),
        F.when(F.size(parts) > 2, F.concat(F.lit("dir2="), parts[1])),
        F.concat(F.lit("kind="), F.when(last.rlike(r"^[0-9]+$"), "number").when(last.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1)).otherwise("text")),
        F.concat(F.lit("start="), F.substring(last, 1, 1)),
        F.concat(F.lit("query="), F.when(F.instr(F.coalesce(url, F.lit("")), "?") > 0, "1").otherwise("0")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(tokens)))


def mine(baskets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(rule_id, items, verdict, confidence, support): rules from baskets (items, verdict) of labelled URLs.

    A rule is dropped if one of its own parts already says the same with as much confidence.
    """
    spark = baskets.sparkSession
    shape = "rule_id bigint, items array<string>, verdict string, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], T.StructType.fromDDL(shape))
    labelled = baskets.select(F.concat("items", F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    said = F.col("consequent")[0]
    found = pin(model.associationRules.filter(said.startswith(VERDICT)).select(
        F.array_sort("antecedent").alias("items"), F.substring_index(said, "=", -1).alias("verdict"), "confidence", "support"))
    # a shorter rule is found through each of its possible one-shorter parents
    parts = found.select("items", "verdict", "confidence", F.explode("items").alias("without")).select(
        "items", "verdict", "confidence", F.array_remove("items", F.col("without")).alias("shorter"))
    covered = parts.alias("a").join(found.alias("b"), (F.col("a.shorter") == F.col("b.items")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.col("b.confidence") >= F.col("a.confidence"))).select("a.items", "a.verdict").distinct()
    kept = found.join(covered, ["items", "verdict"], "left_anti")
    return pin(kept.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", "verdict", "confidence", "support"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) for every row of `pages`.

    The longest stated rule decides; confidence is then 1. Else the surest mined rule whose items the URL has, ties
    by support, then length, then block before allow; without one the verdict is `allow` and confidence null. Null URLs and URLs without `://` have an empty host and path and no rule. Repeated
    rows stay; extra columns are not read; an empty table gives no rows.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), url.alias("url"))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("stated_", verdict).withColumn("items", items(F.col("host"), F.col("path"), F.col("url"))).drop("url")
    mined = mine(judged.filter("rule is not null").select("items", F.col("stated_").alias("verdict")), min_support, min_confidence)
    index = mined.select("rule_id", F.explode("items").alias("item"), F.size("items").alias("needs"))
    # each distinct set of items is matched once, however many URLs share it
    sets = judged.filter("rule is null").select("items").distinct()
    hits = sets.select("items", F.explode("items").alias("item")).join(index, "item").groupBy("items", "rule_id").agg(F.count(F.lit(1)).alias("met"), F.first("needs").alias("needs")).filter("met = needs")
    facts = mined.select("rule_id", "verdict", "confidence", "support", F.size("items").alias("needs"))
    strength = F.struct("confidence", "support", F.col("needs").alias("length"), F.col("verdict").alias("verdict"))
    best = hits.select("items", "rule_id").join(facts, "rule_id").groupBy("items").agg(F.max(strength).alias("best"))
    out = judged.join(best, "items", "left")
    mined_says = F.when(F.col("rule").isNull(), F.col("best.verdict"))
    return out.select(
        "id", "host", "path", "rule", F.coalesce("stated_", mined_says, F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit(1.0)).otherwise(F.col("best.confidence")).alias("confidence"),
    )
