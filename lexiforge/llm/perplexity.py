"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts of all orders are DataFrames keyed by packed grams. Each order joins its grams with their contexts' totals and with the
next lower order; a context has at most 256 grams, so no key is hot. Every gram of any document is in these tables, seen in
training or not, so scoring needs one lookup a byte. Rejected are documents whose loss per byte lies above the quantile
that held-out trusted documents of their language and size class have; a class with fewer than LEAST_ROWS of them uses its
language's, then everybody's.

Trusted rows are those labelled quality 1, all of them: a fifth, by hash of the id, sets the quantiles, the rest trains.
Counting, lookup and scoring cover all documents. Documents are not exchanged to find the trusted ones: counting tasks look
their ids up in a broadcast of at most BROADCAST_IDS, and quantiles come from losses that are joined without their texts.

Null and empty texts hold only their end; null languages are one language. Without trusted rows everything stays. Repeated
rows are judged alike. Extra columns pass through; names beginning with two underscores are reserved. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common, ngrams

DEPTH = 4
QUANTILE, SLACK, LEAST_ROWS = 0.995, 1.03, 20
#: Slack besides, divided by the text's bytes: the loss of a few bytes says little.
SHORT_SLACK = 0.8
#: Ids of training rows, eight bytes each, that are broadcast at most; beyond that, and for ids that are no whole numbers, texts are exchanged to meet them.
BROADCAST_IDS = 8_000_000


def kneser_ney(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, value: log10 of the probability of each gram's last byte after its context. counts: gram, n (0: not in training)."""
    levels = {depth: counts.select(F.col("gram").alias("key"), F.col("n").alias("c"))}
    for k in range(depth - 1, -1, -1):
        above = levels[k + 1]
        levels[k] = common.checkpointed(above.groupBy(ngrams.level(F.col("key"), k + 1, k).alias("key")).agg(F.sum((F.col("c") > 0).cast("bigint")).alias("c")))
    spread = None
    for k, own in levels.items():
        row = own.agg(F.lit(k).alias("k"), *(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)))
        spread = row if spread is None else spread.unionByName(row)
    discounts = {r["k"]: _discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in spread.collect()}
    lower = None
    for k in range(depth + 1):
        d1, d2, d3 = discounts[k]
        own = levels[k].withColumn("context", F.shiftright("key", 8))
        n = lambda test: F.count(F.when(test, 1))
        c = F.col("c")
        held = F.lit(d1) * n(c == 1) + F.lit(d2) * n(c == 2) + F.lit(d3) * n(c >= 3)
        totals = own.groupBy("context").agg(F.sum("c").alias("total"), held.alias("held"))
        totals = F.broadcast(totals) if k <= 2 else totals  # at most 65,536 contexts of two bytes
        own = own.join(totals, "context")
        if k:
            own = own.withColumn("shorter", ngrams.level(F.col("key"), k, k - 1))
            own = own.join(F.broadcast(lower) if k <= 2 else lower, "shorter")
        else:
            own = own.withColumn("p_lower", F.lit(1 / 256))
        less = F.when(c >= 3, d3).when(c == 2, d2).when(c == 1, d1).otherwise(0.0)
        p = F.when(F.col("total") > 0, (c - less + F.col("held") * F.col("p_lower")) / F.col("total")).otherwise(F.col("p_lower"))
        lower = own.select(F.col("key").alias("shorter"), p.alias("p_lower"))
    return lower.select(F.col("shorter").alias("gram"), F.log10("p_lower").alias("value"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts, kept within what a count can give."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(min(max(d, 0.05), most)) for d, most in zip(found, (0.95, 1.9, 2.9), strict=True))


def _size_class(n: Column) -> Column:
    return F.least(F.lit(8), F.greatest(F.lit(2), F.floor(F.log(4.0, n)).cast("int")))


def _counts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, broadcast_ids: int) -> DataFrame:
    """gram, n: every gram of docs and its count in the rows with one of these ids. Texts stay where they are while the ids can be broadcast."""
    whole = all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((docs, id_col), (ids, "__id")))
    if whole and ids.count() <= broadcast_ids:
        own = np.sort(ids.select(F.col("__id").cast("bigint")).toArrow()["__id"].to_numpy())
        keyed = docs.select(F.col(text_col), F.col(id_col).cast("bigint").alias("__key"))
        return ngrams.counted(keyed, DEPTH, text_col, "__key", lower=False, ids=docs.sparkSession.sparkContext.broadcast(own))
    ids = ids.select("__id", F.lit(-1).cast("bigint").alias("__spread"), F.lit(True).alias("__train"))
    # rows without an id match nothing; they are spread, lest they meet in one task
    spread = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    keyed = docs.select(F.col(id_col), F.col(text_col), spread.alias("__at"))
    marked = keyed.join(ids, (keyed[id_col] == ids["__id"]) & (keyed["__at"] == ids["__spread"]), "left")
    return ngrams.counted(marked, DEPTH, text_col, "__train", lower=False)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with __loss (-log10 of the probability, per byte), __grams, __limit and __kept."""
    ids = labels.where("quality = 1").select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    # written, so that its size is known and Spark broadcasts it only where it is small
    ids = common.written(ids.select("__id", (fold("__id") == 0).alias("__limits")))
    counts = common.checkpointed(_counts(docs, ids.where("NOT __limits"), id_col, text_col, broadcast_ids))
    table = common.checkpointed(kneser_ney(counts))
    score = lambda part: ngrams.summed(part, table, DEPTH, id_col, text_col, lower=False)
    lang, loss = F.coalesce(F.col(lang_col), F.lit("")), -F.col("__sum") / F.col("__grams")
    # the losses meet the ids, not the texts
    some = docs.where(fold(id_col) == 0) if docs.schema[id_col].dataType == labels.schema[id_col].dataType else docs
    scored = score(some.select(id_col, text_col, lang_col)).select(F.col(id_col).alias("__own"), lang.alias("__lang"), _size_class(F.col("__grams")).alias("__class"), loss.alias("__loss"))
    limits = scored.join(ids.where("__limits"), F.col("__own") == F.col("__id"), "left_semi").drop("__own")
    q = F.percentile_approx("__loss", quantile, 10_000)
    sets = limits.groupingSets([["__lang", "__class"], ["__lang"], []], "__lang", "__class").agg(F.when(F.count("*") >= LEAST_ROWS, q * SLACK).alias("__limit"), F.grouping_id().alias("__set"))
    sets = common.checkpointed(sets)  # a row for each language and size class
    fine = F.broadcast(sets.where("__set = 0").select("__lang", "__class", F.col("__limit").alias("__fine")))
    coarse = F.broadcast(sets.where("__set = 1").select("__lang", F.col("__limit").alias("__coarse")))
    whole = sets.where("__set = 3").select(F.max("__limit")).first()
    out = score(docs).withColumn("__lang", lang).withColumn("__class", _size_class(F.col("__grams"))).withColumn("__loss", loss)
    out = out.join(fine, ["__lang", "__class"], "left").join(coarse, "__lang", "left")
    limit = F.coalesce("__fine", "__coarse", F.lit(whole[0] if whole else None).cast("double"))
    out = out.withColumn("__limit", limit * (1 + SHORT_SLACK / F.col("__grams")))
    return out.withColumn("__kept", F.coalesce(F.col("__loss") <= F.col("__limit"), F.lit(True))).drop("__lang", "__class", "__fine", "__coarse")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, log probability, perplexity per byte, limit and verdict."""
    docs, labels = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels")
    out = judged(docs.select("doc_id", "text", "lang"), labels)
    return out.select("doc_id", "lang", F.col("__grams").alias("n_bytes"), F.col("__sum").alias("log10_prob"), F.pow(10.0, "__loss").alias("perplexity"), F.pow(10.0, "__limit").alias("most_perplexity"), F.col("__kept").alias("kept"))
