"""Document fingerprints by one-permutation MinHash, in DataFrame and SQL functions only.

Every five-word shingle is hashed once. The hash's top eight bits choose one of 256 bins; each bin keeps its least hash.
Sorting the hashes together with one sentinel a bin leaves the bins' minima as the first of each run. An empty bin copies
a filled one: it probes bins in an order that depends on the bin alone, as optimal densification does; after PROBES misses
(texts with few shingles) it takes the filled bin of least priority hash. Of each bin the low eight bits are kept. Two
fingerprints agree by chance in 1 of 256 bins, and the likeness corrects for that.

Texts of fewer than five words are one shingle. A null text is empty; a text without words has the fingerprint of
zeros, like itself (1) and nothing else (0). Every row is fingerprinted. Of rows that share an id the one with the least text hash
is the next document of others; rows without an id are one document in that order, which comes last. Only id and text are read, so extra columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BINS, BITS, SHINGLE, PROBES = 256, 8, 5, 24
MASK = (1 << 56) - 1
ZEROS = "00" * BINS
#: Ids that one neighbour window holds, on average, and the most windows (whose edges meet in one task).
IDS_IN_WINDOW, MOST_WINDOWS = 5000, 4096
NO_ID = -(1 << 63)
#: Parts that the rows without an id are spread over.
PARTS = 64


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _filled(v: str) -> str:
    return f"({v} & {MASK}L) <> {MASK}L"


def fingerprint(text: str) -> Column:
    """The fingerprint of the column of that name: a byte for each bin."""
    trimmed = f"btrim(lower(coalesce({text}, '')), ' \\t\\n\\u000b\\f\\r')"
    words = "CASE WHEN t = '' THEN cast(array() AS array<bigint>) ELSE transform(split(t, '[ \\\\t-\\\\r]+'), x -> xxhash64(x)) END"
    after = ", ".join(f"w[i + {k}]" for k in range(1, SHINGLE))
    grams = f"CASE WHEN size(w) = 0 THEN cast(array() AS array<bigint>) WHEN size(w) < {SHINGLE} THEN array(xxhash64(w)) ELSE transform(slice(w, 1, size(w) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {after})) END"
    sentinels = f"transform(sequence(-{BINS // 2}, {BINS // 2 - 1}), b -> shiftleft(cast(b AS bigint), 56) | {MASK}L)"
    minima = _let(f"sort_array(concat({grams}, {sentinels}))", "a", "filter(a, (x, i) -> i = 0 OR shiftright(x, 56) <> shiftright(a[i - 1], 56))")
    probe = [f"d[cast(pmod(xxhash64(i, {k}), {BINS}) AS int)]" for k in range(PROBES)]
    tries = ", ".join(f"CASE WHEN {_filled(p)} THEN {p} END" for p in probe)
    last = "array_min(transform(own, v -> struct(xxhash64(i, shiftright(v, 56)) AS h, v AS v))).v"
    dense = f"transform(d, (x, i) -> CASE WHEN {_filled('x')} THEN x ELSE coalesce({tries}, {last}) END)"
    packed = f"unhex(array_join(transform({dense}, x -> substring(hex((x & 255) + 256), 2, 2)), ''))"
    bins = _let(f"filter(d, v -> {_filled('v')})", "own", f"CASE WHEN size(own) = 0 THEN unhex('{ZEROS}') ELSE {packed} END")
    return F.expr(_let(trimmed, "t", _let(words, "w", _let(minima, "d", bins))))


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard similarity of the shingles behind two fingerprints, corrected for chance agreement."""
    equal = f"size(filter(sequence(1, {BINS}), i -> substring({a}, i, 1) = substring({b}, i, 1)))"
    chance = 1 / (1 << BITS)
    zero = f"unhex('{ZEROS}')"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {a} = {zero} OR {b} = {zero} THEN 0D ELSE greatest(0D, ({equal} / {BINS}D - {chance}D) / (1D - {chance}D)) END")


def neighbours(ids: DataFrame) -> DataFrame:
    """key, next_key: of each distinct key the next smaller one, and the greatest after the least. Windows over ranges of keys, as many in one as in another; only their edges meet in one task."""
    ids = common.written(ids)
    windows = max(1, min(MOST_WINDOWS, ids.count() // IDS_IN_WINDOW))
    placed = common.written(ids.repartitionByRange(windows, "key").withColumn("at", F.spark_partition_id()))
    inside = placed.withColumn("before", F.lag("key").over(Window.partitionBy("at").orderBy("key")))
    edges = placed.groupBy("at").agg(F.max("key").alias("greatest"))  # at most MOST_WINDOWS rows
    edges = edges.select("at", F.coalesce(F.lag("greatest").over(Window.orderBy("at")), F.max("greatest").over(Window.partitionBy())).alias("edge"))
    return inside.join(F.broadcast(edges), "at").select("key", F.coalesce("before", "edge").alias("next_key"), "n_chars")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the beginning of the next document), and their likeness."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = keyed.select("key", F.xxhash64("text").alias("hash"), F.length("text").cast("bigint").alias("n_chars")).groupBy("key").agg(F.max("n_chars").alias("n_chars"), F.min("hash").alias("hash"))
    sizes = common.written(sizes)
    nxt = neighbours(sizes.select("key", "n_chars")).withColumnRenamed("key", "of")
    nxt = nxt.join(sizes.select(F.col("key").alias("next_key"), "hash"), "next_key")
    parts = lambda key: F.explode(F.when(F.col(key) == NO_ID, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    part = F.when(F.col("key") == NO_ID, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    texts = keyed.withColumn("fp", fingerprint("text")).withColumn("part", part)
    nxt = nxt.withColumn("next_part", parts("next_key"))
    heads = texts.join(nxt, (texts["key"] == nxt["next_key"]) & (texts["part"] == nxt["next_part"]) & (F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0))
    heads = heads.select("of", F.expr("left(text, cast(n_chars div 3 AS int))").alias("most_head"), F.col("fp").alias("next_fp"))
    heads = heads.dropDuplicates(["of"]).withColumn("of_part", parts("of"))
    both = texts.join(heads, (texts["key"] == heads["of"]) & (texts["part"] == heads["of_part"]))
    both = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("head", F.expr("left(most_head, cast(n_chars div 3 AS int))"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 AS int)), head)")).withColumn("edited_fp", fingerprint("edited"))
    return both.select(
        F.when(F.col("key") > NO_ID, F.col("key")).alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(common.read_table(spark, sf_dir, "documents"))
