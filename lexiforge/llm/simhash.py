"""Near-duplicates by SimHash, linked through anchor points of a covering code.

Fingerprints within `2` bits of each other differ in at most one bit in one of their two halves. For each half the
anchors are the words of the Hamming code of length 31, a perfect code of covering radius 1. A fingerprint is
home at the one anchor nearest its half, and is replicated to every anchor within radius plus threshold, 1 + 1: at
most 16. Whoever is within one bit of a fingerprint in that half is replicated to its home, so comparing homes with
replicas per anchor loses no link. Equal fingerprints are one class before any of this, so a group of copies, however
large, is one row; components are found over classes by alternating large and small stars.

Nulls, empty texts and texts without words have fingerprint zero and link like any other. Repeated rows fall into
one class. Rows with a null id keep their fingerprint and get the component of their class; the smallest id is taken over the others.
Only id and text are read, so extra columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Positions of the Hamming code, and the bits of each half that it spans.
CODE = 31
THRESHOLD = 2
SHINGLE = 3
SEED = 42
_AT_ONCE = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered; bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The text's 64-bit fingerprint as a signed integer."""
    import xxhash

    grams = shingles(words_of(text), size)
    if not grams:
        return 0
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and text_hash."""
    read = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash"))
    return common.map_rows(read, lambda ids, texts, hashes: [ids, [simhash(t, size, seed) for t in texts], hashes], f"{id_col} bigint, fp bigint, text_hash bigint")


def _syndrome(half: Column) -> Column:
    """Of a word of CODE bits: the exclusive or of the positions, from 1, of its set bits."""
    out = F.lit(0)
    for b in range(5):
        mask = sum(1 << (p - 1) for p in range(1, CODE + 1) if p >> b & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, b))
    return out


def _placed(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """side, anchor and a with one home for each half of each fingerprint, and side, anchor and b with all its replicas. Other columns come along."""
    mask, more = F.lit((1 << CODE) - 1).cast("bigint"), [c for c in classes.columns if c != "fp"]
    halves = classes.select("fp", *more, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(mask).alias("half")), F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).bitwiseAND(mask).alias("half")))).alias("h")).select("fp", *more, "h.side", "h.half")
    halves = halves.withColumn("s", _syndrome(F.col("half")))
    bit = lambda p: F.when(p > 0, F.expr("shiftleft(1L, p - 1)")).otherwise(F.lit(0).cast("bigint"))
    home = halves.withColumn("p", F.col("s")).select("side", F.col("half").bitwiseXOR(bit(F.col("p"))).alias("anchor"), F.col("fp").alias("a"), *more)
    # errors of weight at most 2 that turn the half into a code word: {s}, or {i, j} with i xor j = s
    flips = "CASE WHEN s = 0 THEN array(0L) ELSE transform(filter(sequence(0, 31), i -> i < (i ^ s)), i -> (CASE WHEN i = 0 THEN 0L ELSE shiftleft(1L, i - 1) END) ^ shiftleft(1L, (i ^ s) - 1)) END"
    replicas = halves.select("side", "half", "fp", *more, F.explode(F.expr(flips)).alias("flip")).select("side", F.col("half").bitwiseXOR(F.col("flip")).alias("anchor"), F.col("fp").alias("b"), *more)
    return home, replicas


def _sorted_pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints in the column fp of classes that differ in at most THRESHOLD bits."""
    home, replicas = _placed(classes.select("fp"))
    return _sorted_pairs(home.join(replicas, ["side", "anchor"]).where("a <> b AND bit_count(a ^ b) <= %d" % THRESHOLD))


def links_apart(classes: DataFrame) -> DataFrame:
    """Of the links between fingerprints of classes (fp, root) those between different roots. A group that is already under one root costs no pairs:
    of an anchor's fingerprints those outside its commonest root meet all others, and anchors with one root are left out."""
    home, replicas = (df.withColumnRenamed("root", f"root_{side}") for df, side in zip(_placed(classes), "ab", strict=True))
    # a home is among the replicas too, so these hold every root of an anchor
    mixed = replicas.groupBy("side", "anchor").agg(F.mode("root_b").alias("main"), F.min("root_b").alias("least"), F.max("root_b").alias("most")).where("least <> most").select("side", "anchor", "main")
    mixed = common.written(mixed)
    home, replicas = common.written(home.join(mixed, ["side", "anchor"])), common.written(replicas.join(mixed, ["side", "anchor"]).drop("main"))
    near = "root_a <> root_b AND bit_count(a ^ b) <= %d" % THRESHOLD
    outside = home.where("root_a <> main").drop("main").join(replicas, ["side", "anchor"]).where(near)
    inside = home.where("root_a = main").join(replicas, ["side", "anchor"]).where("root_b <> main").where(near)
    return _sorted_pairs(outside.select("a", "b").unionByName(inside.select("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for every node of the edges (a, b): stars are merged until all are whole."""

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = common.checkpointed(edges)
    before = mark(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        edges = common.checkpointed(joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b")).where("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes_of(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fp, component_id (the smallest id reachable), n_links (classes it links to), root (the component's smallest fp) for every distinct fp of prints (id, fp)."""
    classes = common.checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    edges = common.checkpointed(links(classes))
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(edges)
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").join(degree, "fp", "left")
    linked = linked.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(heads, "root").select("fp", "component_id", "n_links", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, fingerprint (16 hex digits), component_id and number of classes that its class links to."""
    prints = common.checkpointed(fingerprints(docs, id_col, text_col).drop("text_hash"))
    found = prints.join(classes_of(prints, id_col), "fp")  # one row for each fp; Spark splits a hot one
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each component: the one with the smallest id, then the smallest text hash.

    A row without an id stands only for a component in which no row has one."""
    prints = common.checkpointed(fingerprints(docs, id_col, text_col))
    return first_rows(docs, prints.join(classes_of(prints, id_col).select("fp", "root"), "fp"), id_col, text_col)


def first_rows(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs that stands for each root of rooted (id, text_hash, root); of rows that agree in id and text, one."""
    row = F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"), "text_hash")
    found = rooted.groupBy("root").agg(F.min(row).alias("row"))
    taken = {c.lower() for c in docs.columns}
    key, own = (next(n for n in (f"__{name}{k or ''}" for k in range(len(taken) + 1)) if n not in taken) for name in ("id", "hash"))
    keep = found.select(F.col("row.id").alias(key), F.col("row.text_hash").alias(own)).distinct()
    placed = docs.withColumn(own, F.xxhash64(text_col))
    chosen = placed.join(keep, placed[id_col].eqNullSafe(keep[key]) & (placed[own] == keep[own]), "left_semi")
    return chosen.dropDuplicates([id_col, own]).drop(own)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))
