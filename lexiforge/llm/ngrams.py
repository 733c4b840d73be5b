"""Byte n-grams: packing, counting, and summing a table's values over every document.

A gram is `depth` context bytes and the byte that follows. It is packed with the nearest context byte first and the
following byte last, so that the grams of any shorter context are one range of keys: level(k) keeps k context bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import common

#: Stands before and behind every text; no word holds it.
EDGE = b"\n"
#: A table of at most so many rows is broadcast (16 bytes a row); a larger one is joined to blocks of documents.
BROADCAST_ROWS = 2_000_000
#: Text bytes that a block of documents holds, on average; small tables have up to LEAST_BLOCKS blocks of LEAST_BYTES or more.
BLOCK_BYTES, LEAST_BLOCKS, LEAST_BYTES = 16_000_000, 24, 100_000
#: Bytes whose grams are sorted at once.
_AT_ONCE = 1_000_000


def joined(text: str | None, lower: bool) -> bytes:
    """The text's words, one space apart."""
    raw = (text or "").encode()
    return b" ".join((raw.lower() if lower else raw).split())


def grams(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of these joined texts, each with its end, and how many each text has."""
    pad = EDGE * depth
    data = np.frombuffer(b"".join([pad + w + EDGE for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    keys = np.zeros(max(0, len(data) - depth), np.uint64)
    for d in range(1, depth + 1):
        keys <<= np.uint64(8)
        keys |= data[depth - d : len(data) - d]
    keys <<= np.uint64(8)
    keys |= data[depth:]
    real = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + depth) - depth  # where each text's grams end
    for d in range(depth):
        at = ends[:-1] + d
        real[at] = False
    return keys[real], sizes


def level(key, depth: int, k: int):
    """The gram of k context bytes within a packed gram; key: a column or an array."""
    if k == depth:
        return key
    if isinstance(key, np.ndarray):
        return ((key >> np.uint64(8 * (depth - k) + 8)) << np.uint64(8)) | (key & np.uint64(255))
    return F.shiftleft(F.shiftright(key, 8 * (depth - k) + 8), 8).bitwiseOR(key.bitwiseAND(F.lit(255).cast("bigint")))


class Counts:
    """Distinct keys and the sum of their weights, merged from time to time."""

    def __init__(self):
        self.parts, self.pending = [], 0

    def add(self, keys: np.ndarray, weigh: bool) -> None:
        for at in range(0, len(keys), _AT_ONCE):
            own, n = np.unique(keys[at : at + _AT_ONCE], return_counts=True)
            self.parts.append((own, n if weigh else np.zeros(len(own), np.int64)))
            self.pending += len(own)
        if self.pending > 2 * _AT_ONCE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.parts = [(keys[first], np.add.reduceat(n, first))]
        self.pending = 0
        return self.parts[0]


def batches_of(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _AT_ONCE bytes together."""
    begin = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size > _AT_ONCE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(words):
        yield begin, len(words)


def among(ids: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each value of a column of whole numbers is one of these, which are sorted; nulls are not."""
    if not len(ids):
        return np.zeros(len(column), bool)
    own = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    found = ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own
    return found & column.is_valid().to_numpy(zero_copy_only=False)


def counted(docs: DataFrame, depth: int, text_col: str, train_col: str, lower: bool, ids: Broadcast | None = None) -> DataFrame:
    """gram, n: every gram of any document and its count in those where train_col holds or, given sorted ids, has one of them."""
    schema = common.spark_schema(docs.sparkSession, "gram bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        counts = Counts()
        for batch in batches:
            for part in common.pieces(batch):
                flags = part.column(1).to_pylist() if ids is None else among(ids.value, part.column(1)).tolist()
                for train in (True, False):
                    own = [joined(t, lower) for t, f in zip(part.column(0).to_pylist(), flags, strict=True) if bool(f) == train]
                    for a, b in batches_of(own):
                        counts.add(grams(own[a:b], depth)[0], train)
        keys, n = counts.merge()
        target = to_arrow_schema(schema)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].astype(np.int64)), pa.array(n[at : at + 100_000])], schema=target)

    return docs.select(text_col, train_col).mapInArrow(common.lean(run), schema).groupBy("gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by key in an open-addressing table: a key takes one or two memory reads, where bisection takes twenty."""

    #: No key: it would be eight bytes of 255, which UTF-8 does not have.
    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.FREE), np.zeros(1 << bits, values.dtype)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == self.FREE
            self.keys[slot[free]] = keys[left[free]]  # of several keys for one slot the last one gets it
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            slot, left = (slot[~won] + 1) & self.mask, left[~won]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value; nan for a key that is not there."""
        out = np.empty(len(keys))
        for a in range(0, len(keys), 1 << 16):
            own = keys[a : a + (1 << 16)]
            slot = self._home(own)
            part = self.values[slot].astype(np.float64)
            left = np.flatnonzero(self.keys[slot] != own)
            slot = slot[left]
            part[left] = np.nan
            while len(left):
                there = self.keys[slot] != self.FREE
                slot, left = (slot[there] + 1) & self.mask, left[there]
                hit = self.keys[slot] == own[left]
                part[left[hit]] = self.values[slot[hit]]
                slot, left = slot[~hit], left[~hit]
            out[a : a + (1 << 16)] = part
        return out


def sums(words: list[bytes], tables: list[Lookup], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each joined text the sum of the values of its grams, each of which one of the tables holds, and their number."""
    out, sizes = np.zeros(len(words)), np.zeros(len(words), np.int64)
    for a, b in batches_of(words):
        found, n = grams(words[a:b], depth)
        value = tables[0](found)
        for table in tables[1:]:
            left = np.flatnonzero(np.isnan(value))
            value[left] = table(found[left])
        if np.isnan(value).any():
            raise KeyError("a gram without a value")
        out[a:b] = np.add.reduceat(value, np.cumsum(n) - n)
        sizes[a:b] = n
    return out, sizes


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the column __block: by hash of id and text, about block_bytes of text each.

    Rows that agree in both are spread over all blocks by position where they are more than a block's share; such
    rows are all alike, so it does not matter which of them lies where if a task is run again."""
    key = F.xxhash64(id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("rows")).first()
    total = size["bytes"] or 0
    n = max(1, -(-total // block_bytes), min(LEAST_BLOCKS, total // min(LEAST_BYTES, block_bytes)))
    often = docs.groupBy(key.alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1000, size["rows"] // n))
    often = [r["__key"] for r in often.select("__key").collect()]  # fewer than n
    place = F.when(key.isin(often), F.monotonically_increasing_id()).otherwise(key) if often else key
    return docs.withColumn("__block", F.pmod(place, F.lit(n)).cast("int"))


def summed(docs: DataFrame, table: DataFrame, depth: int, id_col: str, text_col: str, lower: bool, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with __sum, the sum of table's values (gram, value) over the grams of each text, and __grams, their number.

    table has to hold every gram of docs. Up to broadcast_rows rows it is broadcast and docs stay where they are. Beyond that,
    each block's distinct grams are joined to it, and block and values meet in one task."""
    spark = docs.sparkSession
    columns = docs.columns
    schema = StructType([*docs.schema.fields, StructField("__sum", DoubleType()), StructField("__grams", LongType())])
    at_text = columns.index(text_col)

    def scored(batch: pa.RecordBatch | pa.Table, values: Lookup) -> list:
        found, sizes = [], []
        for part in common.pieces(batch):
            s, n = sums([joined(t, lower) for t in part.column(at_text).to_pylist()], [values], depth)
            found.append(s)
            sizes.append(n)
        return [pa.array(np.concatenate(found) if found else [], pa.float64()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())]

    if table.count() <= broadcast_rows:
        got = table.select("gram", "value").toArrow()
        shared, made = spark.sparkContext.broadcast((got["gram"].to_numpy().astype(np.uint64), got["value"].to_numpy())), []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not made:
                    made.append(Lookup(*shared.value))
                yield pa.RecordBatch.from_arrays([*batch.columns, *scored(batch, made[0])], names=[*columns, "__sum", "__grams"])

        return docs.mapInArrow(common.lean(run), schema)

    placed = blocks(docs, id_col, text_col)

    def distinct(own: pa.Table) -> pa.Table:
        counts = Counts()
        for part in common.pieces(own):
            words = [joined(t, lower) for t in part.column(text_col).to_pylist()]
            for a, b in batches_of(words):
                counts.add(grams(words[a:b], depth)[0], False)
        keys = counts.merge()[0]
        return pa.table({"__block": pa.array([own.column("__block")[0].as_py()] * len(keys), pa.int32()), "gram": pa.array(keys.astype(np.int64))})

    needed = placed.groupBy("__block").applyInArrow(distinct, "__block int, gram bigint").join(table.select("gram", "value"), "gram")

    def meet(own: pa.Table, values: pa.Table) -> pa.Table:
        out = own.select(columns)
        s, n = scored(out, Lookup(values.column("gram").to_numpy().astype(np.uint64), values.column("value").to_numpy()))
        return pa.table([*out.columns, s, n], names=[*columns, "__sum", "__grams"])

    return placed.groupBy("__block").cogroup(needed.groupBy("__block")).applyInArrow(meet, schema)
