"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision has a tree of contexts, up to DEPTH bytes long, and each context a
Krichevsky-Trofimov estimator. Weighting mixes all depths: a context's own estimate counts by half of what its evidence
is worth against that of its longer contexts. Training counts grams of DEPTH + 1 bytes. Contexts that share their three
nearest bytes are one subtree, so each subtree's weights are computed in one task, whatever the others hold; what joins
the subtrees (contexts of two bytes and fewer) is 256^3 rows at most, far fewer in text. Scoring then needs one value for each gram.

Texts are words joined by single spaces, with an end; their words are also scored by a smoothed unigram model (the base).
Documents are grouped into blocks of bounded size by hash. A block's distinct words and grams, not their occurrences, are
counted over the corpus. What the most blocks hold (OFTEN_GRAMS, OFTEN_WORDS at most) is broadcast; the rest, which few
blocks hold, is joined and brought back to its blocks. The code length is also given in bits a byte.

Five bytes of context say less than whole words do: trained on few texts the model loses to the base on held-out ones (README),
and with more text it wins. Longer contexts would need more distinct grams than the shuffle allows.

Null and empty texts hold only their end. Rows without an id learn like any other. Repeated rows learn and score each
time. Only id and text are read, so extra columns cannot clash. An empty table gives no rows; with nothing to learn from,
every byte costs eight bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ngrams

DEPTH = 5
#: Context bytes that all contexts of one task share.
ROOT = 3
#: Grams (12 bytes each) and words that are broadcast at most.
OFTEN_GRAMS, OFTEN_WORDS = 2_000_000, 400_000
END_WORD = "\n"
_HALF = math.log(0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up."""
    x = x.astype(np.float64)
    small = x < 10
    moved = np.where(small, x + 10, x)
    out = (moved - 0.5) * np.log(moved) - moved + 0.5 * math.log(2 * math.pi) + 1 / (12 * moved) - 1 / (360 * moved**3)
    if small.any():
        y, less = x[small], np.zeros(int(small.sum()))
        for k in range(10):
            less += np.log(y + k)
        out[small] -= less
    return out


def evidence(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and each key's index among them."""
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    return sorted_keys[new], np.cumsum(new) - 1


def weighted(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, root: int = ROOT) -> tuple[np.ndarray, dict]:
    """For sorted grams: the mixed probability of each of the last byte's bits at the root contexts (nan where the root has
    no count), and the roots' nodes: (context, bits so far), zeros, ones, log weighted probability."""
    levels = []
    for k in range(root, depth + 1):
        own = ngrams.level(keys, depth, k)
        order = np.argsort(own, kind="stable")
        distinct, rank = _runs(own[order])
        index = np.empty(len(keys), np.int64)
        index[order] = rank
        levels.append((distinct, index, np.bincount(index, weights=counts, minlength=len(distinct))))
    mixed, nodes = np.empty((len(keys), 8), np.float32), {n: [] for n in ("node", "n0", "n1", "logpw")}
    for bit in range(8):
        below = None
        estimates = []
        for distinct, index, n in reversed(levels):
            prefix, at = _runs(distinct >> np.uint64(8 - bit))
            one = ((distinct >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            n1 = np.bincount(at, weights=n * one, minlength=len(prefix))
            n0 = np.bincount(at, weights=n * ~one, minlength=len(prefix))
            own = evidence(n0, n1)
            if below is None:
                logpw, share = own, np.ones(len(own))
            else:
                longer, longer_pw = below
                parent = ((longer >> np.uint64(8 + bit)) << np.uint64(bit)) | (longer & np.uint64((1 << bit) - 1))
                children = np.bincount(np.searchsorted(prefix, parent), weights=longer_pw, minlength=len(prefix))
                logpw = _HALF + np.logaddexp(own, children)
                share = np.exp(_HALF + own - logpw)
            below = (prefix, logpw)
            node, bits = at[index], one[index]
            estimates.append(((np.where(bits, n1[node], n0[node]) + 0.5) / (n0[node] + n1[node] + 1), share[node], (n0 + n1)[node] > 0))
        p = None
        for own, share, seen in estimates:  # from the longest context to the root
            p = own if p is None else share * own + (1 - share) * np.where(longer_seen, p, own)
            longer_seen = seen
        mixed[:, bit] = np.where(longer_seen, p, np.nan)
        nodes["node"].append((prefix >> np.uint64(bit)) << np.uint64(8) | np.uint64(1 << bit) | (prefix & np.uint64((1 << bit) - 1)))
        nodes["n0"].append(n0)
        nodes["n1"].append(n1)
        nodes["logpw"].append(logpw)
    return mixed, {k: np.concatenate(v) for k, v in nodes.items()}


@dataclass
class Tops:
    """The mixture weights of contexts of two bytes (sorted by context and node), one byte and none."""

    keys: np.ndarray
    one: np.ndarray
    share: np.ndarray
    seen: np.ndarray
    upper: tuple[np.ndarray, ...]


def tops(rows: pa.Table) -> Tops:
    """From the sums over two-byte contexts (key: context and node, n0, n1, children): own probability of a one and share, for depth 2, 1 and 0."""
    order = np.argsort(rows["key"].to_numpy())
    keys, z, o, children = (rows[c].to_numpy()[order] for c in ("key", "n0", "n1", "children"))
    own = evidence(z, o)
    logpw = _HALF + np.logaddexp(own, children)
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    at = (keys >> 16, keys & 255)
    for table, values in ((n0, z), (n1, o), (below, logpw)):
        np.add.at(table, at, values)
    own1 = evidence(n0, n1)
    logpw1 = _HALF + np.logaddexp(own1, below)
    z0, z1 = n0.sum(axis=0), n1.sum(axis=0)
    own0 = evidence(z0, z1)
    logpw0 = _HALF + np.logaddexp(own0, logpw1.sum(axis=0))
    upper = ((n1 + 0.5) / (n0 + n1 + 1), np.exp(_HALF + own1 - logpw1), n0 + n1 > 0, (z1 + 0.5) / (z0 + z1 + 1), np.exp(_HALF + own0 - logpw0))
    return Tops(keys, ((o + 0.5) / (z + o + 1)).astype(np.float32), np.exp(_HALF + own - logpw).astype(np.float32), z + o > 0, upper)


def finished(keys: np.ndarray, mixed: np.ndarray, top: Tops, depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each gram's last byte: the roots' mixtures mixed with contexts of two bytes, one and none."""
    one1, share1, seen1, one0, share0 = top.upper
    pair = (keys >> np.uint64(8 * depth - 8)).astype(np.int64)
    context, last = pair >> 8, (keys & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for bit in range(8):
        node = (1 << bit) | (last >> (8 - bit))
        is_one = (last >> (7 - bit) & 1).astype(bool)
        at = np.searchsorted(top.keys, pair << 8 | node)
        own = np.where(is_one, top.one[at], 1 - top.one[at])
        p = np.where(np.isnan(mixed[:, bit]), own, mixed[:, bit])
        p = top.share[at] * own + (1 - top.share[at]) * p
        own = np.where(is_one, one1[context, node], 1 - one1[context, node])
        p = share1[context, node] * own + (1 - share1[context, node]) * np.where(top.seen[at], p, own)
        own = np.where(is_one, one0[node], 1 - one0[node])
        out += np.log10(share0[node] * own + (1 - share0[node]) * np.where(seen1[context, node], p, own))
    return out


def _packed_rows(values: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    data = np.ascontiguousarray(values)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.dtype.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def gram_values(counts: DataFrame, tasks: int) -> DataFrame:
    """gram, often, value: log10 of each gram's probability, from gram, n (0: only in texts to score), often."""
    spark = counts.sparkSession
    schema = "gram bigint, often boolean, mixed binary, node bigint, n0 double, n1 double, logpw double"

    def subtree(own: pa.Table) -> pa.Table:
        keys, n = own.column("gram").to_numpy().astype(np.uint64), own.column("n").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        mixed, nodes = weighted(keys, n[order].astype(np.float64))
        none = pa.nulls(len(keys))
        part = pa.table({"gram": pa.array(keys.astype(np.int64)), "often": own.column("often").take(pa.array(order)), "mixed": _packed_rows(mixed), "node": none.cast(pa.int64()), **{c: none.cast(pa.float64()) for c in ("n0", "n1", "logpw")}})
        none = pa.nulls(len(nodes["node"]))
        return pa.concat_tables([part, pa.table({"gram": none.cast(pa.int64()), "often": none.cast(pa.bool_()), "mixed": none.cast(pa.binary()), "node": pa.array(nodes["node"].astype(np.int64)), **{c: pa.array(nodes[c]) for c in ("n0", "n1", "logpw")}})])

    # a root has at most 256^(DEPTH - ROOT + 1) grams, however large the corpus
    placed = counts.withColumn("task", F.pmod(F.xxhash64(F.shiftright("gram", 8 * (DEPTH - ROOT + 1))), F.lit(tasks)))
    trees = common.written(placed.groupBy("task").applyInArrow(subtree, schema))
    # a node is its context's bytes, nearest first, and the bits so far; without the root's farthest byte it is a node of two-byte contexts
    key = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255).cast("bigint")))
    nodes = trees.where("node IS NOT NULL").groupBy(key.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("logpw").alias("children"))
    top = spark.sparkContext.broadcast(tops(nodes.toArrow()))  # at most 256^3 rows, whatever the corpus; UTF-8 text has far fewer
    values = common.spark_schema(spark, "gram bigint, often boolean, value float")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy()
            mixed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8)
            value = finished(grams.astype(np.uint64), mixed, top.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["gram", "often", "value"])

    return trees.where("gram IS NOT NULL").select("gram", "often", "mixed").mapInArrow(rows, values)


def trains(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of joined texts, each word's number among them, and where each text's words begin. An empty text has one empty word."""
    lists = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    words = lists.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), lists.offsets.to_numpy()


def _column(rows: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in rows.column(name).chunks] or [pa.array([], kind)])


def often(counts: DataFrame, most: int) -> Column:
    """Whether a row of counts (blocks) is in so many blocks that at most `most` rows are in as many."""
    level = F.floor(F.log2("blocks") * 16).cast("int")
    least, room = 1 << 30, most
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return level >= least


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, block_bytes: int = ngrams.BLOCK_BYTES, often_grams: int = OFTEN_GRAMS, often_words: int = OFTEN_WORDS) -> DataFrame:
    """Base and model score of every text, and the model's code length in bits a byte. train: which rows to learn from."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (trains(id_col) if train is None else train).alias("train"))
    placed = ngrams.blocks(own, "doc_id", "text", block_bytes)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's distinct words and grams, with their counts in its training texts."""
        counts, own, trained, number = ngrams.Counts(), [], 0, 0
        for part in (p for batch in batches for p in common.pieces(batch)):
            number = part.column("__block")[0].as_py()
            texts, learn = [ngrams.joined(t, True) for t in part.column("text").to_pylist()], np.array(part.column("train").to_pylist(), bool)
            words, at, begins = _words(texts)
            own.append(pa.table({"word": words, "n": np.bincount(at, weights=np.repeat(learn, np.diff(begins)), minlength=len(words)).astype(np.int64)}))
            trained += int(learn.sum())
            for flag in (True, False):
                chosen = [t for t, yes in zip(texts, learn.tolist(), strict=True) if yes == flag]
                for a, b in ngrams.batches_of(chosen):
                    counts.add(ngrams.grams(chosen[a:b], DEPTH)[0], flag)
        found = pa.concat_tables(own).group_by("word", use_threads=False).aggregate([("n", "sum")])
        found = found.filter(pc.greater(pc.binary_length(found["word"]), 0))  # without the empty word of empty texts
        words = pa.concat_arrays([_column(found, "word", pa.large_binary()), pa.array([END_WORD.encode()], pa.large_binary())])
        n_words = np.append(found["n_sum"].to_numpy(), trained)
        names = ["__block", "word", "gram", "n"]
        for at in range(0, len(words), 50_000):
            part, n = words[at : at + 50_000].cast(pa.large_string()).cast(pa.string()), pa.array(n_words[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int32)), part, pa.nulls(len(part), pa.int64()), n], names=names)
        keys, n = counts.merge()
        for at in range(0, len(keys), 50_000):
            part = pa.array(keys[at : at + 50_000].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int32)), pa.nulls(len(part), pa.string()), part, pa.array(n[at : at + 50_000].astype(np.int64))], names=names)

    seen = common.written(placed.groupBy("__block").applyInArrow(gathered, "__block int, word string, gram bigint, n bigint"))
    words = seen.where("word IS NOT NULL").select("__block", "word", "n")
    in_blocks = F.count("*").alias("blocks")
    of_word = common.written(words.groupBy("word").agg(F.sum("n").cast("double").alias("value"), in_blocks))
    total = of_word.agg(F.sum("value").cast("bigint"), F.count(F.when(F.col("value") > 0, 1))).first()
    n_train, n_distinct = total[0] or 0, total[1] or 0
    counts = common.checkpointed(seen.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"), in_blocks))
    values = common.checkpointed(gram_values(counts.withColumn("often", often(counts, often_grams)).drop("blocks"), max(16, counts.count() // 100_000)))
    of_word = of_word.withColumn("often", often(of_word, often_words)).drop("blocks")
    top_words, top_grams = (t.where("often").drop("often") for t in (of_word, values))
    got = [t.toArrow() for t in (top_words, top_grams)]
    shared = spark.sparkContext.broadcast((_column(got[0], "word", pa.large_binary()), got[0].column("value").to_numpy(), got[1].column("gram").to_numpy().astype(np.uint64), got[1].column("value").to_numpy()))
    # the others, each word or gram once on the right, so that one of many blocks is split over tasks
    rare = lambda of, key, found, all_of: of.join(F.broadcast(found.select(key)), key, "left_anti").join(all_of.where("NOT often").drop("often"), key)
    known = rare(words.select("__block", "word"), "word", top_words, of_word).select("__block", "word", F.lit(None).cast("bigint").alias("gram"), "value")
    in_block = rare(seen.where("gram IS NOT NULL").select("__block", "gram"), "gram", top_grams, values)
    known = known.unionByName(in_block.select("__block", F.lit(None).cast("string").alias("word"), "gram", "value"))
    norm = n_train + 0.5 * (n_distinct + 1)

    def meet(block: pa.Table, known: pa.Table) -> pa.Table:
        is_word = known.column("word").is_valid()
        rest = known.filter(pc.invert(is_word))
        top_word, top_count, top_gram, top_value = shared.value
        tables = [ngrams.Lookup(top_gram, top_value), ngrams.Lookup(rest.column("gram").to_numpy().astype(np.uint64), rest.column("value").to_numpy().astype(np.float32))]
        known = known.filter(is_word)
        names, count = pa.concat_arrays([top_word, _column(known, "word", pa.large_binary())]), np.append(top_count, known.column("value").to_numpy())
        end = count[pc.index_in(pa.array([END_WORD.encode()], pa.large_binary()), names)[0].as_py()]
        out: list[list[np.ndarray]] = []
        for part in common.pieces(block):
            texts = [ngrams.joined(t, True) for t in part.column("text").to_pylist()]
            words, at, begins = _words(texts)
            found = pc.index_in(words, names)
            of = np.where(found.is_valid().to_numpy(zero_copy_only=False), count[found.fill_null(0).to_numpy()], np.nan)  # nan: the empty word
            per_text = lambda each: np.add.reduceat(each[at], begins[:-1])  # noqa: B023, E731
            base = per_text(np.where(np.isnan(of), 0.0, np.log10((of + 0.5) / norm))) + math.log10((end + 0.5) / norm)
            known_words = per_text((of > 0).astype(np.int64)) + int(end > 0)
            out.append([per_text((~np.isnan(of)).astype(np.int64)) + 1, known_words, base, *ngrams.sums(texts, tables, DEPTH)])
        n_tokens, n_known, base, score, n_bytes = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0)] * 5
        held = pc.invert(_column(block, "train", pa.bool_()))
        return pa.table({"doc_id": block.column("doc_id"), "held_out": held, "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(block.num_rows, n_train), pa.int64()), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(score * -math.log2(10) / n_bytes)})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
    return placed.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(meet, schema)


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.read_table(spark, sf_dir, "documents"))
