"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lowers case and maps look-alike letters and digit substitutions to plain letters, so that disguised words meet
the lexicon. Exception phrases cancel the matches inside them. The sum of the weights, and that sum normalised by
length, give the score through a logistic curve.

The lexicon is BASE_WORDS and what labelled texts teach: whole words and word beginnings that toxic texts have far more
often than clean ones. It and the curve are fitted on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, those
with the smallest hash of their id, one row of each id (the least text hash); so what reaches the driver is bounded too. Scoring covers all rows.

Null and empty texts score as texts without matches. Without labels BASE_WORDS and DEFAULT_CURVE hold. Of labels that share
an id the most toxic counts; null labels teach nothing. Repeated rows score alike. Only the named columns are read, so
extra ones cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
BASE_WORDS = ("idiot", "moron", "stupid", "loser", "worthless", "pathetic", "disgusting", "scum", "trash", "clown", "imbecile", "dumbass", "asshole", "bastard")
BASE_WEIGHT = 3.0
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "pond scum", "soap scum", "idiot proof")
DEFAULT_CURVE = (-2.0, 2.5, 0.5)
PREFIXES = (4, 5, 6, 7)
#: A pattern enters the lexicon with at least this log odds and this gain in log likelihood (chance hardly reaches it among a million candidates).
LEAST_WEIGHT, LEAST_GAIN = 2.5, 30.0
#: Look-alikes and digit substitutions (fixed values).
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝαεορνικτυχ0134578@$", "aeopcyxijshdqwaeopviktuxoieastbas", strict=True))
FOLD = str.maketrans(LOOKALIKES)
NOT_LETTERS = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """The text's folded words, each between single spaces."""
    return f" {NOT_LETTERS.sub(' ', (text or '').lower().translate(FOLD)).strip()} "


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    import ahocorasick

    out = ahocorasick.Automaton()
    for pattern, weight in lexicon.items():
        out.add_word(pattern, (len(pattern), weight))
    for phrase in exceptions:
        out.add_word(folded(phrase), (len(folded(phrase)), None))
    out.make_automaton()
    return out


def matches(found, text: str | None) -> tuple[float, int, int]:
    """Sum of weights, number of matches, number of words."""
    plain = folded(text)
    hits, spared = [], []
    for end, (size, weight) in found.iter(plain):
        (spared if weight is None else hits).append((end - size + 1, end, weight))
    if spared:
        spared.sort(key=lambda h: h[0])
        begins, reach = [a for a, _, _ in spared], [*accumulate((b for _, b, _ in spared), max)]
        hits = [h for h in hits if not ((k := bisect_right(begins, h[0])) and h[1] <= reach[k - 1])]
    return sum(h[2] for h in hits), len(hits), plain.count(" ") - 1


def features(weight: float, words: int) -> tuple[float, float]:
    """The sum of weights on a log scale, and normalised by length."""
    return math.log1p(weight), weight / math.sqrt(words + 10)


def score(curve: tuple[float, float, float], weight: float, words: int) -> float:
    x1, x2 = features(weight, words)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, curve[0] + curve[1] * x1 + curve[2] * x2))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, n_toxic: int, n_clean: int) -> DataFrame:
    """text and toxic of the sampled labelled rows; at most n_toxic + n_clean ids are broadcast."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    pick = lambda keep, n: rows.where(keep).orderBy(F.xxhash64(id_col), id_col).limit(n)
    ids = common.checkpointed(pick("toxic = 1", n_toxic).unionByName(pick("toxic = 0", n_clean)).select(F.col(id_col).alias("key"), F.col("toxic").cast("int").alias("toxic")))
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(ids), "key").groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _candidates(sample: DataFrame) -> DataFrame:
    """pattern, toxic, clean: texts of either label that have each whole word and word beginning."""
    schema = common.spark_schema(sample.sparkSession, "pattern string, toxic bigint, clean bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, n = to_arrow_schema(schema), [{}, {}]

        def flushed() -> pa.RecordBatch:
            keys = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1].get(k, 0) for k in keys], pa.int64()), pa.array([n[0].get(k, 0) for k in keys], pa.int64())], schema=target)
            n[0].clear(), n[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(folded(text).split())
                patterns = {f" {w} " for w in words}.union(*({f" {w[:k]}" for w in words if len(w) > k} for k in PREFIXES))
                own = n[toxic]
                for p in patterns:
                    own[p] = own.get(p, 0) + 1
                if len(n[0]) + len(n[1]) > 300_000:
                    yield flushed()
        yield flushed()

    return sample.mapInArrow(common.lean(run), schema).groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """A lexicon from (pattern, toxic texts, weight): the strongest first, none that another one already covers."""
    out: dict[str, float] = {f" {w} ": BASE_WEIGHT for w in BASE_WORDS}
    for pattern, _, weight in sorted(rows, key=lambda r: (-r[1] * r[2], -len(r[0]), r[0])):
        if pattern in out:
            out[pattern] = max(out[pattern], weight)
        elif not any(p in pattern or p.startswith(pattern) for p in out):
            out[pattern] = weight
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3), design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> tuple[dict[str, float], tuple[float, float, float]]:
    """The lexicon (pattern: weight) and the curve, from a bounded sample of labelled rows."""
    sample = common.checkpointed(sampled(docs, labels, id_col, text_col, label_col, n_toxic, n_clean))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return chosen([]), DEFAULT_CURVE
    rest = lambda k, n: F.when(k > 0, k * F.log(k * (toxic + clean) / (n * (F.col("toxic") + F.col("clean"))))).otherwise(F.lit(0.0))
    gain = 2 * (rest(F.col("toxic"), toxic) + rest(F.col("clean"), clean))  # of the log likelihood, if the pattern depends on the label
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1)))
    rows = _candidates(sample).withColumn("weight", weight).where((gain >= LEAST_GAIN) & (F.col("weight") >= LEAST_WEIGHT))
    lexicon = chosen([tuple(r) for r in rows.select("pattern", "toxic", "weight").collect()])  # of the sampled texts only
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(texts: list, toxic: list) -> list:
        found = automaton(shared.value)
        x = [features(w, size) for w, _, size in (matches(found, t) for t in texts)]
        return [[a for a, _ in x], [b for _, b in x], toxic]

    got = common.map_rows(sample, measured, "x1 double, x2 double, y int").toArrow()  # at most n_toxic + n_clean rows
    return lexicon, _curve(np.column_stack([got["x1"].to_numpy(), got["x2"].to_numpy()]), got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, model: tuple[dict[str, float], tuple[float, float, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score, matches and words of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list = []

    def rows(ids: list, texts: list) -> list:
        lexicon, curve = shared.value
        if not kept:
            kept.append(automaton(lexicon))
        found = [matches(kept[0], t) for t in texts]
        return [ids, [score(curve, w, size) for w, _, size in found], [n for _, n, _ in found], [size for _, _, size in found]]

    return common.map_rows(docs.select(id_col, text_col), rows, f"{id_col} bigint, score double, n_matches bigint, n_words bigint")


def kept(docs: DataFrame, model: tuple[dict[str, float], tuple[float, float, float]], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below `least`."""
    shared, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, curve = shared.value
        found = automaton(lexicon)
        for batch in batches:
            clean = []
            for part in common.pieces(batch):
                measured = (matches(found, t) for t in part.column(at).to_pylist())
                clean += [score(curve, w, size) < least for w, _, size in measured]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(common.lean(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels")
    out = scored(docs, trained(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
