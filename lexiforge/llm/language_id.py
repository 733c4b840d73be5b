"""Language identification with labelled spans.

Training counts hashed character trigrams of every training text, per language: at most BUCKETS numbers for each
language and task, added up by Spark. The table that reaches the driver has at most CELLS numbers, besides those of scripts: with
more than CELLS / BUCKETS languages the buckets are folded, so that none is left out. A word's script narrows its candidates to languages that use that script; letters of a
script that is not listed leave all. Each word scores every candidate by its trigrams, and Viterbi with a penalty for switching labels the words; the language with
the most letters' words is the document's, and its share of them is the score.

Null texts and texts without a letter are `und` with score 0, and so is everything if there is no training text. Null
languages teach nothing. Ties between languages go to the first in order. Repeated rows count each time. Only the
named columns are read, so extra ones cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Numbers of the model that is broadcast, and of the scores that are held at once.
CELLS, SCORES = 26_000_000, 8_000_000
SWITCH_PENALTY = 14.0
ROWS = 512
#: First and last code point of each script, by name.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
LETTER = regex.compile(r"\p{L}")
_SPACE = np.array([9, 10, 11, 12, 13], np.uint32)


#: Numbers of scripts: none, letters of a script that is not listed, and the listed ones from 2 up.
OTHER, N_SCRIPTS = 1, len(SCRIPTS) + 2


def _script_table() -> np.ndarray:
    """The script of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for begin, end in ((0, 0xD800), (0xE000, 0x110000)):
        for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(begin, end)))):
            table[begin + run.start() : begin + run.end()] = OTHER
    for k, ranges in enumerate(SCRIPTS.values(), OTHER + 1):
        for a, b in ranges:
            table[a : b + 1] = k
    for a, b in ((0x5B, 0x60), (0x7B, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7)):  # signs between Latin letters
        table[a : b + 1] = 0
    return table


SCRIPT_OF = _script_table()


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams around every character of every word; where words begin among them; each text's number of words; each word's script."""
    joined = "\n".join(["", *((t or "").lower() for t in texts), ""]).encode("utf-32-le")
    cp = np.frombuffer(joined, np.uint32)
    lengths = np.array([len((t or "").lower()) for t in texts], np.int64)
    gap = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cp = np.where(gap, np.uint32(32), cp)
    h = np.zeros(len(cp), np.uint32)
    h[1:-1] = (cp[:-2] * np.uint32(0x9E3779B1)) ^ (cp[1:-1] * np.uint32(0x85EBCA77)) ^ (cp[2:] * np.uint32(0xC2B2AE3D))
    inside = np.flatnonzero(~gap)
    begins = np.flatnonzero(gap[inside - 1]) if len(inside) else np.zeros(0, np.int64)
    text_at = np.cumsum(lengths + 1) - lengths
    n_words = np.diff(np.searchsorted(inside[begins], np.append(text_at, len(cp)))) if len(texts) else np.zeros(0, np.int64)
    script = SCRIPT_OF[cp[inside]]
    words = np.maximum.reduceat(script, begins) if len(begins) else np.zeros(0, np.uint8)
    return (h[inside] >> np.uint32(16)).astype(np.int64), begins, n_words, words


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of every word, for many texts at once: step t handles word t of all texts that have one."""
    total, n_lang = scores.shape
    order = np.argsort(-n_words, kind="stable")
    lengths, offsets = n_words[order], (np.cumsum(n_words) - n_words)[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    before, best = np.zeros((total, n_lang), np.uint8 if n_lang < 256 else np.uint16), np.zeros(total, np.int64)
    stay = np.arange(n_lang)
    value = np.zeros((len(lengths), n_lang))
    for t, k in enumerate(active):
        at = offsets[:k] + t
        v = value[:k]
        if t:
            top = v.argmax(axis=1)
            moved = v[np.arange(k), top] - penalty
            switch = moved[:, None] > v
            before[at] = np.where(switch, top[:, None], stay)
            v = np.where(switch, moved[:, None], v)
        value[:k] = v + scores[at]
    state = value.argmax(axis=1) if len(lengths) else np.zeros(0, np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        best[at] = state[:k]
        state[:k] = before[at, state[:k]]
    return best


def portions(texts: list, n_langs: int) -> Iterator[list]:
    """The texts in turn, so many at once that the scores of their words are about SCORES numbers."""
    begin = cells = 0
    for i, t in enumerate(texts):
        own = (len(t or "") // 2 + 1) * n_langs
        if i > begin and cells + own > SCORES:
            yield texts[begin:i]
            begin = i
            cells = 0
        cells += own
    if begin < len(texts):
        yield texts[begin:]


def held_out(id_col: str = "doc_id", part: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == part


def counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, bucket, n over all training texts; buckets from BUCKETS up count words of each script."""
    schema = common.spark_schema(train.sparkSession, "lang string, bucket int, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.pieces(batch, ROWS):
                rows = sorted(zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True), key=lambda x: x[0])
                for lang, own in groupby(rows, key=lambda x: x[0]):
                    grams, _, _, scripts = trigrams([t for _, t in own])
                    n = found.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    n[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(scripts, minlength=N_SCRIPTS)
        target = to_arrow_schema(schema)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=target)

    return train.select(text_col, lang_col).mapInArrow(common.lean(run), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learned(train: DataFrame, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log probabilities [bucket, language], and which languages each script allows [script, language]."""
    table = common.checkpointed(counts(train, text_col, lang_col))
    langs = [r[0] for r in table.select("lang").distinct().orderBy("lang").collect()]
    buckets = BUCKETS
    while buckets * len(langs) > cells and buckets > 1:
        buckets //= 2
    folded = F.when(F.col("bucket") < BUCKETS, F.pmod("bucket", F.lit(buckets))).otherwise(F.col("bucket") - BUCKETS + buckets)
    got = table.groupBy("lang", folded.cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((buckets + N_SCRIPTS, len(langs)))
    where = {lang: k for k, lang in enumerate(langs)}
    n[got["bucket"].to_numpy(), [where[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    grams, scripts = n[:buckets], n[buckets:]
    logp = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * buckets)).astype(np.float32)
    allowed = scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1)
    allowed |= ~allowed.any(axis=1, keepdims=True)
    allowed[OTHER] = True
    return langs, logp, allowed


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """lang_pred, score and spans (first word, words, language) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> list:
        langs, logp, allowed = shared.value
        pred, share, spans = [], [], []
        if not langs:
            return [ids, ["und"] * len(ids), [0.0] * len(ids), [[]] * len(ids)]
        path, sizes, lettered = [], [], []
        for part in portions(texts, len(langs)):
            grams, begins, n_words, scripts = trigrams(part)
            s = np.zeros((len(begins), len(langs)), np.float32)
            if len(begins):
                grams %= len(logp)
                for k in range(len(langs)):
                    s[:, k] = np.add.reduceat(logp[grams, k], begins)
                s[~allowed[scripts]] = -1e6
                s[scripts == 0] = 0
            path.append(viterbi(s, n_words, penalty))
            sizes.append(n_words)
            lettered.append(scripts > 0)
        sizes, path, lettered = (np.concatenate(x) for x in (sizes, path, lettered))
        end = 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            own, begin = path[end : end + n], end
            end += n
            if not text or not LETTER.search(text):
                pred.append("und")
                share.append(0.0)
                spans.append([])
                continue
            by = np.bincount(own[lettered[begin:end]], minlength=len(langs))
            best = int(by.argmax())
            pred.append(langs[best])
            share.append(float(by[best] / by.sum()))
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            spans.append([(int(a), int(b - a), langs[own[a]]) for a, b in zip(cut, [*cut[1:], n], strict=True)])
        return [ids, pred, share, [[{"first": a, "words": b, "lang": c} for a, b, c in x] for x in spans]]

    return common.map_rows(docs.select(id_col, text_col), rows, f"{id_col} bigint, lang_pred string, score double, spans array<struct<first: bigint, words: bigint, lang: string>>")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out() & F.col("lang").isNotNull()))
    out = identified(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))
