"""Quality rules as weak supervision: each rule votes or abstains, and expectation-maximisation weighs the votes.

One pass measures every text and takes the rules' votes. Documents with the same votes are one pattern, and with R rules
there are at most 3^R patterns (6,561 for eight), whatever the number of documents; only their counts reach the
driver. There EM fits, for either hidden class, how often each rule that votes says good or bad (who abstains says nothing); a pattern's posterior is
the probability that its documents are good.

A null text has no words. Texts without words fail the base test. Repeated rows and ids give a row each. Only id
and text are read, so extra columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
GOOD, BAD, ABSTAIN = 1, 0, 2
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeated_windows", "capitals", "exclamations", "top_word")
ROUNDS = 60


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of that many (a power of two) words found twice or more. Exact: windows are named by doubling."""
    n = len(ids)
    if n <= window:
        return 0
    names, size, counts = ids, 1, None
    while size < window:
        pairs = names[:-size].astype(np.int64) * n + names[size:]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(names):
            return 0  # already no two alike
        size *= 2
    twice = np.flatnonzero(counts[names] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then what the rules need besides: lines, capitals, letters, exclamations, top word."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = text.split("\n")
    seen: set[str] = set()
    again = n_lines = 0
    for line in lines:
        if line.strip(SPACES):
            n_lines += 1
            again += line in seen
            seen.add(line)
    letters = raw.translate(None, bytes(set(range(256)) - set(_LETTERS)))
    capitals = len(letters) - len(letters.translate(None, _UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(ids),
        n_lines,
        capitals,
        len(letters),
        text.count("!!"),
        int(np.bincount(ids).max()) if words else 0,
    )


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(m: tuple) -> tuple[int, ...]:
    """What each of RULES says of a text with these measures."""
    n, chars, symbols, dup, repeat, lines, capitals, letters, marks, top = m
    return (
        _vote(n >= 50, n < 20),
        _vote(3 * n <= chars <= 10 * n, n > 0 and not 2 * n <= chars <= 15 * n),
        _vote(50 * symbols <= n, 10 * symbols > n),
        _vote(lines > 1 and dup == 0, 2 * dup > lines),
        _vote(repeat == 0, 100 * repeat > 25 * n),
        _vote(letters > 0 and 5 * capitals < letters, letters > 0 and 2 * capitals > letters),
        _vote(marks == 0, 10 * marks > n),
        _vote(n >= 20 and 6 * top < n, n >= 20 and 10 * top > 3 * n),
    )


def fitted(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, the table [class, rule, vote] of vote probabilities, and the share of good."""
    post = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)
    chance, prior = np.ones((2, patterns.shape[1], 3)), 0.5  # whoever abstains says nothing
    for _ in range(rounds):
        share = np.stack([counts * (1 - post), counts * post])
        prior = float((share[1].sum() + 1) / (share.sum() + 2))
        cast = share @ (patterns != ABSTAIN)
        for vote in (BAD, GOOD):
            chance[:, :, vote] = (share @ (patterns == vote) + 0.5) / (cast + 1)
        log = np.stack([np.log(np.take_along_axis(chance[c], patterns.T, axis=1)).sum(axis=0) for c in (0, 1)])
        log += np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, chance, prior


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's measures and its vote pattern (a digit for each rule: 1 good, 0 bad, 2 abstains)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(ids: list, texts: list) -> list:
        found = [measures(t) for t in texts]
        return [ids, *([m[k] for m in found] for k in range(len(names))), ["".join(map(str, votes(m))) for m in found]]

    return common.map_rows(docs.select(id_col, text_col), rows, ", ".join([f"{id_col} bigint", *(f"{n} bigint" for n in names), "pattern string"]))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Measures, base_failed, quality (posterior probability) and kept: not base_failed and quality at least `least`."""
    spark = docs.sparkSession
    found = common.checkpointed(measured(docs, id_col, text_col))
    counted = [(r["pattern"], r["count"]) for r in found.groupBy("pattern").count().orderBy("pattern").collect()]  # at most 3^R rows
    patterns = np.array([[int(c) for c in p] for p, _ in counted], np.int64).reshape(-1, len(RULES))
    post = fitted(patterns, np.array([c for _, c in counted], float))[0] if counted else []
    table = spark.createDataFrame([(p, float(x)) for (p, _), x in zip(counted, post, strict=True)], "pattern string, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = found.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "pattern")
