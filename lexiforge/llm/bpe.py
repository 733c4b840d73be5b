"""Byte-pair encoding and decoding with a contiguous rank array per word.

A tokenizer file is read once on the driver and broadcast (1 to 2 MB, whatever the data). A word keeps its
parts and the ranks of adjacent pairs in two plain lists: find the least rank, merge there, drop one boundary
and refresh the ranks on either side. Words over LONG_WORD bytes use a heap of pairs, which gives the same
merges without rescanning. Words repeat, so each worker remembers their ids in two generations of bounded size.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Repeated rows give repeated
results. Only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words longer than this (in bytes) are merged by heap instead of by scanning.
LONG_WORD = 128
#: Entries of one generation of a worker's word memory, and the longest one remembered (in characters).
REMEMBERED, LONGEST = 400_000, 64
INF = 1 << 40
_MARKS = (".", ",", ";", ":", "!", "?", ")")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Remembered(dict):
    """A dict that computes what it lacks and holds two generations, so its size stays bounded."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Characters that Python's tables and the tokenizers library's are proven to treat alike (a test compares each of them): ASCII,
#: letters and signs of Latin, Greek and Cyrillic, punctuation, kana, Han, Hangul and pictographs; no combining marks.
PROVEN = re.compile("[\x00-\x7e\xa0-\u024f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0513\u2010-\u2029\u202f-\u205e\u20a0-\u20b5\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]*")


def proven(text: str) -> bool:
    return text.isascii() or PROVEN.fullmatch(text) is not None


class ByteBPE:
    """Encoder and decoder for a byte-level BPE tokenizer file. Words with characters that are not proven are cut by the library."""

    #: Split rule of byte-level vocabularies (fixed value).
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, source: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        spec = json.loads(source)
        model, letters = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.first = [vocab[c] for c in letters]
        self.merge = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            self.merge[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.flat = np.frombuffer(b"".join(self.piece), np.uint8)
        self.length = np.array([len(p) for p in self.piece], np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.words = regex.compile(self.WORD).findall
        self.apart = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = Remembered(self.word)
        self.chunks = Remembered(self.chunk)

    def word(self, word: str) -> bytes:
        """The word's ids, each as 4 little-endian bytes."""
        parts = [self.first[b] for b in word.encode()]
        if len(parts) > LONG_WORD:
            parts = self.merge_long(parts)
        elif len(parts) > 1:
            parts = self.merge_short(parts)
        return struct.pack(f"<{len(parts)}I", *parts)

    def chunk(self, chunk: str) -> bytes:
        """The ids of a text between two cuts; a lone word, with or without a mark behind it, needs no pattern."""
        if not proven(chunk):
            return b"".join([self.known[chunk[a:b]] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)])
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha() and "'" not in chunk:
            return self.word(chunk)
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.known[chunk[-1]]
        return b"".join(map(self.known.__getitem__, self.words(chunk)))

    def merge_short(self, parts: list[int]) -> list[int]:
        find = self.merge.get
        ranks = [find(a << 20 | b, INF) for a, b in pairwise(parts)]
        ranks.append(INF)  # so that the last pair has a neighbour
        while (least := min(ranks)) != INF:
            i = ranks.index(least)
            parts[i] = new = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i + 1 < len(parts):
                ranks[i] = find(new << 20 | parts[i + 1], INF)
            if i:
                ranks[i - 1] = find(parts[i - 1] << 20 | new, INF)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        find, n = self.merge.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := find(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j], after[i] = rank & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := find(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    #: A single space between two other characters always starts a word, so text may be cut there.
    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Without any of these, every space inside a text is such a place.
    ODD = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or any(map(text.__contains__, self.ODD)):
            first, *rest = self.CUT.split(text)
        else:
            first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.chunks.__getitem__, [" " + x for x in rest]))

    def encode(self, text: str) -> bytes:
        if self.apart is None or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self.plain(text[at : m.start()]), int(self.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """Every id's bytes, gathered from one flat table, as text; what is not UTF-8 becomes U+FFFD."""
        size = self.length[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        at = np.arange(ends[-1], dtype=np.int32)
        at += np.repeat(self.start[ids] - (ends - size).astype(np.int32), size)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_MADE: dict[int, ByteBPE] = {}


def made(source: str) -> ByteBPE:
    """This worker's codec; it outlives a task, and so does its word memory."""
    key = hash(source)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteBPE(source)
    return _MADE[key]


def encoded(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (packed, unsigned 32-bit, little-endian) and what they decode to."""
    with open(path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def rows(ids: list, texts: list) -> list:
        codec = made(source.value)
        packed = [codec.encode(t or "") for t in texts]
        return [ids, packed, [codec.decode(np.frombuffer(p, "<u4")) for p in packed]]

    return common.map_rows(docs.select(id_col, text_col), rows, f"{id_col} bigint, ids binary, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of its decoded text."""
    path = common.tokenizer_path("byte_bpe_50k.json")
    out = encoded(spark, common.read_table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
