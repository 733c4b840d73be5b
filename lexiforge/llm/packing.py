"""Hierarchical packing of documents into windows of several context sizes.

A map-only job: each task packs the documents of its own partition, block by block, so nothing is shuffled and
no task holds more than a block. Within a block
  1. a document gives whole windows of the longest tier while it can; what is left is routed to the smallest
     tier that holds it;
  2. tier by tier, from the longest, each rest opens a window and its gap is filled from shorter tiers: the longest
     rest that fits, else a cut of the shortest, so a window ends exactly full;
  3. rests that no filler completes are joined and cut into windows again, the last one into powers of two, which
     need no padding;
  4. windows are dealt to step groups of about equal tokens, largest first.

Word ids are remembered for the length of a task; unknown words go through a rank table of the same vocabulary, and texts with
characters outside its plain case go through the tokenizers library. Nulls count as empty texts, which hold the
end id alone. Repeated rows are packed once each. Only id and text are read, so extra columns cannot clash. An empty
table gives no pieces. Piece, sequence and group numbers depend on how the table is split into partitions, as a packing
may; the pieces of a document always cover it once.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe import byte_alphabet, proven

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Windows of the longest tier that a step group holds.
GROUP_WINDOWS = 32
#: Rows and bytes of text of a block, which is packed by itself.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 64 << 20
#: Words whose ids a task remembers at most, and the longest one remembered.
REMEMBERED, LONGEST = 400_000, 64
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class WordIds:
    """Ids of whole texts under a word-level BPE file whose words end in a suffix and whose white space is dropped."""

    #: Split rule of this vocabulary (fixed value).
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SUFFIX = "</w>"
    #: Characters that Python and the library do not treat alike.
    APART = "\x00\x1c\x1d\x1e\x1f"

    def __init__(self, source: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        vocab = json.loads(source)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks, self.ids = {}, np.zeros(len(vocab) + 2, "<u4")
        for token, i in vocab.items():
            body, ends = token.removesuffix(self.SUFFIX), token.endswith(self.SUFFIX)
            if all(c in back for c in body):
                ranks[bytes(back[c] for c in body) + b"\x00" * ends] = i
        for i in ranks.values():
            self.ids[i] = i
        self.line = ranks[b"\n"]
        self.table = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(self.WORD)
        self.known: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many words, looked up in one call."""
        out, plain = {}, []
        for w in words:
            if "<|" in w or "\u03a3" in w or "\u0130" in w or not proven(w):
                out[w] = self.slow(w)
            else:
                plain.append(w)
        if not plain:
            return out
        lower = unicodedata.normalize("NFC", "\n".join(plain)).lower().split("\n")
        text = "\n".join([w + "\x00" if w.isalpha() else self.words.sub("\\g<0>\x00", w) for w in lower])
        ids = np.array(self.table.encode_ordinary(text + "\n"), "<u4")
        ends = np.flatnonzero(ids == self.line).tolist()
        packed, at = ids.tobytes(), 0
        for w, end in zip(plain, ends, strict=True):
            out[w] = packed[4 * at : 4 * end]
            at = end + 1
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. New words of all texts are looked up together."""
        out: list = []
        lacking: dict[str, None] = {}
        find = self.known.get
        for t in texts:
            if any(map(t.__contains__, self.APART)):
                out.append(self.slow(t))
                continue
            words = t.split()
            found = list(map(find, words))
            if None in found:
                lacking.update((w, None) for w, ids in zip(words, found, strict=True) if ids is None)
                out.append((words, found))
            else:
                out.append(b"".join(found))
        new = self.learn(list(lacking))
        for i, x in enumerate(out):
            if type(x) is tuple:
                out[i] = b"".join([new[w] if ids is None else ids for w, ids in zip(*x, strict=True)])
        if len(self.known) + len(new) > REMEMBERED:  # a generation is full: begin with this block's words
            self.known = {}
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
        return out


_MADE: dict[int, WordIds] = {}


def made(source: str) -> WordIds:
    key = hash(source)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = WordIds(source)
    return _MADE[key]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces) for documents of these lengths; a piece is (document, start, length)."""
    longest, out, rests = tiers[0], [], []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    rests.sort()
    open_windows: list[tuple[int, list]] = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        at = bisect_right(rests, (below, 1 << 62, 0)) if below else 0
        opening, rests = rests[at:], rests[:at]
        while opening:
            size, doc, start = opening.pop()
            pieces, gap = [(doc, start, size)], tier - size
            filler = rests if below else opening
            while gap and filler:
                i = bisect_right(filler, (gap, 1 << 62, 0))
                size, doc, start = filler.pop(i - 1) if i else filler.pop(0)
                if size > gap:
                    insort(filler, (size - gap, doc, start + gap))
                    size = gap
                pieces.append((doc, start, size))
                gap -= size
            if gap:
                open_windows.append((tier, pieces))
            else:
                out.append((tier, pieces))
    pieces, room = [], longest
    rest = [p for _, w in open_windows for p in w]
    for doc, start, size in rest:
        while size:
            take = min(size, room)
            pieces.append((doc, start, take))
            start, size, room = start + take, size - take, room - take
            if not room:
                out.append((longest, pieces))
                pieces, room = [], longest
    left = longest - room
    for power in sorted({1 << b for b in range(left.bit_length()) if left >> b & 1}, reverse=True):
        window, need = [], power
        while need:
            doc, start, size = pieces.pop(0)
            if size > need:
                pieces.insert(0, (doc, start + need, size - need))
                size = need
            window.append((doc, start, size))
            need -= size
        out.append((power, window))
    return out


def step_groups(windows: list[tuple[int, list]], group_tokens: int) -> list[int]:
    """A group for each window, so that groups hold nearly the same number of tokens: largest first, to the emptiest."""
    groups = [(0, g) for g in range(max(1, round(sum(t for t, _ in windows) / group_tokens)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        tokens, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (tokens + windows[i][0], g))
    return out


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with their places in sequences. tiers: descending powers of two."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    schema = common.spark_schema(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, words = to_arrow_schema(schema), made(source.value)
        sequence = group = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        for piece in (p for batch in batches for p in common.pieces(batch, BLOCK_ROWS, BLOCK_BYTES)):
            ids, packed_ids = piece.column(0).to_pylist(), []
            for part in common.pieces(piece):
                packed_ids += [x + end for x in words.encode_all([t or "" for t in part.column(1).to_pylist()])]
            windows = pack_block([len(x) // 4 for x in packed_ids], tiers)
            groups = step_groups(windows, tiers[0] * GROUP_WINDOWS)
            rows = []
            for k, (tier, pieces) in enumerate(windows):
                offset = 0
                for doc, start, size in pieces:
                    x = packed_ids[doc]
                    rows.append((ids[doc], start, size, zlib.crc32(x[4 * start : 4 * (start + size)]), len(x) // 4, sequence + k, offset, tier, group + groups[k]))
                    offset += size
            sequence += len(windows)
            group += max(groups, default=-1) + 1
            cols = zip(*rows, strict=True) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, target, strict=True)], schema=target)
        words.known = {}  # idle workers stay small beside the next stage

    out = docs.select(id_col, text_col).mapInArrow(common.lean(run), schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(common.read_table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))
