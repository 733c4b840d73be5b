"""64-bit FNV-1a and the Merkle digest built on it, vectorised over Arrow batches.

Spark has no wrapping unsigned arithmetic, so these run in numpy: all values of a batch advance together, byte column by
byte column, and a long content is many 64-byte leaves that also advance together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: FNV-1a offset basis and prime, and the factor of the right child (fixed values).
BASIS, PRIME, RIGHT = 14695981039346656037, 1099511628211, 16777619
LEAF = 64
_P, _R = np.uint64(PRIME), np.uint64(RIGHT)


def _fold(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of each row's first bytes."""
    h = np.full(len(lengths), BASIS, np.uint64)
    for k in range(matrix.shape[1]):
        h = np.where(k < lengths, (h ^ matrix[:, k]) * _P, h)
    return h


def fnv64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of every value; values of like length are folded together."""
    out = np.empty(len(values), np.uint64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        width = max(1, int(lengths[at].max()))
        matrix = np.frombuffer(b"".join(values[i].ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)
        out[at] = _fold(matrix, lengths[at])
    return out


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The digest of a pair of digests."""
    mixed = left * _P + right * _R
    return mixed + (mixed >> np.uint64(31))


def reduce_tree(level: np.ndarray) -> int:
    """Combine neighbours level by level; an odd last one is paired with 0."""
    while len(level) > 1:
        if len(level) % 2:
            level = np.append(level, np.uint64(0))
        level = combine(level[0::2], level[1::2])
    return int(level[0])


def leaves(content: bytes) -> np.ndarray:
    """FNV-1a of each 64-byte leaf; an empty content has one empty leaf."""
    n = max(1, -(-len(content) // LEAF))
    matrix = np.frombuffer(content.ljust(n * LEAF, b"\0"), np.uint8).reshape(n, LEAF)
    lengths = np.full(n, LEAF)
    lengths[-1] = len(content) - (n - 1) * LEAF
    return _fold(matrix, lengths)


def merkle64(content: bytes) -> int:
    return reduce_tree(leaves(content))


def hex16(value: int) -> str:
    return f"{int(value) & 0xFFFFFFFFFFFFFFFF:016x}"


_HEX = np.array([f"{i:02x}".encode() for i in range(256)])


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and how long it is; nothing is copied but offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def _fold_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of spans of data, longest first, so that a step touches only spans that still have a byte."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], -lengths[order]
    h = np.full(len(lengths), BASIS, np.uint64)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        m = int(np.searchsorted(left, -k))
        h[:m] = (h[:m] ^ data[at[:m] + k]) * _P
    out = np.empty_like(h)
    out[order] = h
    return out


def _hex_column(values: np.ndarray, like: pa.Array) -> pa.Array:
    """64-bit values as 16 hex digits each; null where like is."""
    digits = _HEX[values.astype(">u8").view(np.uint8)].tobytes()
    out = pa.StringArray.from_buffers(len(values), pa.py_buffer((np.arange(len(values) + 1) * 16).astype(np.int32)), pa.py_buffer(digits))
    return pc.if_else(pc.is_valid(like), out, pa.scalar(None, pa.string())) if like.null_count else out


@F.arrow_udf(StringType())
def fnv64_hex(values: pa.Array) -> pa.Array:
    """FNV-1a of binary values as 16 hex digits; null for null."""
    return _hex_column(_fold_spans(*_spans(values)), values)


def merkle64_many(contents: list[bytes]) -> list[int]:
    """Merkle digests of many contents, whose leaves are all folded together."""
    sizes = np.fromiter((max(1, -(-len(c) // LEAF)) for c in contents), np.int64, len(contents))
    ends = np.cumsum(sizes)
    if not len(ends):
        return []
    matrix = np.frombuffer(b"".join(c.ljust(n * LEAF, b"\0") for c, n in zip(contents, sizes.tolist(), strict=True)), np.uint8).reshape(-1, LEAF)
    lengths = np.full(len(matrix), LEAF)
    lengths[ends - 1] = np.fromiter(map(len, contents), np.int64, len(contents)) - (sizes - 1) * LEAF
    folded = _fold(matrix, lengths)
    return [int(folded[b - 1]) if n == 1 else reduce_tree(folded[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


#: Bytes whose leaves are folded together.
AT_ONCE = 8 << 20


def merkle64_column(values: pa.Array) -> np.ndarray:
    """Merkle digests of a binary column. Leaves are read where they lie in the Arrow batch, those of AT_ONCE bytes together, so a batch costs little memory besides its own."""
    data, starts, lengths = _spans(values)
    sizes = np.maximum(1, -(-lengths // LEAF))
    out, total = np.empty(len(starts), np.uint64), np.cumsum(sizes)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE // LEAF, side="right")))
        n = sizes[a:b]
        ends = np.cumsum(n)
        nth = np.arange(ends[-1]) - np.repeat(ends - n, n)
        folded = _fold_spans(data, np.repeat(starts[a:b], n) + nth * LEAF, np.minimum(LEAF, np.repeat(lengths[a:b], n) - nth * LEAF))
        out[a:b] = folded[ends - 1]
        for i in np.flatnonzero(n > 1):
            out[a + i] = reduce_tree(folded[ends[i] - n[i] : ends[i]])
        a = b
    return out


@F.arrow_udf(StringType())
def merkle64_hex(values: pa.Array) -> pa.Array:
    """Merkle digest of binary contents as 16 hex digits; null for null."""
    return _hex_column(merkle64_column(values), values)


@F.pandas_udf(StringType())
def combine_hex(left: pd.Series, right: pd.Series) -> pd.Series:
    """The digest of two digests, all as 16 hex digits."""
    ints = [np.array([int(x, 16) for x in s], np.uint64) for s in (left, right)]
    return pd.Series([hex16(x) for x in combine(*ints)])


class StreamDigest:
    """SHA-256 and Merkle digest of a stream of byte strings, with a carry of less than one leaf and one digest a tree level."""

    def __init__(self):
        import hashlib

        self.sha, self.carry, self.levels, self.empty = hashlib.sha256(), b"", [], True

    def update(self, data: bytes) -> None:
        self.sha.update(data)
        data = self.carry + data
        whole = len(data) - len(data) % LEAF
        for h in leaves(data[:whole]) if whole else ():
            self._push(0, h)
        self.carry = data[whole:]

    def _push(self, level: int, h: np.uint64) -> None:
        self.empty = False
        if level == len(self.levels):
            self.levels.append(None)
        if self.levels[level] is None:
            self.levels[level] = h
            return
        left, self.levels[level] = self.levels[level], None
        self._push(level + 1, combine(np.array([left]), np.array([h]))[0])

    def digests(self) -> tuple[str, str]:
        """index_hash and fingerprint of all that was given."""
        if self.carry or self.empty:
            self._push(0, leaves(self.carry)[0])
        carried = None
        for level, h in enumerate(self.levels):
            last = all(x is None for x in self.levels[level + 1 :])
            if carried is None:
                if h is not None and last:
                    return self.sha.hexdigest(), hex16(h)
                carried = None if h is None else combine(np.array([h]), np.zeros(1, np.uint64))[0]
            elif h is not None:
                carried = combine(np.array([h]), np.array([carried]))[0]
            elif last:
                break
            else:
                carried = combine(np.array([carried]), np.zeros(1, np.uint64))[0]
        return self.sha.hexdigest(), hex16(carried)
