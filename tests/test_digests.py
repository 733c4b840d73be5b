import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.functions import digests as D


def scalar_fnv(data: bytes) -> int:
    h = D.BASIS
    for b in data:
        h = (h ^ b) * D.PRIME % 2**64
    return h


def scalar_merkle(data: bytes) -> int:
    level = [scalar_fnv(data[i : i + 64]) for i in range(0, max(1, len(data)), 64)]
    while len(level) > 1:
        level += [0] * (len(level) % 2)
        level = [(m + (m >> 31)) % 2**64 for m in ((a * D.PRIME + b * D.RIGHT) % 2**64 for a, b in zip(level[::2], level[1::2], strict=True))]
    return level[0]


@pytest.mark.parametrize(("text", "hex16"), [("a", "af63dc4c8601ec8c"), ("fn", "08985a07b541d4f5"), ("alpha_value", "c405eb5f2bb881f5"), ("index", "83cf8e8f9081468b")])
def test_fnv_vectors(text, hex16):
    assert D.hex16(D.fnv64_many([text.encode()])[0]) == hex16


@pytest.mark.parametrize(("n", "hex16"), [(0, "cbf29ce484222325"), (1, "af63ba4c8601b2c6"), (63, "ea8db5b66cd6c581"), (64, "65910efaf0f13cbe"), (65, "ee4dd2b8fa010dcf"), (129, "68c3a0a6aa18055d"), (193, "2f474d96650ff7df"), (1024, "fe8861533e9c067e")])
def test_merkle_vectors(n, hex16):
    assert D.hex16(D.merkle64(bytes((i * 31 + 7) % 251 for i in range(n)))) == hex16


def test_combine_is_ordered():
    two = D.combine(np.array([1, 2], np.uint64), np.array([2, 1], np.uint64))
    assert [D.hex16(x) for x in two] == ["00000100020006d9", "00000200010008f9"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=8))
def test_stream_and_batch_equal_scalar(parts):
    whole, stream = b"".join(parts), D.StreamDigest()
    for p in parts:
        stream.update(p)
    assert stream.digests()[1] == D.hex16(scalar_merkle(whole)) == D.hex16(D.merkle64(whole))
    assert D.merkle64_many(parts) == [scalar_merkle(p) for p in parts]
    assert [int(x) for x in D.fnv64_many(parts)] == [scalar_fnv(p) for p in parts]


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([(b"a",), (None,), (b"",)], "v binary")
    assert [tuple(r) for r in df.select(D.fnv64_hex("v"), D.merkle64_hex("v")).collect()] == [("af63dc4c8601ec8c",) * 2, (None, None), ("cbf29ce484222325",) * 2]
