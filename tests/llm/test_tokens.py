import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiforge.llm import bpe, common, packing

from .conftest import SF

BYTE, WORD = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("word_bpe_49k.json")
TEXTS = ["", "  a  b ", "x<|endoftext|> y<|endoftext|>", "a\n\n b\t c  d  ", "éß ١٢ ²½ \U0001f600\U0001f937\U0001f3fd‍ x", "Don't I'LL we've 's", "ΣΑΣ İst", "a" * 1000 + "b" * 500, "\x1c\x1d a\x85b", "ab cd\nef\n gh  \n", "日本語 中文", "\x00 a", "U.S.A. 3.14 x_y"]


@pytest.fixture(scope="module")
def codecs():
    return bpe.ByteBPE(open(BYTE).read()), Tokenizer.from_file(BYTE), packing.WordIds(open(WORD).read()), Tokenizer.from_file(WORD)


def check(codecs, text):
    codec, library, words, word_library = codecs
    ids = library.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(codec.encode(text), "<u4")
    assert mine.tolist() == ids
    assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(words.encode_all([text])[0], "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(codecs, text):
    check(codecs, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'stTHE\n\t.,!1é中\U0001f600\xa0"), max_size=60))
def test_equals_library_random(codecs, text):
    check(codecs, text)


def test_proven_characters_and_others_equal_library(codecs):
    codec, library, words, word_library = codecs
    chars = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if bpe.proven(c)]
    rnd = np.random.default_rng(6)
    odd = [chr(int(c)) for c in rnd.integers(0x80, 0x1FFFF, 6000) if not 0xD800 <= c < 0xE000]
    named = [0x819, 0x89B, 0x730, 0x8D2, 0x8CC, 0xC3C, 0x558, 0x88F, 0x1C89, 0xA7DC, 0x10D50, 0x16EA0, 0x1E6EA, 0x3E737]
    pairs = ["".join(map(chr, x)) for x in ((0x819, 0x89B), (0x730, 0x8D2), (0x8CC, 0xC3C))]
    marks = [chr(c) for c in range(0x300, 0x36F)]
    texts = [f"a{c}b {c} 1{c}!{c} {c}'t {c.upper()}{c.lower()}x" for c in (*chars, *odd, *map(chr, named), *pairs)]
    texts += [f"e{a}{b}{a} o{b}{rnd.choice(odd)}'ll" for a in marks for b in marks[:: 7]]
    for own, known, theirs in ((codec.encode, lambda e: e.ids, library), (lambda t: words.encode_all([t])[0], lambda e: e.ids, word_library)):
        bad = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own(t), "<u4").tolist() != known(e)]
        assert not bad, (len(bad), bad[:5])


def test_long_texts_in_small_memory(codecs):
    words = packing.WordIds(open(WORD).read())
    texts = ["x" * 100_000 + str(i) for i in range(20)]
    words.encode_all(texts)
    assert not words.known
    codec = bpe.ByteBPE(open(BYTE).read())
    assert all(codec.encode(t) for t in texts) and not any(len(k) > bpe.LONGEST for k in (*codec.known, *codec.chunks))


def test_long_word_heap_equals_scan(codecs):
    codec = codecs[0]
    word = "antidisestablishmentarianism" * 4
    parts = [codec.first[b] for b in word.encode()]
    assert codec.merge_long(parts.copy()) == codec.merge_short(parts.copy())


def test_query_equals_library(spark, codecs, documents):
    library = codecs[1]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in bpe.op5_bpe(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def verify_packing(rows, texts, library):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # full at a power of two: no padding


def test_packing_query(spark, codecs, documents):
    verify_packing(packing.op2_packing(spark, SF).collect(), {r["doc_id"]: r["text"] for r in documents.collect()}, codecs[3])


def test_odd_rows(spark, codecs, odd, empty):
    one = odd.dropDuplicates(["doc_id"])
    verify_packing(packing.packed(one, WORD).collect(), {r["doc_id"]: r["text"] for r in one.collect()}, codecs[3])
    assert packing.packed(empty, WORD).count() == 0 and bpe.encoded(spark, empty, BYTE).count() == 0
    found = bpe.encoded(spark, odd, BYTE).collect()
    assert len(found) == odd.count() and all(r["decoded"] == "" for r in found if r["doc_id"] in (3, 4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_windows_are_full_and_cover(lengths):
    seen = [np.zeros(n, int) for n in lengths]
    windows = packing.pack_block(lengths)
    for tier, pieces in windows:
        assert sum(p[2] for p in pieces) == tier
        for doc, start, size in pieces:
            seen[doc][start : start + size] += 1
    assert all((s == 1).all() for s in seen)
    groups = packing.step_groups(windows, 4096)
    load = {}
    for (tier, _), g in zip(windows, groups, strict=True):
        load[g] = load.get(g, 0) + tier
    assert not load or max(load.values()) - min(load.values()) <= 2048
