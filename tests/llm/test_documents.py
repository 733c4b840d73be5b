import hashlib
import re

import numpy as np
import xxhash

import corpus_pipeline
from lexiforge.llm import licenses, minhash, shingle_join, simhash

from .conftest import SF


def brute_simhash(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints):
    """prints: id to fingerprint; the smallest id reachable over at most two bits."""
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, documents):
    prints = {r["doc_id"]: brute_simhash(r["text"]) for r in documents.collect()}
    roots = brute_components(prints)
    for r in simhash.op4_simhash(spark, SF).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", roots[r["doc_id"]])


def test_links_lose_none(spark):
    rnd = np.random.default_rng(5)
    base = [int(x) for x in rnd.integers(0, 2**63, 40)]
    prints = {0}
    for v in base:
        prints.add(v)
        for _ in range(4):
            bits = rnd.choice(64, rnd.integers(1, 4), replace=False)
            prints.add(v ^ sum(1 << int(b) for b in bits))
    signed = [p - (p >> 63 << 64) for p in prints]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert found == want and len(want) > 40


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 103), (100, 102)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(1, 31)) and all(found[i] == 100 for i in (101, 102, 103))


def test_representatives_keep_one_row_of_each_component(spark, odd, empty):
    rows = [(1, "a b c d", "x"), (1, "entirely other words here", "y"), (2, "a b c d", "x"), (None, "a b c d", "x"), (None, "no id and no like", "z"), (None, "no id and no like", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    kept = [tuple(r) for r in simhash.representatives(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
    found = simhash.representatives(odd)
    assert found.columns == odd.columns and found.count() == simhash.near_duplicates(odd).select("component_id").distinct().count()
    assert simhash.representatives(empty).count() == 0


def test_simhash_odd_rows(odd, empty):
    found = {}
    for r in simhash.near_duplicates(odd).collect():
        found.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert sum(map(len, found.values())) == odd.count()
    assert found[1][0] == found[2][0] and found[1][0][1] == 1
    assert {found[i][0] for i in (3, 4, 5)} == {("0" * 16, 3)} and found[None][0][1] is None
    assert simhash.near_duplicates(empty).count() == 0


def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_dedup_stage_equals_brute_force(spark, documents):
    rnd = np.random.default_rng(8)
    rows, base = [tuple(r) for r in documents.select("doc_id", "text").collect()], 10**6
    for _, text in [r for r in rows if 40 < len(r[1].split()) < 400][:40]:
        for edits in (1, 2, 4, 8):  # edited copies, some of them below the limit
            w = text.split()
            for at in rnd.choice(len(w), min(edits, len(w) // 8 + 1), replace=False):
                w[at] = f"edit{at}"
            base += 1
            rows.append((base, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, linked = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8:
                linked += sets[a] != sets[b]
                root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept) == sorted({find(i) for i in ids}) and linked > 80


def test_frequent_shingles_change_no_pair(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SAMPLE", 1)
    lead = "all of these texts begin with the very same ten words"
    rows = [(i, f"{lead} " + " ".join(f"w{i // 2}x{k}" for k in range(40)) + f" {i}") for i in range(60)] + [(None, None), (99, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in shingle_join.representatives(docs).collect()) == [*range(0, 60, 2), 99]


def test_fingerprint_query(spark, documents):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    found, errors = {r["doc_id"]: r for r in minhash.op10_fingerprint(spark, SF).collect()}, []
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited, r = text[: len(text) - k] + other[:k], found[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, b in ((r["near_edited"], edited), (r["near_next"], other)):
            x, y = shingles(text), shingles(b)
            errors.append(near - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.03 and np.abs(errors).max() < 0.15
    assert len({r["fingerprint"] for r in found.values()}) >= len({t for _, t in rows}) * 0.99


def test_neighbours_of_ids_far_apart(spark):
    keys = [-(1 << 62), *range(12_000), 1 << 62, minhash.NO_ID]
    found = minhash.neighbours(spark.createDataFrame([(k, 1) for k in keys], "key bigint, n_chars bigint"))
    keys.sort()
    assert {r["key"]: r["next_key"] for r in found.collect()} == dict(zip(keys, [keys[-1], *keys[:-1]], strict=True))


def test_fingerprint_is_native(spark):
    plan = minhash.op10_fingerprint(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprint_odd_rows(odd, empty):
    found = {r["doc_id"]: r for r in minhash.fingerprinted(odd).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert found[3]["fingerprint"] == minhash.ZEROS == found[5]["fingerprint"] and found[4]["near_next"] == 1.0 and found[3]["n_chars"] == 0
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[2]["near_next"] == 1.0
    assert found[8]["near_next"] == 0.0 and minhash.fingerprinted(empty).count() == 0


def test_every_row_is_fingerprinted(spark):
    rows = [(1, "one two three four five six"), (2, "a short one"), (2, "a longer text of the same id, with more words in it"), (2, "a short one"), *[(None, f"no id {k} at all in row {k}") for k in range(200)]]
    found = minhash.fingerprinted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    one = {2: rows[0][1], None: None, 1: None}  # the next of 2 is 1, of those without an id 2, of 1 one without an id
    got = {(r["doc_id"], r["edited_sha256"]) for r in found}
    for i, text in rows:
        k = len(text) // 3
        nexts = [one[2]] if i == 2 else [t for j, t in rows if j == (None if i == 1 else 2)]
        assert any((i, hashlib.sha256((text[: len(text) - k] + t[:k]).encode()).hexdigest()) in got for t in nexts)
    assert len({r["fingerprint"] for r in found}) == len({t for _, t in rows})


def test_licenses(spark, documents, odd, empty):
    whole = licenses.TEMPLATES["mit-header"]
    texts = {
        1: "lead words " + whole.replace("charge", "cost").replace("hereby ", "") + " and more",
        2: "This work is licenced under the GNU General Public License version 3 only.",
        3: "the license of the public under version",
        4: "x " * 5000 + "Released under the MIT License.",
    }
    found = {(r["doc_id"], r["license"]): r for r in licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert set(found) == {(1, "mit-header"), (2, "gpl-3.0-notice"), (4, "mit-notice")}
    assert found[1, "mit-header"]["span_start"] == 2 and 0.9 < found[1, "mit-header"]["coverage"] < 1
    assert (found[4, "mit-notice"]["span_start"], found[4, "mit-notice"]["span_end"]) == (5000, 5005)
    notices = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice", "Licensed under the Apache License, Version 2.0.": "apache-2.0-notice", "Released under the MIT License.": "mit-notice", "GNU General Public License, version 3.": "gpl-3.0-notice"}
    want = {(r["doc_id"], name) for r in documents.collect() for notice, name in notices.items() if notice in r["text"]}
    assert {(r["doc_id"], r["license"]) for r in licenses.op1_license_scan(spark, SF).collect()} == want and want
    assert licenses.scanned(odd).count() == 0 and licenses.scanned(empty).count() == 0


def test_license_passages_that_follow_closely():
    index = licenses.Index(licenses.TEMPLATES)
    mit, cc = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["cc-by-4.0-notice"]
    for text, want in ((f"{mit} {mit} {mit}", [(0, 5), (5, 10), (10, 15)]), (f"{mit} and so {mit}", [(0, 5), (7, 12)]), (f"{mit} {cc} {mit}", [(0, 5), (5, 11), (11, 16)])):
        assert [m[3:] for m in licenses.found(index, text)] == want
    header = licenses.TEMPLATES["apache-2.0-header"]
    n = len(licenses.tokens(header))
    found = licenses.found(index, " word ".join([header] * 50))
    assert [m[3:] for m in found] == [(k * (n + 1), k * (n + 1) + n) for k in range(50)]
    assert len(licenses.found(index, f"{mit} " * 5000)) == 5000


def test_every_close_license_passage_has_a_seed():
    index, rnd = licenses.Index(licenses.TEMPLATES), np.random.default_rng(4)
    for name, text in licenses.TEMPLATES.items():
        words = [w.decode() for w in licenses.tokens(text)]
        edited = [[*words[:i], *put, *words[i + cut :]] for i in range(len(words)) for put, cut in ((["changed"], 1), ([], 1), (["put", "in"], 0))]
        spread = [x for w in words[:8] for x in (w, "between")] + words[8:]  # every word of the short ones apart
        most = len(words) // 5
        many = [["changed" if i in set(rnd.choice(len(words), most, replace=False).tolist()) else w for i, w in enumerate(words)] for _ in range(30)]
        template = index.texts[index.names.index(name)]
        for own in (*edited, spread, *many):
            ids = np.array([0, *(index.number.get(w.encode(), 0) for w in own), 0])
            if licenses.aligned(template, ids, 1)[0] >= 0.8 * len(words):  # what the scan would report, had it a seed
                assert licenses.found(index, " ".join(["lead", *own, "end"])), (name, own)
    assert [m[0] for m in licenses.found(index, "Released under the X MIT License")] == ["mit-notice"]
