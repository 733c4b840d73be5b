import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import canonical, changes, records
from lexiforge.plans import build

CORPUS = [
    ("a.mod", b"module demo.alpha;\n\nuse demo.deep as d\nfn shared\nfn shared\nfn 9bad PRESS-009\n// PRESS-001 and PRESS-0012, RFC 0002\n"),
    ("sub/dup.mod", b"fn shared\r\nrecord \tpoint.x\nfn foo.\n"),
    ("b.md", b"# One\n  ## Two words\n####### seven\n#none\n# \n[x](t.md) [y](<u v>) [](<>) []() [z](t.md)\nPRESS-002 PRESS-002 see rfc 0003\n# bad \xff\n"),
    ("c.json", b'{"a": "PRESS-004, rfcs 0005 RFC0006"}\n'),
    ("empty.txt", b""),
    ("noext", b"plain words"),
    ("x.bin", b"no"),
]


def frame(spark, rows=CORPUS, parts=3):
    return spark.createDataFrame(rows, "path string, content binary").repartition(parts)


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_documents(spark):
    docs = records.documents(records.prepared(frame(spark)))
    found = {r["path"]: r for r in docs.collect()}
    assert "x.bin" not in found
    assert (found["b.md"]["kind"], found["c.json"]["kind"], found["noext"]["kind"], found["a.mod"]["kind"]) == (2, 3, 0, 1)
    assert tuple(found["empty.txt"][c] for c in ("size", "words", "lines", "digest")) == (0, 0, 0, "cbf29ce484222325")
    assert (found["noext"]["words"], found["noext"]["lines"]) == (2, 0)


def test_token_cap_counts_before_validity(spark):
    text = " ".join([*(f"{i:03d}" for i in range(200)), *(f"w{i:03d}" for i in range(100)), "x" * 33])
    rows = records.term_rows(records.prepared(frame(spark, [("cap.txt", text.encode())]))).orderBy("seq").collect()
    assert (len(rows), rows[-1]["token"], rows[-1]["seq"]) == (56, "w055", 55)


def test_rich_tables(spark):
    t = records.rich(records.prepared(frame(spark)))
    assert listed(t["syms"], "path", "sym", "name", "seq") == [("a.mod", "fn", "shared", 2), ("a.mod", "module", "demo.alpha", 0), ("a.mod", "use", "demo.deep", 1), ("sub/dup.mod", "fn", "shared", 3), ("sub/dup.mod", "record", "point.x", 4)]
    assert listed(t["headings"], "seq", "level", "title") == [(0, 1, "One"), (1, 2, "Two words"), (2, 1, "")]
    assert listed(t["press"], "path", "pid") == [("a.mod", "PRESS-001"), ("b.md", "PRESS-002"), ("c.json", "PRESS-004")]
    rels = listed(t["rels"], "src", "rel", "dst")
    assert [r for r in rels if r[1] == "rfc-ref"] == [("a.mod", "rfc-ref", "0002"), ("b.md", "rfc-ref", "0003"), ("c.json", "rfc-ref", "0005")]
    assert [r[2] for r in rels if r[:2] == ("b.md", "references")] == ["", "t.md", "u v"]
    assert ("a.mod", "depends-on", "demo.deep") in rels and ("a.mod", "references", "demo.deep") in rels


@pytest.mark.parametrize(("name", "ext"), [("a/b.TXT", "txt"), (".hidden.mod", ""), ("x", ""), ("a.b.yml", "yml"), ("a.verylongext", ""), ("d.x/y", "")])
def test_extension(spark, name, ext):
    assert spark.range(1).select(T.path_extension(F.lit(name))).first()[0] == ext


def test_unsafe_path_fails(spark):
    with pytest.raises(Exception, match="control characters"):
        records.prepared(frame(spark, [("a\tb.txt", b"x")])).collect()


def test_identity_ignores_partitioning_and_order(spark):
    found = {build.full(frame(spark, rows, n), rich=True).identity for rows, n in ((CORPUS, 1), (CORPUS, 7), (CORPUS[::-1], 3))}
    assert len(found) == 1


def test_canonical_bytes(spark):
    files = records.prepared(frame(spark, [("t.txt", b"ab 1c\n")]))
    lines = canonical.canonical_lines({"docs": records.documents(files), "terms": records.terms(files)})
    data = b"".join(canonical.canonical_bytes(lines, "id")).decode().split("\n")
    assert data[0] == f"{canonical.MARKER} canonical-v1" and data[1] == "snapshot id" and data[-2:] == ["end", ""]
    assert data[2].startswith("doc 6 t.txt ") and data[2].endswith(" 6 2 1 0") and data[3].startswith("term t.txt ab ") and len(data) == 6


def test_incremental_equals_rebuild(spark):
    new = [(p, c + b"fn more\n") if p == "a.mod" else (p, c) for p, c in CORPUS if p != "c.json"] + [("new.md", b"# New\n[l](b.md)\n"), ("moved.txt", b"plain words")]
    before = build.full(frame(spark), rich=True)
    a, b = build.incremental(before.tables, frame(spark, new), rich=True), build.full(frame(spark, new), rich=True)
    assert (a.identity, a.snapshot_id) == (b.identity, b.snapshot_id) and build.compatible_hashes(a.tables) == build.compatible_hashes(b.tables)
    assert {r["path"]: r["verdict"] for r in a.verdicts.collect() if r["verdict"]} == {"a.mod": 3, "c.json": 2, "new.md": 1, "moved.txt": 1}


def test_lineage(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    out = changes.lineage(make([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")]), make([("x", "1"), ("y", "2"), ("z", "4")]))
    assert sorted(map(str, ((r["old"], r["new"], r["kind"]) for r in out.collect()))) == sorted(map(str, [("a", "x", "moved"), ("b", None, "removed"), ("c", None, "removed"), ("d", None, "removed"), (None, "y", "added"), (None, "z", "added")]))


def test_empty_corpus(spark):
    snap = build.full(frame(spark, [("x.bin", b"")], 1), rich=True)
    assert snap.tables["docs"].count() == 0 and len(snap.identity) == 64


def test_set_digest_sees_every_row_and_no_order(spark):
    import hashlib

    values = [b"a", b"b", b"b", b"", b"long " * 1000]
    parts = [int(hashlib.sha256(v).hexdigest(), 16) for v in values]
    sums = [sum(p >> 192 - 64 * k & (2**64 - 1) for p in parts) % 2**64 for k in range(4)]
    want = hashlib.sha256(" ".join(map(str, [len(values), *sums])).encode()).hexdigest()
    make = lambda v, n: canonical.set_digest(spark.createDataFrame([(x,) for x in v], "raw binary").repartition(n), "raw").first()["digest"]
    assert make(values, 1) == make(values[::-1], 4) == want != make(values[1:], 2)


def test_identity_whatever_the_partitions_and_the_adaptive_planner(spark):
    found, before = set(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for n, adaptive in ((1, "true"), (3, "false"), (8, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            found.add(build.full(frame(spark, CORPUS, n), rich=True).identity)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 1


def test_small_rules(spark):
    from pyspark.sql import functions as F

    from lexiforge.functions import text as T

    df = spark.createDataFrame([(a, d, u) for a in (False, True) for d in (1, 2, 3) for u in (0, 1, 2)], "a boolean, d int, u int")
    got = df.select("a", "d", "u", T.should_visit(F.col("a"), F.col("d"), F.lit(2), F.col("u"), F.lit(2)).alias("v")).collect()
    assert all(r["v"] == (not r["a"] and r["d"] <= 2 and r["u"] < 2) for r in got)
