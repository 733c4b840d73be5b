import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge import queries
from lexiforge.functions import digests
from lexiforge.llm import simhash
from lexiforge.operators import canonical, changes, records
from lexiforge.sources import files

from .test_digests import scalar_merkle
from .test_queries import SF
from .test_records import CORPUS, frame, listed


def plan(capsys, df):
    df.explain()
    return capsys.readouterr().out


def test_incremental_equals_rebuild_writes_and_compares_once(spark, capsys):
    found = queries.incremental_equals_rebuild(spark, SF)
    text = plan(capsys, found)
    assert {tuple(r) for r in found.collect()} == {(n, 0) for n in ("docs", "terms", "syms", "headings", "rels", "press")}
    assert "replicaterows" not in text.lower() and "posexplode(split(" not in text  # one comparison by table, no contents parsed in it


def test_differing_counts_repeated_rows(spark):
    a, b = (spark.createDataFrame(rows, "side string, v int") for rows in ([("x", 1), ("x", 1), ("y", None), ("z", 2)], [("x", 1), ("y", None), ("y", None)]))
    assert changes.differing(a, b).first()["n"] == 3 and changes.differing(a, a).first()["n"] == 0


def test_a_line_is_parsed_once(spark, capsys):
    rows = records.parsed_lines(records.prepared(frame(spark))).where("decl <> ''")
    assert plan(capsys, rows).count("^(module|fn|record|use)") == 1


def test_shared_rows_equal_separate_ones(spark):
    prepared = records.prepared(frame(spark))
    apart, shared = records.rich_rows(prepared), records.rich_rows(prepared, shared=True)
    for name, rows in apart.items():
        assert listed(rows, *rows.columns) == listed(shared[name], *rows.columns) and not rows.isEmpty()


def test_one_carriage_return_ends_a_line(spark):
    heads = records.rich_rows(records.prepared(frame(spark, [("a.md", b"# One\r\r\n# Two\r\n")])))["headings"]
    assert listed(heads, "lineno", "title") == [(0, "One\r"), (1, "Two")]


def test_names_are_bounded(spark):
    content = "\n".join(f"fn {n}" for n in ("a" * 32 + "." + "b" * 31, "a" * 32 + "." + "b" * 32, "a" * 33, "x.y rest", "x..y")).encode()
    syms = records.rich_rows(records.prepared(frame(spark, [("a.mod", content)])))["syms"]
    assert listed(syms, "name") == [("a" * 32 + "." + "b" * 31,), ("x.y",)]


def test_canonical_lines_parse_once_and_digest_in_python(spark, capsys):
    prepared = records.prepared(frame(spark, CORPUS))
    lines = canonical.canonical_lines(records.rich(prepared) | {"docs": records.documents(prepared)})
    assert "^(module|fn|record|use)" not in plan(capsys, lines)
    assert "MapInArrow" in plan(capsys, canonical.set_digest(lines.select(F.col("line").cast("binary").alias("raw")), "raw"))


def test_set_digest_of_nothing_and_null(spark):
    of = lambda v: canonical.set_digest(spark.createDataFrame([(x,) for x in v], "raw binary"), "raw").first()
    assert of([])["n"] == 0 and of([None])["n"] == 1 and of([])["digest"] != of([None])["digest"]


def test_staged_limits_before_it_sorts(spark, capsys):
    rng = random.Random(5)
    rows = [(f"{rng.choice('abc')}/{rng.randrange(40):02d}", b"x" * rng.randrange(30)) for _ in range(300)] + [("d/1", None), ("c/99", b"y" * 9)]
    corpus = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    found = files.staged(corpus, 20, 20)
    assert "LeftOuter" in plan(capsys, found)
    fits = F.octet_length("content") <= 20
    nth = corpus.select("path", fits.alias("f"), F.split("path", "/")[0].alias("r")).withColumn("n", F.row_number().over(Window.partitionBy("r", "f").orderBy("path")))
    want = nth.select("path", F.when(~F.col("f"), "too large").when(F.col("n") > 20, "beyond tier").otherwise("staged").alias("reason"))
    assert listed(found, "path", "reason") == listed(want, "path", "reason")


def test_invalidation_and_walks_need_neither_python_nor_order(spark, capsys):
    assert "Python" not in plan(capsys, queries.invalidation_roots(spark, SF))
    assert "monotonically" not in plan(capsys, queries.fanout_hubs(spark, SF)) and queries._edges(spark, SF).columns == ["src", "rel", "dst"]


def test_digests_of_slices_nulls_and_long_values():
    values = [b"skipped", b"", None, b"a", bytes(range(256)) * 40, b"x" * 64, b"y" * 65]
    column = pa.array(values, pa.binary())[1:]
    want = [None if v is None else scalar_merkle(v) for v in values[1:]]
    before, digests.AT_ONCE = digests.AT_ONCE, 256
    try:
        found = digests.merkle64_column(column)
    finally:
        digests.AT_ONCE = before
    assert [None if w is None else int(x) for x, w in zip(found, want, strict=True)] == want
    assert digests._hex_column(found, column).to_pylist() == [None if w is None else f"{w:016x}" for w in want]
    assert digests._fold_spans(*digests._spans(pa.array([], pa.binary()))).tolist() == []


def test_links_apart_are_those_between_roots_and_no_others(spark):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(-(2**62), 2**62, 3)]
    flip = lambda x, *bits: int(np.int64(x) ^ np.bitwise_or.reduce(np.array([1 << b if b < 63 else -(2**63) for b in bits], np.int64)))
    rows = {c: i for i, c in enumerate(centre)}
    rows |= {flip(c, b): (i if b % 9 else 100 + b) for i, c in enumerate(centre) for b in range(64)}
    table = spark.createDataFrame(list(rows.items()), "fp bigint, root bigint")
    every = {tuple(r) for r in simhash.links(table.select("fp")).collect()}
    found = {tuple(r) for r in simhash.links_apart(table).collect()}
    assert found == {(a, b) for a, b in every if rows[a] != rows[b]} and 0 < len(found) < len(every)
    assert simhash.links_apart(table.withColumn("root", F.lit(0).cast("bigint"))).isEmpty()
