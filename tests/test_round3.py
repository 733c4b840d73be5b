import os

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge import queries
from lexiforge.llm import shingle_join, simhash
from lexiforge.operators import changes, ordering, records
from lexiforge.plans import build, lineage_cut

from .test_queries import SF
from .test_records import frame, listed


def stored(spark):
    folder = lineage_cut._session_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_incremental_equals_rebuild_sees_a_difference_and_leaves_no_table(spark, monkeypatch):
    before, kept = stored(spark), changes.kept
    monkeypatch.setattr(changes, "kept", lambda name, table, same: kept(name, table, same.where("path NOT LIKE '%/1%'")))
    found = {r["relation"]: r["differing"] for r in queries.incremental_equals_rebuild(spark, SF).collect()}
    assert found["docs"] == 0 and found["terms"] > 0 and found["headings"] > 0 and stored(spark) == before


def test_numbers_keep_one_table(spark):
    before = stored(spark)
    rows = ordering.dense_numbers(spark.range(50).select(F.col("id").alias("v")), ["v"])
    assert len(stored(spark) - before) == 1 and [r["seq"] for r in rows.orderBy("v").collect()] == list(range(50))


def test_written_leaves_no_shuffle_file_and_the_setting_alone(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().size()
    before = files()
    table = lineage_cut.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and spark.conf.get(lineage_cut._CLEANUP) == "false" and table.count() == 7


def test_scratch_removes_only_what_was_made_inside(spark):
    outer = lineage_cut.written(spark.range(3))
    before = stored(spark)
    with lineage_cut.scratch():
        inner = lineage_cut.written(spark.range(4))
        assert inner.count() == 4 and len(stored(spark) - before) == 1
    lineage_cut.removed(inner)
    assert stored(spark) == before and outer.count() == 3
    lineage_cut.removed(outer)
    assert len(before - stored(spark)) == 1


def test_kept_rows_of_an_update_equal_a_build(spark):
    files = records.prepared(frame(spark))
    full = build.full(frame(spark), rich=True)
    same = files.select("path")
    for name, rows in records.rich_rows(files).items():
        again = records.globalized({name: changes.kept(name, full.tables[name], same)})[name]
        want = full.tables[name]
        assert listed(again, *want.columns) == listed(want, *want.columns) and rows.count() == again.count()


#: Fifty words; with the 25th replaced 41 of 51 shingles are in common, but 46 of 128 bits of the two SimHash words that once chose pairs differ.
FAR = "853345 120343 895799 898485 969105 819166 342703 780596 532510 896580 615917 199126 597583 842950 536775 498873 660479 643782 831496 195217 461930 506920 318139 148682 55355 564861 965510 933631 727122 923688 43914 624360 415403 474999 532487 774809 645464 883348 165144 653397 15729 872102 554047 873410 7432 37384 199447 922290 253695 489835"


def test_near_duplicates_with_far_fingerprints_are_linked(spark):
    words = [f"w{w}" for w in FAR.split()]
    texts = [" ".join(words), " ".join([*words[:24], "x7610", *words[25:]]), " ".join(["y", *words[:20], "z", *words[21:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a, b, c = (set(shingle_join.shingle_set(simhash.words_of(t)).tolist()) for t in texts)
    assert 5 * len(a & b) >= 4 * len(a | b) and 5 * len(a & c) < 4 * len(a | c)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_parities_never_differ_in_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 40, 300, 5000):
        for k in (0, 1, 7, n // 4):
            both = rng.integers(-(2**63), 2**63 - 1, n)
            a, b = both, np.concatenate([both[min(k, n) :], rng.integers(-(2**63), 2**63 - 1, k)])
            apart = int(np.bitwise_count((shingle_join.parities(a) ^ shingle_join.parities(b)).view(np.uint64)).sum())
            assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and shingle_join.parities(a).shape == (shingle_join.PARITIES,)
