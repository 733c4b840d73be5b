from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge.operators import records

from .test_records import CORPUS, frame, listed

#: Repeated paths with unlike numbers of terms, files without terms and without contents.
TWICE = [("z/a.txt", b"one two three"), ("z/a.txt", b"one"), ("z/a.txt", b""), ("z/b.md", b"1 2 3"), ("z/b.md", None), ("z/c.mod", b" ".join(b"t%03d" % i for i in range(300)))]


def by_rows(files):
    """Every record sorted by itself."""
    rows = files.select(F.col("kind").alias("rank"), "path", F.lit(0).cast("bigint").alias("seq")).unionByName(records.term_rows(files).select(F.lit(100).alias("rank"), "path", "seq"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rank", "path", "seq")).cast("bigint") - 1)


def test_places_equal_those_of_sorted_records(spark):
    files = records.prepared(frame(spark, [*CORPUS, *TWICE]).repartition(3))
    mine, want = records.placed_records(files), by_rows(files)
    assert listed(mine, "place", "rank", "path", "seq") == listed(want, "place", "rank", "path", "seq") and [t for _, t in mine.dtypes] == [t for _, t in want.dtypes]
    assert records.placed_records(files.limit(0)).isEmpty()


def test_sorted_are_paths_not_terms(spark, monkeypatch):
    seen, starts = [], records.dense_starts
    monkeypatch.setattr(records, "dense_starts", lambda df, *a: seen.append(df.count()) or starts(df, *a))
    files = records.prepared(frame(spark, CORPUS))
    assert records.placed_records(files).count() > seen[0] and seen[0] <= 2 * files.count()
