"""Changes between two corpora: verdicts, reuse of unchanged records, and lineage of moved files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage_cut import written
from . import records

SAME, ADDED, REMOVED, MODIFIED = range(4)


def verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, verdict, old_digest, new_digest over the paths of either side (path, digest)."""
    a, b = old.select("path", F.col("digest").alias("old_digest")), new.select("path", F.col("digest").alias("new_digest"))
    both = a.join(b, "path", "full_outer")
    v = T.classify_change(F.col("old_digest").isNotNull(), F.col("old_digest"), F.col("new_digest").isNotNull(), F.col("new_digest"))
    return both.select("path", v.alias("verdict"), "old_digest", "new_digest")


def lineage(removed: DataFrame, added: DataFrame) -> DataFrame:
    """old, new, kind, digest: a digest with exactly one removed and one added path has moved, unless the path is the same."""
    a = removed.groupBy("digest").agg(F.count("*").alias("n_old"), F.min("path").alias("one_old"))
    b = added.groupBy("digest").agg(F.count("*").alias("n_new"), F.min("path").alias("one_new"))
    pairs = a.join(b, "digest").where("n_old = 1 AND n_new = 1 AND one_old <> one_new")
    moved = pairs.select(F.col("one_old").alias("old"), F.col("one_new").alias("new"), F.lit("moved").alias("kind"), "digest")
    none = F.lit(None).cast("string")
    gone = removed.join(pairs, "digest", "left_anti").select(F.col("path").alias("old"), none.alias("new"), F.lit("removed").alias("kind"), "digest")
    come = added.join(pairs, "digest", "left_anti").select(none.alias("old"), F.col("path").alias("new"), F.lit("added").alias("kind"), "digest")
    return moved.unionByName(gone).unionByName(come)


def kept(name: str, table: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of a former record table at the paths of same; those of rich tables as before numbering."""
    key = "src" if name == "rels" else "path"
    rows = table.join(same.withColumnRenamed("path", key), key, "left_semi")
    # former sequence numbers stand in for line numbers: within a path they have the same order
    lineno = F.col("seq").cast("int").alias("lineno") if name in ("syms", "headings") else None
    columns = {"syms": ["path", "sym", "name", lineno], "headings": ["path", lineno, "level", "title"], "rels": ["src", "rel", "dst"], "press": ["path", "pid"]}
    return rows.select(*columns[name]) if name in columns else rows


def split(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By verdicts (path, verdict): the paths of unchanged files, and the added and modified files."""
    same, fresh = found.where(F.col("verdict") == SAME).select("path"), found.where(F.col("verdict").isin(ADDED, MODIFIED)).select("path")
    return same, files.join(fresh, "path", "left_semi")


def updated(old: dict[str, DataFrame], files: DataFrame, rich: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The record tables of files, reusing those of unchanged paths, and the verdicts. Every file is digested; only changed ones are extracted again."""
    docs = written(records.documents(files))
    found = written(verdicts(old["docs"], docs))
    same, changed = split(found, files)
    changed = written(changed) if rich else changed  # then read for more than one table
    out = {"docs": docs, "terms": kept("terms", old["terms"], same).unionByName(records.terms(changed))}
    if rich:
        new = records.rich_rows(changed, shared=True)
        out |= records.globalized({name: kept(name, old[name], same).unionByName(new[name]) for name in new})
    return out, found


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """n: how many rows of a and b, repeated rows counted, have no partner in the other. Both have the same columns; each is read once."""
    taken = {c.lower() for c in a.columns}
    side = next(f"side{k or ''}" for k in range(len(taken) + 1) if f"side{k or ''}" not in taken)
    both = a.withColumn(side, F.lit(1)).unionByName(b.withColumn(side, F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum(side).alias(side)).agg(F.coalesce(F.sum(F.abs(side)), F.lit(0)).alias("n"))


def established(before: DataFrame, docs: DataFrame, generation: int) -> DataFrame:
    """path, generation: when each path was first published."""
    known = before.withColumnRenamed("generation", "first")
    return docs.select("path").join(known, "path", "left").select("path", F.coalesce("first", F.lit(generation)).alias("generation"))
