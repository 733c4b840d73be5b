"""Commit feeds of binary relation records: decoding, the latest state of each relation, freshness and queries.

A relation is 80 bytes, big-endian: magic, kind 1 to 4, three zero bytes, source 12, target 12, generation 8, provenance
32, ordinal 8. Generations beyond 2^63 are kept as decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage_cut import written
from .canonical import set_digest

#: Magic bytes and sizes of the three record types (fixed values).
RELATION, PROVENANCE, COMMIT = ("4D520100", 80), ("4D500100", 112), ("4D430100", 56)
#: Stands before the records whose hash identifies a result; a parameter.
RESULT_MARKER = b"corpus-index/result-v1\x00"


def _part(raw: str, at: int, size: int) -> Column:
    return F.expr(f"substring({raw}, {at + 1}, {size})")


def _number(raw: str, at: int, size: int) -> Column:
    return F.conv(F.hex(_part(raw, at, size)), 16, 10).cast("decimal(20,0)")


def _checked(raw: str, form: tuple[str, int], also: Column | None = None) -> Column:
    ok = (F.octet_length(raw) == form[1]) & (F.hex(_part(raw, 0, 4)) == form[0])
    return ok if also is None else ok & also


def _decoded(df: DataFrame, raw: str, ok: Column, columns: dict[str, Column], what: str) -> DataFrame:
    checked = df.withColumn(raw, F.when(F.coalesce(ok, F.lit(False)), F.col(raw)).otherwise(F.raise_error(F.lit(f"invalid {what} record")).cast("binary")))
    return checked.select(*df.columns, *(c.alias(n) for n, c in columns.items()))


def decoded_relations(df: DataFrame, raw: str = "raw") -> DataFrame:
    also = F.hex(_part(raw, 5, 3)).eqNullSafe("000000") & F.hex(_part(raw, 4, 1)).isin("01", "02", "03", "04")
    return _decoded(df, raw, _checked(raw, RELATION, also), {
        "kind": F.conv(F.hex(_part(raw, 4, 1)), 16, 10).cast("int"), "source": _part(raw, 8, 12), "target": _part(raw, 20, 12),
        "generation": _number(raw, 32, 8), "provenance": _part(raw, 40, 32), "ordinal": _number(raw, 72, 8),
    }, "relation")


def decoded_provenance(df: DataFrame, raw: str = "raw") -> DataFrame:
    return _decoded(df, raw, _checked(raw, PROVENANCE), {
        "source": _part(raw, 4, 12), "producer": _part(raw, 16, 12), "transformation": _part(raw, 28, 12),
        "generation": _number(raw, 40, 8), "evidence": _part(raw, 48, 32), "ancestry": _part(raw, 80, 32),
    }, "provenance")


def decoded_commits(df: DataFrame, raw: str = "raw") -> DataFrame:
    return _decoded(df, raw, _checked(raw, COMMIT), {
        "generation": _number(raw, 4, 8), "objects": _number(raw, 12, 4), "relations": _number(raw, 16, 4),
        "provenances": _number(raw, 20, 4), "root": _part(raw, 24, 32),
    }, "commit")


IDENTITY = ["kind", "source", "target", "ordinal"]


def latest(relations: DataFrame, position: str = "position") -> DataFrame:
    """The last record of each identity: by generation, then by position in the input. Partial maxima keep hot identities cheap."""
    return relations.groupBy(*IDENTITY).agg(F.max_by("raw", F.struct("generation", position)).alias("raw"), F.max("generation").alias("generation"))


def freshness(index_generation: Column, store_generation: Column) -> Column:
    return F.when(index_generation == store_generation, "complete").when(index_generation < store_generation, "stale").otherwise("future_invalid")


def selected(state: DataFrame, target: bytes | None = None, source: bytes | None = None, kind: int | None = None) -> DataFrame:
    for name, value in (("target", target), ("source", source), ("kind", kind)):
        state = state if value is None else state.where(F.col(name) == F.lit(value))
    return state


def result_identity(state: DataFrame) -> DataFrame:
    """result_identity: a digest of the set of all records, made in tasks."""
    return set_digest(state, "raw").select(F.col("digest").alias("result_identity"))


def serial_result_identity(state: DataFrame, marker: bytes = RESULT_MARKER) -> str:
    """SHA-256 of the marker and all records in identity order, streamed through the driver: serial by definition, for comparison only."""
    import hashlib

    h = hashlib.sha256(marker)
    for r in state.orderBy(*IDENTITY).select("raw").toLocalIterator():
        h.update(bytes(r[0]))
    return h.hexdigest()


def checked_commit(relations: DataFrame, commit: DataFrame, provenance: DataFrame | None = None) -> int:
    """The generation of a decoded commit record, if it fits its relations and provenance records: their numbers, and the generation they name."""
    head = commit.select("generation", "relations", "provenances").collect()
    if len(head) != 1:
        raise ValueError("a commit has one record")
    generation = int(head[0]["generation"])
    for rows, want, what in ((relations, head[0]["relations"], "relations"), (provenance, head[0]["provenances"], "provenance records")):
        if rows is None and not want:
            continue
        found = None if rows is None else rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("generation") != generation, 1)).alias("other")).first()
        if found is None or found["n"] != want or found["other"]:
            raise ValueError(f"the commit's {what} are not those that it names")
    return generation


class Projection:
    """A disposable relation index: rebuilt from commits or advanced by one, with explicit generations."""

    def __init__(self, state: DataFrame | None = None, through: int = 0, store: int = 0):
        self.state, self.through, self.store = state, through, store

    @classmethod
    def rebuilt(cls, relations: DataFrame) -> Projection:
        """From decoded relations with their commit's generation in the column commit."""
        top = relations.agg(F.max("commit")).first()[0] or 0
        return cls(latest(relations), int(top), int(top))

    def applied(self, relations: DataFrame, commit: DataFrame, provenance: DataFrame | None = None) -> Projection:
        """One commit more: its decoded relations, record and provenance records, which have to fit. The state is written, so plans do not grow."""
        generation = checked_commit(relations, commit, provenance)
        if generation <= self.through:
            raise ValueError("a commit has to advance the generation")
        new = latest(relations).withColumn("position", F.lit(1))
        old = new.limit(0) if self.state is None else self.state.withColumn("position", F.lit(0))
        merged = old.unionByName(new).groupBy(*IDENTITY).agg(F.max_by(F.struct("raw", "generation"), "position").alias("r")).select(*IDENTITY, "r.raw", "r.generation")
        return Projection(written(merged), generation, max(self.store, generation))

    def destroyed(self) -> Projection:
        """Without state: it is made again from the commits, of which it was only a view."""
        return Projection(None, 0, self.store)

    def answered(self, generation: int | None = None, target: bytes | None = None, source: bytes | None = None, kind: int | None = None) -> DataFrame:
        """The state, filtered; an error unless it is complete through the generation asked for (by default the store's)."""
        want = self.store if generation is None else generation
        if self.state is None or self.through < want or self.freshness()[0] == "future_invalid":
            raise ValueError(f"complete through {self.through}, asked for {want}")
        return selected(self.state, target, source, kind)

    def observed(self, generation: int) -> Projection:
        if generation < self.store:
            raise ValueError("the store's generation moved backwards")
        return Projection(self.state, self.through, generation)

    def freshness(self) -> tuple[str, bool]:
        word = "complete" if self.through == self.store else "stale" if self.through < self.store else "future_invalid"
        return word, word == "complete"
