"""Point, filter and substring queries over the record tables of one snapshot.

Every answer carries its untruncated total, counted when it is asked for, so a limit never changes what was found. Limited
answers are the first in canonical order; `ordered` sorts the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Answer:
    """What was found: found without a limit, order is the canonical one."""

    snapshot_id: str
    generation: int
    found: DataFrame
    order: list[str]
    limit: int | None

    @property
    def records(self) -> DataFrame:
        """The rows, in no order unless there is a limit."""
        return self.found if self.limit is None else self.ordered

    @property
    def ordered(self) -> DataFrame:
        rows = self.found.orderBy(*self.order)
        return rows if self.limit is None else rows.limit(self.limit)

    @cached_property
    def total(self) -> int:
        return self.found.count()

    @property
    def limited(self) -> bool:
        return self.limit is not None and self.total > self.limit


def containing(docs: DataFrame, term: str, terms: DataFrame | None = None) -> DataFrame:
    """Documents with a token that contains the term; with an empty term, those with any token.

    Where docs carry their tokens as an array, each row decides by itself; else terms (path, token) are joined."""
    if "tokens" in docs.columns:
        return docs.where(F.exists("tokens", lambda t: F.contains(t, F.lit(term))))
    return docs.join(terms.where(F.contains("token", F.lit(term))).select("path"), "path", "left_semi")


def provenance(docs: DataFrame, established: DataFrame, paths: DataFrame) -> DataFrame:
    """path, found, digest, size, established_generation of every path asked for, known or not."""
    known = docs.select("path", "digest", "size", F.lit(True).alias("found"))
    out = paths.select("path").distinct().join(known, "path", "left").join(established, "path", "left")
    return out.select("path", F.coalesce("found", F.lit(False)).alias("found"), "digest", "size", F.col("generation").alias("established_generation"))


class Lookup:
    """Queries over tables docs, terms, syms, headings, rels, press and established (path, generation).

    docs may have a column tokens, each document's terms; it then serves instead of terms and is left out of answers."""

    def __init__(self, tables: dict[str, DataFrame], snapshot_id: str = "", generation: int = 0):
        self.tables, self.snapshot_id, self.generation = tables, snapshot_id, generation

    def _answer(self, rows: DataFrame, order: list[str], limit: int | None) -> Answer:
        return Answer(self.snapshot_id, self.generation, rows.drop("tokens"), order, limit)

    def _docs(self, test: Column | None, limit: int | None) -> Answer:
        docs = self.tables["docs"]
        return self._answer(docs if test is None else docs.where(test), ["kind", "path"], limit)

    def all_docs(self, limit: int | None = None) -> Answer:
        return self._docs(None, limit)

    def by_id(self, digest: str, limit: int | None = None) -> Answer:
        return self._docs(F.col("digest") == digest, limit)

    def by_path(self, path: str, limit: int | None = None) -> Answer:
        return self._docs(F.col("path") == path, limit)

    def by_kind(self, kind: int, limit: int | None = None) -> Answer:
        return self._docs(F.col("kind") == kind, limit)

    def term_substring(self, term: str, limit: int | None = None) -> Answer:
        return self.match(term=term, limit=limit)

    def match(self, kind: int | None = None, digest: str | None = None, term: str | None = None, limit: int | None = None) -> Answer:
        """All conditions that are given, together."""
        docs = self.tables["docs"]
        docs = docs if kind is None else docs.where(F.col("kind") == kind)
        docs = docs if digest is None else docs.where(F.col("digest") == digest)
        docs = docs if term is None else containing(docs, term, self.tables.get("terms"))
        return self._answer(docs, ["kind", "path"], limit)

    def _rels(self, rel: str, column: str, value: str, limit: int | None) -> Answer:
        return self._answer(self.tables["rels"].where((F.col("rel") == rel) & (F.col(column) == value)), ["src", "seq"], limit)

    def defines(self, name: str, limit: int | None = None) -> Answer:
        return self._rels("defines", "dst", name, limit)

    def references(self, dst: str, limit: int | None = None) -> Answer:
        return self._rels("references", "dst", dst, limit)

    def depends_on(self, path: str, limit: int | None = None) -> Answer:
        return self._rels("depends-on", "src", path, limit)

    def dependents(self, dst: str, limit: int | None = None) -> Answer:
        return self._rels("depends-on", "dst", dst, limit)

    def rfc_refs(self, number: str, limit: int | None = None) -> Answer:
        return self._rels("rfc-ref", "dst", number, limit)

    def pressure(self, pid: str, limit: int | None = None) -> Answer:
        return self._answer(self.tables["press"].where(F.col("pid") == pid), ["path", "seq"], limit)

    def symbols(self, name: str, limit: int | None = None) -> Answer:
        return self._answer(self.tables["syms"].where(F.col("name") == name), ["path", "seq"], limit)

    def headings_for(self, path: str, limit: int | None = None) -> Answer:
        return self._answer(self.tables["headings"].where(F.col("path") == path), ["path", "seq"], limit)

    def provenance(self, path: str) -> DataFrame:
        spark = self.tables["docs"].sparkSession
        return provenance(self.tables["docs"], self.tables["established"], spark.createDataFrame([(path,)], "path string"))
