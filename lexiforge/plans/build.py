"""Building a snapshot's tables from a corpus frame, whole or from the snapshot before."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import text as T
from ..operators import canonical, changes, records
from .lineage_cut import written


@dataclass
class Snapshot:
    """Record tables and identities of one corpus state."""

    tables: dict[str, DataFrame]
    snapshot_id: str
    identity: str
    verdicts: DataFrame | None = field(default=None)


def _finished(tables: dict[str, DataFrame], verdicts: DataFrame | None = None) -> Snapshot:
    tables = {name: written(df) for name, df in tables.items()}
    return Snapshot(tables, canonical.content_identity(tables["docs"]), canonical.index_identity(tables), verdicts)


def compatible_hashes(tables: dict[str, DataFrame], marker: str = canonical.MARKER) -> tuple[str, str, str]:
    """snapshot_id, index_hash and fingerprint of the canonical byte stream. Serial by definition: all lines pass through the driver."""
    snapshot = canonical.discovery_id(tables["docs"])
    return (snapshot, *canonical.identities(canonical.canonical_lines(tables), snapshot, marker))


def full(corpus: DataFrame, rich: bool = False, module_extension: str = T.MODULE_EXTENSION) -> Snapshot:
    files = records.prepared(corpus, module_extension)
    tables = {"docs": records.documents(files), "terms": records.terms(files)}
    return _finished(tables | records.rich(files) if rich else tables)


def incremental(before: dict[str, DataFrame], corpus: DataFrame, rich: bool = False, module_extension: str = T.MODULE_EXTENSION) -> Snapshot:
    """The same tables and identities as full(corpus), reusing the records of unchanged files. before needs the rich tables if rich."""
    tables, verdicts = changes.updated(before, records.prepared(corpus, module_extension), rich)
    return _finished(tables, verdicts)
