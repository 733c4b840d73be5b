"""Canonical lines, their total order, and the identities of corpus and index.

content_identity and index_identity are aggregates, made in tasks. discovery_id and identities give the hashes of the canonical
byte stream, which are serial by definition: they stream all lines through the driver, and only a caller that has to compare with
an index made elsewhere needs them (plans.build.compatible_hashes)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import StreamDigest
from ..functions.text import RANKS

#: First line of the canonical bytes, without version; a parameter wherever bytes are made.
MARKER = "corpus-index"
#: Canonical bytes that are digested at once.
DIGEST_BYTES = 1 << 20
VERSIONS = ("canonical-v1", "canonical-v2")


def canonical_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """rank, path, seq, line of every record of docs, terms and, if given, syms, headings, rels and press."""
    line = lambda *parts: F.concat_ws(" ", *(F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts))
    row = lambda df, rank, path, seq, text: df.select(rank.cast("int").alias("rank"), F.col(path).alias("path"), seq.cast("bigint").alias("seq"), text.alias("line"))
    out = row(tables["docs"], F.col("kind"), "path", F.lit(0), line("=doc", "kind", "path", "digest", "size", "words", "lines", "=0"))
    forms = {
        "terms": ("term", "path", ("=term", "path", "token", "tid", "seq")),
        "syms": ("sym", "path", ("=sym", "path", "sym", "name", "ndigest", "seq")),
        "headings": ("heading", "path", ("=heading", "path", "level", "seq", "tdigest", "title")),
        "rels": ("rel", "src", ("=rel", "src", "rel", "dst", "seq")),
        "press": ("press", "path", ("=press", "path", "pid", "seq")),
    }
    for name, (rank, path, parts) in forms.items():
        if name in tables:
            out = out.unionByName(row(tables[name], F.lit(RANKS[rank]), path, F.col("seq"), line(*parts)))
    return out


def set_digest(rows: DataFrame, raw: str) -> DataFrame:
    """One row: n, and a digest of the multiset of a binary column's values, whatever their order and partitions.

    The SHA-256 of every value is added up in four parts modulo 2^64; the sums and the count are hashed. A task adds up its own values and leaves one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(4, np.uint64)
        for batch in batches:
            n += batch.num_rows
            found = b"".join(hashlib.sha256(v).digest() for v in batch.column(0).to_pylist() if v is not None)
            sums += np.frombuffer(found, ">u8").reshape(-1, 4).sum(axis=0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, *sums.view(np.int64).tolist())], names=["n", "s0", "s1", "s2", "s3"])

    parts = rows.select(raw).mapInArrow(run, "n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    # a signed part differs from the unsigned one by 2^64, which the modulus takes away
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(total(f"s{k}").alias(f"s{k}") for k in range(4)))
    whole = F.concat_ws(" ", F.col("n").cast("string"), *(F.pmod(F.col(f"s{k}"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("string") for k in range(4)))
    return sums.select("n", F.sha2(whole.cast("binary"), 256).alias("digest"))


def index_identity(tables: dict[str, DataFrame]) -> str:
    """The identity of an index: a digest of all canonical lines, made in tasks."""
    return set_digest(canonical_lines(tables).select(F.col("line").cast("binary").alias("raw")), "raw").first()["digest"]


def content_identity(docs: DataFrame) -> str:
    """The identity of a corpus: a digest of path, size and CRC of every file, made in tasks."""
    return set_digest(docs.select(F.format_string("%s\n%d\n%08x\n", "path", "size", "crc").cast("binary").alias("raw")), "raw").first()["digest"]


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy("rank", "path", "seq")


def discovery_id(docs: DataFrame) -> str:
    """SHA-256 over path, size and CRC of every file in path order, streamed partition by partition."""
    h = hashlib.sha256()
    rows = docs.select("path", F.format_string("%s\n%d\n%08x\n", "path", "size", "crc").alias("line")).orderBy("path")
    for r in rows.select("line").toLocalIterator():
        h.update(r[0].encode())
    return h.hexdigest()


def canonical_bytes(lines: DataFrame, snapshot_id: str, marker: str = MARKER) -> Iterator[bytes]:
    """The canonical bytes, piece by piece; without rich rows they are those of version 1."""
    version = VERSIONS[0] if lines.where(F.col("rank") > RANKS["term"]).isEmpty() else VERSIONS[1]
    yield f"{marker} {version}\nsnapshot {snapshot_id}\n".encode()
    for r in ordered(lines).select("line").toLocalIterator():
        yield f"{r[0]}\n".encode()
    yield b"end\n"


def identities(lines: DataFrame, snapshot_id: str, marker: str = MARKER) -> tuple[str, str]:
    """index_hash (SHA-256) and fingerprint (Merkle digest) of the canonical bytes. Serial by definition; held in memory are DIGEST_BYTES and a partition's lines."""
    out, pending, size = StreamDigest(), [], 0
    for piece in canonical_bytes(lines, snapshot_id, marker):
        pending.append(piece)
        size += len(piece)
        if size > DIGEST_BYTES:
            out.update(b"".join(pending))
            pending, size = [], 0
    out.update(b"".join(pending))
    return out.digests()
