"""Published snapshots: one folder of Parquet tables for each generation, and a small HEAD file naming the current one.

A generation is staged, then renamed, then named by HEAD under a lock, so readers see a whole generation or the one before.
Publishing names the generation it was built on and fails if HEAD has moved meanwhile. The store is a folder that the
driver can rename in and all tasks can reach; it holds tables, Spark reads and writes them.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, changes
from ..operators.lookups import Lookup
from .build import Snapshot


class StaleBase(Exception):
    """HEAD is no longer the generation that a candidate was built on."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    @contextmanager
    def _locked(self):
        with open(os.path.join(self.root, ".lock"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _folder(self, generation: int) -> str:
        return os.path.join(self.root, f"gen-{generation:06d}")

    def head(self) -> int | None:
        """The current generation; None for an empty store; an error if HEAD does not name one that is there."""
        try:
            with open(os.path.join(self.root, "HEAD")) as f:
                generation = int(json.load(f)["generation"])
        except FileNotFoundError:
            return None
        if not os.path.exists(os.path.join(self._folder(generation), "manifest.json")):
            raise ValueError(f"HEAD names generation {generation}, which is not there")
        return generation

    def manifest(self, generation: int) -> dict:
        with open(os.path.join(self._folder(generation), "manifest.json")) as f:
            return json.load(f)

    def generations(self) -> list[int]:
        return sorted(int(n[4:]) for n in os.listdir(self.root) if n.startswith("gen-"))

    def publish(self, snapshot: Snapshot, base: int | None = None) -> int:
        """Make the snapshot the next generation, if HEAD still is base."""
        if self.head() != base:
            raise StaleBase(f"HEAD is {self.head()}, not {base}")
        generation = 0 if base is None else base + 1
        staging = os.path.join(self.root, f".staging-{uuid.uuid4().hex}")
        old = self.spark.createDataFrame([], "path string, generation int") if base is None else self.load(base)["established"]
        tables = snapshot.tables | {"established": changes.established(old, snapshot.tables["docs"], generation)}
        for name, df in tables.items():
            df.write.parquet(f"file://{staging}/{name}.parquet")
        with open(os.path.join(staging, "manifest.json"), "w") as f:
            json.dump({"generation": generation, "snapshot_id": snapshot.snapshot_id, "identity": snapshot.identity, "tables": sorted(tables)}, f)
            f.flush()
            os.fsync(f.fileno())
        with self._locked():
            if self.head() != base:
                shutil.rmtree(staging)
                raise StaleBase(f"HEAD is {self.head()}, not {base}")
            os.rename(staging, self._folder(generation))
            new = os.path.join(self.root, f".HEAD-{uuid.uuid4().hex}")
            with open(new, "w") as f:
                json.dump({"generation": generation}, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(new, os.path.join(self.root, "HEAD"))
        return generation

    def load(self, generation: int) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"file://{self._folder(generation)}/{name}.parquet") for name in self.manifest(generation)["tables"]}

    def verified(self, generation: int) -> bool:
        """Whether a generation's tables still have the identity of its manifest."""
        tables = {n: t for n, t in self.load(generation).items() if n != "established"}
        return canonical.index_identity(tables) == self.manifest(generation)["identity"]

    def lookup(self, generation: int | None = None) -> Lookup:
        """Queries over one generation, by default the current one. It stays the same whatever is published meanwhile."""
        generation = self.head() if generation is None else generation
        if generation is None:
            raise ValueError("the store is empty")
        return Lookup(self.load(generation), self.manifest(generation)["snapshot_id"], generation)

    def check(self) -> list[tuple[str, str]]:
        """(code, what) of all that is wrong."""
        out, there = [], self.generations()
        try:
            head = self.head()
            if head is None and there:
                out.append(("HEAD_MISSING", "generations without HEAD"))
        except ValueError as e:
            head = None
            out.append(("HEAD_DANGLING" if "not there" in str(e) else "HEAD_MALFORMED", str(e)))
        for g in there:
            try:
                if self.manifest(g)["generation"] != g:
                    out.append(("GEN_NUMBER_MISMATCH", str(g)))
                elif not self.verified(g):
                    out.append(("GEN_HASH_MISMATCH", str(g)))
            except Exception as e:  # noqa: BLE001  any failure to read is the finding
                out.append(("GEN_UNREADABLE", f"{g}: {type(e).__name__}"))
            if head is not None and g > head:
                out.append(("NEWER_THAN_HEAD", str(g)))
        out += [("GEN_GAP", str(g)) for a, b in zip(there, there[1:], strict=False) for g in range(a + 1, b)]
        return out + [("ORPHAN_TMP", n) for n in sorted(os.listdir(self.root)) if n.startswith((".staging-", ".HEAD-"))]

    def repair(self) -> list[str]:
        """Remove what interrupted publications left."""
        with self._locked():
            left = [n for n in sorted(os.listdir(self.root)) if n.startswith((".staging-", ".HEAD-"))]
            for n in left:
                path = os.path.join(self.root, n)
                shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        return left

    def reclaim(self, keep_recent: int) -> list[int]:
        """Remove generations below HEAD but for the newest keep_recent of them."""
        with self._locked():
            head = self.head()
            below = [g for g in self.generations() if head is not None and g < head]
            gone = below[: max(0, len(below) - keep_recent)]
            for g in gone:
                shutil.rmtree(self._folder(g))
        return gone

    def metrics(self) -> dict:
        """Bytes of all generations, of HEAD, and their ratio."""
        size = lambda g: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(self._folder(g)) for f in fs)
        total, head = sum(map(size, self.generations())), self.head()
        own = size(head) if head is not None else 0
        return {"bytes": total, "head_bytes": own, "amplification": total / own if own else None}

    def table_counts(self, generation: int) -> DataFrame:
        out = None
        for name, df in self.load(generation).items():
            row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
            out = row if out is None else out.unionByName(row)
        return out
