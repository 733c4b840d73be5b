"""Watching a folder with Structured Streaming: a rate-free source reports the folder's state, and each change publishes a generation.

The stream carries hints only. What is published is always derived from the files themselves, so late, lost, repeated or reordered hints
cannot change the result; a candidate whose base is no longer HEAD is dropped and made again.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..plans import build
from ..plans.generations import StaleBase, Store
from ..sources import files


def hint(root: str, module_extension: str = T.MODULE_EXTENSION) -> str:
    """A digest of paths, sizes and modification times."""
    h = hashlib.sha256()
    for path, size in files.listed(root, module_extension)[0]:
        h.update(f"{path}\n{size}\n{os.stat(os.path.join(root, path)).st_mtime_ns}\n".encode())
    return h.hexdigest()


class HintReader(SimpleDataSourceStreamReader):
    """A hint for each change that has stayed the same for quietPolls polls more, and one every validateEvery polls without any."""

    def __init__(self, options: dict):
        self.root, self.extension = options["path"], options.get("moduleextension", T.MODULE_EXTENSION)
        self.quiet, self.validate = int(options.get("quietpolls", 0)), int(options.get("validateevery", 0))

    def initialOffset(self) -> dict:
        return {"hint": "", "pending": "", "still": 0, "polls": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        now = hint(self.root, self.extension)
        changed = now != start["hint"]
        still = start["still"] + 1 if changed and now == start["pending"] else 0
        polls = start["polls"] + 1 if self.validate else 0
        if (changed and still >= self.quiet) or (self.validate and polls >= self.validate):
            # a round that validates derives everything from the files, so it also takes up what is pending
            return iter([(now,)]), {"hint": now, "pending": now, "still": 0, "polls": 0}
        return iter([]), {"hint": start["hint"], "pending": now, "still": still, "polls": polls}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        return iter([(end["hint"],)] if end["polls"] == 0 and end["still"] == 0 and end["hint"] == end["pending"] else [])


class HintSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_hints"

    def schema(self) -> str:
        return "hint string"

    def simpleStreamReader(self, schema) -> HintReader:
        return HintReader(self.options)


def refresh(spark: SparkSession, root: str, store: Store, rich: bool = False, attempts: int = 5) -> int | None:
    """Publish the folder's state if any file differs from HEAD; the new generation, or None."""
    for _ in range(attempts):
        head = store.head()
        corpus = files.read(spark, root)
        snapshot = build.full(corpus, rich) if head is None else build.incremental(store.load(head), corpus, rich)
        if head is not None and snapshot.identity == store.manifest(head)["identity"]:
            return None
        try:
            return store.publish(snapshot, head)
        except StaleBase:
            continue
    raise StaleBase(f"HEAD moved {attempts} times")


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, rich: bool = False, trigger: dict | None = None, quiet_polls: int = 0, validate_every: int = 0) -> StreamingQuery:
    """Keep the store up to date with the folder. trigger: as for a stream writer, by default a poll every two seconds.

    quiet_polls: polls for which a change has to stay the same before it is taken up, so that a burst of writes is one generation.
    validate_every: polls after which all files are read again even if nothing seems to have changed; 0: never."""
    spark.dataSource.register(HintSource)

    def batch(hints: DataFrame, _: int) -> None:
        if not hints.isEmpty():
            refresh(spark, root, store, rich)

    stream = spark.readStream.format("corpus_hints").option("quietPolls", quiet_polls).option("validateEvery", validate_every).load(root)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def described(store: Store) -> str:
    head = store.head()
    return json.dumps({"head": head} | ({} if head is None else store.manifest(head)))
