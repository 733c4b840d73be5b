"""Command line: build, query, watch, check, reclaim."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import build
from .plans.generations import Store
from .sources import files
from .streaming import watch as watching

#: Flags of `query`, the first given one decides, and the lookup each stands for.
LOOKUPS = ("defines", "references", "depends_on", "dependents", "rfc_refs", "pressure", "symbols", "headings_for", "by_id", "by_path", "by_kind", "term_substring")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexiforge", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("build", "watch"):
        p = sub.add_parser(name)
        p.add_argument("--corpus", required=True)
        p.add_argument("--store", required=True)
        p.add_argument("--rich", action="store_true")
        if name == "build":
            p.add_argument("--incremental", action="store_true")
        else:
            p.add_argument("--checkpoint", required=True)
            p.add_argument("--seconds", type=int, default=2)
            p.add_argument("--quiet-polls", type=int, default=0)
            p.add_argument("--validate-every", type=int, default=0)
    p = sub.add_parser("query")
    p.add_argument("--store", required=True)
    p.add_argument("--generation", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--provenance")
    for name in LOOKUPS:
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=int if name == "by_kind" else str)
    p = sub.add_parser("check")
    p.add_argument("--store", required=True)
    p.add_argument("--repair", action="store_true")
    p = sub.add_parser("reclaim")
    p.add_argument("--store", required=True)
    p.add_argument("--keep-recent", type=int, default=0)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexiforge").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "build":
        head, corpus = store.head(), files.read(spark, args.corpus)
        snapshot = build.incremental(store.load(head), corpus, args.rich) if args.incremental and head is not None else build.full(corpus, args.rich)
        print(json.dumps({"generation": store.publish(snapshot, head), "identity": snapshot.identity}))
    elif args.command == "watch":
        watching.watch(spark, args.corpus, store, args.checkpoint, args.rich, {"processingTime": f"{args.seconds} seconds"}, args.quiet_polls, args.validate_every).awaitTermination()
    elif args.command == "query":
        if store.head() is None:
            print("the store is empty", file=sys.stderr)
            return 1
        lookup = store.lookup(args.generation)
        if args.provenance:
            print(lookup.provenance(args.provenance).toJSON().first())
            return 0
        name = next((n for n in LOOKUPS if getattr(args, n) not in (None, "")), None)
        found = getattr(lookup, name)(getattr(args, name), args.limit) if name else lookup.all_docs(args.limit)
        print(json.dumps({"snapshot_id": found.snapshot_id, "generation": found.generation, "total": found.total, "limited": found.limited}))
        for row in found.ordered.toJSON().toLocalIterator():
            print(row)
    elif args.command == "check":
        removed = store.repair() if args.repair else []
        issues = store.check()
        print(json.dumps({"ok": not issues, "issues": issues, "removed": removed}))
        return int(bool(issues))
    else:
        print(json.dumps({"reclaimed": store.reclaim(args.keep_recent)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
