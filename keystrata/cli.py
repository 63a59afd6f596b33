"""Command line: ``python -m keystrata.cli [--path DIR] put|get|delete|scan|prefix|batch|snapshot|compact|stats|repair|serve ...``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .sources.batch import WriteBatch
from .sources.store import Store


def parse_batch(words: list[str]) -> WriteBatch:
    """``put k v`` and ``delete k`` in any order, a delete may come last."""
    batch, i = WriteBatch(), 0
    while i < len(words):
        if words[i] == "put" and i + 2 < len(words):
            batch.put(words[i + 1], words[i + 2])
            i += 3
        elif words[i] == "delete" and i + 1 < len(words):
            batch.delete(words[i + 1])
            i += 2
        else:
            raise SystemExit(f"not an operation: {' '.join(words[i:])}")
    return batch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keystrata")
    p.add_argument("--path", default="./data")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"put": ["key", "value"], "get": ["key"], "delete": ["key"], "scan": ["start", "end"], "prefix": ["prefix"], "snapshot": [], "compact": [], "stats": [], "repair": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "put":
            s.add_argument("--ttl", type=float)
        if name in ("get", "scan", "prefix"):
            s.add_argument("--at", type=int)
    sub.add_parser("batch").add_argument("ops", nargs=argparse.REMAINDER)
    serve = sub.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("keystrata").getOrCreate()
    if args.command == "repair":
        print(Store.repair(spark, args.path))
        return 0
    store = Store.open(spark, args.path)
    rows = None
    if args.command == "put":
        store.put(args.key, args.value) if args.ttl is None else store.put_with_ttl(args.key, args.value, args.ttl)
    elif args.command == "delete":
        store.delete(args.key)
    elif args.command == "batch":
        store.write_batch(parse_batch(args.ops))
    elif args.command == "get":
        rows = store.get(args.key) if args.at is None else store.get_at(args.key, args.at)
    elif args.command == "scan":
        rows = store.scan(args.start, args.end, args.at)
    elif args.command == "prefix":
        rows = store.prefix_scan(args.prefix, args.at)
    elif args.command == "snapshot":
        print(store.snapshot())
    elif args.command == "compact":
        print(store.compact(force=True))
    elif args.command == "stats":
        for frame in (store.metrics(), store.stats()):
            frame.show(truncate=False)
    elif args.command == "serve":
        from .server import serve

        serve(store, args.host, args.port)
    if rows is not None:
        found = 0
        for r in rows.select(F.col("key"), scalars.shown(F.col("value").cast("binary")).alias("value")).toLocalIterator():
            print(f"{r.key}\t{r.value}")
            found += 1
        return 0 if found or args.command != "get" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
