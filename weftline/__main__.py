"""Command line: run any registered query over a folder of tables, or read a corpus."""

from __future__ import annotations

import argparse
import importlib
import sys

from weftline.session import local_session

PLANS = ("audit", "quality", "vectors", "blocks", "extract", "features", "model", "sources", "relations")


def all_queries() -> dict:
    """Queries of the core by name; those of other subpackages are added by the entry point."""
    return {name: f for plan in PLANS for name, f in importlib.import_module(f"weftline.plans.{plan}").QUERIES.items()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("query")
    run.add_argument("--tables", required=True, help="folder with the Parquet tables")
    run.add_argument("--output", help="new Parquet folder; without it the first rows are shown")
    run.add_argument("--cpus", type=int, default=8)
    extract = sub.add_parser("extract", help="extract documents of a corpus into typed blocks")
    extract.add_argument("--input", required=True)
    extract.add_argument("--output", required=True)
    extract.add_argument("--limit-rows", type=int)
    args = parser.parse_args(argv)
    if args.command == "list":
        for name, f in sorted(all_queries().items()):
            print(f"{name}: {(f.__doc__ or '').splitlines()[0] if f.__doc__ else ''}")
        return 0
    spark = local_session(getattr(args, "cpus", 8))
    if args.command == "run":
        queries = all_queries()
        if args.query not in queries:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        df = queries[args.query](spark, args.tables)
        if args.output:
            df.write.mode("errorifexists").parquet(args.output)
        else:
            df.show(50, truncate=80)
        return 0
    from pyspark.sql import functions as F

    from weftline.operators.extract import extract_documents
    from weftline.sources.corpus import read_corpus, write_table

    corpus = read_corpus(spark, args.input, strict=False).withColumn("raw_id", F.monotonically_increasing_id())
    write_table(extract_documents(corpus.limit(args.limit_rows) if args.limit_rows else corpus), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
