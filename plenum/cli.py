"""Command line: ``python -m plenum.cli COMMAND``. Every command works on the tables below ``--folder``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plenum.operators import dedup, nested, store
from plenum.settings import Settings
from plenum.sources import html, pages, providers
from plenum.streaming import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plenum")
    p.add_argument("--folder", default=Settings.read().folder)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="create empty tables")
    sub.add_parser("reset", help="replace all tables by empty ones").add_argument("--yes", action="store_true")
    a = sub.add_parser("ingest-sessions", help="ingest session files (Parquet)")
    a.add_argument("source")
    a.add_argument("--force", action="store_true", help="delete what is stored of these sessions first")
    a.add_argument("--terms", help="dictionary of entities (Parquet: entity_id, entity_type, name)")
    a = sub.add_parser("ingest-papers", help="flatten an order paper table")
    a.add_argument("source")
    a = sub.add_parser("scrape", help="read paper links from stored pages (Parquet: page, html)")
    a.add_argument("source")
    a.add_argument("--base-url", required=True)
    a.add_argument("--max-papers", type=int)
    a = sub.add_parser("pages", help="read paper links from a paginated fetcher")
    a.add_argument("module")
    a.add_argument("function")
    a.add_argument("--max-papers", type=int)
    a = sub.add_parser("embed", help="fill missing vectors of a table")
    a.add_argument("table")
    a.add_argument("text")
    a.add_argument("--limit", type=int)
    a.add_argument("--batch-size", type=int, default=Settings.read().embedding_batch)
    a = sub.add_parser("deduplicate", help="candidate pairs, roots and merged entities")
    a.add_argument("entities")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plenum").getOrCreate()
    out = args.folder
    if args.command == "init" or args.command == "reset":
        if args.command == "reset" and not args.yes:
            print("reset replaces all tables; say --yes", file=sys.stderr)
            return 2
        store.create_tables(spark, out)
    elif args.command == "ingest-sessions":
        schema = spark.read.parquet(args.source).schema
        ingest.ingest_sessions(spark, args.source, schema, out, f"{out}/_ingest", args.force, spark.read.parquet(args.terms) if args.terms else None).awaitTermination()
    elif args.command == "ingest-papers":
        for name, df in nested.paper_tables(spark.read.parquet(args.source)).items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
    elif args.command == "scrape":
        found = html.paper_links(spark.read.parquet(args.source), "page", "html", args.base_url)
        (found.orderBy("page", "row").limit(args.max_papers) if args.max_papers else found).write.mode("overwrite").parquet(f"{out}/paper_links")
    elif args.command == "pages":
        pages.register(spark)
        reader = spark.read.format("pages").option("module", args.module).option("function", args.function)
        (reader.option("most", args.max_papers) if args.max_papers else reader).load().write.mode("overwrite").parquet(f"{out}/paper_links")
    elif args.command == "embed":
        df = spark.read.parquet(f"{out}/{args.table}")
        made = store.backfill(df, "embedding", lambda d: providers.embed(d, args.text, batch=args.batch_size), args.limit)
        made.write.mode("overwrite").parquet(f"{out}/{args.table}_embedded")
    elif args.command == "deduplicate":
        e = spark.read.parquet(args.entities)
        pairs = dedup.ranked(dedup.candidates(e, Settings.read().embedding_dimensions))
        pairs.write.mode("overwrite").parquet(f"{out}/entity_candidates")
        stored = spark.read.parquet(f"{out}/entity_candidates")
        roots = dedup.survivors(stored, "keep_id", "merge_id", e)
        roots.write.mode("overwrite").parquet(f"{out}/entity_roots")
        dedup.merged(e, spark.read.parquet(f"{out}/entity_roots")).write.mode("overwrite").parquet(f"{out}/entities_merged")
        print(stored.agg(F.count("*")).first()[0], "candidate pairs")
    return 0


if __name__ == "__main__":
    sys.exit(main())
