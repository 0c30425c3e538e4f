"""Commands: init, add, search, drop, list, reindex, status, watch, retry, upkeep."""

from __future__ import annotations

import argparse
import os
import sys
import urllib.request

from pyspark.sql import SparkSession

from shiori.config import Config
from shiori.operators.embedding import MODEL_FILES


def session() -> SparkSession:
    return SparkSession.builder.appName("shiori").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def download(base: str, folder: str) -> None:
    """Fetches the model's files that are missing; a file appears under its name when it is whole."""
    os.makedirs(folder, exist_ok=True)
    for name in MODEL_FILES:
        target = os.path.join(folder, name)
        if not os.path.exists(target):
            urllib.request.urlretrieve(f"{base.rstrip('/')}/{name}", target + ".tmp")
            os.rename(target + ".tmp", target)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shiori", description=__doc__)
    p.add_argument("--hashed", type=int, metavar="DIM", help="embed by hashed bigrams of so many dimensions instead of a model")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="download the embedding model").add_argument("--url", default="", help="where its files are (by default MODEL_URL)")
    for name, text in (("add", "register files or directories"), ("drop", "remove files or directories"), ("watch", "follow directories")):
        sub.add_parser(name, help=text).add_argument("-f", "--file", "--files", dest="files", nargs="+", action="extend", required=True)
    found = sub.add_parser("search", help="hybrid search")
    found.add_argument("query")
    found.add_argument("--json", action="store_true")
    sub.add_parser("list", help="registered documents").add_argument("keyword", nargs="?")
    sub.add_parser("reindex", help="rebuild everything").add_argument("--dry-run", action="store_true")
    sub.add_parser("status", help="tables of the store, and changes that could not be applied")
    sub.add_parser("retry", help="try the changes again that could not be applied")
    sub.add_parser("upkeep", help="fold segments and delete old versions").add_argument("--keep-days", type=float, default=7.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, config = parser().parse_args(argv), Config.load()
    if args.command == "init":
        if not (args.url or config.model_url):
            parser().error("name the model's address: --url or MODEL_URL")
        download(args.url or config.model_url, config.model_dir)
        print(f"Model ready at {config.model_dir}")
        return 0

    from shiori.operators import ingest, render
    from shiori.operators.embedding import HashedEmbedder, StaticEmbedder
    from shiori.schema import HASHED
    from shiori.sources.store import Store
    from shiori.streaming.watch import failures, retry, watch

    spark = spark or session()
    store = Store(spark, config.db_path)

    def embedder():
        return HashedEmbedder(args.hashed) if args.hashed else StaticEmbedder.shipped(spark, config.model_dir)

    if args.command == "add":
        done = ingest.update_files(spark, store, args.files, embedder())
        print(f"Indexed {done.updated} document(s), {len(done.failed)} failed.")
    elif args.command == "drop":
        ingest.drop_files(spark, store, args.files)
    elif args.command == "list":
        print(render.list_text(ingest.list_docs(store.read(HASHED), args.keyword, config.search_limit).collect()))
    elif args.command == "status":
        print(render.status_text(config.db_path, ingest.status(store)))
        for r in failures(spark, os.path.join(config.db_path, "_watch", "failed")).orderBy("path").toLocalIterator():
            print(f"not applied ({r.attempts} attempts): {r.kind} {r.path}: {r.error}")
    elif args.command == "retry":
        left = retry(store, embedder(), os.path.join(config.db_path, "_watch"))
        print(f"{len(left)} change(s) still not applied.")
    elif args.command == "upkeep":
        print(f"Rewrote {store.fold()} row(s), deleted {store.expire(args.keep_days * 86400)} old folder(s).")
    elif args.command == "reindex":
        count = ingest.reindex(spark, store, None if args.dry_run else embedder(), dry_run=args.dry_run)
        if count and not args.dry_run:
            print(f"Reindexed {count} document(s).")
    elif args.command == "search":
        asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        hits = ingest.search_store(store, asked, embedder(), limit=config.search_limit, k=config.search_rrf_k, window=config.search_adjacent_window)
        print(render.as_json(hits) if args.json else render.as_text(hits))
    else:
        watch(spark, store, args.files, embedder(), os.path.join(config.db_path, "_watch")).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
