"""Command line of the crawler: ``python -m tarn.crawl_cli --seeds FILE --corpus DIR [--max-pages 500] [--max-depth 5] [--max-links-per-page 50] …``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from tarn.functions.text import now_iso
from tarn.operators.crawl import Source, crawl_from, from_web
from tarn.session import local_session
from tarn.sources.corpus import load_seeds, write_documents


def main(argv: list[str] | None = None, source: Source | None = None) -> int:
    """0 after a crawl, 1 if there are no seeds. ``source`` replaces fetching over HTTP."""
    p = argparse.ArgumentParser(description="crawl the web into a corpus of JSON lines")
    p.add_argument("--seeds", required=True)
    p.add_argument("--corpus", required=True)
    p.add_argument("--max-pages", type=int, default=500)
    p.add_argument("--max-depth", type=int, default=5)
    p.add_argument("--max-links-per-page", type=int, default=None)
    p.add_argument("--allowed-domains", nargs="*", default=None)
    p.add_argument("--log")
    p.add_argument("--clear-corpus", action="store_true")
    args = p.parse_args(argv)
    logging.basicConfig(filename=args.log, level=logging.INFO, format="%(asctime)s %(message)s", force=True)
    spark = local_session()
    seeds = [r.url for r in load_seeds(spark, args.seeds).collect()]  # a crawl starts from a list in a file
    if not seeds:
        print("no seeds", file=sys.stderr)
        return 1
    found = crawl_from(spark, source or from_web(), seeds, args.max_pages, args.max_depth, args.max_links_per_page, args.allowed_domains)
    meta = F.struct(now_iso().alias("crawled_at"), F.col("content_length").cast("string").alias("content_length"), F.lit("200").alias("status"), F.col("depth").cast("string").alias("depth"))
    docs = found.select("doc_id", "url", "title", "text", "tokens", "token_segments", meta.alias("meta"))
    write_documents(docs, args.corpus, "overwrite" if args.clear_corpus else "append")
    logging.info("%d pages from %d seeds", docs.count(), len(seeds))
    return 0


if __name__ == "__main__":
    sys.exit(main())
