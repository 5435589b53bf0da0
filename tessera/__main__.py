"""python -m tessera ROOT COMMAND ...: the archive's commands; rows are printed as JSON lines."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import ingestion
from tessera.archive import MODES, Archive
from tessera.operators import vectors
from tessera.operators.filters import SearchFilters, parse_date
from tessera.session import get_session
from tessera.sources import readers
from tessera.sources.versions import VersionLog


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    out.add_argument("root", help="folder of the archive's tables")
    commands = out.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="keyword, semantic or hybrid search; without a query the latest that pass the filters")
    search.add_argument("query", nargs="?", default="")
    search.add_argument("--mode", choices=MODES, default="keyword")
    search.add_argument("--limit", type=int)
    for name in ("folder", "from-contains", "from-exact", "date-from", "date-to", "attachment-type"):
        search.add_argument(f"--{name}")
    search.add_argument("--has-attachments", action=argparse.BooleanOptionalAction)
    for name, what in (("get", "one message"), ("thread", "the thread of a message")):
        commands.add_parser(name, help=what).add_argument("message", type=int)
    page = commands.add_parser("attachment-text", help="a page of an attachment's text")
    page.add_argument("attachment", type=int)
    page.add_argument("--offset", type=int, default=0)
    page.add_argument("--window", type=int, default=50_000)
    for name, what in (("folders", "folders with counts and dates"), ("status", "counts over the pipeline"), ("doctor", "checks: ok, warn or fail"), ("audit-embeddings", "vectors by state"), ("rebuild-bodies", "derive texts from HTML anew")):
        commands.add_parser(name, help=what)
    commands.add_parser("rebuild-index", help="write the keyword index").add_argument("path")
    purge = commands.add_parser("purge-deleted", help="drop what was deleted some days ago")
    purge.add_argument("--days", type=int, default=30)
    vacuum = commands.add_parser("vacuum", help="delete what only old versions of the tables name")
    vacuum.add_argument("--keep", type=int, default=2)
    vacuum.add_argument("--hours", type=float, default=24)
    ingest = commands.add_parser("ingest", help="parse a mail folder and print what was found; with --publish bring the archive up to it")
    ingest.add_argument("maildir")
    ingest.add_argument("--publish", action="store_true")
    return out


def run(args: argparse.Namespace, archive: Archive) -> DataFrame:
    if args.command == "search":
        filters = SearchFilters(args.folder, parse_date(args.date_from), parse_date(args.date_to, True), args.from_contains, args.from_exact, args.has_attachments, args.attachment_type)
        return archive.search(args.query, args.mode, filters, args.limit)
    if args.command == "get":
        return archive.get_message(args.message)
    if args.command == "thread":
        return archive.get_thread(args.message)
    if args.command == "attachment-text":
        return archive.attachment_text(args.attachment, args.offset, args.window)
    if args.command == "audit-embeddings":
        return archive.vectors().groupBy(vectors.audit_class(F.col("embedding")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    if args.command == "rebuild-bodies":
        return Archive.change(archive.spark, args.root, lambda now: {"messages": now.rebuild_bodies()}).status()
    if args.command == "rebuild-index":
        archive.build_index(args.path)
        return archive.status()
    if args.command == "purge-deleted":
        before = dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(days=args.days)
        return Archive.change(archive.spark, args.root, lambda now: now.purge(before)).status()
    if args.command == "vacuum":
        gone = VersionLog(archive.spark, args.root).vacuum(args.keep, args.hours * 3600)
        return archive.spark.createDataFrame([(g,) for g in gone], "deleted string")
    if args.command == "ingest" and args.publish:
        return ingestion.counts(ingestion.ingest_maildir(archive.spark, args.root, args.maildir))
    if args.command == "ingest":
        return readers.parse_mail(readers.maildir(archive.spark, args.maildir)).drop("body_html")
    return {"folders": archive.folders, "status": archive.status, "doctor": archive.doctor}[args.command]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session("tessera", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    archive = Archive(spark, {}) if args.command == "ingest" else Archive.open(spark, args.root)
    for row in run(args, archive).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
