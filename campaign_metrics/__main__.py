"""Command line: the reference's operational commands as Spark jobs.

    python -m campaign_metrics import-history --base DIR --store DIR [--campaign NAME]
    python -m campaign_metrics aggregate --store DIR [--all]
    python -m campaign_metrics health --store DIR
    python -m campaign_metrics backfill-slugs --store DIR
    python -m campaign_metrics delete --store DIR [--campaign ID ...] [--source ID ...]
    python -m campaign_metrics ingest --landing DIR --store DIR [--trigger "1 minute"]

The store and the stream checkpoint must live in shared storage on a cluster.
"""

from __future__ import annotations

import argparse

from campaign_metrics.plans import jobs
from campaign_metrics.session import checkpoint_dir, get_session
from campaign_metrics.sources.store import Store


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="campaign_metrics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("import-history")
    p.add_argument("--base", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--campaign")
    p.add_argument("--single-line", action="store_true", help="splittable reads (no quoted newlines)")
    p = sub.add_parser("aggregate")
    p.add_argument("--store", required=True)
    p.add_argument("--all", action="store_true", help="include archived campaigns")
    for name in ("health", "backfill-slugs"):
        sub.add_parser(name).add_argument("--store", required=True)
    p = sub.add_parser("delete")
    p.add_argument("--store", required=True)
    p.add_argument("--campaign", type=int, nargs="*", default=[])
    p.add_argument("--source", type=int, nargs="*", default=[])
    p = sub.add_parser("ingest")
    p.add_argument("--landing", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--trigger", default="availableNow")
    for p in sub.choices.values():
        p.add_argument("--slice", choices=("day", "hour"), default="day",
                       help="time grain of the fact partitions (fixed per store)")
    args = ap.parse_args(argv)

    spark = get_session()
    checkpoint_dir(spark)
    store = Store(spark, args.store, slice=args.slice)
    if args.cmd == "import-history":
        jobs.import_history(spark, args.base, store, args.campaign, multiline=not args.single_line).show(truncate=False)
    elif args.cmd == "aggregate":
        jobs.rebuild_rollups(store, include_archived=args.all)
    elif args.cmd == "health":
        jobs.health(store).show(truncate=False)
    elif args.cmd == "backfill-slugs":
        jobs.backfill_slugs(store).show()
    elif args.cmd == "delete":
        jobs.delete(store, args.campaign, args.source).show()
    elif args.cmd == "ingest":
        from campaign_metrics.streaming.ingest import start_ingest

        q = start_ingest(spark, args.landing, store, store.read("sources"), f"{args.store}/_ingest_checkpoint",
                         trigger=args.trigger)
        q.awaitTermination()


if __name__ == "__main__":
    main()
