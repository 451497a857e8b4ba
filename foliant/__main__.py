"""python -m foliant scan|extract|preprocess|query ...: the batch jobs from the command line."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="foliant", description=__doc__)
    sub = ap.add_subparsers(dest="job", required=True)
    scan = sub.add_parser("scan", help="profile the images under a folder into a JSON report")
    scan.add_argument("root")
    scan.add_argument("out")
    ext = sub.add_parser("extract", help="write the files of ZIP archives that lie under a prefix")
    ext.add_argument("archives", help="a path or pattern")
    ext.add_argument("prefix")
    ext.add_argument("out")
    ext.add_argument("--images-only", action="store_true")
    pre = sub.add_parser("preprocess", help="write the split and the quarantine of a dataset")
    pre.add_argument("root")
    pre.add_argument("dataset")
    pre.add_argument("out")
    pre.add_argument("--mode", choices=["flat", "split"], default="flat")
    pre.add_argument("--no-cluster", action="store_true")
    pre.add_argument("--no-quarantine", action="store_true")
    run = sub.add_parser("query", help="write the result of a registered query")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("out")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from foliant.operators import profile
    from foliant.plans import catalog, pipeline
    from foliant.plans.workspace import store
    from foliant.session import SETTINGS
    from foliant.sources import files, sinks

    spark = SparkSession.builder.appName("foliant").config(map=SETTINGS).getOrCreate()
    if args.job == "scan":
        found = files.scan_images(spark, args.root).withColumns({"ok": files.F.col("status") == "ok", "other": files.F.col("status") == "unsupported"})
        sinks.write_report(profile.report(found, "dataset", "label", "suffix", "ok", "md5", "size_bytes", "width", "height", "other"), args.out)
    elif args.job == "extract":
        found = store(files.archive_entries(spark, args.archives, args.prefix, args.images_only), "extracted")
        sinks.write_entries(found, args.out)
        for r in found.filter("error IS NOT NULL").select("archive", "entry", "error").limit(100).collect():
            print(f"{r.archive} {r.entry or ''}: {r.error}", file=sys.stderr)
    elif args.job == "preprocess":
        split, moved = pipeline.preprocess(spark, args.root, args.dataset, args.mode, not args.no_cluster)
        sinks.write_split(split, f"{args.out}/split")
        if not args.no_quarantine:
            moved.write.mode("overwrite").parquet(f"{args.out}/quarantine")
    else:
        catalog.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
