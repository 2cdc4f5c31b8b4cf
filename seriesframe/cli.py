"""python -m seriesframe.cli append|range|verify|inspect|migrate-v6 ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from seriesframe.errors import SeriesError
from seriesframe.functions.scalars import plain_number
from seriesframe.sources.legacy import migrate
from seriesframe.sources.store import CODECS, Reader, Writer, verify


def _report(spark: SparkSession, store: str) -> list[str]:
    r = verify(spark, store).first()
    share = 100 * r.compressed_blocks // r.block_count if r.block_count else 0
    lines = [f"checkpoints: {r.checkpoint}", f"series: {r.series_count}", f"records: {r.record_count}", f"blocks: {r.block_count}", f"compressed: {share}%", f"logical bytes: {r.logical_size}", f"physical bytes: {r.physical_size}", f"trailing bytes: {r.trailing_bytes}"]
    return lines + ([f"oldest: {r.oldest_timestamp}", f"newest: {r.newest_timestamp}"] if r.record_count else [])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seriesframe")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("append", help="append one point and publish it")
    a.add_argument("store"), a.add_argument("series"), a.add_argument("ts", type=int), a.add_argument("value", type=float), a.add_argument("codec", nargs="?", choices=list(CODECS), default="compressed")
    a = commands.add_parser("range", help="print points, one on each line")
    a.add_argument("store"), a.add_argument("series"), a.add_argument("start", type=int), a.add_argument("end", type=int)
    for name in ("verify", "inspect"):
        commands.add_parser(name).add_argument("store")
    a = commands.add_parser("migrate-v6", help="copy a version 6 file into a new store")
    a.add_argument("source"), a.add_argument("target"), a.add_argument("codec", nargs="?", choices=list(CODECS), default="compressed")
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("seriesframe").getOrCreate()
    try:
        if args.command == "append":
            with Writer(spark, args.store, codec=args.codec) as w:
                w.append(args.series, args.ts, args.value)
        elif args.command == "range":
            for p in Reader(spark, args.store).iter_range(args.series, args.start, args.end):
                print(p.ts, plain_number(p.value))
        elif args.command == "verify":
            verify(spark, args.store).first()
            print("ok")
        elif args.command == "inspect":
            print("\n".join(_report(spark, args.store)))
        else:
            print(f"{migrate(spark, args.source, args.target, codec=args.codec)} points")
    except SeriesError as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
