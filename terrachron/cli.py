"""Command line: print a feed once, or as a stream.

    python -m terrachron.cli changes -d sqlite:///tmp/c.db -p name -s 1 -e 10 --base-uri file:///feed [--stream]
"""

from __future__ import annotations

import argparse

from .session import build_session
from .sources.datasources import register
from .sources.feeds import AUGMENTED_DIFFS, CHANGES, CHANGESETS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="terrachron", description=__doc__)
    out.add_argument("feed", choices=(CHANGES, CHANGESETS, AUGMENTED_DIFFS))
    out.add_argument("-b", "--base-uri", "-a", "--augmented-diff-source", "-c", "--changeset-source", dest="base_uri")
    out.add_argument("-s", "--start-sequence", type=int)
    out.add_argument("-e", "--end-sequence", type=int)
    out.add_argument("-d", "--database-url", dest="db_uri")
    out.add_argument("-p", "--proc-name", default="terrachron")
    out.add_argument("--batch-size", type=int)
    out.add_argument("--partition-count", type=int)
    out.add_argument("--retries", type=int)
    out.add_argument("--stream", action="store_true", help="keep reading until the end sequence, or for ever")
    out.add_argument("--timeout", type=float, help="seconds after which a stream ends")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(f"terrachron {args.feed}")
    register(spark)
    names = ("base_uri", "start_sequence", "end_sequence", "batch_size", "partition_count", "retries")
    options = {n: str(getattr(args, n)) for n in names if getattr(args, n) is not None}
    if not args.stream:
        spark.read.format(args.feed).options(**options).load().show(truncate=False)
        return 0
    options["proc_name"] = args.proc_name
    if args.db_uri:
        options["db_uri"] = args.db_uri
    query = spark.readStream.format(args.feed).options(**options).load().writeStream.format("console").option("truncate", "false").start()
    query.awaitTermination(args.timeout)
    query.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
