"""Command line: ``python -m siftwork.cli pack | index | feedback submit | feedback weights | feedback stats | watch | serve``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from siftwork import api
from siftwork.config import Config
from siftwork.errors import SiftworkError
from siftwork.serve import serve
from siftwork.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwork")
    sub = p.add_subparsers(dest="command", required=True)
    repo = argparse.ArgumentParser(add_help=False)
    repo.add_argument("-r", "--repo", default=".")
    repo.add_argument("-C", "--config")
    pk = sub.add_parser("pack", parents=[repo], help="choose the most valuable files under a token budget")
    pk.add_argument("-b", "--budget", type=int, default=128_000)
    pk.add_argument("-o", "--output", choices=api.LEVELS, default="l3")
    pk.add_argument("-f", "--focus", action="append", default=[])
    pk.add_argument("-s", "--signatures", action="store_true")
    sub.add_parser("index", parents=[repo], help="count files and tokens")
    sub.add_parser("watch", parents=[repo], help="report changed files")
    sub.add_parser("serve", help="answer tool calls over standard input and output")
    fb = sub.add_parser("feedback").add_subparsers(dest="action", required=True)
    sb = fb.add_parser("submit", parents=[repo])
    sb.add_argument("-s", "--session", required=True)
    sb.add_argument("-f", "--response-file", required=True)
    w = fb.add_parser("weights", parents=[repo])
    w.add_argument("-l", "--learn", action="store_true")
    fb.add_parser("stats", parents=[repo])
    return p


def run(args: argparse.Namespace, spark) -> str:
    if args.command == "serve":
        serve(spark)
        return ""
    root = args.repo if "://" in args.repo else os.path.realpath(args.repo)
    config = Config.load(args.config) if args.config else Config.find(root)
    if args.command == "pack":
        return api.pack_context(spark, root, args.budget, args.output, args.focus, args.signatures, config)
    if args.command == "index":
        return api.index_stats(spark, root, config)
    if args.command == "watch":
        from siftwork.streaming.watch import watch

        watch(spark, root, lambda batch, _: [print(r["path"], flush=True) for r in batch.select("path").toLocalIterator()]).awaitTermination()
        return ""
    if args.action == "submit":
        return api.submit_feedback(spark, root, args.session, Path(args.response_file).read_text(), config)
    return api.learned_weights(spark, root, args.learn, config) if args.action == "weights" else api.feedback_stats(spark, root, config)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        sys.stdout.write(run(args, local_session()))
    except SiftworkError as e:
        sys.stderr.write(f"{e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
