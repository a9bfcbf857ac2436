"""Command line: scan a folder, or check a working tree against a git ref.

Exit code 0: nothing fails; 1: check has findings at or above --fail-on; 2: usage or other error.
"""

from __future__ import annotations

import argparse
import os
import sys

from .config import FAIL_RANK, load
from .sinks.documents import FORMATS, stream


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="twinsight")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "check"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--format", choices=sorted(FORMATS), default="terminal")
        p.add_argument("--verbose", action="store_true")
        p.add_argument("--fail-on", choices=[*FAIL_RANK, "none"], default="exact-normalized")
        p.add_argument("--top", type=int, default=None, help="findings that the terminal shows, 0 for all")
        if name == "check":
            p.add_argument("--base", required=True, help="git ref to compare with")
    return parser.parse_args(argv)


def run(args: argparse.Namespace, spark, out=None) -> int:
    """Write the report to out and return the exit code."""
    from .operators.check import check
    from .operators.report import report
    from .sources.files import read_files

    t, code = load(args.path), 0
    if args.command == "scan":
        found = report(read_files(spark, args.path, t=t), t, args.fail_on)
    else:
        found, counters = check(spark, args.path, args.base, args.fail_on, t)
        code = counters["exit_code"]
    options = {"top": t.top if args.top is None else args.top} if args.format == "terminal" else {}
    out = out or sys.stdout
    try:
        for part in stream(FORMATS[args.format](found, args.verbose, **options), args.format):
            out.write(part)
        out.flush()
    except BrokenPipeError:
        # The reader has seen enough; nothing more is to be flushed to it at exit.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    return code


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    from pyspark.sql import SparkSession

    try:
        return run(args, SparkSession.builder.appName("twinsight").getOrCreate())
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
