"""Command line: clean a table, or print its profile."""

from __future__ import annotations

import argparse
import sys

from .operators.profile import profile
from .plans.pipeline import run_id, run_pipeline
from .session import build
from .sources.readers import load


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="refinery")
    commands = parser.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="clean a table and write all artifacts")
    clean.add_argument("input")
    clean.add_argument("-t", "--target")
    clean.add_argument("-o", "--out")
    clean.add_argument("-s", "--session", help="name of the run; a time and random letters if none is given")
    clean.add_argument("-q", "--quiet", action="store_true")
    show = commands.add_parser("profile", help="print a profile")
    show.add_argument("input")
    a = parser.parse_args(args)
    spark = build()
    try:
        if a.command == "profile":
            found = profile(load(spark, a.input))
            rows = next(iter(found.values())).n_total if found else 0
            print(f"{a.input}: {rows:,} rows, {len(found)} columns")
            print(f"{'column':30} {'type':12} {'missing':>7} {'unique':>10}  flags")
            for p in found.values():
                print(f"{p.name:30} {p.kind:12} {p.missing_rate:7.1%} {p.n_unique:>10,}  {'; '.join(p.flags)}")
            return 0
        out = f"{a.out or 'run_artifacts'}/{a.session or run_id()}" if a.session or not a.out else a.out
        tell = None if a.quiet else lambda name, carried: print(name, carried)
        run_pipeline(spark, a.input, a.target, on_event=tell, out=out)
        print(out)
        return 0
    except FileNotFoundError as e:
        print(f"no such file: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
