"""Command line: info, convert, validate, batch, formats. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import os
import sys

from .convert import compare_with_exports, convert_container, convert_folder, show_info
from .sources.codebook import find_codebook
from .sources.sinks import FORMATS


def _formats(text: str) -> list[str]:
    return list(FORMATS) if text == "all" else [f.strip().lower() for f in text.split(",")]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomfield", description="Open survey containers on Spark.")
    sub = p.add_subparsers(dest="command")
    q = sub.add_parser("info", help="what a container holds")
    q.add_argument("container")
    q.add_argument("codebook", nargs="?")
    q = sub.add_parser("convert", help="convert a container")
    q.add_argument("container")
    q.add_argument("codebook", nargs="?")
    q.add_argument("output")
    q.add_argument("--formats", "-f", default="parquet", help=f"comma-separated, or all: {', '.join(FORMATS)}")
    q.add_argument("--year", default="unknown")
    q.add_argument("--quiet", "-q", action="store_true")
    q.add_argument("--single", action="store_true", help="single files instead of folders of parts")
    q = sub.add_parser("validate", help="compare converted tables with exports")
    q.add_argument("parquet_dir")
    q.add_argument("export_dir")
    q = sub.add_parser("batch", help="convert all containers of a survey")
    q.add_argument("--survey", "-s", default="hces")
    q.add_argument("--formats", "-f", default="parquet")
    q.add_argument("--root", default="data")
    q.add_argument("--single", action="store_true", help="single files instead of folders of parts")
    sub.add_parser("formats", help="list the formats")
    return p


def _inputs(args) -> tuple[str, str] | None:
    if not os.path.isfile(args.container):
        print(f"Error: no such file: {args.container}")
        return None
    try:
        book = args.codebook or find_codebook(args.container)
    except FileNotFoundError as e:
        print(f"Error: {e}")
        return None
    if not os.path.isfile(book):
        print(f"Error: no such codebook: {book}")
        return None
    return args.container, book


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command in ("convert", "batch") and (bad := [f for f in _formats(args.formats) if f not in FORMATS]):
        print(f"Error: unknown format(s): {', '.join(bad)}\nThere are: {', '.join(FORMATS)}")
        return 2
    if args.command in ("info", "convert"):
        pair = _inputs(args)
        if pair is None:
            return 2
        if args.command == "info":
            show_info(*pair)
            return 0
        report = convert_container(*pair, args.output, _formats(args.formats), args.year, not args.quiet, single=args.single)
        return 1 if report["errors"] else 0
    if args.command == "validate":
        got = compare_with_exports(args.parquet_dir, args.export_dir)
        if "error" in got:
            print(got["error"])
            return 2
        return 1 if got["failed"] else 0
    if args.command == "batch":
        try:
            results = convert_folder(args.root, args.survey, _formats(args.formats), single=args.single)
        except FileNotFoundError as e:
            print(e)
            return 1
        return 1 if any(r.error for r in results) else 0
    if args.command == "formats":
        for name, (suffix, text) in FORMATS.items():
            print(f"  {name:10}  {suffix:8}  {text}")
        return 0
    parser.print_help()
    print("\nTip: info looks into a file, convert converts it.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
