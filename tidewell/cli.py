"""Command line: ``python -m tidewell run CONFIG`` and ``python -m tidewell list-stats``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell", description="Gridded statistics on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline; without CONFIG, the file or text in $CONFIG")
    run.add_argument("config", nargs="?")
    run.add_argument("-v", "--verbose", action="store_true")
    commands.add_parser("list-stats", help="list the registered statistics")
    args = parser.parse_args(argv)

    from tidewell.plans.pipeline import Pipeline
    from tidewell.registry import list_stats, load_plugins

    load_plugins()
    if args.command == "list-stats":
        print("\n".join(list_stats()))
        return 0
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    given = args.config or os.environ.get("CONFIG")
    if not given:
        print("no configuration: give a file or set CONFIG", file=sys.stderr)
        return 2
    if "\n" not in given and Path(given).is_file():
        Pipeline.from_yaml(given).run()
    elif args.config:
        print(f"no such file: {given}", file=sys.stderr)
        return 2
    else:
        Pipeline.from_yaml_string(given).run()
    return 0
