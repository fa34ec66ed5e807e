"""python -m lodestone TASK [--root DIR] [--json] [-v] [--all]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = argparse.ArgumentParser(prog="lodestone", description="Select the files worth reading for a task.")
    parser.add_argument("task")
    parser.add_argument("--root", default=".")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("--all", action="store_true", dest="show_all")
    parser.add_argument("--version", action="version", version=VERSION)
    long = {o for action in parser._actions for o in action.option_strings if o.startswith("--")}
    short = [f"-{a}" for a in argv if f"-{a}".split("=")[0] in long]
    if short:
        parser.print_usage(sys.stderr)
        print(f"{parser.prog}: long options take two dashes: {' '.join(short)}", file=sys.stderr)
        return 2
    args = parser.parse_args(argv)
    if not Path(args.root).is_dir():
        print(f"no directory: {args.root}", file=sys.stderr)
        return 2
    if not args.task.strip():
        print("the task is empty", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans import context, render

    builder = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
    package = context.get_context(builder.getOrCreate(), args.task, args.root)
    print(context.to_json(package) if args.json else render.render(package, args.verbose, args.show_all))
    return 0


if __name__ == "__main__":
    sys.exit(main())
