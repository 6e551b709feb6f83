"""The command line: parse, transform, render, validate and fmt over files or standard input.

    python -m foliospark render --config tags.yaml --partials parts --var n=3 a.md b.md

Results print in the order of the arguments.  Exit codes: 0 fine, 1 a problem (validate: an error
or critical one; fmt --check: a file that would change), 2 a failure; the worst wins.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.format import FormatOptions
from foliospark.kernel.schema import Config
from foliospark.sources.declare import DeclarationError
from foliospark.sources.documents import read_config, read_documents
from foliospark.sources.sinks import human_lines, unified_diff


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="foliospark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "transform", "render", "validate"):
        p = commands.add_parser(name)
        p.add_argument("paths", nargs="*")
        p.add_argument("--file", help="the label of standard input")
        if name != "parse":
            p.add_argument("--config", help="tags, nodes and variables as YAML or JSON")
            p.add_argument("--partials", help="a folder of partials")
            p.add_argument("--var", action="append", default=[], metavar="NAME=VALUE")
        if name == "validate":
            p.add_argument("--format", choices=("human", "json"), default="human")
    p = commands.add_parser("fmt")
    p.add_argument("paths", nargs="*")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--check", action="store_true")
    mode.add_argument("--write", action="store_true")
    p.add_argument("--max-tag-opening-width", type=int, default=80)
    p.add_argument("--ordered-list-mode", choices=("repeat", "increment"), default="repeat")
    return parser


def inputs(spark: SparkSession, paths: list[str], label: str | None) -> DataFrame:
    """(doc_id, file, source, error), doc_id being the place among the arguments."""
    if not paths:
        return spark.createDataFrame([(0, label or "<stdin>", sys.stdin.read(), None)], "doc_id long, file string, source string, error string")
    out = None
    for k, path in enumerate(paths):
        rows = read_documents(spark, path, label=path).withColumn("doc_id", F.lit(k).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report(command: str, message: str) -> None:
    print(f"foliospark {command}: {message}", file=sys.stderr)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    command, config = args.command, Config()
    if command not in ("parse", "fmt"):
        try:
            config = read_config(spark, args.config, args.partials, args.var)
        except (DeclarationError, PySparkException, OSError) as e:
            where = f"{args.config}: " if args.config else ""
            report(command, f"{where}{str(e).splitlines()[0]}")
            return 2
    formatting = FormatOptions(getattr(args, "max_tag_opening_width", 80), getattr(args, "ordered_list_mode", "repeat"))
    engine = Engine(spark, config, ParseOptions(), formatting)
    docs = inputs(spark, args.paths, getattr(args, "file", None))
    code = 0
    for row in docs.filter("error is not null").orderBy("doc_id").toLocalIterator():
        report(command, f"{row['file']}: {row['error']}")
        code = 2
    docs = docs.filter("error is null")
    if command == "fmt":
        return max(code, formats(engine.format(docs), args))
    if command == "validate":
        problems = engine.validate_by_kernel(docs, file="file")
        bad = not problems.filter("level in ('error', 'critical')").isEmpty()
        if args.format == "json":
            lines = docs.select("doc_id", engine.kernels.diagnostics_json(F.col("source"), F.col("file")).alias("line"))
        else:
            lines = human_lines(problems.join(docs, "doc_id")).orderBy("pos").select("doc_id", "pos", "line")
        order = [c for c in ("doc_id", "pos") if c in lines.columns]
        for row in lines.orderBy(*order).toLocalIterator():
            print(row["line"])
        return max(code, int(bad))
    column = {"parse": lambda: engine.ast_json(docs, file="file", column="out"), "transform": lambda: engine.renderable_json(docs, column="out"), "render": lambda: engine.render(docs, html="out")}[command]()
    for row in column.orderBy("doc_id").toLocalIterator():
        sys.stdout.write(row["out"] + ("" if command == "render" else "\n"))
    return code


def formats(done: DataFrame, args: argparse.Namespace) -> int:
    code = 0
    for row in done.orderBy("doc_id").toLocalIterator():
        text, changed, settled = row["formatted"]
        if not settled:
            report("fmt", f"{row['file']}: still changing after the allowed passes; the formatter does not settle on this document")
            code = 2
        elif args.check:
            if changed:
                sys.stdout.write(unified_diff(row["file"], row["source"], text))
                code = max(code, 1)
        elif not args.write:
            sys.stdout.write(text)
        elif not args.paths:
            report("fmt", "<stdin>: --write needs a file; stdin has nowhere to be written back to")
            code = 2
        elif changed:
            with open(row["file"], "w", encoding="utf-8", newline="") as f:
                f.write(text)
    return code


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
