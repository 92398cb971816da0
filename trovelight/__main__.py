"""Command line: ingest, search, ask, chat, eval, bench."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from trovelight.functions.models import HttpModel
from trovelight.plans.engine import Engine
from trovelight.plans.evaluate import ann_bench, evaluate, read_cases


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trovelight")
    parser.add_argument("--index", default=".trovelight")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "eval"):
        commands.add_parser(name).add_argument("path")
    for name in ("search", "ask"):
        commands.add_parser(name).add_argument("words", nargs="+")
    commands.add_parser("chat")
    commands.add_parser("bench").add_argument("n", nargs="?", type=int, default=5000)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("trovelight").getOrCreate()
    model = HttpModel()
    engine = Engine(spark, args.index, model=model if model.available() else None)
    try:
        if args.command == "ingest":
            n, failed = engine.ingest(args.path)
            for r in failed.toLocalIterator():
                print(f"skipped {r['source']}: {r['error']}", file=sys.stderr)
            print(f"{n} chunks in {args.index}")
        elif args.command == "search":
            for r in engine.search(" ".join(args.words)).orderBy("rank").toLocalIterator():
                print(f"\n{r['head']}\n{r['body']}")
        elif args.command == "ask":
            _print(engine.ask(" ".join(args.words)))
        elif args.command == "chat":
            for said in engine.chat(sys.stdin):
                _print(said)
        elif args.command == "eval":
            for df in evaluate(engine.retriever(), read_cases(spark, args.path)):
                df.show(truncate=False)
        else:
            ann_bench(spark, args.n).show(truncate=False)
    except (FileNotFoundError, RuntimeError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _print(said: dict) -> None:
    print(said["answer"])
    for n, name in said["cited"]:
        print(f"[{n}] {name}")


if __name__ == "__main__":
    sys.exit(main())
