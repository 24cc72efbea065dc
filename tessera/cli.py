"""Command line: show-config, doctor, sft, grpo, generate-sft, generate-grpo."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from tessera import __version__
from tessera import config as cf

TRAINING, GENERATION = ("sft", "grpo"), ("generate-sft", "generate-grpo")


def _named(spec: str):
    """The object that module:name stands for."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Curate, quota-balance and score text-task corpora on Spark.")
    top.add_argument("--version", action="version", version=f"tessera {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    where = {"help": "TOML configuration; configs/<stage>.toml unless given"}
    for name, stages, said in (("show-config", list(cf.STAGES), "print a resolved configuration"), ("doctor", list(TRAINING), "read-only checks of a training stage")):
        p = commands.add_parser(name, help=said)
        p.add_argument("--stage", choices=stages, required=True)
        p.add_argument("--config", **where)
        if name == "doctor":
            p.add_argument("--login", help="module:function that says who is logged in")
    for name in (*TRAINING, *GENERATION):
        said = "hand a stage's tables to a trainer" if name in TRAINING else "fill the quotas of a stage and write its projection"
        p = commands.add_parser(name, help=said)
        p.add_argument("--config", **where)
        p.add_argument("--push", action=argparse.BooleanOptionalAction, default=None)
        if name in TRAINING:
            p.add_argument("--trainer", required=True, help="module:function that trains")
            p.add_argument("--resume", help="none, auto or a checkpoint folder")
            p.add_argument("--smoke-test", action="store_true", help="few rows, one step, a folder of its own, no publication")
        else:
            p.add_argument("--input", required=True, help="raw corpus that Spark can read, or the data set's name with --fetch")
            p.add_argument("--fetch", help="module:function that answers requests of a remote corpus")
            p.add_argument("--format", default="parquet")
            p.add_argument("--identity", default="id", help="column that names a raw row")
            p.add_argument("--provider", required=True, help="module:function that drafts and reviews a task")
            p.add_argument("--publisher", help="module:object that stages and publishes files")
            p.add_argument("--login", help="module:function that says who is logged in")
            p.add_argument("--tasks", type=int, default=1, help="Spark tasks that a batch of calls is dealt to")
            p.add_argument("--overplan", action="store_true", help="plan attempts by the acceptance rate so far")
            p.add_argument("--rate", type=float, help="calls a second that all tasks together may start")
    return top


def show(value) -> None:
    print(json.dumps(value, indent=2, sort_keys=True, default=str))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        stage = getattr(args, "stage", args.command)
        config = cf.load(stage, args.config or f"configs/{stage.replace('-', '_')}.toml")
        if args.command == "show-config":
            show(config)
            return 0
        from pyspark.sql import SparkSession

        from tessera import jobs
        from tessera.sources import corpus, remote

        spark = SparkSession.builder.appName("tessera").getOrCreate()
        if args.command == "doctor":
            result = jobs.doctor(spark, stage, config, _named(args.login) if args.login else None)
            show(result)
            return 0 if result["passed"] else 1
        if args.command in TRAINING:
            config = cf.with_overrides(config, resume=args.resume, push=args.push, smoke=args.smoke_test)
            show(jobs.run_training(spark, stage, config, _named(args.trainer), smoke=args.smoke_test))
            return 0
        config = cf.with_overrides(config, push=args.push)
        if args.fetch:
            source = config["source"]
            raw = remote.read_corpus(spark, _named(args.fetch), args.input, split=source["split"])
        else:
            raw = corpus.scan(spark, args.input, args.format)
        publisher, login = (_named(spec) if spec else None for spec in (args.publisher, args.login))
        spread = {"tasks": args.tasks, "overplan": args.overplan, "rate": args.rate}
        show(jobs.run_generation(spark, stage, config, raw, args.identity, _named(args.provider), publisher, login, **spread))
        return 0
    except (FileNotFoundError, RuntimeError, TypeError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
