"""Command line: ``python -m siftline offline|round|train|sample-data``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import det
from .plans.config import load_yaml, preset
from .plans.pipeline import SelectionPipeline
from .sources import readers, sinks


def simulated(seed: int):
    """Feedback of a dry run: Beta(2, 5) errors."""
    return lambda picked: picked.select("id", det.beta(F.lit(2.0), F.lit(5.0), seed, 0, F.col("id")).alias("error"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siftline")
    parser.add_argument("command", choices=["offline", "round", "train", "sample-data"])
    parser.add_argument("--folder", required=True, help="state of the pipeline, or the output of sample-data")
    parser.add_argument("--input", help="samples (offline)")
    parser.add_argument("--preset", default="default")
    parser.add_argument("--config", help="a YAML file over the preset")
    parser.add_argument("--set", nargs="*", default=[], metavar="a.b=value")
    parser.add_argument("--rounds", type=int, default=1, help="number of rounds (train), or of the round (round)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("siftline").getOrCreate()
    config = preset(args.preset, load_yaml(args.config) if args.config else None, args.set)
    if args.command == "sample-data":
        sinks.write_jsonl(readers.sample_data(spark, seed=config["seed"]), args.folder)
        return
    pipeline = SelectionPipeline(spark, args.folder, config)
    if args.command == "offline":
        pipeline.run_offline(args.input)
    elif args.command == "round":
        pipeline.run_online_round(args.rounds).show()
    else:
        pipeline.train(args.rounds, simulated(config["seed"])).show()


if __name__ == "__main__":
    main()
