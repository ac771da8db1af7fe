"""Command line: train a model from a file, score a file, or check it for drift."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skylag.operators.drift import DriftMonitor
from skylag.plans import jobs
from skylag.sources.files import read_flights
from skylag.sources.scratch import clear
from skylag.sources.session import tune


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skylag", description=__doc__)
    parser.add_argument("--scratch", help="shared folder for intermediate tables; needed on a cluster")
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="fit and save a model")
    train.add_argument("--data-path", required=True)
    train.add_argument("--model-dir", required=True)
    train.add_argument("--validation-fraction", type=float, default=0.0)
    train.add_argument("--zero-label", action="store_true", help="label 0 when no delay column exists")
    score = commands.add_parser("score", help="score flights into a prediction log")
    score.add_argument("--data-path", required=True)
    score.add_argument("--model-dir", required=True)
    score.add_argument("--log-root", required=True)
    score.add_argument("--rejected-path")
    drift = commands.add_parser("drift", help="compare flights with the stored baseline")
    drift.add_argument("--data-path", required=True)
    drift.add_argument("--monitor-dir", required=True)
    args = parser.parse_args(argv)

    builder = SparkSession.builder.appName("skylag")
    if args.scratch:
        builder = builder.config("spark.checkpoint.dir", args.scratch)
    spark = tune(builder.getOrCreate())
    try:
        if args.command == "train":
            _, metrics = jobs.train_file(
                spark,
                args.data_path,
                args.model_dir,
                validation_fraction=args.validation_fraction,
                zero_if_unknown=args.zero_label,
            )
            metrics.show(truncate=False)
        elif args.command == "score":
            print(jobs.score_to_log(spark, args.data_path, args.model_dir, args.log_root, args.rejected_path))
        else:
            tests, summary = DriftMonitor(spark, args.monitor_dir).run(read_flights(spark, args.data_path))
            tests.show(truncate=False)
            summary.show(truncate=False)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()
