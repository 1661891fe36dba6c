"""python -m windrow CONFIG MESSAGES RESULTS STATE: run a configuration's queries over message files until all are read.

All four are paths that Spark can read or write; MESSAGES holds JSON lines, or push envelopes with --push.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from windrow.config import load_config
from windrow.streaming.engine import finish, message_stream, run_config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="windrow", description=__doc__)
    for name in ("config", "messages", "results", "state"):
        parser.add_argument(name)
    parser.add_argument("--push", action="store_true", help="messages are push envelopes")
    parser.add_argument("--files-per-trigger", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    messages = message_stream(spark, args.messages, args.files_per_trigger, args.push)
    finish(run_config(spark, load_config(spark, args.config), messages, args.results, args.state))


if __name__ == "__main__":
    main()
