"""Command line: ``python -m lexloom COMMAND`` reads a JSON object and prints one.

Exit status 2 with the usage for no or an unknown command, 1 with ``{"error": ...}`` for input that can't be used.
"""

from __future__ import annotations

import json
import sys

from .plans.requests import COMMANDS, RequestError, run


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print("usage: python -m lexloom COMMAND\ncommands: " + " ".join(COMMANDS), file=sys.stderr)
        return 2
    try:
        payload = json.loads(sys.stdin.read())
    except ValueError as e:
        print(json.dumps({"error": f"invalid JSON: {e}"}))
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lexloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(json.dumps(run(spark, args[0], payload), ensure_ascii=False))
    except RequestError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
