"""Python -m acopio QUERY DATA_FOLDER [OUTPUT]; 0 done, 1 no rows, 2 wrong use, 3 failed."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .queries import QUERIES


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(f"{__doc__}\n{' '.join(sorted(QUERIES))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"acopio {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = QUERIES[args[0]](spark, args[1])
        if len(args) == 3:
            out.write.mode("errorifexists").parquet(args[2])
            out = spark.read.parquet(args[2])
        else:
            out.show(20, False)
        return 0 if not out.isEmpty() else 1
    except Exception as error:  # what went wrong is told, and the exit code says so
        print(error, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
