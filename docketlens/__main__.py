"""``python -m docketlens --data FOLDER --out FOLDER [--format parquet|json|csv] [--year YEAR]
[--continue-on-error] QUERY...``

Runs queries of the registry and writes one result per query.  Without names all
core queries run.  Years are rows of the tables, not processes: a query covers
whatever years its folder holds; only calendars show one year, which ``--year`` names.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from docketlens.plans import registry


def run(spark: SparkSession, names: list[str], data: str, out: str, kind: str = "parquet", go_on: bool = False) -> dict[str, str]:
    """Write the named queries; returns ``ok`` or the error per name, and stops at the first error unless told to go on."""
    queries, told = registry.queries(), {}
    for name in names or list(queries):
        try:
            writer = queries[name](spark, data).write.mode("overwrite")
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{out}/{name}")
            told[name] = "ok"
        except Exception as error:  # noqa: BLE001 - reported per query
            told[name] = f"{type(error).__name__}: {str(error)[:200]}"
            if not go_on:
                break
    return told


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docketlens", description=__doc__)
    parser.add_argument("queries", nargs="*")
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    parser.add_argument("--year", type=int, help="calendar year of ag4, ag38, jn13 and ch16 to ch18")
    parser.add_argument("--continue-on-error", action="store_true")
    args = parser.parse_args(argv)
    unknown = set(args.queries) - registry.queries().keys()
    if unknown:
        parser.error(f"unknown queries: {', '.join(sorted(unknown))}")
    spark = SparkSession.builder.appName("docketlens").getOrCreate()
    if args.year:
        spark.conf.set("docketlens.year", str(args.year))
    told = run(spark, args.queries, args.data, args.out, args.format, args.continue_on_error)
    for name, state in told.items():
        print(f"{name}: {state}")
    return int(any(state != "ok" for state in told.values()))


if __name__ == "__main__":
    sys.exit(main())
