"""``python -m sparkloom.cli``: rebuild a query's table, verify a stored one or inputs by hash, or list the queries."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    """The command line."""
    p = argparse.ArgumentParser(prog="sparkloom")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--list", action="store_true", help="list the queries and stop")
    mode.add_argument("--check-inputs", metavar="JSON", help="compare files with {path: sha256} and stop; exit 1 if any differs")
    mode.add_argument("--query", help="the query to run")
    mode.add_argument("--verify", help="a query whose stored table is recomputed and compared; exit 1 if any row differs")
    p.add_argument("--data", help="folder of the tables")
    p.add_argument("--out", help="where to write the result; must not exist")
    p.add_argument("--stored", help="the Parquet table that --verify compares with")
    return p


def main(argv: list[str] | None = None) -> int:
    """Run one mode; the exit code is 0 when all is well, 1 when something differs, 2 for missing options."""
    a = parser().parse_args(argv)
    from .plans.catalog import QUERIES

    if a.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    from .sources.files import hash_problems, write

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.check_inputs:
        bad = hash_problems(spark, json.loads(Path(a.check_inputs).read_text())).collect()
        for r in bad:
            print(f"{r.problem}: {r.path}")
        return int(bool(bad))
    if a.verify:
        if not (a.data and a.stored):
            print("--verify needs --data and --stored", file=sys.stderr)
            return 2
        now, then = QUERIES[a.verify](spark, a.data), spark.read.parquet(a.stored)
        if sorted(now.columns) != sorted(then.columns):
            print(f"columns differ: {sorted(now.columns)} now, {sorted(then.columns)} stored")
            return 1
        then = then.select(now.columns)
        lost, new = then.exceptAll(now).count(), now.exceptAll(then).count()
        print(f"{lost} stored rows are not recomputed, {new} recomputed rows are not stored")
        return int(lost + new > 0)
    if not (a.query and a.data and a.out):
        print("--query needs --data and --out", file=sys.stderr)
        return 2
    write(QUERIES[a.query](spark, a.data), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
