"""python -m sparkmend repair IN OUT: repairs a knowledge base of four CSV files (people, places, events, relationships) and writes what came of it."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from sparkmend.plans import kb, kb_quality
from sparkmend.session import session


def main() -> None:
    parser = argparse.ArgumentParser(prog="sparkmend")
    parser.add_argument("command", choices=["repair"])
    parser.add_argument("source", help="folder of people.csv, places.csv, events.csv and relationships.csv")
    parser.add_argument("out", help="folder to write to")
    parser.add_argument("--shared", help="folder that driver and executors share, for tables in between (default: OUT/_shared)")
    args = parser.parse_args()
    spark = session(shared=args.shared or f"{args.out}/_shared")
    tables = {t: spark.read.csv(f"{args.source}/{t}.csv", header=True).select(*kb.SCHEMAS[t]).withColumn("pos", F.monotonically_increasing_id()) for t in kb.SCHEMAS}
    kb_quality.export(kb.repair(**tables), tables, args.out)


if __name__ == "__main__":
    main()
