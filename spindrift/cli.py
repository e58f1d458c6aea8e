"""``python -m spindrift.cli BASE COMMAND …``: look into tables below a folder, move them, or run a search."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spindrift.operators import index, search, store
from spindrift.operators.job import Job
from spindrift.sources.tables import current, pages, table


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("base")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("tables")
    for name, rest in (("count", ()), ("get", ("key",)), ("scan", ()), ("rename", ("new",)), ("delete", ()), ("compact", ("new",))):
        command = commands.add_parser(name)
        command.add_argument("table")
        for argument in rest:
            command.add_argument(argument)
        command.add_argument("--key", dest="column", default="id")
        command.add_argument("--from", dest="start")
        command.add_argument("--to", dest="end")
        command.add_argument("--limit", type=int, default=10)
    commands.add_parser("search").add_argument("terms", nargs="+")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    job, at = Job(), lambda name: f"{args.base}/{name}.parquet"

    def show(df) -> None:
        for row in df.toJSON().collect():
            job.output(row + "\n")

    if args.command == "tables":
        job.output("".join(f"{t.removesuffix('.parquet')}\n" for t in store.tables(spark, args.base)))
    elif args.command == "count":
        job.output(f"{table(spark, args.base, args.table).count()}\n")
    elif args.command == "get":
        show(store.get_row(table(spark, args.base, args.table), args.key, args.column).limit(args.limit))
    elif args.command == "scan":
        show(store.scan(table(spark, args.base, args.table), args.start, args.end, args.column).limit(args.limit))
    elif args.command == "rename":
        store.rename(spark, at(args.table), at(args.new))
    elif args.command == "delete":
        job.output(f"{store.delete(spark, at(args.table))}\n")
    elif args.command == "compact":
        current(table(spark, args.base, args.table), args.column).write.mode("errorifexists").parquet(at(args.new))
    else:
        own = pages(spark, args.base, "page").where("page IS NOT NULL").withColumnRenamed("id", "url")
        show(search.search(index.positions(own), index.word_counts(own), " ".join(args.terms)))
    return job.answer()


if __name__ == "__main__":
    print(main(), end="")
