"""Runs an operator over a folder of tables: ``python -m placeloom report|import|books --data DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from placeloom.operators import imports, report
from placeloom.plans.tables import table
from placeloom.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="placeloom", description=__doc__)
    p.add_argument("what", choices=("report", "import", "books"))
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--out", required=True, help="folder for the result")
    p.add_argument("--chain-from", type=int, default=3, help="rows of one phone or name that make a chain")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "import":
        rows = imports.import_rows(table(spark, a.data, "raw_places"), ("place_id", "title", "address", "phone", "website", "categories"), "raw_id")
        rows.drop("records").write.mode("overwrite").parquet(a.out)
        return
    final = report.decorate(table(spark, a.data, "final_filtered"), a.chain_from)
    if a.what == "report":
        files.write_export(report.summary(final, "detected_district", "detected_category_group"), f"{a.out}/summary")
        files.write_export(report.chain_table(final, at_least=a.chain_from), f"{a.out}/chains")
    else:
        files.write_books(files.books(final, "detected_district"), a.out, "book")


if __name__ == "__main__":
    main()
