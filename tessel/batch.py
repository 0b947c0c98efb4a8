"""The batch job: a vendor's file matched against a catalog, with a report.

    python -m tessel.batch --vendor vendor.csv --catalog catalog.csv --output out
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import Row, SparkSession

from .operators import blocking
from .plans import cascade, report
from .sources import catalog
from .storage import written


def kind_of(path: str) -> str:
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return end if end in ("csv", "json", "parquet", "orc", "xlsx") else "parquet"


def run(spark: SparkSession, vendor: str, items: str, output: str, foreign: bool = False, limit: int = 0, parts: int = 0, flow: cascade.Flow = cascade.BATCH, reranker=None) -> Row:
    """Matches the vendor's file and writes the report: a workbook if the output ends in .xlsx, else folders of the sheets, and with parts of all rows too. Returns the sums of the run."""
    start = time.perf_counter()
    read = catalog.read_foreign_catalog if foreign else catalog.read_catalog
    known = written(blocking.prepared(read(spark, items, kind_of(items))), "catalog")
    asked = written(catalog.read_vendor(spark, vendor, kind_of(vendor), limit), "vendor")
    rows = written(report.report(asked, cascade.run(asked, known, flow, reranker)), "report")
    if output.endswith(".xlsx"):
        report.write_workbook(rows, output)
    else:
        report.write_sheets(rows, output)
        if parts:
            report.write_parts(rows, parts, f"{output}/parts")
    sums = report.summary(rows, time.perf_counter() - start).first()
    return Row(**sums.asDict(), **report.histogram(rows).first().asDict())


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Match a vendor's product list with a catalog.")
    p.add_argument("--vendor", required=True, help="csv, xlsx, json or parquet: name, and if known code, pack, compname")
    p.add_argument("--catalog", required=True, help="the same kinds: code, name, compname, pack, strength")
    p.add_argument("--output", required=True, help="folder, or a file that ends in .xlsx")
    p.add_argument("--foreign", action="store_true", help="the catalog has foreign headers and no codes")
    p.add_argument("--limit", type=int, default=0, help="first rows of the vendor's file alone; 0: all")
    p.add_argument("--parts", type=int, default=0, help="also write the report's rows in so many parts")
    p.add_argument("--flow", choices=sorted(cascade.FLOWS), default="batch")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessel batch").getOrCreate()
    for name, value in run(spark, a.vendor, a.catalog, a.output, a.foreign, a.limit, a.parts, cascade.FLOWS[a.flow]).asDict().items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
