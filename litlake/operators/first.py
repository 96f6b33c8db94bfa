"""The first rows of a large table that satisfy something costly, without reading all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import cut

PLACE = ("_file", "_row")


def first_of(spark: SparkSession, path: str, n: int, good: Column, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, start: int = 1) -> tuple[DataFrame, int]:
    """The first ``n`` rows for which ``good`` holds after ``prepare``, and how many files were read.

    The order is that of the file names, then of the rows in a file (columns ``_file``, ``_row``), so that the result is the
    same as that of a whole read. Files are read in batches that double, from ``start``: at most about twice as many files as
    needed, in as many jobs as the logarithm of their number; each batch's rows are a written table, so no file is read again.
    ``prepare`` has to treat each row by itself. With too few good rows all files are read and all good rows returned."""
    files = sorted(spark.read.parquet(path).inputFiles())
    found, left, at, size = [], n, 0, start
    while at < len(files) and left > 0:
        some = files[at : at + size]
        rows = spark.read.parquet(*some).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
        best = cut(prepare(rows).where(good).orderBy(*PLACE).limit(left), "first")
        found.append(best)
        left -= best.count()
        at, size = at + len(some), size * 2
    if not found:
        return prepare(spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})).where(good).limit(0), 0
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, at
