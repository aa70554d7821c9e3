"""The N best items of every group, by skipping row groups whose statistics rule them out.

The table is written once, clustered: ranges of (group, score, key), sorted
within each file.  A group of millions of items then fills row groups, and
even files, of its own, best items first; thousands of small groups share one.
Reading goes by the row groups' statistics in the file footers.  Among the row
groups that hold a single group, those whose best score is strictly worse than
a bound on that group's N-th score are never read; the rest are read in order
of their best score, and skipped as soon as the N-th score found so far is
strictly better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path

#: Rows of a file: the least, the most, and the number of files from which they grow.
FILE_ROWS, FILE_ROWS_MOST, FILES = 250_000, 5_000_000, 10_000
#: A row group ends after so many bytes in memory for each row of a file; small enough to be worth skipping, large enough to be worth reading.
ROW_GROUP_BYTES_A_ROW = 2
#: Tasks that read; tiny descriptions of row groups say nothing about the work, so their number is set.
TASKS_MOST = 20_000


@dataclass(frozen=True)
class Clustered:
    """A table clustered by group and score at ``location``; the lowest ``score`` is the best."""

    spark: SparkSession
    location: str
    group: tuple[str, ...]
    score: str
    key: str


def cluster(df: DataFrame, group: list[str], score: str, key: str, file_rows: int | None = None) -> Clustered:
    """Write ``(group, score, key)`` of ``df`` in clustered form; rows that repeat all of them are written once.

    Rows with a null group column, key or score and rows with a NaN score take
    no part.  Infinite scores count as they are.
    """
    spark = df.sparkSession
    order = [*group, score, key]
    rows = df.select(*order).dropna(subset=order)
    rows = rows.where(~F.isnan(F.col(score).cast("double")))
    n = rows.count()
    file_rows = file_rows or min(max(FILE_ROWS, n // FILES), FILE_ROWS_MOST)
    files = max(1, -(-n // file_rows))
    location = new_path(spark, "clustered")
    # Range partitions keep equal rows together, so repeats fall out without a shuffle of their own.
    spread = rows.repartitionByRange(files, *order).dropDuplicates(order).sortWithinPartitions(*order)
    spread.write.option("parquet.block.size", max(1 << 19, ROW_GROUP_BYTES_A_ROW * file_rows)).option("compression", "snappy").parquet(location)
    return Clustered(spark, location, tuple(group), score, key)


def _open(path: str):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    # Spark's names of paths, as Arrow knows them.
    path = path.replace("s3a://", "s3://", 1).replace("file:///", "file:/", 1).replace("file:/", "file:///", 1)
    where, at = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(where.open_input_file(at))


def _files(table: Clustered) -> DataFrame:
    return table.spark.read.parquet(table.location).select(F.input_file_name().alias("file")).distinct()


def row_groups(table: Clustered) -> DataFrame:
    """The statistics of every row group: ``(file, row_group, n, single, best, worst, group...)``.

    ``single``: all its rows are of the one group named in the group columns.
    """
    names = [*table.group]
    kinds = dict(table.spark.read.parquet(table.location).dtypes)
    group, score = table.group, table.score

    def footers(batches):
        for pdf in batches:
            rows = []
            for path in pdf["file"]:
                meta = _open(path).metadata
                for i in range(meta.num_row_groups):
                    rg = meta.row_group(i)
                    stats = {rg.column(j).path_in_schema: rg.column(j).statistics for j in range(rg.num_columns)}
                    known = all(stats[c] is not None and stats[c].has_min_max for c in (*group, score))
                    single = known and all(stats[c].min == stats[c].max for c in group)
                    best, worst = (float(stats[score].min), float(stats[score].max)) if known else (-np.inf, np.inf)
                    rows.append((path, i, rg.num_rows, single, best, worst, *[stats[c].min if single else None for c in group]))
            yield pd.DataFrame(rows, columns=["file", "row_group", "n", "single", "best", "worst", *group])

    schema = "file string, row_group int, n bigint, single boolean, best double, worst double, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    files = _files(table)
    return files.repartition(min(max(1, files.count()), TASKS_MOST), "file").mapInPandas(footers, schema)


def to_read(table: Clustered, n: int) -> DataFrame:
    """The row groups that the statistics alone can't rule out: ``(file, row_group, best, single)``.

    The worst score of a row group of at least ``n`` items of one group bounds
    that group's N-th score from above.
    """
    stats = cut(row_groups(table))  # one short row a row group
    whole = stats.where(F.col("single") & (F.col("n") >= n))
    bound = whole.groupBy(*table.group).agg(F.min("worst").alias("_bound"))
    names = {c: f"_b_{c}" for c in table.group}
    bound = bound.select(*[F.col(c).alias(names[c]) for c in table.group], "_bound")
    on = F.col("single")
    for c in table.group:
        on = on & (F.col(c) == F.col(names[c]))
    return stats.join(bound, on, "left").where("_bound is null or best <= _bound").select("file", "row_group", "best", "single")


def skipped(table: Clustered, n: int) -> DataFrame:
    """One row: how many row groups and rows there are, how many row groups hold one group only, and what the statistics alone rule out for the best ``n``."""
    every = row_groups(table).agg(F.count("*").alias("n_row_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("single"), 1)).alias("n_single"))
    read = row_groups(table).select("file", "row_group", "n").join(to_read(table, n).select("file", "row_group"), ["file", "row_group"], "left_semi")
    left = read.agg(F.count("*").alias("_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"))
    return every.crossJoin(left).select("n_row_groups", "n_rows", "n_single", (F.col("n_row_groups") - F.col("_groups")).alias("n_ruled_out"), (F.col("n_rows") - F.col("_rows")).alias("n_rows_ruled_out"))  # one row each


def top_n(table: Clustered, n: int) -> DataFrame:
    """The ``n`` items of each group with the lowest score, equal scores by the lower key: ``(group..., score, key, rank)``.

    Groups with fewer items give them all.  An empty table gives an empty
    result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    group, score, key = list(table.group), table.score, table.key
    order = [*group, score, key]
    kinds = dict(table.spark.read.parquet(table.location).dtypes)

    def read(batches):
        path, source, nth = None, None, {}
        for pdf in batches:
            for file, i, best, single in zip(pdf["file"], pdf["row_group"], pdf["best"], pdf["single"], strict=True):
                if file != path:
                    path, source, nth = file, _open(file), {}
                name = None
                if single:
                    meta = source.metadata.row_group(i)
                    stats = {meta.column(j).path_in_schema: meta.column(j).statistics for j in range(meta.num_columns)}
                    name = tuple(stats[c].min for c in group)
                    if name in nth and best > nth[name]:
                        continue
                rows = source.read_row_group(i, columns=order)
                columns = [rows.column(g).combine_chunks() for g in group]
                codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
                new = np.r_[True, np.any([k[1:] != k[:-1] for k in codes], axis=0)] if rows.num_rows else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                place = np.arange(rows.num_rows) - np.repeat(begin, np.diff(np.r_[begin, rows.num_rows]))
                # Rows of a file are in order of group, score and key.
                yield rows.take(np.flatnonzero(place < n)).to_pandas()[order]
                if single and rows.num_rows >= n:
                    nth[name] = min(nth.get(name, np.inf), float(rows.column(score)[n - 1].as_py()))

    wanted = cut(to_read(table, n))  # a short row for each row group
    tasks = min(max(1, wanted.select("file").distinct().count()), TASKS_MOST)
    found = wanted.repartition(tasks, "file").sortWithinPartitions("file", "best", "row_group").mapInPandas(read, ", ".join(f"`{c}` {kinds[c]}" for c in order))
    best = Window.partitionBy(*group).orderBy(score, key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
