"""Documents from tables, and the file filters on table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions import paths
from spanguard.options import DEFAULT_OPTIONS, ScanOptions

DOC_COLUMNS = ("repo", "scan_id", "relative_path", "extension", "size_bytes", "text")
#: input per task below which a small table is spread over all cores
SMALL_TASK_BYTES = 32 * 1024 * 1024


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that is small against the cluster over all its cores.

    A small file is one row group and so one task. Above the size limit the input has enough row
    groups of its own and is left as it is: texts of a large corpus are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:  # no JVM plan to ask (a remote session)
        return df
    return df.repartition(cores, *keys) if size < cores * SMALL_TASK_BYTES else df


def load_documents(
    table: DataFrame,
    repo: Column,
    scan_id: Column,
    relative_path: Column,
    text: Column,
    size_bytes: Column | None = None,
) -> DataFrame:
    """Any table as documents. The columns are projections of it, so pruning reaches the scan."""
    path = paths.normalise_path(relative_path)
    size = F.octet_length(text) if size_bytes is None else size_bytes
    return table.select(
        repo.cast("string").alias("repo"),
        scan_id.cast("bigint").alias("scan_id"),
        path.alias("relative_path"),
        paths.extension(path).alias("extension"),
        size.cast("bigint").alias("size_bytes"),
        text.alias("text"),
    )


def with_extension_filter(files: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    wanted = [e.lower() for e in options.supported_extensions]
    return files.where(F.lower("extension").isin(*wanted))


def with_directory_exclusion(files: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    return files.where(~paths.in_excluded_directory(F.col("relative_path"), options.excluded_directories))


def with_size_limit(files: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    return files.where(F.col("size_bytes") <= options.max_file_size_bytes)


def in_scope(files: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Files the scan reads: extension, directory and size."""
    return with_size_limit(with_directory_exclusion(with_extension_filter(files, options), options), options)
