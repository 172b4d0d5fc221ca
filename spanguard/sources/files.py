"""Files of source trees as documents.

Spark's own file listing hides names that start with `.` or `_`, so the trees are walked in tasks: a task opens folders from a root on until it
has seen `FOLDER_SHARE` entries, and hands the folders left over back to be spread over all tasks for the next round. The driver opens none.
The walk yields metadata only; extension, directory and size tests come before any content is read. Then the file names, not the contents, are
spread over the cluster and each task reads its own files. The trees must be on a mount that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanguard.functions import paths
from spanguard.options import DEFAULT_OPTIONS, ScanOptions
from spanguard.session import cut, ship_package

ROOT_SCHEMA = "repo string, scan_id bigint, directory string"
#: bytes of content handed over in one batch
BATCH_BYTES = 32 * 1024 * 1024
#: entries after which a task hands the folders it has not opened to others
FOLDER_SHARE = 20_000

Roots = DataFrame | Sequence[tuple[str, int, str]]


def folder_opener(extensions: Sequence[str], excluded: Sequence[str], share: int):
    """A batch function from (repo, scan_id, root, folder) to the files in scope and the folders left over; a missing folder gives none."""
    def opened(start: str) -> Iterator[tuple[str, int | None, bool]]:
        stack, seen = [start], 0
        while stack and seen < share:
            try:
                with os.scandir(stack.pop()) as entries:
                    found = sorted(entries, key=lambda e: e.name)
            except OSError:
                continue
            seen += len(found) + 1
            for entry in found:
                if entry.is_dir():
                    if not entry.is_symlink() and entry.name not in excluded:
                        stack.append(entry.path)
                elif os.path.splitext(entry.name)[1].lower() in extensions:
                    try:
                        yield entry.path, entry.stat().st_size, False
                    except OSError:
                        yield entry.path, None, False
        for folder in stack:
            yield folder, None, True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                root = os.path.realpath(os.path.expanduser(row.root))
                rows = [(row.repo, row.scan_id, root, *x) for x in opened(row.folder if isinstance(row.folder, str) else root)]
                if rows:
                    out = pd.DataFrame(rows, columns=["repo", "scan_id", "root", "absolute_path", "size_bytes", "is_folder"])
                    yield out.assign(size_bytes=out["size_bytes"].astype("Int64"))

    return run


def list_repo_files(
    spark: SparkSession, roots: Roots, options: ScanOptions = DEFAULT_OPTIONS, share: int = FOLDER_SHARE
) -> DataFrame:
    """Metadata of the in-scope files below roots (repo, scan_id, directory); a missing or null root gives none."""
    ship_package(spark)
    table = roots if isinstance(roots, DataFrame) else spark.createDataFrame(list(roots), ROOT_SCHEMA)
    extensions = tuple(e.lower() for e in options.supported_extensions)
    run = folder_opener(extensions, tuple(options.excluded_directories), share)
    todo = table.where(F.col("directory").isNotNull()).select(
        "repo", F.col("scan_id").cast("bigint").alias("scan_id"), F.col("directory").alias("root"), F.lit(None).cast("string").alias("folder"))
    schema = "repo string, scan_id bigint, root string, absolute_path string, size_bytes bigint, is_folder boolean"
    found = None
    while True:
        spread = todo.repartition(spark.sparkContext.defaultParallelism, "root", "folder")
        level = cut(spread.mapInPandas(run, schema))  # a lost executor must not open folders at another time
        files = level.where(~F.col("is_folder"))
        found = files if found is None else found.unionByName(files)
        todo = level.where("is_folder").select("repo", "scan_id", "root", F.col("absolute_path").alias("folder"))
        if todo.isEmpty():
            break
    inside = F.expr("substring(absolute_path, if(endswith(root, '/'), length(root) + 1, length(root) + 2))")
    listed = found.select("repo", "scan_id", "absolute_path", inside.alias("relative_path"), "size_bytes")
    return listed.withColumn("extension", paths.extension(F.col("relative_path")))


def content_reader(limit: int):
    """A batch function that adds `content`, None for files above the limit or not readable.

    Batches are cut by bytes, not by rows.
    """
    def content_of(path: str, size) -> bytes | None:
        if pd.isna(size) or size > limit:
            return None
        try:
            with open(path, "rb") as handle:
                return handle.read()
        except OSError:
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                content = content_of(row.absolute_path, row.size_bytes)
                rows.append((*row, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*batch.columns, "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[*batch.columns, "content"])

    return read


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; CRLF and CR become LF."""
    as_utf8 = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(decoded, F.lit("\r\n?"), F.lit("\n"))


def read_repo_files(
    spark: SparkSession,
    roots: Roots,
    options: ScanOptions = DEFAULT_OPTIONS,
    tasks: int | None = None,
) -> DataFrame:
    """All candidate files with their text; `text` is NULL for skipped ones (too large, unreadable)."""
    listed = list_repo_files(spark, roots, options)
    spread = listed.repartition(tasks or spark.sparkContext.defaultParallelism, "absolute_path")
    schema = T.StructType([*spread.schema.fields, T.StructField("content", T.BinaryType())])
    read = spread.mapInPandas(content_reader(options.max_file_size_bytes), schema)
    return read.select(*spread.columns, decode_text(F.col("content")).alias("text"))


def scan_documents_with_content(files: DataFrame) -> DataFrame:
    """The files that could be read, as documents."""
    return files.where(F.col("text").isNotNull()).select(
        "repo", "scan_id", "relative_path", "extension", "size_bytes", "text"
    )
