"""Report tables: the latest reports and the history of all of them.

A history is a folder of batches and claims. An append writes its rows as a batch of its own, which nobody reads yet, and then claims the next
version of the history with one small file that appears whole or not at all; of two writers one gets it, and the other numbers its rows anew.
Readers take the batches that have a claim. So numbers are never given twice, and a job that ends early leaves nothing that can be seen.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard import rules
from spanguard.functions import text
from spanguard.operators.findings import SCAN_KEYS
from spanguard.operators.position import with_position
from spanguard.operators.reports import REPORT_SCHEMA, report_json
from spanguard.session import cut

KEYS = list(SCAN_KEYS)
CORRUPT = "_corrupt"


def write_latest_reports(reports: DataFrame, path: str) -> None:
    """Replace the latest reports of the repositories present; others keep theirs."""
    (
        reports.withColumn("report_json", report_json(F.col("report"))).drop("report")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist a derived table (dashboard, guidance, summary) under its own path."""
    df.write.mode("overwrite").format(fmt).save(path)


def content_hash(report: Column) -> Column:
    """SHA-256 of the report in its fixed field order."""
    return F.sha2(report_json(report), 256)


def report_hashes(reports: DataFrame) -> DataFrame:
    """One hash per report over the hashes of its pages (one page per `report_page_size` findings)."""
    hashed = reports.select(*KEYS, "page", content_hash(F.col("report")).alias("_h"))
    pages = hashed.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("page", "_h"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda p: p["_h"]), "")
    return pages.select(*KEYS, F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["_h"])
                        .otherwise(F.sha2(joined, 256)).alias("content_hash"))


def content_anti_join(new: DataFrame, history: DataFrame) -> DataFrame:
    """The reports whose content is not in the history yet."""
    return new.join(history.select("repo", "content_hash").distinct(), ["repo", "content_hash"], "left_anti")


def next_numbers(new: DataFrame, history: DataFrame) -> DataFrame:
    """Number new reports of each repository after the highest number in its history."""
    highest = history.groupBy("repo").agg(F.max("scan_no").alias("_max"))
    placed = with_position(new, ["repo"], [F.col("scan_id"), F.col("content_hash")], "_pos")
    return placed.join(highest, "repo", "left").select(
        *new.columns, (F.coalesce("_max", F.lit(0)) + F.col("_pos") + 1).cast("bigint").alias("scan_no")
    )


def numbered_rows(reports: DataFrame, history: DataFrame, moment: Column | None = None) -> DataFrame:
    """The rows that an append of these reports to this history stores."""
    hashes = report_hashes(reports)
    first = hashes.groupBy("repo", "content_hash").agg(F.min("scan_id").alias("scan_id"))  # of equal reports in one batch
    numbered = next_numbers(content_anti_join(first.select(*hashes.columns), history), history)
    stamp = F.current_timestamp() if moment is None else moment
    return reports.join(numbered, KEYS).select(
        *KEYS, "scan_no", "page", "page_count", stamp.alias("stored_at"), "content_hash",
        F.format_string("Report_%03d_%s", "scan_no", F.date_format(stamp, "yyyy-MM-dd_HH-mm-ss")).alias("name"),
        report_json(F.col("report")).alias("report_json"),
    )


def append_history(reports: DataFrame, path: str, moment: Column | None = None, tries: int = 20) -> DataFrame:
    """Append the reports that are new, with number and time stamp; gives the rows written.

    Running it again with the same reports appends nothing, and of equal reports of a repository in one call the first is stored.
    A batch that loses its version to another writer stays behind without a claim; the next try looks at the winner's rows, too.
    """
    spark = reports.sparkSession
    for _ in range(tries):
        claims = read_claims(spark, path)
        version = claims.agg(F.max("version")).first()[0] or 0
        written = cut(numbered_rows(reports, claimed_rows(spark, path, claims), moment))
        if written.isEmpty():
            return written
        batch = uuid.uuid4().hex
        written.write.partitionBy("repo").parquet(f"{path}/batches/batch={batch}")
        if claim_version(spark, path, version + 1, batch):
            return written
    raise RuntimeError(f"no version of the history {path} could be claimed in {tries} tries")


def claim_version(spark: SparkSession, path: str, version: int, batch: str) -> bool:
    """Give a version of the history to a batch; False if it has been given already.

    The claim is written beside its place and moved there whole, by a link on a mounted folder and by a rename that never overwrites on other
    file systems. A store without such a rename needs one writer at a time.
    """
    java, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = java.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/claims")
    files = folder.getFileSystem(conf)
    files.mkdirs(folder)
    draft, place = hadoop.Path(folder, f"_{batch}"), hadoop.Path(folder, f"{version:012d}")
    stream = files.create(draft, False)
    stream.write(bytearray(batch.encode()))
    stream.close()
    moved = _linked if files.getUri().getScheme() == "file" else _renamed
    done = moved(spark, draft, place)
    files.delete(draft, False)
    return done


def _linked(spark: SparkSession, draft, place) -> bool:
    try:
        os.link(draft.toUri().getPath(), place.toUri().getPath())
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, draft, place) -> bool:
    from py4j.protocol import Py4JJavaError

    gateway = spark.sparkContext._gateway
    hadoop = gateway.jvm.org.apache.hadoop.fs
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, place, options)
    except Py4JJavaError as exc:
        if "FileAlreadyExistsException" not in exc.java_exception.getClass().getName():
            raise
        return False
    return True


HISTORY_SCHEMA = (
    "scan_id bigint, scan_no bigint, page bigint, page_count bigint, stored_at timestamp, "
    "content_hash string, name string, report_json string, repo string"
)


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """version and batch of every claim, as of now; none when nothing was stored yet."""
    return _or_empty(spark, "version bigint, batch string", lambda: spark.read.text(f"{path}/claims").select(
        F.col("_metadata.file_name").cast("bigint").alias("version"), F.col("value").alias("batch")))


def claimed_rows(spark: SparkSession, path: str, claims: DataFrame) -> DataFrame:
    """The rows of the claimed batches. Files are listed here, after those of the claims, so a claimed batch is there in full."""
    schema = f"{HISTORY_SCHEMA}, batch string"
    rows = _or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(f"{path}/batches"))
    return rows.join(claims.select("batch"), "batch", "left_semi").drop("batch")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history table; empty when nothing was stored yet."""
    return claimed_rows(spark, path, read_claims(spark, path))


def parse_reports(history: DataFrame) -> DataFrame:
    """Report texts as structs; `readable` is false for corrupt or missing ones, fields are NULL."""
    schema = f"{REPORT_SCHEMA}, {CORRUPT} string"
    parsed = F.from_json("report_json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    opened = history.withColumn("report", parsed)
    readable = F.col("report").isNotNull() & F.col(f"report.{CORRUPT}").isNull()
    return opened.withColumn("readable", readable)


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON report files of any origin, one per file, as report structs with `readable`."""
    texts = spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "report_json")
    return parse_reports(texts.withColumn("source_file", F.input_file_name()))


def history_headers(history: DataFrame) -> DataFrame:
    """One row per stored report with its totals, for ranking and trends."""
    first = parse_reports(history.where(F.col("page") == 0))
    return first.select(
        *KEYS, "scan_no", "name", "stored_at", "readable",
        F.coalesce("report.scan.finished_at", "report.scan.started_at").alias("report_time"),
        F.coalesce("report.summary.total_findings", F.lit(0)).alias("total_findings"),
        F.coalesce("report.summary.risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("report.summary.pipeline_status", F.lit("UNKNOWN")).alias("pipeline_status"),
    )


def history_index(headers: DataFrame) -> DataFrame:
    """Every stored report: number, date, status and its tone. Sort by repo and scan_no to show it."""
    return headers.select(
        "repo", "scan_no", F.format_string("%03d", "scan_no").alias("report_number"),
        text.format_report_date(F.col("report_time")).alias("report_date"), "pipeline_status",
        text.status_tone(F.col("pipeline_status")).alias("tone"),
    )


def recent_reports(headers: DataFrame, limit: int = rules.RECENT_REPORTS) -> DataFrame:
    """The newest reports of each repository."""
    newest = Window.partitionBy("repo").orderBy(F.col("scan_no").desc())
    return headers.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def latest_previous_report(headers: DataFrame) -> DataFrame:
    """The last stored report of each repository."""
    return recent_reports(headers, 1).drop("rank")
