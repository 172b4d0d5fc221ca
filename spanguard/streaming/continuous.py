"""The batch operators on a stream of documents.

Detection, validation and masking work row by row, so they take a streaming DataFrame as it is; the
counts of each micro-batch are appended to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from spanguard.operators.findings import SCAN_KEYS, find
from spanguard.operators.risk import severity_aggregates
from spanguard.options import DEFAULT_OPTIONS, ScanOptions


def append_findings(
    docs: DataFrame, findings_path: str, counts_path: str, checkpoint: str, options: ScanOptions = DEFAULT_OPTIONS
) -> StreamingQuery:
    """Write the findings of new documents and their counts per scan.

    A batch that is run again after a failure overwrites its own `batch_id` partition, so each
    finding is stored once.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_id", F.lit(batch_id))
        _replace(tagged, findings_path)
        stored = batch.sparkSession.read.schema(tagged.schema).parquet(findings_path).where(F.col("batch_id") == batch_id)
        _replace(stored.groupBy(*SCAN_KEYS, "batch_id").agg(*severity_aggregates()), counts_path)

    return (
        find(docs, options).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
