"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Sums from each length upwards then answer, for every context limit, how many documents
and tokens there are, how many are longer, and how many tokens stay when documents are cut off at the limit.

The sums are made in two levels, within stretches of 1,024 lengths and over the stretches, so that no task
sorts all lengths. Defined results: a null text has no tokens; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanguard.llm.bpe import encoder
from spanguard.llm.common import table
from spanguard.session import cut, ship_package

RANKS = "byte_bpe_50k.tiktoken"
_STRETCH = 1024


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens of every document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            sizes = [len(bpe.encode_packed(x or "")) // 4 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens bigint")


def length_table(lengths: DataFrame) -> DataFrame:
    """A row per length that occurs, with the sums from it upwards and downwards.

    n_docs: documents of this length; docs_from, tokens_from: documents of this length or longer, and their tokens; docs_to: of this
    length or shorter; truncated: tokens of all documents when each is cut off at this length.
    """
    counts = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
                 .withColumn("_stretch", F.floor(F.col("n_tokens") / _STRETCH)))
    tokens = F.col("n_docs") * F.col("n_tokens")
    stretches = counts.groupBy("_stretch").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    later = Window.orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    stretches = stretches.select(
        "_stretch", F.coalesce(F.sum("_docs").over(later), zero).alias("_docs_later"),
        F.coalesce(F.sum("_tokens").over(later), zero).alias("_tokens_later"),
        F.sum("_docs").over(everything).alias("_all_docs"), F.sum("_tokens").over(everything).alias("_all_tokens"))
    up = Window.partitionBy("_stretch").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    df = counts.withColumns({"_d": F.sum("n_docs").over(up), "_t": F.sum(tokens).over(up)}).join(stretches, "_stretch")
    df = df.withColumns({"docs_from": F.col("_d") + F.col("_docs_later"), "tokens_from": F.col("_t") + F.col("_tokens_later")})
    shorter = F.col("_all_tokens") - F.col("tokens_from")
    return df.select("n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("_all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
                     (shorter + F.col("docs_from") * F.col("n_tokens")).alias("truncated"))


def at_limits(lengths: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """For each row of `limits`: documents longer than the limit, tokens kept and tokens cut off.

    What holds for a limit follows from the first length that is longer: `docs_from` of that row is the number of longer documents.
    """
    sizes = cut(length_table(lengths).select("n_tokens", "docs_from", "tokens_from"))
    wanted = limits.select(F.col(limit).cast("bigint").alias("limit")).distinct()
    whole = sizes.agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("n_docs"), F.coalesce(F.max("tokens_from"), F.lit(0)).alias("n_tokens")).first()
    # The next longer length of a limit, found in one ordered pass over lengths and limits by stretch.
    marks = sizes.select("n_tokens", F.struct("docs_from", "tokens_from").alias("row"), F.lit(False).alias("asks")).unionByName(
        wanted.select((F.col("limit") + 1).alias("n_tokens"), F.lit(None).cast("struct<docs_from:bigint,tokens_from:bigint>").alias("row"), F.lit(True).alias("asks")))
    marks = marks.withColumn("_stretch", F.floor(F.col("n_tokens") / _STRETCH))
    ahead = Window.partitionBy("_stretch").orderBy("n_tokens", F.desc("asks")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    over = Window.orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)
    firsts = marks.groupBy("_stretch").agg(F.min_by("row", F.when(~F.col("asks"), F.col("n_tokens"))).alias("head"))
    firsts = firsts.withColumn("next", F.first("head", ignorenulls=True).over(over)).select("_stretch", "next")
    found = marks.withColumn("hit", F.first("row", ignorenulls=True).over(ahead)).where("asks").join(firsts, "_stretch")
    row = F.coalesce(F.col("hit"), F.col("next"))
    longer, tokens = F.coalesce(row["docs_from"], F.lit(0)), F.coalesce(row["tokens_from"], F.lit(0))
    limit_value = F.col("n_tokens") - 1
    return found.select(
        limit_value.alias("limit"), F.lit(whole["n_docs"]).alias("n_docs"), longer.cast("bigint").alias("longer"),
        (F.lit(whole["n_tokens"]) - tokens + longer * limit_value).cast("bigint").alias("kept_tokens"),
        (tokens - longer * limit_value).cast("bigint").alias("cut_tokens"))


def quantile(sizes: DataFrame, share: float) -> int | None:
    """The smallest length that at least `share` of the documents do not exceed, from a length table."""
    row = sizes.agg(F.min(F.when(F.col("docs_to") >= F.lit(share) * (F.col("docs_to") + F.col("docs_from") - F.col("n_docs")), F.col("n_tokens"))).alias("q")).first()
    return row["q"]


def op8_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length table of all documents: the answer for every context limit that a document reaches."""
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
    return length_table(lengths)
