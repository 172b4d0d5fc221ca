"""Sharding by rendezvous hashing over weighted shards.

Every record key draws a number for every shard from a digest of key and shard, and goes to the shard whose number, raised to one over the
shard's weight, is greatest. A shard thus gets records in proportion to its weight, a key's place depends on nothing but the key, the shards
and their weights, and a further shard only takes records into itself: the draws of the others stay as they are. The draws are
column functions in the row; no table of shards is joined and nothing is shuffled. The work grows with records times shards.

`with_slots` numbers the records of each shard without a gap. Shards are few and so large, and a key may hold a third of all records; the slim rows
are therefore sorted over the whole table by (shard, key, ...) and each run of a shard in a task gets its offset from the runs before it.

Defined results: a null key is one more key, of which all records share a shard; a null text has no bytes (size 16, check-sum 0); repeated rows each
get a slot of their own; equal draws go to the smaller shard; a shard of weight 0 gets nothing; an empty table gives no rows; other columns are ignored
or, in `assign`, kept as they are. Texts are only measured, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.llm.common import table
from spanguard.operators.position import with_position

#: Shards of the registered query.
SHARDS = 40
#: Bytes that a record costs besides its text (fixed by the contract of the query).
RECORD_BYTES = 16


def _draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from a digest of key and shard; 52 bits and a half, so that it is exact."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), shard.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, as an int; `weights[i]` is the weight of shard i."""
    if not all(math.isfinite(w) and w >= 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and one of them positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])
    # ln(u) / w orders as u^(1/w) does; the greatest struct has the greatest draw, then the smallest shard.
    drawn = F.transform(shards, lambda s: F.struct((F.ln(_draw(key, s["shard"])) / s["weight"]).alias("draw"), (-s["shard"]).alias("shard")))
    return (-F.array_max(drawn)["shard"]).cast("int")


def assign(records: DataFrame, key: Column, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Add the shard of each record; a column of that name is replaced."""
    return records.withColumn(name, shard_of(key, weights))


def with_slots(records: DataFrame, order: list[Column], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add a number from 0 for each record of a shard, in the given order; equal rows are interchangeable."""
    return with_position(records.withColumn("_row_id", F.monotonically_increasing_id()), [shard], [*order, F.col("_row_id")], name).drop("_row_id")


def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards, and where each would be with one more."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(body) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * SHARDS).alias("shard"), shard_of(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"))
    placed = with_slots(slim, [F.asc_nulls_last("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _zero_bits(state: int, n: int) -> int:
    """A check-sum register after n zero bits; for negative n, before them."""
    for _ in range(n):
        state = (state >> 1) ^ (0xEDB88320 if state & 1 else 0)
    for _ in range(-n):
        state = ((state ^ 0xEDB88320) << 1) | 1 if state >> 31 else state << 1
    return state


def _reference_sql() -> str:
    """The query as SQL, which has no CRC-32.

    The hexadecimal text, after the four bytes that fill an empty register with ones and zeros up to a whole number of pieces, is cut into
    pieces of 512 bytes. Each is reduced by half bytes; then the register of the pieces so far goes through 512 zero bytes and meets the next.
    """
    size = 1024
    first = _zero_bits(0xFFFFFFFF, -32).to_bytes(4, "little").hex().upper()
    half = [_zero_bits(x, 4) for x in range(16)]
    skipped = "a"
    for i in range(8):
        moved = f"{[_zero_bits(x << (4 * i), 4 * size) for x in range(16)]}[((a >> {4 * i}) & 15) + 1]"
        skipped = moved if i == 0 else f"xor({skipped}, {moved})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT k, repeat('0', CAST(({size} - (length(h) + 8) % {size}) % {size} AS BIGINT)) || '{first}' || h AS x FROM d),
y AS (SELECT k, i, substr(x, {size} * i + 1, {size}) AS x FROM (SELECT k, x, unnest(range(0, length(x) // {size})) AS i FROM z)),
r AS (SELECT k, i, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, {size}),
  lambda j: CAST(instr('123456789ABCDEF', x[j + 2 - 2 * (j % 2)]) AS BIGINT))),
  lambda a, e: xor(a >> 4, {half}[xor(a & 15, e) + 1])) AS v FROM y),
c AS (SELECT k, xor(list_reduce(list(v ORDER BY i), lambda a, e: xor({skipped}, e)), 4294967295) AS text_crc32 FROM r GROUP BY k),
u AS (
  SELECT k, s, ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || s), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) AS draw
  FROM d, range(0, {SHARDS + 1}) AS t(s)),
w AS (
  SELECT k, CAST(first(s ORDER BY draw DESC, s) FILTER (s < {SHARDS}) AS INTEGER) AS shard, CAST(first(s ORDER BY draw DESC, s) AS INTEGER) AS grown_shard
  FROM u GROUP BY k)
SELECT doc_id, CAST(length(h) // 2 + {RECORD_BYTES} AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, length(h), text_crc32) - 1 AS slot, grown_shard
FROM d JOIN c USING (k) JOIN w USING (k)"""


OP12_SQL = _reference_sql()
