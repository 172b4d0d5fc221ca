"""Exact top-k search by distributed histogram selection.

Vectors are packed to blocks of rows. Every block of candidates meets every block of queries once, in cells of a grid of
(candidate group, query group) that an equi-join on the cell brings together: queries are copied once per candidate group, candidates
once per query group, nothing is broadcast. All pairs are scored, but scores never leave the task. Each pass
returns counts of scores by (query, bin) and narrows the interval that holds the query's k-th value until it is one score wide. A last pass returns the
rows at or above that value; a block never needs to return more than k of them, and ties go to smaller ids.

A block counts only its bins from the top down to where it has k scores itself: the k-th value of all
blocks is not below. The counts are summed natively.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id; vectors of
another length than the query's are no candidates; a query id that occurs with several vectors asks with the smallest;
repeated candidate rows each count. Scores are 64-bit integers and wrap beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard.llm.common import settle, table
from spanguard.session import cut, ship_package

_BLOCK = "block bigint, dim int, n int, ids binary, vectors binary, norm double"


def _pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, vector of integers as double) as blocks of vectors of one length."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pd.DataFrame:
            nonlocal number
            ids, vectors = held.pop(dim)
            data = np.stack(vectors) if dim else np.zeros((len(ids), 0))
            ints = np.where(np.abs(data) < 2.0**63, data, np.sign(data) * (2.0**63 - 1024)).astype(np.int64)
            number += 1
            norm = float(np.sqrt((data * data).sum(axis=1).max())) if dim else 0.0
            return pd.DataFrame([(number - 1, dim, len(ids), np.array(ids, np.int64).tobytes(), ints.tobytes(), norm)],
                                columns=["block", "dim", "n", "ids", "vectors", "norm"])

        for frame in frames:
            for i, v in zip(frame["id"], frame["vector"]):
                mine = held.setdefault(len(v), ([], []))
                mine[0].append(i)
                mine[1].append(np.floor(np.asarray(v, np.float64)))
                if len(mine[0]) * max(1, len(v)) >= block_rows * 64:
                    yield close(len(v))
        for dim in sorted(held):
            yield close(dim)

    return cut(rows.mapInPandas(run, _BLOCK))


def _score(left: bytes, right: bytes, dim: int, safe: bool) -> np.ndarray:
    """Integer inner products of two blocks; through doubles where these are exact."""
    a = np.frombuffer(left, np.int64).reshape(-1, dim)
    b = np.frombuffer(right, np.int64).reshape(-1, dim)
    if safe:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([(b * q).sum(axis=1) for q in a])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, bins: int = 1024,
          cells: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates with another id.

    Both tables hold id (long) and vector (array of whole doubles); more columns are ignored.
    """
    spark = candidates.sparkSession
    ship_package(spark)
    base = _pack(candidates.select("id", "vector"), block_rows)
    asked = _pack(queries.select("id", "vector").groupBy("id").agg(F.min("vector").alias("vector")), max(1, block_rows // 8))
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"), F.max("norm").alias("norm"))
    facts = {r["dim"]: r for r in sizes.collect()}  # a row per vector length
    wanted = {r["dim"]: r for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"), F.max("norm").alias("norm")).collect()}
    pairs = sum(facts[d]["blocks"] * wanted[d]["blocks"] for d in wanted if d in facts)
    tasks = cells or max(spark.sparkContext.defaultParallelism * 2, math.ceil(pairs / 64))
    n_base, n_asked = sum(r["blocks"] for r in facts.values()) or 1, sum(r["blocks"] for r in wanted.values()) or 1
    across = max(1, min(n_asked, round(math.sqrt(tasks * n_asked / n_base))))
    down = max(1, min(n_base, math.ceil(tasks / across)))
    peak = max([facts[d]["norm"] * wanted[d]["norm"] for d in wanted if d in facts], default=0.0)
    safe = peak < 2.0**52
    bound = int(min(peak + 1, 2.0**62))

    grid_base = base.where(F.col("n") > 0).select(
        "dim", F.pmod(F.xxhash64("block"), F.lit(down)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("h"),
        F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))

    def meet(state: DataFrame | None) -> DataFrame:
        """Pairs of blocks; with the state (query, lo, width, need) of each query in its block, if given."""
        side = asked
        if state is not None:
            side = asked.join(state, "block")
        more = [] if state is None else ["lo", "width"]
        side = side.select(
            "dim", "block", *more, F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("h"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("g"),
            F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        return grid_base.join(side, ["dim", "g", "h"]).drop("g", "h")

    def scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mine, theirs = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
        s = _score(row.q_vectors, row.c_vectors, row.dim, safe) if row.dim else np.zeros((len(mine), len(theirs)), np.int64)
        return mine, theirs, s, theirs[None, :] != mine[:, None]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                mine, _, s, other = scores(row)
                lo, width = np.asarray(row.lo, np.int64)[:, None], np.asarray(row.width, np.int64)[:, None]
                place = np.clip((s - lo) // width, -1, bins)  # -1: below the interval, bins: above it
                flat = (np.arange(len(mine))[:, None] * (bins + 2) + place + 1)[other]
                held = np.bincount(flat, minlength=len(mine) * (bins + 2)).reshape(len(mine), bins + 2)
                above = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held  # scores in higher bins
                q, b = np.nonzero((held > 0) & (above < k))
                yield pd.DataFrame({"block": row.block, "at": q.astype(np.int32), "bin": (b - 1).astype(np.int32), "n": held[q, b]})

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                mine, theirs, s, other = scores(row)
                q, c = np.nonzero((s >= np.asarray(row.lo, np.int64)[:, None]) & other)
                order = np.lexsort((theirs[c], -s[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q)
                own = np.arange(len(q)) - first < k
                q, c = q[own], c[own]
                yield pd.DataFrame({"query_id": mine[q], "vec_id": theirs[c], "score": s[q, c]})

    # lo: lower end of the interval that holds the k-th score, width: of a bin
    start = -bound - 1
    width = max(1, math.ceil((2 * bound + 2) / bins))
    state = asked.select("block", F.array_repeat(F.lit(start).cast("bigint"), F.col("n")).alias("lo"),
                         F.array_repeat(F.lit(width).cast("bigint"), F.col("n")).alias("width"))
    while pairs:
        seen = meet(state).mapInPandas(count, "block bigint, at int, bin int, n bigint").groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        down_from = Window.partitionBy("block", "at").orderBy(F.desc("bin"))
        seen = seen.withColumn("through", F.sum("n").over(down_from))
        # The k-th score lies in the highest bin that fills k; with fewer candidates than k, all are wanted.
        kth = seen.groupBy("block", "at").agg(F.max(F.when(F.col("through") >= k, F.col("bin"))).alias("bin"))
        kth = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bin"))).alias("bins"))
        narrower = max(1, math.ceil(width / bins))
        joined = state.join(kth, "block", "left")
        lo = F.transform("lo", lambda x, i: x + F.coalesce(F.greatest(F.try_element_at("bins", i), F.lit(0)), F.lit(0)) * width)
        state = settle(joined.select("block", lo.alias("lo"), F.transform("width", lambda x: F.lit(narrower).cast("bigint")).alias("width")))
        if width == 1:
            break
        width = narrower
    found = meet(state).mapInPandas(pick, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id and vector, each component floor(scale * x); rows that take no part are left out."""
    wide = F.col(vector).cast("array<double>")
    fine: Column = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    return usable.select(F.col(key).cast("bigint").alias("id"), F.transform(wide, lambda x: x * float(scale)).alias("vector"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for each vector whose id is divisible by 50, as the stated query set."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)
