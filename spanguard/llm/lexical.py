"""Exact ranked lexical search by dense blocked multiplication.

1. Documents are cut into terms once and written as index blocks: the distinct terms of some 2 MB of text, and per document its terms as
   (term number, occurrences). Items become blocks of the same form, of at most `item_rows` items.
2. The document frequency of every item term is counted where a block of items meets the document blocks, and summed natively. With the
   numbers of documents and terms it gives the weight of each term.
3. Item blocks meet document blocks again. A tile of the terms that both hold is written out as two dense matrices of doubles, items by
   terms (occurrences times weight) and terms by documents (impacts), which one matrix product scores. A tile ends before its terms could sum to
   2^53, so every partial sum is a whole number that a double holds exactly; tiles are added as 64-bit integers. A term that passes the
   bound by itself is multiplied in integers. Of each product only scores from the item's k-th best so far on are looked at; equal scores go by id,
   so the k best do not depend on blocks or their order.
4. Each task returns k rows per item, of which the k best are kept.

A cell is an item block and a share of the document blocks. Item blocks are copied once per share, document blocks once per item block;
nothing is broadcast, and a task holds one item block and one document block at a time. A very long text is a block of its own and is cut into terms
in pieces of 1 MB. Work grows with items times documents.

Defined results: a null text has no terms, and a document or item without terms appears nowhere; a null document id comes after all others among
equal scores; repeated documents each count and each rank; an item id that occurs with several texts asks with the smallest, a null item id is one more item;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard.llm.common import expand, settle, squeeze, table
from spanguard.session import ship_package

#: Whole numbers below are held exactly by a double.
_EXACT = float(1 << 53)
#: Bytes that belong to terms: letters (capitals turned small), digits, and all that is not ASCII; others become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PIECE = 1 << 20

_INDEX = "block bigint, n_docs int, n_found bigint, n_terms bigint, ids binary, lengths binary, terms binary, found binary, ends binary, places binary, counts binary"


def terms_of(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their occurrences."""
    folded = text.translate(_FOLD)
    if len(folded) <= _PIECE:
        return Counter(folded.split())
    held, at = Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        held.update(folded[at:end].split())
        at = end
    return held


def index_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = 2 << 20, block_rows: int = 2048) -> DataFrame:
    """Rows with at least one term as index blocks, written to the shared folder.

    ids: positions as (id, is null) pairs of 64 bits; lengths: terms per document; terms: distinct terms of the block; found: documents per term;
    ends, places, counts: per document, the end of its entries, and per entry the number of the term and its occurrences.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids: list[tuple[int, int]] = []
        lengths: list[int] = []
        ends: list[int] = []
        places: list[int] = []
        counts: list[int] = []
        numbers: dict[bytes, int] = {}
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size, numbers
            at = np.array(places, np.int32)
            fields = {
                "block": (number, pa.int64()), "n_docs": (len(ids), pa.int32()), "n_found": (len(ids), pa.int64()), "n_terms": (sum(lengths), pa.int64()),
                "ids": (squeeze(np.array(ids, np.int64).tobytes()), pa.binary()), "lengths": (squeeze(np.array(lengths, np.int64).tobytes()), pa.binary()),
                "terms": (squeeze(b" ".join(numbers)), pa.binary()),
                "found": (squeeze(np.bincount(at, minlength=len(numbers)).astype(np.int64).tobytes()), pa.binary()),
                "ends": (squeeze(np.array(ends, np.int64).tobytes()), pa.binary()), "places": (squeeze(at.tobytes()), pa.binary()),
                "counts": (squeeze(np.array(counts, np.int32).tobytes()), pa.binary())}
            for held in (ids, lengths, ends, places, counts):
                held.clear()
            number, size, numbers = number + 1, 0, {}
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in fields.values()], names=list(fields))

        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                view = body.as_py()
                if ids and (size + len(view) > block_bytes or len(ids) >= block_rows):
                    yield close()
                found = terms_of(view)
                if not found:
                    continue
                size += len(view)
                ids.append((0, 1) if i is None else (i, 0))
                lengths.append(found.total())
                for term, times in found.items():
                    places.append(numbers.setdefault(term, len(numbers)))
                    counts.append(times)
                ends.append(len(places))
        if ids:
            yield close()

    return settle(slim.mapInArrow(run, _INDEX))


def _numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(expand(data), kind)


class _Items:
    """A block of items: their ids and, by term, (item, weight times occurrences)."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = _numbers(row["ids"]).reshape(-1, 2)
        self.terms = {term: i for i, term in enumerate(expand(row["terms"]).split())}
        counts, places = _numbers(row["counts"], np.int32).astype(np.int64), _numbers(row["places"], np.int32)
        item = np.repeat(np.arange(len(self.ids)), np.diff(_numbers(row["ends"]), prepend=0))
        order = np.argsort(places, kind="stable")
        self.item, self.counts = item[order], counts[order]
        self.starts = np.searchsorted(places[order], np.arange(len(self.terms) + 1))

    def weigh(self, slots: np.ndarray, weights: np.ndarray) -> None:
        w = np.zeros(len(self.terms), np.int64)
        w[slots] = weights
        self.values = self.counts * np.repeat(w, np.diff(self.starts))
        self.peak = np.maximum.reduceat(np.append(self.values, 0), self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def meeting(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms shared with a document block: their numbers there and here."""
        get = self.terms.get
        here = np.fromiter((get(t, -1) for t in expand(terms).split()), np.int64)
        there = np.flatnonzero(here >= 0)
        return there, here[there]

    def entries(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the given terms: item, place of the term in `slots`, value."""
        sizes = self.starts[slots + 1] - self.starts[slots]
        column = np.repeat(np.arange(len(slots)), sizes)
        at = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[slots], sizes)
        return self.item[at], column, self.values[at]


def _tiles(bounds: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of terms whose bounds sum to less than 2^53; a term that passes it is a range of its own."""
    at, total = 0, 0.0
    for i, bound in enumerate(bounds.tolist()):
        if i > at and (total + bound >= _EXACT or i - at >= width):
            yield at, i
            at, total = i, 0.0
        total += bound
    if at < len(bounds):
        yield at, len(bounds)


def block_scores(items: _Items, row: dict, n_found: int, n_terms: int, width: int = 512) -> np.ndarray:
    """Scores of all items (rows) and documents (columns) of two blocks, as 64-bit integers."""
    lengths = _numbers(row["lengths"]).tolist()
    scores = np.zeros((len(items.ids), len(lengths)), np.int64)
    there, here = items.meeting(row["terms"])
    if not len(there):
        return scores
    column_of = np.full(len(_numbers(row["found"])), -1)
    column_of[there] = np.arange(len(there))
    places, counts = _numbers(row["places"], np.int32), _numbers(row["counts"], np.int32)
    column = column_of[places]
    used = column >= 0
    doc = np.repeat(np.arange(len(lengths)), np.diff(_numbers(row["ends"]), prepend=0))[used]
    column, tf = column[used], counts[used].astype(np.int64)
    norm = np.array([25 + (75 * n * n_found) // n_terms for n in lengths], np.int64)  # Python integers do not overflow
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
    order = np.argsort(column, kind="stable")
    column, doc, impact = column[order], doc[order], impact[order]
    first = np.searchsorted(column, np.arange(len(there) + 1))
    peak = np.maximum.reduceat(np.append(impact, 0), first[:-1])
    for a, b in _tiles(items.peak[here].astype(np.float64) * peak, width):
        item, at, value = items.entries(here[a:b])
        mine = slice(first[a], first[b])
        exact = np.float64 if float(items.peak[here[a]]) * float(peak[a]) < _EXACT else np.int64
        left, right = np.zeros((len(items.ids), b - a), exact), np.zeros((b - a, len(lengths)), exact)
        left[item, at] = value
        right[column[mine] - a, doc[mine]] = impact[mine]
        scores += (left @ right).astype(np.int64)
    return scores


class _Best:
    """The k best (score, id) of each item so far; equal scores by id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # scores below are not looked at
        self.item, self.score, self.id, self.null = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        wanted = scores >= self.least[:, None]
        if scores.shape[1] > self.k and wanted.sum() > 4 * self.k * len(scores):
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            wanted &= scores >= kth[:, None]
        item, doc = np.nonzero(wanted)
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, doc]])
        name, null = np.concatenate([self.id, ids[doc, 0]]), np.concatenate([self.null, ids[doc, 1]])
        order = np.lexsort((name, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        full = item[rank == self.k - 1]
        self.item, self.score, self.id, self.null = item[rank < self.k], score[order], name[order], null[order]
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _meet(items: DataFrame, docs: DataFrame, numbers: list[int], shares: int) -> DataFrame:
    """Rows of both tables, each cell a partition of its own: the item block first, then its share of the document blocks, one by one."""
    types = dict(items.dtypes) | dict(docs.dtypes)

    def rows(df: DataFrame, kind: int, pairs: Column, share: Column) -> DataFrame:
        placed = df.select("*", pairs.alias("_at", "_number")) if kind else df.withColumn("_at", F.array_position(F.lit(numbers), F.col("block")) - 1)
        return placed.select((F.col("_at") * shares + share).cast("int").alias("cell"), F.lit(kind).alias("kind"),
                             *[(F.col(c) if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in sorted(types)])

    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    left = rows(items.withColumn("_share", every_share), 0, F.lit(None), F.col("_share"))
    right = rows(docs, 1, F.posexplode(F.lit(numbers)), F.pmod(F.xxhash64("block"), F.lit(shares)))
    return left.unionByName(right).repartitionById(len(numbers) * shares, F.col("cell")).sortWithinPartitions("cell", "kind")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block_bytes: int = 2 << 20, block_rows: int = 2048, item_bytes: int = 1 << 20, item_rows: int = 1024, width: int = 512, shares: int | None = None) -> DataFrame:
    """item, rank (from 1), key, score of the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    index = index_blocks(docs, key, text, block_bytes, block_rows)
    one = items.select(F.col(item).cast("bigint").alias("_item"), F.col(item_text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    distinct = settle(one.groupBy("_item").agg(F.min("_text").alias("_text")))
    wanted = distinct.agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("_text")).alias("bytes")).first()
    # As few blocks as the sizes allow, however the items are dealt over tasks: each one copies the index.
    full = math.ceil(max(wanted["items"] / item_rows, (wanted["bytes"] or 0) / item_bytes, 1))
    asked = index_blocks(distinct.coalesce(full), "_item", "_text", item_bytes, item_rows)
    totals = index.agg(F.sum("n_found").alias("docs"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("blocks")).first()
    schema = f"{item} bigint, rank int, {key} bigint, score bigint"
    numbers = [r["block"] for r in asked.select("block").orderBy("block").collect()]  # a number per thousand items
    if not totals["blocks"] or not numbers:
        return spark.createDataFrame([], schema)
    n_found, n_terms = totals["docs"], totals["terms"]
    shares = shares or min(totals["blocks"], max(2 * spark.sparkContext.defaultParallelism, math.ceil(totals["blocks"] / 128)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def flush() -> pa.RecordBatch:
            slots = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), block.block)), pa.array(slots.astype(np.int32)), pa.array(total[slots])],
                                              names=["block", "slot", "df"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if block is not None:
                        yield flush()
                    block = _Items(row)
                    total = np.zeros(len(block.terms), np.int64)
                else:
                    there, here = block.meeting(row["terms"])
                    total[here] += _numbers(row["found"])[there]
        if block is not None:
            yield flush()

    fields = ["block", "ids", "terms", "ends", "places", "counts"]
    found = _meet(asked.select(*fields), index.select("block", "terms", "found"), numbers, shares)
    summed = found.mapInArrow(frequencies, "block bigint, slot int, df bigint").groupBy("block", "slot").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_found + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = summed.groupBy("block").agg(F.collect_list("slot").alias("slots"), F.collect_list(weight).alias("weights"))
    none = F.array().cast("array<bigint>")
    weighed = settle(asked.select(*fields).join(weights, "block", "left").select(
        *fields, F.coalesce(F.col("slots").cast("array<bigint>"), none).alias("slots"), F.coalesce("weights", none).alias("weights")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None

        def flush() -> pa.RecordBatch:
            name, null = block.ids[best.item, 0], block.ids[best.item, 1] == 1
            return pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64(), mask=null), pa.array(best.id, pa.int64(), mask=best.null == 1), pa.array(best.score)],
                names=["item", "doc", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if block is not None:
                        yield flush()
                    block = _Items(row)
                    block.weigh(np.array(row["slots"], np.int64), np.array(row["weights"], np.int64))
                    best = _Best(len(block.ids), k)
                else:
                    best.add(block_scores(block, row, n_found, n_terms, width), _numbers(row["ids"]).reshape(-1, 2))
        if block is not None:
            yield flush()

    cells = _meet(weighed, index.select("block", "ids", "lengths", "terms", "found", "ends", "places", "counts"), numbers, shares)
    kept = cells.mapInArrow(rank, "item bigint, doc bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def op11_blocked_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH i0 AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM i0) GROUP BY ALL),
t AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
d AS (SELECT k, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_found, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
f AS (SELECT k, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_found + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, n_found),
p AS (
  SELECT k, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_found) // n_terms)) AS impact
  FROM f JOIN d USING (k), s),
r AS (SELECT item_id, k, CAST(sum(times * w * impact) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, k),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM r JOIN d USING (k) WHERE score > 0)
SELECT * FROM o WHERE rank <= 10"""
