"""URL filters from dated lists, joined as of the time of each capture.

A list entry says that from a time on a pattern is on a list, or no longer on it; so the entries of a pattern are validity
intervals. A pattern is a domain, which also holds for its subdomains, or a host with a path, which holds for that page alone.
Each capture is held against the entries of its own page, its host and all parent domains that were in force when it was fetched.

Entries and captures are sorted together by (pattern, time) over the whole cluster, and each task walks through its stretch and
remembers which lists the pattern is on. What is in force where a stretch begins is carried over from the stretches
before: one small row per task. So neither a host with a third of all captures nor a pattern with very many entries is
ever in one task.

Defined results: entries count from their time on, that moment included; of several entries of one pattern and list at one moment the one
with the largest id holds; a null or unreadable URL matches nothing; a capture without a time matches
nothing; every capture gives one row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.llm.common import table
from spanguard.session import cut, ship_package

_SORTED = ["pattern", "at", "kind", "id"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def page_of(url: Column) -> Column:
    """Host and path without query, fragment and final slash; empty if there is no path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    return F.when((path == "") | (host_of(url) == ""), F.lit("")).otherwise(F.concat(host_of(url), path))


def patterns_of(url: Column) -> Column:
    """The page, the host and all its parent domains."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.array_distinct(F.concat(domains, F.array(page_of(url))))


def list_join(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", partitions: int | None = None) -> DataFrame:
    """Add `lists`, the sorted names of the lists that a capture was on, to every capture.

    `entries` holds entry_id (long), list, pattern, added (true: on the list from `since` on, false: off it) and since, of the type of `fetched` (long).
    """
    ship_package(captures.sparkSession)
    columns = [c for c in captures.columns if c != "lists"]
    held = cut(captures.select(F.struct(*columns).alias("_capture"), F.monotonically_increasing_id().alias("_row")))
    asks = held.select(F.explode(patterns_of(F.col("_capture")[url])).alias("pattern"), F.col("_capture")[fetched].cast("bigint").alias("at"), F.lit(1).alias("kind"),
                       F.col("_row").alias("id"), F.lit(None).cast("string").alias("list"), F.lit(None).cast("boolean").alias("added"))
    asks = asks.where(F.col("at").isNotNull() & (F.col("pattern") != ""))
    says = entries.select("pattern", F.col("since").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.col("entry_id").cast("bigint").alias("id"), "list", "added")
    says = says.dropna()
    both = says.unionByName(asks)
    ranged = both.repartitionByRange(*_SORTED) if partitions is None else both.repartitionByRange(partitions, *_SORTED)
    placed = cut(ranged.sortWithinPartitions(*_SORTED).withColumn("part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = key = None
        state: dict[str, bool] = {}
        for batch in batches:
            cells = batch.to_pydict()
            for pattern, kind, name, added, number in zip(cells["pattern"], cells["kind"], cells["list"], cells["added"], cells["part"]):
                if pattern != key:
                    key, state = pattern, {}
                    first, part = (pattern if first is None else first), number
                if kind == 0:
                    state[name] = added
        if part is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.string()), "last": pa.array([key], pa.string()),
                "names": pa.array([list(state)], pa.list_(pa.string())), "flags": pa.array([list(state.values())], pa.list_(pa.bool_()))})

    carried: dict[int, tuple[str, dict[str, bool]]] = {}
    before: tuple[str | None, dict[str, bool]] = (None, {})
    # One row per task, whatever the number of entries.
    for row in sorted(placed.mapInArrow(ends, "part int, first string, last string, names array<string>, flags array<boolean>").collect()):
        carried[row["part"]] = before
        own = dict(zip(row["names"], row["flags"]))
        before = (row["last"], {**before[1], **own} if row["first"] == row["last"] == before[0] else own)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: str | None = None
        state: dict[str, bool] = {}
        started = False
        for batch in batches:
            cells = batch.to_pydict()
            rows, found = [], []
            for pattern, kind, number, name, added, part in zip(*[cells[c] for c in ("pattern", "kind", "id", "list", "added", "part")]):
                if not started:
                    started, (key, state) = True, carried.get(part, (None, {}))
                    state = dict(state)
                if pattern != key:
                    key, state = pattern, {}
                if kind == 0:
                    state[name] = added
                else:
                    for on in [x for x, y in state.items() if y]:
                        rows.append(number)
                        found.append(on)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], names=["_hit", "list"])

    hits = placed.mapInArrow(walk, "_hit bigint, list string").groupBy("_hit").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    return held.join(hits, held["_row"] == hits["_hit"], "left").select("_capture.*", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day made from their ids, as the table has none."""
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % 400).alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list entry from every page: its page or its host's parent domain put on, or taken off, one of three lists on some day."""
    host = host_of(F.col("url"))
    parent = F.when(F.size(F.split(host, r"\.")) > 3, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    return pages.select(
        F.col("page_id").alias("entry_id"), F.concat(F.lit("list"), (F.col("page_id") % 3).cast("string")).alias("list"),
        F.when(F.col("page_id") % 2 == 0, parent).otherwise(page_of(F.col("url"))).alias("pattern"),
        (F.col("page_id") % 4 != 3).alias("added"), (F.col("page_id") * 31 % 400).alias("since"))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that each page was on when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    joined = list_join(dated_captures(pages), dated_entries(pages))
    return joined.select("page_id", "url", F.col("fetched"), F.size("lists").cast("bigint").alias("n_lists"), F.array_join("lists", ",").alias("lists"))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id * 7919 % 400 AS fetched, page_id * 31 % 400 AS since,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/+$', '') AS path
  FROM pages),
q AS (SELECT *, CASE WHEN path = '' OR host = '' THEN '' ELSE host || path END AS page, string_split(host, '.') AS labels FROM p),
e AS (
  SELECT page_id AS entry_id, 'list' || (page_id % 3) AS list, page_id % 4 <> 3 AS added, since,
    CASE WHEN page_id % 2 = 0 THEN CASE WHEN len(labels) > 3 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END ELSE page END AS pattern
  FROM q),
c AS (
  SELECT DISTINCT page_id, fetched, unnest(list_append(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')), page)) AS pattern
  FROM q),
h AS (
  SELECT c.page_id, e.list, c.pattern, arg_max(e.added, e.since * 1000000000 + e.entry_id) AS added
  FROM c JOIN e ON e.pattern = c.pattern AND e.since <= c.fetched WHERE c.pattern <> '' GROUP BY ALL),
l AS (SELECT page_id, list_sort(list(DISTINCT list)) AS lists FROM h WHERE added GROUP BY page_id)
SELECT q.page_id, q.url, q.fetched, CAST(len(coalesce(lists, [])) AS BIGINT) AS n_lists, array_to_string(coalesce(lists, []), ',') AS lists
FROM q LEFT JOIN l USING (page_id)"""
