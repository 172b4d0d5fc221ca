"""Overlap resolution among spans of one entity in one document.

A sweep instead of pairs. In the order of starts (longer spans first) every span that may hold the one at hand has been seen, and all that
matters of those is a staircase: for rising ends, the best score of a span that ends there or later. In the reverse order the same holds for
what the span holds. So each span is looked up and entered by bisection, however many overlap.

The spans of a document are dealt by the strip of text they start in, so that one document is many tasks. Only spans that reach beyond their strip
meet spans of others; the staircases of the strips, which are short, are added up along the document and handed to each
strip before its own spans.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanguard.operators.spans import JOIN_KEYS
from spanguard.session import cut, ship_package

#: Characters of a strip.
STRIP_CHARS = 1 << 16


class Holders:
    """The best score among the spans seen that end at a place or behind it."""

    def __init__(self, ends=(), scores=()):
        self.ends, self.scores = list(ends), list(scores)  # ends rise, scores fall

    def best(self, end: int) -> float | None:
        at = bisect_left(self.ends, end)
        return self.scores[at] if at < len(self.ends) else None

    def add(self, end: int, score: float) -> None:
        known = self.best(end)
        if known is not None and known >= score:
            return
        to = bisect_right(self.ends, end)
        at = to
        while at and self.scores[at - 1] <= score:
            at -= 1
        self.ends[at:to], self.scores[at:to] = [end], [score]

    def behind(self, place: int) -> None:
        """Forget the spans that end at `place` or before."""
        at = bisect_right(self.ends, place)
        del self.ends[:at], self.scores[:at]


class Held:
    """The best score among the spans seen that end at a place or before it."""

    def __init__(self, ends=(), scores=()):
        self.ends, self.scores = list(ends), list(scores)  # ends rise, scores rise

    def best(self, end: int) -> float | None:
        at = bisect_right(self.ends, end)
        return self.scores[at - 1] if at else None

    def add(self, end: int, score: float) -> None:
        known = self.best(end)
        if known is not None and known >= score:
            return
        at = bisect_left(self.ends, end)
        to = at
        while to < len(self.ends) and self.scores[to] <= score:
            to += 1
        self.ends[at:to], self.scores[at:to] = [end], [score]


def _sweep(starts: list, ends: list, scores: list, rows: range, keep: list[bool], before: Holders, after: Held) -> None:
    """Mark the spans that another one beats; spans in sweep order, with the staircases of other strips, which are added to."""
    whole = [i for i in rows if starts[i] is not None and ends[i] is not None and scores[i] is not None]
    for i in whole:
        known = before.best(ends[i])
        if known is not None and known >= scores[i]:
            keep[i] = False
        before.add(ends[i], scores[i])
    for i in reversed(whole):
        known = after.best(ends[i])
        if known is not None and known > scores[i]:
            keep[i] = False
        after.add(ends[i], scores[i])


def _firsts(rows: pa.Table, columns: int) -> list[int]:
    """Where groups of equal values in the first columns begin, and the number of rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for i in range(columns):
        codes = rows.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(new).tolist(), rows.num_rows]


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows as tables of whole groups, with `_firsts`; the last group of a batch waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.Table.from_batches([*[b.slice(0, 1) for b in held[:1]], batch.slice(batch.num_rows - 1)])
        held.append(batch)
        if len(held) > 1 and _firsts(ends, columns) == [0, 2]:
            continue  # all of it belongs to the waiting group
        rows = pa.Table.from_batches(held).combine_chunks()
        firsts = _firsts(rows, columns)
        if len(firsts) > 2:
            yield rows.slice(0, firsts[-2]), firsts[:-1]
        held = rows.slice(firsts[-2]).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _firsts(rows, columns)


def _grouped(df: DataFrame, by: list[str], order: list, run: Callable, schema: str) -> DataFrame:
    """Apply `run` to whole groups, their rows in order; many groups share a call."""
    count = len(by)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in _whole_groups(batches, count):
            yield from run(rows, firsts)

    return df.select(*by, *[c for c in df.columns if c not in by]).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(each, schema)


def resolve_overlaps(spans: DataFrame, strip_chars: int = STRIP_CHARS) -> DataFrame:
    """Of two spans of one entity where one holds the other, keep the higher score, then the longer.

    A span is dropped when any other beats it. Equal ranges keep one row with the best score. A span without start, end or score
    beats none and stays.
    """
    ship_package(spans.sparkSession)
    keys = [*JOIN_KEYS, "entity_type"]
    extra = [c for c in spans.columns if c not in (*keys, "start", "end", "score")]
    # one row per range: the best by score, then by its other columns
    best = spans.groupBy(*keys, "start", "end").agg(F.max(F.struct("score", *extra)).alias("_best"))
    strip = F.floor(F.coalesce("start", F.lit(0)) / strip_chars).cast("int").alias("_strip")
    unique = cut(best.select(*keys, strip, "start", "end", "_best.*"))
    types = dict(unique.dtypes)
    key_types = ", ".join(f"`{k}` {types[k]}" for k in keys)
    columns = spans.columns

    def stairs(rows: pa.Table, firsts: list[int]) -> Iterator[pa.RecordBatch]:
        """What a strip tells the others: spans that reach beyond it, and all that it holds."""
        strips, starts, ends, scores = (rows.column(c).to_pylist() for c in ("_strip", "start", "end", "score"))
        out = []
        for a, b in zip(firsts, firsts[1:]):
            before, after = Holders(), Held()
            for i in range(a, b):
                if starts[i] is not None and ends[i] is not None and scores[i] is not None:
                    before.add(ends[i], scores[i])
                    after.add(ends[i], scores[i])
            before.behind((strips[a] + 1) * strip_chars - 1)
            out.append((a, before.ends, before.scores, after.ends, after.scores))
        yield _state_rows(rows, [*keys, "_strip"], out)

    def carry(rows: pa.Table, firsts: list[int]) -> Iterator[pa.RecordBatch]:
        """The staircases of all strips before and behind each, document by document; a row per strip that needs one."""
        strips, ends, scores, held_ends, held_scores = (
            rows.column(c).to_pylist() for c in ("_strip", "ends", "scores", "held_ends", "held_scores"))
        out = []
        for a, b in zip(firsts, firsts[1:]):
            if not any(ends[a:b]):
                continue
            behind: list[tuple[list, list]] = [([], [])] * (b - a)
            after = Held()
            for i in reversed(range(a, b)):
                if ends[i]:  # only a span that reaches beyond its strip holds spans of later ones
                    behind[i - a] = (list(after.ends), list(after.scores))
                for e, score in zip(held_ends[i], held_scores[i]):
                    after.add(e, score)
            before = Holders()
            for i in range(a, b):
                before.behind(strips[i] * strip_chars - 1)
                if before.ends or behind[i - a][0]:
                    out.append((i, list(before.ends), list(before.scores), *behind[i - a]))
                for e, score in zip(ends[i], scores[i]):
                    before.add(e, score)
        yield _state_rows(rows, [*keys, "_strip"], out)

    def sweep(rows: pa.Table, firsts: list[int]) -> Iterator[pa.RecordBatch]:
        carried, starts, ends, scores = (rows.column(c).to_pylist() for c in ("_carried", "start", "end", "score"))
        keep = [not c for c in carried]
        for a, b in zip(firsts, firsts[1:]):
            if b - a == 1:
                continue
            before, after = Holders(), Held()
            if carried[a]:
                first = rows.slice(a, 1).to_pydict()
                before, after = Holders(first["ends"][0], first["scores"][0]), Held(first["held_ends"][0], first["held_scores"][0])
                a += 1
            _sweep(starts, ends, scores, range(a, b), keep, before, after)
        yield from rows.select(columns).filter(pa.array(keep)).to_batches()

    state = f"{key_types}, _strip int, ends array<int>, scores array<double>, held_ends array<int>, held_scores array<double>"
    order = [F.col("start").asc_nulls_first(), F.col("end").desc_nulls_last()]
    rows = unique.withColumn("_carried", F.lit(False))
    if not unique.where(F.col("end") >= (F.col("_strip") + 1) * strip_chars).isEmpty():  # else no strip has to know of another
        plain = unique.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int"), "score": F.col("score").cast("double")})
        told = _grouped(plain.select(*keys, "_strip", "start", "end", "score"), [*keys, "_strip"], order, stairs, state)
        carried = _grouped(told, keys, [F.col("_strip")], carry, state)
        rows = rows.unionByName(carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return _grouped(rows, [*keys, "_strip"], [F.col("_carried").desc(), *order], sweep, schema)


def _state_rows(rows: pa.Table, keys: list[str], states: list[tuple]) -> pa.RecordBatch:
    """Rows (key columns of the given row, four lists)."""
    names, kinds = ("ends", "scores", "held_ends", "held_scores"), (pa.int32(), pa.float64(), pa.int32(), pa.float64())
    head = rows.select(keys).take(pa.array([x[0] for x in states], pa.int64())).combine_chunks()
    columns = [head.column(k).combine_chunks() for k in keys]
    lists = [pa.array([x[i + 1] for x in states], pa.list_(kind)) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*keys, *names])
