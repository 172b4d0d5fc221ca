"""Positions in a text, as column expressions whose cost does not grow with the place in the text.

A substring or a count of line breaks by character offset starts at the front of the text each time, which is quadratic over all matches of a
long line. A text index cuts the text once into pieces of equal length and keeps the line breaks before each; a lookup then
touches one piece, or those that a long span covers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanguard.functions.lambdas import bind

#: Characters of a piece of a text index.
PIECE = 2048
#: Numbers that a running sum handles at once; more are summed in two levels.
_RUN = 256


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _running(counts: Column) -> Column:
    """Sums up to and with each count; copies its result once per count."""
    def step(acc: Column, n: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1), F.lit(0)) + n))

    first = F.array(F.get(counts, F.lit(0)))
    rest = F.aggregate(F.slice(counts, 2, F.greatest(F.size(counts) - 1, F.lit(0))), first, step)
    return F.when(F.size(counts) > 0, rest).otherwise(F.array().cast("array<int>"))


def running_sums(counts: Column) -> Column:
    """Sums up to and with each count of an ARRAY<INT>; long arrays in stretches, then over the stretches."""
    def by_stretch(c: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _RUN).cast("int")),
                                lambda i: _running(F.slice(c, i * _RUN + 1, _RUN)))
        return bind(stretches, lambda s: bind(
            _running(F.transform(s, lambda x: F.element_at(x, -1))),
            lambda totals: F.flatten(F.transform(s, lambda x, i: F.transform(
                x, lambda n: n + F.when(i > 0, F.get(totals, i - 1)).otherwise(0))))))

    return bind(counts, lambda c: F.when(F.size(c) <= _RUN, _running(c)).otherwise(by_stretch(c)))


def sums_before(counts: Column) -> Column:
    """[0, n0, n0+n1, …], one longer than the counts."""
    return F.concat(F.array(F.lit(0)), running_sums(counts))


def text_index(text: Column) -> Column:
    """STRUCT<pieces, breaks>: the text in pieces, and the line breaks before each piece."""
    pieces = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return bind(pieces, lambda p: F.struct(p.alias("pieces"), sums_before(F.transform(p, newline_count)).alias("breaks")))


def _piece_of(position: Column) -> Column:
    return F.floor(position / PIECE).cast("int")


def char_at(index: Column, position: Column) -> Column:
    """The character at a 0-based position, the empty text outside."""
    piece = F.coalesce(F.get(index["pieces"], _piece_of(position)), F.lit(""))
    return F.when(position >= 0, F.substring(piece, position % PIECE + 1, F.lit(1))).otherwise(F.lit(""))


def between(index: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive), 0 <= start; a position behind the text counts as its end."""
    first = _piece_of(start)
    covered = F.slice(index["pieces"], first + 1, F.greatest(_piece_of(end) - first + 1, F.lit(0)))
    return F.substring(F.array_join(covered, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def breaks_before(index: Column, position: Column) -> Column:
    """Line breaks before a 0-based position inside the text or at its end."""
    number = _piece_of(position)
    piece = F.coalesce(F.get(index["pieces"], number), F.lit(""))
    known = F.get(index["breaks"], F.least(number, F.size(index["breaks"]) - 1))
    return known + newline_count(F.substring(piece, F.lit(1), position % PIECE))


def whole_lines(lines: Column, first: Column, last: Column) -> Column:
    """The lines with numbers first to last (0-based) of an array of lines."""
    return F.array_join(F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(1))), "\n")
