"""Detection: documents to scored spans with their context.

Each document is cut, inside its own row, into blocks of whole lines, and patterns run on blocks. A line
of any length is one block: offsets come from running sums over the pieces between the matches, and what
stands around a match is looked up in an index of the block, so the work grows with the text and not
with its length times its matches. A document with the mark of a private key is one block, as a key has
many lines. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanguard.functions import positions as P
from spanguard.functions.lambdas import bind
from spanguard.functions.positions import newline_count
from spanguard.operators import recognizers as R
from spanguard.operators.engines import engine_for, identity_of
from spanguard.operators.validate import Context, Validator
from spanguard.options import DEFAULT_OPTIONS, ScanOptions
from spanguard.rules import CONTEXT_CHARS
from spanguard.session import ship_package

BLOCK_CHARS = 4096
DOC_KEYS = ("repo", "scan_id", "relative_path", "extension")
JOIN_KEYS = ("repo", "scan_id", "relative_path")
_BLOCKS = rf"(?s).{{1,{BLOCK_CHARS}}}[^\n]*\n?"


def block_array(text: Column) -> Column:
    """The text in blocks of whole lines; joined they give the text again."""
    whole = (F.length(text) <= BLOCK_CHARS) | F.contains(text, F.lit(R.KEY_MARK))
    return F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(0)))


def with_blocks(docs: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """One row per block: keys, text, before, after, base, base_line."""
    blocks, bases, lines, structs = _block_columns(id(docs.sparkSession.sparkContext))
    listed = docs.where(F.length("text") > 0).select(*keys, blocks.alias("_blocks"))
    measured = listed.select(*keys, "_blocks", bases.alias("_bases"), lines.alias("_lines"))
    return measured.select(*keys, F.inline(structs))


@lru_cache(maxsize=4)
def _block_columns(context: int) -> tuple[Column, Column, Column, Column]:
    """The expressions of `with_blocks`, built once (per Spark context)."""
    def block(text: Column, i: Column) -> Column:
        following = F.coalesce(F.get("_blocks", i + 1), F.lit(""))
        preceding = F.coalesce(F.get("_blocks", i - 1), F.lit(""))
        return F.struct(
            text.alias("text"),
            F.right(preceding, F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(following, F.lit(CONTEXT_CHARS)).alias("after"),
            F.get("_bases", i).alias("base"),
            F.get("_lines", i).alias("base_line"),
        )

    return (
        block_array(F.col("text")),
        P.sums_before(F.transform("_blocks", lambda b: F.length(b))),
        P.sums_before(F.transform("_blocks", newline_count)),
        F.transform("_blocks", block),
    )


# --- context columns ---------------------------------------------------------------------------

def matched_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def line_number(text: Column, start: Column) -> Column:
    """1 + line breaks before the offset, NULL outside the text."""
    inside = (start >= 0) & (start <= F.length(text))
    return F.when(inside, newline_count(F.substring(text, F.lit(1), start)) + 1)


def context_window(text: Column, start: Column, end: Column) -> Column:
    """The match with up to 120 characters on each side."""
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    return F.substring(text, first + 1, F.least(end + CONTEXT_CHARS, F.length(text)) - first)


def context_line(text: Column, start: Column, end: Column) -> Column:
    """The whole line or lines that hold the match."""
    return F.concat(
        F.substring_index(F.substring(text, F.lit(1), start), "\n", -1),
        matched_text(text, start, end),
        F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1),
    )


# --- native detection --------------------------------------------------------------------------

def _any_in(text: Column, literals: Iterable[str]) -> Column:
    out = None
    for item in literals:
        test = F.contains(text, F.lit(item))
        out = test if out is None else out | test
    return out


def _by_recognizer(
    number: Column, active: Sequence[R.Recognizer], value_of: Callable[[R.Recognizer], Column | None], default: Column
) -> Column:
    """`CASE WHEN` on the recognizer number of a hit."""
    out = None
    for i, rec in enumerate(active):
        value = value_of(rec)
        if value is None:
            continue
        test = number == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def match_ends(matches: Column, text: Column, pattern: str) -> Column:
    """End offset of every match, in order: what stands between matches and the matches, summed up."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    return P.running_sums(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))


def feature_struct(active: Sequence[R.Recognizer], text: Column, around: Column) -> Column:
    """The cheap facts about a block that decide which patterns run."""
    needed = {r.feature for r in active}
    fields = [test(text).alias(name) for name, test in R.FEATURES.items() if name in needed]
    if needed & set(R.DIGIT_RUNS):
        fields.append(R.digit_level(text).alias("digits"))
    return F.struct(F.lower(around).alias("low"), *fields)


def has_feature(facts: Column, name: str) -> Column:
    if name in R.DIGIT_RUNS:
        return facts["digits"] > list(R.DIGIT_RUNS).index(name)
    return facts[name]


def can_match(active: Sequence[R.Recognizer], text: Column) -> Column:
    """False for texts that no recognizer can match; true when one of them has no feature."""
    needed = {r.feature for r in active}
    if None in needed:
        return F.lit(True)
    tests = [test(text) for name, test in R.FEATURES.items() if name in needed]
    runs = [pattern for name, pattern in R.DIGIT_RUNS.items() if name in needed]
    if runs:
        tests.insert(0, text.rlike(runs[0]))
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _hit(number: int, pattern: str, text: Column) -> Callable[[Column], Column]:
    return lambda m: F.when(F.size(m) > 0, F.struct(
        F.lit(number).alias("_r"), m.alias("_m"), match_ends(m, text, pattern).alias("_e")))


def candidate_hits(active: Sequence[R.Recognizer], text: Column, facts: Column, minimum: float) -> Column:
    """ARRAY<STRUCT<_r, _m, _e>>: the recognizers that matched in a text, what they matched and where it ends."""
    hits = []
    for i, rec in enumerate(active):
        found = F.regexp_extract_all(text, F.lit(rec.pattern), F.lit(0))
        if rec.words:
            found = F.when(_any_in(facts["low"], rec.words), found)
        if rec.cues and rec.score < minimum:
            # below the threshold unless a cue word is near: none in sight, no work
            found = F.when(_any_in(facts["low"], rec.cues), found)
        if rec.feature:
            found = F.when(has_feature(facts, rec.feature), found)
        hits.append(bind(found, _hit(i, rec.pattern, text)))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def detect_spans(
    docs: DataFrame, options: ScanOptions = DEFAULT_OPTIONS, keys: Sequence[str] = DOC_KEYS, lines: bool = True,
    validator: Validator | None = None,
) -> DataFrame:
    """Run the recognizers over whole texts.

    Gives keys, start, end (0-based, end exclusive, in characters of the document), entity_type,
    score, value, line_number, window and, with `lines`, line. The text itself goes no further. The line
    is repeated for every match in it; a validator that is given here sees it without that, and reads `relative_path` and `extension` among the keys.
    """
    active = tuple(R.active(options.recognizers, options.min_confidence))
    tests, steps = _row_columns(active, options.min_confidence, lines, validator, id(docs.sparkSession.sparkContext))
    found = with_blocks(docs.where(tests), keys).select(
        *keys, "base", "base_line", F.struct("text", "before", "after").alias("_b"))
    for step in steps:
        found = found.select(*(c for c in found.columns if c != "_b"), step.alias("_b"))
    # outer: for the inner form a size test is inferred and moved below this projection, where every
    # pattern would run a second time
    found = found.select(*keys, "base", "base_line", F.inline_outer("_b"))
    return found.where(F.col("entity_type").isNotNull()).select(
        *keys,
        (F.col("base") + F.col("start")).alias("start"),
        (F.col("base") + F.col("end")).alias("end"),
        "entity_type", "score", "value",
        (F.col("base_line") + F.col("line_number")).alias("line_number"),
        "window", *(["line"] if lines else []),
    )


#: A rule on (entity type, value, window, line) of a span.
Rule = Callable[[Column, Column, Column, Column], Column]


@lru_cache(maxsize=64)
def _row_columns(
    active: tuple[R.Recognizer, ...], minimum: float, lines: bool, validator: Validator | None, context: int
) -> tuple[Column, list[Column]]:
    """The expressions of `detect_spans`, built once per set of recognizers (and Spark context)."""
    rule = None if validator is None else lambda entity, value, window, line: validator(
        Context(entity, value, window, line, F.col("relative_path"), F.col("extension")))
    return can_match(active, F.col("text")), [step(F.col("_b")) for step in span_steps(active, minimum, lines, rule)]


def _values(active, number: Column, match: Column, stop: Column) -> Column:
    """ARRAY<STRUCT<r, value, start, end>>: the values inside a match that ends at `stop`."""
    value = _by_recognizer(
        number, active, lambda r: F.regexp_extract(match, r.value_pattern, 1) if r.value_pattern else None, match
    )
    trailing = _by_recognizer(number, active, lambda r: r.trailing(match) if r.trailing else None, F.lit(0))

    def placed(value: Column, start: Column) -> Column:
        return F.struct(number.alias("r"), value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"))

    one = bind(value, lambda v: F.array(placed(v, stop - trailing - F.length(v))))
    several = _by_recognizer(number, active, lambda r: r.parts(match) if r.parts else None, F.lit(None))
    if not any(r.parts for r in active):
        return one
    base = stop - F.length(match)
    return bind(several, lambda found: F.when(found.isNotNull(), F.transform(
        found, lambda p: placed(p["value"], base + p["at"]))).otherwise(one))


def _passes(active, number: Column, value: Column, before: Column, after: Column) -> Column:
    """Neighbouring characters first, then the check of the recognizer."""
    free = _by_recognizer(number, active, lambda r: _free(r, before, after), F.lit(True))
    checked = _by_recognizer(number, active, lambda r: r.check(value) if r.check else None, F.lit(True))
    edged = _by_recognizer(number, active, lambda r: r.edge_check(value, before, after) if r.edge_check else None, checked)
    return F.when(free, edged).otherwise(F.lit(False))


def block_structs(blocks: Column) -> Column:
    """ARRAY<STRUCT<text, before, after>> from a column of blocks, for work that stays in its row."""
    return F.transform(blocks, lambda b, i: F.struct(
        b.alias("text"),
        F.right(F.coalesce(F.get(blocks, i - 1), F.lit("")), F.lit(CONTEXT_CHARS)).alias("before"),
        F.left(F.coalesce(F.get(blocks, i + 1), F.lit("")), F.lit(CONTEXT_CHARS)).alias("after"),
    ))


def span_steps(
    active: Sequence[R.Recognizer], minimum: float, lines: bool = False, rule: Rule | None = None
) -> list[Callable[[Column], Column]]:
    """Functions of a block, STRUCT<text, before, after>, that one after the other give its spans.

    The spans are ARRAY<STRUCT<start, end, entity_type, score, value, line_number, window[, line]>>, null where there are none; offsets and
    line numbers are those of the block. The steps are array functions, so they serve rows of blocks and
    documents that must keep their row. `rule` keeps the spans it accepts. Each step is a projection of its
    own: lambdas are resolved level by level, and one expression for all would have too many levels.
    """
    with_lines = lines or rule is not None

    def hits(b: Column) -> Column:
        facts = feature_struct(active, b["text"], F.concat(b["before"], b["text"], b["after"]))
        return F.struct(b["text"].alias("text"), b["before"].alias("before"), b["after"].alias("after"),
                        bind(facts, lambda f: candidate_hits(active, b["text"], f, minimum)).alias("hits"))

    def values(b: Column) -> Column:
        placed = F.flatten(F.transform(b["hits"], lambda h: F.flatten(F.zip_with(
            h["_m"], h["_e"], lambda m, stop: _values(active, h["_r"], m, stop)))))
        fields = [P.text_index(F.concat(b["before"], b["text"], b["after"])).alias("index"), F.length(b["before"]).alias("shift"),
                  newline_count(b["before"]).alias("skipped"), placed.alias("placed")]
        if with_lines:
            fields.append(F.split(b["text"], "\n").alias("lines"))
        return F.when(F.size(b["hits"]) > 0, F.struct(*fields))

    def seen(b: Column) -> Column:
        index, shift = b["index"], b["shift"]
        kept = F.filter(b["placed"], lambda x: _passes(
            active, x["r"], x["value"], P.char_at(index, x["start"] + shift - 1), P.char_at(index, x["end"] + shift)))

        def around(x: Column) -> Column:
            start, end = x["start"] + shift, x["end"] + shift
            fields = [
                x["start"].alias("start"), x["end"].alias("end"), x["r"].alias("r"), x["value"].alias("value"),
                _by_recognizer(x["r"], active, lambda r: F.lit(r.entity_type), F.lit("")).alias("entity_type"),
                (P.breaks_before(index, start) - b["skipped"] + 1).alias("line_number"),
                P.between(index, F.greatest(start - CONTEXT_CHARS, F.lit(0)), end + CONTEXT_CHARS).alias("window"),
            ]
            if with_lines:
                fields.append((P.breaks_before(index, end) - b["skipped"]).alias("last_line"))
            return F.struct(*fields)

        return F.struct(F.transform(kept, around).alias("seen"), *([b["lines"].alias("lines")] if with_lines else []))

    def line_of(b: Column, x: Column) -> Column:
        return P.whole_lines(b["lines"], x["line_number"] - 1, x["last_line"])

    def spans(b: Column) -> Column:
        kept = b["seen"]
        if rule is not None:
            kept = F.filter(kept, lambda x: rule(x["entity_type"], x["value"], x["window"], line_of(b, x)))

        def scored(x: Column) -> Column:
            return F.struct(
                x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"),
                _by_recognizer(x["r"], active, lambda r: _score(r, x["window"]), F.lit(0.0)).alias("score"),
                x["value"].alias("value"), x["line_number"].alias("line_number"), x["window"].alias("window"),
                *([line_of(b, x).alias("line")] if lines else []))

        return F.filter(F.transform(kept, scored), lambda x: x["score"] >= F.lit(float(minimum)))

    return [hits, values, seen, spans]


def _free(rec: R.Recognizer, before: Column, after: Column) -> Column | None:
    tests = []
    if rec.not_before:
        tests.append(~before.rlike(rec.not_before))
    if rec.not_after:
        tests.append(~after.rlike(rec.not_after))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def _score(rec: R.Recognizer, window: Column) -> Column:
    if not rec.cues:
        return F.lit(rec.score)
    return F.when(_any_in(F.lower(window), rec.cues), F.lit(rec.cue_score)).otherwise(F.lit(rec.score))


def filter_confidence(spans: DataFrame, minimum: float) -> DataFrame:
    return spans.where(F.col("score") >= F.lit(float(minimum)))


# --- spans from elsewhere ----------------------------------------------------------------------

#: Spans that start within so many characters of a document meet its text together.
MEETING_CHARS = 1 << 20


def spans_with_docs(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Give spans of another engine the context columns that validation reads.

    The spans of a document are gathered first, so its text meets them once (once per million characters, if it is that long, so that
    no task holds all spans of a huge document); value, window and lines are then looked up in an index of the text, in its row. Spans of unknown or
    empty documents give nothing; a span that starts outside the text has no line number.
    """
    gathered = spans.groupBy(*JOIN_KEYS, F.floor(F.col("start") / MEETING_CHARS).alias("_part")).agg(
        F.collect_list(F.struct("start", "end", "entity_type", "score")).alias("_spans"))
    texts = docs.where(F.length("text") > 0).select(*JOIN_KEYS, "extension", "text")
    met = gathered.join(texts, list(JOIN_KEYS)).select(
        *DOC_KEYS, "_spans", P.text_index(F.col("text")).alias("_index"), F.split("text", "\n").alias("_lines"), F.length("text").alias("_n"))

    def with_context(x: Column) -> Column:
        start, end = x["start"], x["end"]
        first, stop = F.greatest(start, F.lit(0)), F.least(F.greatest(end, F.lit(0)), F.col("_n"))
        line = P.breaks_before(F.col("_index"), F.least(first, F.col("_n")))
        return F.struct(
            start.alias("start"), end.alias("end"), x["entity_type"].alias("entity_type"), x["score"].alias("score"),
            P.between(F.col("_index"), first, stop).alias("value"),
            F.when((start >= 0) & (start <= F.col("_n")), line + 1).alias("line_number"),
            P.between(F.col("_index"), F.greatest(start - CONTEXT_CHARS, F.lit(0)), end + CONTEXT_CHARS).alias("window"),
            P.whole_lines(F.col("_lines"), line, P.breaks_before(F.col("_index"), stop)).alias("line"))

    return met.select(*DOC_KEYS, F.transform("_spans", with_context).alias("_found")).select(*DOC_KEYS, F.inline("_found"))


UDF_SPAN_FIELDS = (
    "start int, end int, entity_type string, score double, value string, line_number int, "
    "window string, line string, error string"
)


#: Spans handed over at once.
UDF_ROWS = 5_000


def spans_from_udf(
    docs: DataFrame,
    factory: Callable[[], object],
    options: ScanOptions = DEFAULT_OPTIONS,
    language: str = "en",
    name: str = "default",
) -> DataFrame:
    """Run a Python recognizer (a language model, say) over each text.

    `factory` builds an object with `analyze(text=, language=, score_threshold=)` giving items with
    entity_type, start, end and score. It is called once per Python worker. A failure on one
    document, or on one item of it, gives one row with `error` set and no span; use `udf_spans` / `udf_errors` to split.
    """
    ship_package(docs.sparkSession)
    minimum = float(options.min_confidence)
    keys = [f for f in docs.select(*DOC_KEYS).schema.fields]
    schema = T.StructType(keys + T.StructType.fromDDL(UDF_SPAN_FIELDS).fields)

    identity = identity_of(factory)

    def run(batches):
        engine = engine_for(name, identity, factory)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                text = row.text
                if not text:
                    continue
                key = tuple(getattr(row, k) for k in DOC_KEYS)
                try:
                    found = list(engine.analyze(text=text, language=language, score_threshold=minimum))
                except Exception as exc:  # one bad document must not end the job
                    out.append(key + (None,) * 8 + (f"{type(exc).__name__}: {exc}",))
                    continue
                for item in found:
                    try:
                        score, s, e = float(item.score), int(item.start), int(item.end)
                        entity = str(item.entity_type)
                    except Exception as exc:  # nor may one odd item
                        out.append(key + (None,) * 8 + (f"{type(exc).__name__}: {exc}",))
                        continue
                    if score < minimum:
                        continue
                    line_from = text.rfind("\n", 0, s) + 1
                    line_to = text.find("\n", e)
                    out.append(key + (
                        s, e, entity, score, text[s:e],
                        text.count("\n", 0, s) + 1 if 0 <= s <= len(text) else None,
                        text[max(0, s - CONTEXT_CHARS):e + CONTEXT_CHARS],
                        text[line_from:len(text) if line_to < 0 else line_to], None,
                    ))
                    if len(out) >= UDF_ROWS:
                        yield pd.DataFrame(out, columns=schema.fieldNames())
                        out = []
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return docs.select(*DOC_KEYS, "text").mapInPandas(run, schema)


def udf_spans(result: DataFrame) -> DataFrame:
    return result.where(F.col("error").isNull()).drop("error")


def udf_errors(result: DataFrame) -> DataFrame:
    return result.where(F.col("error").isNotNull()).select(*DOC_KEYS, "error")
