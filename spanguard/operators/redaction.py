"""Masking of sensitive values inside whole documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanguard import rules
from spanguard.functions.lambdas import bind
from spanguard.functions.redact import redact_value
from spanguard.operators import spans as S
from spanguard.operators import validate
from spanguard.options import DEFAULT_OPTIONS, ScanOptions
from spanguard.session import cut, ship_package


def masked(text: Column, spans: Column) -> Column:
    """Replace each span of a text by its mask.

    `spans` is ARRAY<STRUCT<start INT, end INT, mask STRING>>. Spans are taken by start, longest
    first. One that lies inside an earlier one is already masked; one that sticks out has its rest
    starred, so no kept value shows through.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["mask"].alias("mask"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["neg_end"]
        gap = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        added = (
            F.when(s["start"] >= acc["pos"], F.concat(gap, s["mask"]))
            .when(end > acc["pos"], F.repeat(F.lit("*"), end - acc["pos"]))
            .otherwise(F.lit(""))
        )
        return F.struct(F.greatest(acc["pos"], end).alias("pos"), F.concat(acc["out"], added).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return bind(F.aggregate(ordered, start, step),
                lambda done: F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text))))


def redact_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with every span of `spans` masked in place, as `redacted_text`.

    The masks are gathered per document and joined to it. Documents without spans keep their text.
    """
    masks = spans.groupBy(*S.JOIN_KEYS).agg(
        F.collect_list(F.struct("start", "end", redact_value(F.col("entity_type"), F.col("value")).alias("mask")))
        .alias("_masks")
    )
    joined = docs.join(masks, list(S.JOIN_KEYS), "left")
    text = F.when(F.col("_masks").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("_masks")))
    return joined.select(*docs.columns, text.alias("redacted_text"))


def redact_documents(
    docs: DataFrame, options: ScanOptions = DEFAULT_OPTIONS, validator: validate.Validator = validate.should_keep
) -> DataFrame:
    """Detect, validate and mask, all inside the row of the document: no text is shuffled."""
    active = tuple(S.R.active(options.recognizers, options.min_confidence))
    tests, steps, clean = _row_columns(active, options.min_confidence, validator, id(docs.sparkSession.sparkContext))
    out = docs.select(*docs.columns, F.when(tests, S.block_array(F.col("text"))).alias("_blocks"))
    out = out.select(*docs.columns, "_blocks", S.block_structs(F.col("_blocks")).alias("_found"))
    for step in steps:
        out = out.select(*docs.columns, "_blocks", step.alias("_found"))
    return out.select(*docs.columns, F.coalesce(clean, F.col("text")).alias("redacted_text"))


@lru_cache(maxsize=16)
def _row_columns(active, minimum: float, validator: validate.Validator, context: int) -> tuple[Column, list[Column], Column]:
    """The expressions of `redact_documents`, built once per choice of rules (and Spark context)."""
    path, extension = F.col("relative_path"), F.col("extension")

    def rule(entity: Column, value: Column, window: Column, line: Column) -> Column:
        return validator(validate.Context(entity, value, window, line, path, extension))

    def clean(block: Column, found: Column) -> Column:
        masks = F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            redact_value(x["entity_type"], x["value"]).alias("mask")))
        return F.when(F.size(found) > 0, masked(block, masks)).otherwise(block)

    steps = [F.transform("_found", step) for step in S.span_steps(active, minimum, rule=rule)]
    return S.can_match(active, F.col("text")), steps, F.array_join(F.zip_with("_blocks", "_found", clean), "")


#: Keys with more logs than this are dealt over several tasks; at most HOT_KEYS keys can be, whatever the table.
KEY_LOGS = 50_000
HOT_KEYS = 10_000


class SecretMask:
    """Replaces secrets in texts: the leftmost, there the longest, and on behind it, in one pass over the text."""

    def __init__(self, secrets: list[str]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for secret in secrets:
            if secret:
                self.trie.add_word(secret, len(secret))
        self.empty = len(self.trie) == 0
        if not self.empty:
            self.trie.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if self.empty or not text:
            return text
        out, at = [], 0
        for last, size in self.trie.iter_long(text):
            out += (text[at:last + 1 - size], rules.REDACTION_MARKER)
            at = last + 1
        return "".join((*out, text[at:])) if at else text


def mask_logs(logs: DataFrame, secrets: DataFrame, keys: list[str], column: str, key_logs: int = KEY_LOGS) -> DataFrame:
    """Mask, in each log text, all secrets that belong to its key; texts without one stay as they are, and so do all rows.

    Logs go to the task of their key, where the secrets of the key come first and are made to one automaton, through which its logs stream.
    So the work is linear in the texts, however many secrets a key has, and a log never carries them. The logs of a key with more
    than `key_logs` rows are dealt over several tasks, each with the secrets of the key. A null key has no secrets; null and empty
    secrets mask nothing. Of secrets that overlap in a text, the one that begins first goes, then the longer.
    """
    spark = logs.sparkSession
    ship_package(spark)
    counts = cut(logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    limit = max(key_logs, math.ceil(total / HOT_KEYS))  # so at most HOT_KEYS keys are above it
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    held = secrets.where(known & (F.col("secret") != "")).select(*keys, "secret").distinct().join(hot, keys, "left").select(
        *keys, F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"), F.lit(0).alias("_kind"), F.col("secret").cast("string").alias("_text"))
    rows = logs.join(hot, keys, "left").select(
        *keys, F.pmod(F.xxhash64(F.monotonically_increasing_id()), copies).cast("int").alias("_copy"), F.lit(1).alias("_kind"),
        F.col(column).cast("string").alias("_text"), F.struct(*[F.col(c) for c in logs.columns]).alias("_row"))
    name = f"masked_{column}"
    schema = T.StructType([rows.schema["_row"], T.StructField("_masked", T.StringType())])
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, mask = None, [], None
        for batch in batches:
            texts, kinds = batch.column(count + 2).to_pylist(), batch.column(count + 1).to_pylist()
            places = list(zip(*(batch.column(i).to_pylist() for i in range(count + 1))))
            out = []
            for place, kind, text in zip(places, kinds, texts):
                if place != key:
                    key, waiting, mask = place, [], None
                if kind == 0:
                    waiting.append(text)
                    continue
                if mask is None:
                    mask, waiting = SecretMask(waiting), []
                out.append(mask(text))
            own = batch.filter(pa.array([k == 1 for k in kinds]))
            yield pa.RecordBatch.from_arrays([own.column(count + 3), pa.array(out, pa.string())], names=["_row", "_masked"])

    met = held.unionByName(rows, allowMissingColumns=True).repartition(*keys, "_copy").sortWithinPartitions(*keys, "_copy", "_kind")
    done = met.select(*keys, "_copy", "_kind", "_text", "_row").mapInArrow(run, schema)
    return done.select(*[F.col("_row")[c].alias(c) for c in logs.columns if c != name], F.col("_masked").alias(name))
