"""Quality rules by distribution divergence, in native column functions only.

A document is compared with its language: the Jensen-Shannon distance between its histogram of character
classes and that of all documents of the language, and the same for the most common words of the language.
The references are counted over every document that is long enough; nothing is sampled. Common words are the
most frequent ones of the language, of whatever length and script; of equally frequent ones the first by bytes.

Defined results: a null text has no words; null is a language of its own; a text shorter than
`min_words` fails the base rules; below `sure_words` the looser class limit holds, as short histograms are rough;
a language with fewer than `min_reference` words in all gives no verdict, and its documents stay. An empty table gives no rows,
repeated rows are judged alike, and a very long text is held in one row, at several times its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from spanguard.functions.lambdas import bind
from spanguard.llm.common import SPACE, small, table, words_of
from spanguard.session import cut

#: Character classes of a word, counted one after the other in what the earlier ones leave; the rest is the last class.
SYMBOLS = "[#*$%&|<>]+"
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"""[.,;:!?'"()-]+""", SYMBOLS, r"[@^~=+/\\_{}\[\]`]+")


@dataclass(frozen=True)
class QualityOptions:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 12
    sure_words: int = 100
    class_limit: float = 0.25
    short_class_limit: float = 0.30
    word_limit: float = 0.40
    min_reference: int = 1000


def _reduced(df: DataFrame) -> DataFrame:
    """Add _class, the characters of each class: white space first, then CLASSES, then all others; needs _text and _words."""
    df = df.withColumn("_rest0", F.array_join("_words", ""))
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_rest{i + 1}", F.regexp_replace(f"_rest{i}", pattern, ""))
    left = [F.char_length("_text"), *[F.char_length(f"_rest{i}") for i in range(len(CLASSES) + 1)], F.lit(0)]
    cells = [(a - b).cast("bigint") for a, b in zip(left, left[1:])]
    return df.withColumn("_class", F.array(*cells)).drop(*[f"_rest{i}" for i in range(len(CLASSES) + 1)])


def common_words(docs: DataFrame, text: str, lang: str, options: QualityOptions) -> DataFrame:
    """One row per language: _common, its most frequent words, and _counts, how often they occur."""
    words = docs.select(F.col(lang).alias("_lang"), words_of(F.col(text).cast("string")).alias("_words"))
    # An outer explode and a condition inside the row keep the optimizer from splitting texts once more in a filter.
    counts = (words.select("_lang", F.explode_outer(F.when(F.size("_words") >= options.min_words, F.col("_words"))).alias("_word"))
              .where(F.col("_word").isNotNull())
              .groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n")))
    best = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word")
    top = (counts.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= options.common_words)
           .groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_rank", "_word", "_n"))).alias("_top")))
    return cut(top.select("_lang", F.transform("_top", lambda x: x["_word"]).alias("_common"),
                          F.transform("_top", lambda x: x["_n"]).alias("_counts")))


def class_reference(docs: DataFrame, text: str, lang: str, options: QualityOptions) -> DataFrame:
    """One row per language: _total, its words, and _class_share, over all documents that are long enough."""
    n = len(CLASSES) + 2
    rows = docs.select(F.col(lang).alias("_lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = _reduced(rows.withColumn("_words", words_of(F.col("_text")))).withColumn("_n", F.size("_words").cast("bigint"))
    enough = F.col("_n") >= options.min_words  # inside the sums, as a filter would split the texts once more
    sums = rows.groupBy("_lang").agg(
        F.sum(F.when(enough, F.col("_n"))).alias("_total"), *[F.sum(F.when(enough, F.col("_class")[i])).alias(f"_c{i}") for i in range(n)])
    chars = sum((F.col(f"_c{i}") for i in range(n)), F.lit(0))
    return cut(sums.where(F.col("_total") > 0).select("_lang", "_total", F.array(*[F.col(f"_c{i}") / chars for i in range(n)]).alias("_class_share")))


def _half(p: Column, q: Column) -> Column:
    """The part that one cell adds to the divergence, in bits."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return (part(p, q) + part(q, p)) / 2


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of the same length."""
    total = F.aggregate(F.zip_with(p, q, _half), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures, _words and _class; all columns stay."""
    body, words = F.col("_text"), F.col("_words")
    n = F.col("n_words").cast("int")
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_words", words_of(body))
    df = _reduced(df).withColumn("n_words", F.size("_words").cast("bigint"))
    df = df.withColumn("_bits", F.length(F.bin(n)).cast("int"))
    # A key holds the hash of three words in its upper bits and the place in its lower ones, so that equal windows
    # become neighbours. Windows whose hash occurs twice are then compared in full.
    df = df.withColumn("_keys", F.sort_array(F.slice(F.transform(words, lambda w, i: F.call_function(
        "shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), F.col("_bits")).bitwiseOR(i.cast("bigint"))),
        1, F.greatest(n - 2, F.lit(0)))))
    df = df.withColumn("_groups", F.transform("_keys", lambda k: F.call_function("shiftright", k, F.col("_bits"))))
    groups, mask = F.col("_groups"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits")) - 1
    df = df.withColumn("_maybe", F.filter(F.arrays_zip(
        F.col("_keys").alias("k"), groups.alias("g"), F.concat(F.array(F.lit(None).cast("bigint")), groups).alias("b"),
        F.slice(groups, 2, F.size(groups)).alias("a")),
        lambda x: (x["g"].eqNullSafe(x["b"]) | x["g"].eqNullSafe(x["a"])) & x["k"].isNotNull()))
    df = df.withColumn("_mask", mask)
    df = df.withColumn("_same", F.sort_array(F.transform("_maybe", lambda k: bind(
        k["k"].bitwiseAND(F.col("_mask")).cast("int"), lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))))
    same = F.col("_same")
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter(same, lambda x, i: F.coalesce(
        x["w"] == F.get(same, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(same, i + 1)["w"], F.lit(False))),
        lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.get(at, i + 1) - p)), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("n_repeat_words", covered.cast("bigint")).withColumn("_lines", lines)
    return df.withColumns({
        "word_chars": F.char_length("_text").cast("bigint") - F.col("_class")[0],
        "n_symbols": F.col("_class")[1 + CLASSES.index(SYMBOLS)],
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    }).drop("_text", "_bits", "_keys", "_groups", "_mask", "_maybe", "_same", "_at", "_lines")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", options: QualityOptions = QualityOptions(),
          keep: list[str] | None = None) -> DataFrame:
    """Base measures, class_distance, word_distance, base_failed and kept of every document, beside the columns `keep` (all).

    Two passes over the texts make the references, a row per language each; a third measures and judges. No text is shuffled or written.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    outputs = [*base, "class_distance", "word_distance", "base_failed", "kept"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(text).cast("string").alias("_in"), F.col(lang).cast("string").alias("_key"))
    common = common_words(rows, "_in", "_key", options)
    shares = class_reference(rows, "_in", "_key", options)
    refs = cut(shares.join(common, shares["_lang"].eqNullSafe(common["_lang"]), "left").select(
        shares["_lang"], "_total", "_class_share", "_common", "_counts"))
    df = rows.join(small(refs), rows["_key"].eqNullSafe(refs["_lang"]), "left").drop("_lang")
    df = measure(df, "_in")
    short = df.withColumn("_short", F.filter("_words", lambda w: F.array_contains(F.col("_common"), w)))
    hits = short.withColumn("_hits", F.transform("_common", lambda w: (
        F.size("_short") - F.size(F.array_remove(F.col("_short"), w))).cast("bigint")))
    df = hits.select("_row", *base, "_class", "_class_share", "_hits", "_counts", "_total")
    n, total = F.col("n_words"), F.col("_total")

    def with_rest(counts: Column, whole: Column) -> Column:
        rest = whole - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.transform(F.concat(F.array(rest), counts), lambda x: x / whole)

    chars = F.aggregate("_class", F.lit(0).cast("bigint"), lambda a, x: a + x)
    class_gap = distance(F.transform("_class", lambda c: c / chars), F.col("_class_share"))
    word_gap = distance(with_rest(F.col("_hits"), n), with_rest(F.col("_counts"), total))
    df = df.withColumns({"class_distance": F.when(total.isNotNull() & (n > 0), class_gap),
                         "word_distance": F.when(F.col("_counts").isNotNull() & (n > 0), word_gap)})
    failed = (n < options.min_words) | (100 * F.col("n_repeat_words") > options.max_repeat_percent * n)
    limit = F.when(n < options.sure_words, F.lit(options.short_class_limit)).otherwise(F.lit(options.class_limit))
    odd = (total >= options.min_reference) & (
        (F.col("class_distance") > limit) | (F.col("word_distance") > options.word_limit))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return df.select("_row.*", *outputs)


def kept_only(docs: DataFrame, text: str = "text", lang: str = "lang", options: QualityOptions = QualityOptions()) -> DataFrame:
    """The documents that pass, with their columns.

    The verdict stays out of a filter, into which the optimizer would copy all measures, each several times.
    """
    judged = judge(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_t"), F.col(lang).alias("_l")), "_t", "_l", options, ["_doc"])
    passed = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("_doc"))).alias("_doc"))
    return passed.where(F.col("_doc").isNotNull()).select("_doc.*")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base measures and the verdict."""
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.drop("class_distance", "word_distance")
