"""Mixing sources to target weights by Pareto order sampling, in native column functions only.

Each source gets a target in words: its share by weight of a total, at most `max_copies` times its size, the
excess reshared by weight. All documents of a source are first taken the same whole number of times. For the rest each
document gets an inclusion probability that grows slowly with its length, and documents are ranked by the
odds of a random number divided by the odds of that probability; the sample is the head of this order whose words come nearest
to what is missing. The order is never sorted as a whole: words are summed by (source, slice of the order), and only
the slice where the target falls is sorted.

Defined results: a null text has no words, is never taken and keeps its row; a null source is a source of its own and
comes last. Random numbers come from the id and the length, so reruns agree; equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanguard.llm.common import small, table, words_of
from spanguard.operators.position import with_position
from spanguard.session import cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """_source, _source_size, _mass, _target of a table (_source, _source_size, _mass): one row per source, at any number of sources."""
    placed = with_position(sizes, [], [F.col("_source").asc_nulls_last()], "_place")
    cells = F.array(*[F.lit(w) for w in weights])
    weighed = cut(placed.withColumn("_w", F.get(cells, (F.col("_place") % len(weights)).cast("int"))))
    cap = F.col("_source_size") * max_copies
    level, capped = 0.0, -1
    wanted = None
    while True:
        full = cap < F.lit(level) * F.col("_w")
        row = weighed.agg(
            F.sum("_source_size").alias("all"), F.sum(F.when(full, cap)).alias("taken"), F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(~full, F.col("_w"))).alias("open")).first()
        wanted = share * (row["all"] or 0)
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (wanted - (row["taken"] or 0)) / row["open"]
    return weighed.select("_source", "_source_size", "_mass", F.least(cap.cast("double"), F.lit(level) * F.col("_w")).alias("_target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
        weights: tuple[int, ...] = WEIGHTS, max_copies: int = 2, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Every document with size, source_size, target and copies, beside the columns `keep` (all); copies may be 0."""
    outputs = ("size", "source_size", "target", "copies")
    columns = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    size = F.size(words_of(F.col(text).cast("string"))).cast("bigint")

    def measured(*more: str) -> DataFrame:
        rows = docs.select(*([F.struct(*more).alias("_row")] if more else []), F.col(key).alias("_key"),
                           F.col(source).cast("string").alias("_source"), size.alias("_size"))
        digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.col("_size").cast("string")))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return rows.withColumn("_u", u).withColumn("_g", F.floor(F.sqrt(F.sqrt(F.col("_size"))) * 1000))

    rows = cut(measured())
    sums = rows.groupBy("_source").agg(
        F.sum("_size").alias("_source_size"), F.sum(F.col("_size") * F.col("_g")).alias("_mass"), F.count(F.lit(1)).alias("_n"))
    sums = cut(sums)
    total = sums.agg(F.sum("_n")).first()[0] or 0
    slices = 1 << max(10, (total // 1000).bit_length())
    plan = source_targets(sums.drop("_n"), share, weights, max_copies)
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("_whole", whole).withColumn("_missing", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    plan = cut(plan.withColumnRenamed("_source", "_s"))

    def placed(frame: DataFrame) -> DataFrame:
        """Each document with its place in the Pareto order of its source."""
        df = frame.join(small(plan), frame["_source"].eqNullSafe(plan["_s"])).drop("_s")
        raw = F.when(F.col("_mass") > 0, F.col("_missing") * F.col("_g") / F.col("_mass")).otherwise(F.lit(0.0))
        df = df.withColumn("_p", F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6)))
        df = df.withColumn("_q", (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))
        return df.withColumn("_slice", F.floor(F.col("_q") / (1 + F.col("_q")) * slices))

    sized = placed(rows)
    by_slice = sized.groupBy("_source", "_slice").agg(F.sum("_size").alias("_words"), F.first("_missing").alias("_need"))
    order = Window.partitionBy("_source").orderBy("_slice")
    by_slice = by_slice.withColumn("_through", F.sum("_words").over(order))
    edge = cut(by_slice.where((F.col("_through") > F.col("_need")) & (F.col("_through") - F.col("_words") <= F.col("_need")) & (F.col("_need") > 0))
               .select(F.col("_source").alias("_s"), F.col("_slice").alias("_edge"), (F.col("_through") - F.col("_words")).alias("_before"))
               .groupBy("_s").agg(F.min_by(F.struct("_edge", "_before"), "_edge").alias("_e")).select("_s", "_e.*"))
    # The documents themselves are read again here; only numbers were written before.
    sized = placed(measured(*columns))
    sized = sized.join(small(edge), sized["_source"].eqNullSafe(edge["_s"]), "left").drop("_s")
    # No edge: the target is reached by all rows, or nothing is missing.
    clear = sized.where(F.col("_edge").isNull() | (F.col("_slice") != F.col("_edge"))).withColumn(
        "_more", F.when(F.col("_missing") <= 0, 0).when(F.col("_edge").isNull(), 1).otherwise((F.col("_slice") < F.col("_edge")).cast("int")))
    near = sized.where(F.col("_slice") == F.col("_edge"))
    head = Window.partitionBy("_source").orderBy("_q", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("_before") + F.coalesce(F.sum("_size").over(head), F.lit(0)) + F.col("_size") / 2
    near = near.withColumn("_run", run).withColumn("_more", (F.col("_run") < F.col("_missing")).cast("int")).drop("_run")
    copies = F.when(F.col("_size") > 0, F.col("_whole") + F.col("_more")).otherwise(0).cast("int")
    return clear.unionByName(near).select(
        "_row.*", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with their columns, each row as often as it is taken."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(source).alias("_o")),
                "_k", "_t", "_o", keep=["_doc"], **options)
    taken = mixed.select(F.explode_outer(F.when(F.col("copies") > 0, F.array_repeat("_doc", F.col("copies")))).alias("_doc"))
    return taken.where(F.col("_doc").isNotNull()).select("_doc.*")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each, repeats counted."""
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
