"""Near-duplicates by order MinHash, verified by banded alignment.

A sketch takes, under one hash order, the smallest few of the document's k-mers of five words, each labelled with how many times it has
occurred before, and keeps them in the order of the text. So two sketches agree where the same k-mers stand in the same
order, which edit similarity asks for and set similarity does not. Documents that agree in a sketch share a bucket.

Copies with the same words are one node. First, twice, each node meets the smallest node of its buckets, which makes a class of most families.
What is left in buckets of several classes is then paired: a bucket of at most `crowd` nodes gives its pairs of different classes. In a larger one,
mostly nodes with one passage in common, all nodes meet, too, in tiles of bounded size: nodes of lengths that can be alike, by counts of their words
in hashed slots. The words that two texts have in common are at most the sums of the lesser counts, so a pair that these rule out is no link, and all
others are tested. This work grows with the square of a crowded bucket, at some ten million pairs a second and core; nothing is left out.

A pair is a link if the edit distance of the words is at most (1 - similarity) of the longer text, found by a
bit-parallel alignment in a band of that width; the work grows with the square of the length, for texts of all lengths. Classes are the
connected components of the links. Each document is held by one row of a task, so a text must fit into a worker.

Defined results: a null text has no words, and texts without words are copies of each other; shorter texts than a k-mer are one k-mer;
repeated rows are copies; rows of one id with different words are documents of their own; rows with a null id take part like all others, and
a class of such rows has a null class_id. An empty table gives no rows. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard.llm.common import expand, mixed, settle, small, squeeze, table, words_of
from spanguard.session import ship_package


@dataclass(frozen=True)
class NearOptions:
    words: int = 5
    similarity: float = 0.8
    sketches: int = 32
    picks: int = 2
    single_rounds: int = 2
    crowd: int = 32
    tile: int = 1024
    leaders: int = 16


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)


def order_sketches(words: np.ndarray, k: int, sketches: int, picks: int) -> np.ndarray:
    """One 64-bit value per sketch of k-word k-mers; `words` holds 64-bit hashes of the words."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    grams = words[:len(words) - k + 1].copy()
    for i in range(1, k):
        grams = grams * _PRIME + words[i:len(words) - k + 1 + i]
    grams = mixed(grams)
    order = np.argsort(grams, kind="stable")
    new = np.flatnonzero(np.diff(grams[order], prepend=grams[order[0]] ^ np.uint64(1)) != 0)
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = np.arange(len(grams)) - np.repeat(new, np.diff(new, append=len(grams)))
    labelled = mixed(grams + occurrence * _PRIME)
    picks, out = min(picks, len(labelled)), np.empty(sketches, np.uint64)
    step = max(1, (1 << 15) // len(labelled))
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * _PRIME)
    for at in range(0, sketches, step):
        ranks = (labelled[None, :] ^ seeds[at:at + step, None]) * _PRIME
        ranks ^= ranks >> np.uint64(29)
        least, each = np.empty((len(ranks), picks), np.int64), np.arange(len(ranks))
        for i in range(picks):  # ranks of one document differ, so the smallest is one
            least[:, i] = ranks.argmin(axis=1)
            ranks[each, least[:, i]] = _LAST
        chosen = labelled[np.sort(least, axis=1)]  # in the order of the text
        value = seeds[at:at + step].copy()
        for i in range(picks):
            value = mixed(value * _PRIME + chosen[:, i])
        out[at:at + step] = value
    return out


def banded_distance(a: list, b: list, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most `limit`; only cells within `limit` of the diagonal are looked at."""
    if abs(len(a) - len(b)) > limit:
        return None
    head, stop = 0, min(len(a), len(b))
    while head < stop and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < stop - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    m, n = len(a), len(b)
    if not m or not n:
        return m + n if m + n <= limit else None
    limit = min(limit, max(m, n))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    mask = (1 << (2 * limit + 1)) - 1  # bit i stands for row j - limit + i of column j
    up = (mask >> limit) << limit
    down, score, turn = 0, min(m, limit), max(0, m - limit)
    top = 1 << (2 * limit)
    for j, x in enumerate(b, 1):
        found, shift = places.get(x, 0), j - limit - 1
        match = (found >> shift if shift >= 0 else found << -shift) & mask
        d = ((((match & up) + up) & mask) ^ up) | match | down
        right, left = (down | ~(d | up)) & mask, d & up
        if j <= turn:
            score += not d & top
        else:
            row = 1 << (m - j + limit)
            score += bool(right & row) - bool(left & row)
        half = d >> 1
        up, down = (left | ~(half | right)) & mask, half & right
        if score > 2 * limit + n:
            return None
    return score if score <= limit else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the edit distance is small enough; narrow bands are tried first, as copies mostly differ in a few words."""
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    x, y = a.tolist(), b.tolist()
    return any(banded_distance(x, y, min(width, limit)) is not None for width in (12, 100, limit) if width == limit or width < limit)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _words(text: str | None, hashes: _Hashes) -> np.ndarray:
    return np.array(list(map(hashes.__getitem__, (text or "").encode("utf-8", "replace").split())), np.uint64)


def _components(edges: DataFrame) -> DataFrame:
    """node and class (the smallest node) of all nodes in edges (a, b), by alternating large and small stars."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Done when every node points to one other and that one to none.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("from")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("from")))
        ends = ends.groupBy("x").agg(F.sum("from").alias("n"), F.min("from").alias("least"))
        if ends.where((F.col("n") > 1) | (F.col("n") > 0) & (F.col("least") == 0)).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(least.select("u", F.col("m").alias("v")).unionByName(rest).where("u <> v").distinct())


def _digest(text: str | None) -> str:
    return hashlib.md5(b" ".join((text or "").encode("utf-8", "replace").split())).hexdigest()


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, _c) of the buckets that hold several classes, with the number of rows of the bucket as _m."""
    several = rows.groupBy("bucket").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count("*").alias("_m"))
    return rows.select("bucket", "node", "n", "_c").join(several.where("_lo < _hi").select("bucket", "_m"), "bucket")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", options: NearOptions = NearOptions()) -> DataFrame:
    """One row per row of `docs`: key; class_id, the smallest id of its class; copy_id, the smallest id with the same words; copy, a digest of
    the words; class_copy, the digest of the row that stands for the class (the smallest id, then the smallest digest)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            rows = []
            for body in frame["text"]:
                words = _words(body, hashes)
                values = order_sketches(words, options.words, options.sketches, options.picks)
                rows.append((_digest(body), len(words), values.view(np.int64).tolist()))
            out = pd.DataFrame(rows, columns=["copy", "n", "sketches"])
            out.insert(0, "id", frame["id"].astype("Int64"))
            yield out

    slim = settle(source.mapInPandas(sketch, "id bigint, copy string, n int, sketches array<bigint>"))
    # Node numbers follow the digests, so that reruns number alike.
    copies = slim.groupBy("copy").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = settle(copies.repartition(places, "copy").sortWithinPartitions("copy").withColumn("node", F.monotonically_increasing_id()))
    keyed = copies.select("node", "n", F.posexplode("sketches").alias("j", "value")).select(
        "node", "n", F.xxhash64("j", "value").alias("bucket"), F.col("node").alias("_c"))
    rows = settle(_mixed(keyed))
    bodies = settle(_bodies(source, slim, copies, rows.select("node").distinct()))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            same = [alike(np.frombuffer(expand(x), np.uint64), np.frombuffer(expand(y), np.uint64), options.similarity)
                    for x, y in zip(frame["x"], frame["y"])]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": same})

    tested: DataFrame | None = None
    classes: DataFrame | None = None

    def in_classes(df: DataFrame) -> DataFrame:
        if classes is None:
            return df.withColumn("_c", F.col("node"))
        return df.join(classes, "node", "left").withColumn("_c", F.coalesce("class", "node")).drop("class")

    def link(pairs: DataFrame) -> None:
        """Test the pairs (a, b) that have not been tested, and add the links to the classes."""
        nonlocal tested, classes
        pairs = pairs.distinct()
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        n_pairs = pairs.count()
        if not n_pairs:
            return
        asks = small(pairs, n_pairs)  # ids only; texts are never broadcast
        with_x = asks.join(bodies.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
        with_y = asks.join(bodies.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").join(with_x, ["a", "b"])
        linked = settle(with_y.mapInPandas(verify, "a bigint, b bigint, linked boolean").where("linked").select("a", "b"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not linked.isEmpty():
            if classes is not None:
                linked = linked.unionByName(classes.select(F.col("class").alias("a"), F.col("node").alias("b")))
            classes = _components(linked)

    def lead(rows: DataFrame) -> DataFrame:
        """The smallest node of each bucket meets the nodes of other classes and leaves; the rows left in mixed buckets."""
        heads = rows.groupBy("bucket").agg(F.min(F.struct("node", "n", "_c")).alias("h"))
        heads = settle(heads.select("bucket", F.col("h._c").alias("_h"), F.col("h.node").alias("leader"), F.col("h.n").alias("size")))
        met = rows.join(heads, "bucket").where(F.col("_c") != F.col("_h"))
        met = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.least("n", "size").alias("lo"), F.greatest("n", "size").alias("hi"))
        link(met.where(_lengths("lo", "hi", options)).select("a", "b"))
        # Only the leaders leave their bucket: who is in the class of one has not met the others yet.
        gone = heads.select("bucket", F.col("leader").alias("node"))
        return settle(_mixed(settle(in_classes(rows.select("bucket", "node", "n").join(gone, ["bucket", "node"], "left_anti")))))

    for _ in range(options.single_rounds):
        if not rows.isEmpty():
            rows = lead(rows)
    if not rows.isEmpty():
        pairs = _pairs(rows.where(F.col("_m") <= options.crowd), options)
        crowded = rows.where(F.col("_m") > options.crowd)
        if not crowded.isEmpty():
            pairs = pairs.unionByName(_crowded_pairs(crowded, bodies, options)).distinct()
        pairs = settle(pairs)
        # The first few pairs of two classes mostly tell whether they are one; the other pairs are tested if they are not.
        which = in_classes(pairs.select(F.col("a").alias("node"), "b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("_c").alias("_x"))
        which = in_classes(which).select("a", F.col("node").alias("b"), F.least("_x", "_c").alias("_x"), F.greatest("_x", "_c").alias("_y"))
        first = F.row_number().over(Window.partitionBy("_x", "_y").orderBy("a", "b"))
        link(which.withColumn("_r", first).where(F.col("_r") <= options.leaders).select("a", "b"))
        rest = in_classes(pairs.select(F.col("a").alias("node"), "b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("_c").alias("_x"))
        link(in_classes(rest).where(F.col("_x") != F.col("_c")).select("a", F.col("node").alias("b")))
    named = copies.select("copy", "node", "first")
    if classes is None:
        named = named.withColumns({"class_id": F.col("first"), "class_copy": F.col("copy")})
    else:
        named = settle(named.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
        best = named.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("_none"), "first", "copy")).alias("_b"))
        named = named.join(best, "class").withColumns({"class_id": F.col("_b.first"), "class_copy": F.col("_b.copy")})
    return slim.select("id", "copy").join(named.select("copy", "first", "class_id", "class_copy"), "copy").select(
        F.col("id").alias(key), "class_id", F.col("first").alias("copy_id"), "copy", "class_copy")


def _lengths(lo: str, hi: str, options: NearOptions) -> Column:
    """Whether texts of so many words can be alike."""
    return F.col(hi) - F.col(lo) <= F.floor((1 - options.similarity) * F.col(hi) + 1e-9)


def _pairs(rows: DataFrame, options: NearOptions) -> DataFrame:
    """Pairs (a, b) of different classes of the buckets, which hold `crowd` rows at most."""
    one = F.sort_array(F.collect_list(F.struct("node", "n", "_c")))
    met = rows.groupBy("bucket").agg(one.alias("all")).select("all", F.posexplode("all").alias("i", "x"))
    met = met.select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y")).where("x._c <> y._c")
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.n", "y.n").alias("lo"), F.greatest("x.n", "y.n").alias("hi"))
    return met.where(_lengths("lo", "hi", options)).select("a", "b").distinct()


def _slots(words: np.ndarray, slots: int) -> tuple[bytes, int]:
    """How many words fall into each slot, 255 at most, and how many are above that in all."""
    counts = np.bincount((mixed(words) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), int(np.maximum(counts - 255, 0).sum())


def _band(n: int, similarity: float) -> int:
    """Band of a length: texts that can be alike are in one band or in neighbouring ones."""
    return int(np.log(max(n, 1)) / (1.001 * max(-np.log(max(similarity, 1e-6)), 0.01)))


def _band_slots(band: int, similarity: float) -> int:
    """Slots for the texts of a band and of the next one: about one for each word, as far as memory allows."""
    words = np.exp((band + 2) * 1.001 * max(-np.log(max(similarity, 1e-6)), 0.01))
    return 1 << int(min(max(np.ceil(np.log2(words)), 8), 13))


def _crowded_pairs(rows: DataFrame, bodies: DataFrame, options: NearOptions) -> DataFrame:
    """Pairs (a, b) of different classes of the buckets but those whose lengths or words rule out that they are alike.

    A tile holds two parts of a bucket, of one band of lengths and the next one: the lower band meets itself and the higher one. Two nodes that
    share several of these buckets are a pair of the first one.
    """
    similarity = options.similarity

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, packed, buckets in zip(frame["node"], frame["words"], frame["buckets"]):
                words = np.frombuffer(expand(packed), np.uint64)
                band = _band(len(words), similarity)
                for tile in (band, band - 1):
                    out.append((node, tile, tile == band, *_slots(words, _band_slots(tile, similarity)), buckets))
            yield pd.DataFrame(out, columns=["node", "band", "lower", "slots", "more", "buckets"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", kind="stable")  # so the lower band comes first
        node, n, group, part, more = (frame[c].to_numpy() for c in ("node", "n", "_c", "part", "more"))
        counts = np.frombuffer(b"".join(frame["slots"]), np.uint8).reshape(len(frame), -1)
        earlier = [set(x) for x in frame["earlier"]]
        limit = np.floor((1 - similarity) * n + 1e-9)
        one, found = bool((frame["first"] == frame["second"]).all()), []
        least = n - limit  # grows with n: the shortest text that can be alike
        stop = np.searchsorted(least, n, side="right")
        for i in range(int(frame["lower"].sum())):
            at = np.arange(i + 1, stop[i])
            at = at[(group[at] != group[i]) & ((part[at] != part[i]) | one)]
            if len(at):
                common = np.minimum(counts[at], counts[i]).sum(axis=1, dtype=np.int64) + np.minimum(more[at], more[i])
                at = [j for j in at[n[at] - common <= limit[at]] if earlier[i].isdisjoint(earlier[j])]
                found.append((np.full(len(at), node[i]), node[at]))
        x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    own = rows.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # one for each sketch at most
    marks = bodies.join(own, "node").mapInPandas(mark, "node bigint, band int, lower boolean, slots binary, more bigint, buckets array<bigint>")
    parts = F.ceil(F.col("_m") / options.tile).cast("int")
    met = rows.select("bucket", "node", "n", "_c", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    met = met.join(settle(marks), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", "band", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "lower", "node", "n", "_c", "slots", "more",
                     F.filter("buckets", lambda b: b < F.col("bucket")).alias("earlier"))
    return met.groupBy("bucket", "band", "first", "second").applyInPandas(meet, "a bigint, b bigint")


def _several(found: DataFrame, key: str) -> DataFrame:
    """Ids that stand for different texts."""
    each = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("copy").alias("_lo"), F.max("copy").alias("_hi"))
    return each.where("_lo < _hi").select(key)


def _bodies(source: DataFrame, slim: DataFrame, copies: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and words (squeezed hashes) of each wanted node; a text is found by its id, or by its digest if its id is null or has several texts."""
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "words": [squeeze(_words(x, hashes).tobytes()) for x in frame["text"]]})

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            yield pd.DataFrame({"copy": [_digest(x) for x in frame["text"]], "words": [squeeze(_words(x, hashes).tobytes()) for x in frame["text"]]})

    several = settle(_several(slim, "id"))
    named = copies.join(wanted, "node", "left_semi").select("copy", "node", F.col("first").alias("id"))
    plain = named.where(F.col("id").isNotNull()).join(several, "id", "left_anti").select("id", "node")
    by_id = source.join(plain, "id").dropDuplicates(["id"]).select("node", "text").mapInPandas(hashed, "node bigint, words binary")
    odd = source.where(F.col("id").isNull()).unionByName(source.join(several, "id", "left_semi")).select("text")
    by_copy = odd.mapInPandas(digested, "copy string, words binary").dropDuplicates(["copy"]).join(named.select("copy", "node", "id"), "copy")
    by_copy = by_copy.join(several.withColumn("_s", F.lit(True)), "id", "left").where("id is null or _s").select("node", "words")
    return by_id.unionByName(by_copy)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", options: NearOptions = NearOptions()) -> DataFrame:
    """One document of each class: the one with the smallest id, of several texts of that id the one with the smallest digest."""
    found = settle(near_classes(docs, key, text, options))
    stay = found.where(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("class_copy")))
    stay = settle(stay.select(F.col(key).alias("_id"), F.col("copy").alias("_copy")).distinct())
    several = settle(_several(found, key).select(F.col(key).alias("_id")))
    row = docs.select(F.col(key).cast("bigint").alias("_id"), F.struct(*docs.columns).alias("_doc"))
    plain = row.join(stay.join(several, "_id", "left_anti").where(F.col("_id").isNotNull()).select("_id"), "_id", "left_semi")
    odd = row.where(F.col("_id").isNull()).unionByName(row.join(several, "_id", "left_semi"))
    odd = odd.withColumn("_copy", F.md5(F.array_join(words_of(F.col(f"_doc.{text}").cast("string")), " ")))
    odd = odd.withColumn("_id", F.coalesce("_id", F.lit(0))).join(  # digests tell null from 0: a copy stands for one class
        stay.withColumn("_id", F.coalesce("_id", F.lit(0))), ["_id", "_copy"], "left_semi")
    return plain.dropDuplicates(["_id"]).select("_doc.*").unionByName(odd.dropDuplicates(["_copy"]).select("_doc.*"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document and whether it is the one that stays."""
    found = near_classes(table(spark, sf_dir, "documents"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("class_copy"))
    return found.select("doc_id", "class_id", stays.alias("kept"))
