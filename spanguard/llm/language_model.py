"""Scores of texts by an interpolated bigram model, its weights learned by deleted interpolation.

P(w | v) = a(b) c(v, w) / c(v) + (1 - a(b) - z(b)) c(w) / N + z(b) / (V + 1), where b is a bucket of how often the context v occurs. The
weights of each bucket are learned by expectation-maximisation on held-out counts: a tenth of the training documents is left out of the counts for
this. The final counts are those of all training documents.

Documents are packed to blocks. A block sends its distinct words and bigrams with their counts to the task of their hash, where the
counts of all blocks are summed, and gets the sums back in the order sent. So counts travel once each way, words and
texts never, and each of the held-out texts is held against the counts without itself. The maximisation runs over arrays of (bucket, bigram share, word
share) that stay where they are; each step returns a few sums per bucket.

A key is a 64-bit hash, of which the place it is sent to and 48 further bits are told apart, one of them by whether it is a word or a bigram, so no
word meets a bigram: two of a million bigrams of one place fall together with a probability of less than 1 in 200. There are as many places as the
corpus asks for; counts are 64-bit numbers, sent as 32-bit ones where all of a message fit.

Defined results: a null text is empty and has one token, its end; a null id counts as the text "null" for the split and comes back as null; an empty
table gives no rows; repeated rows are documents of their own; other columns are not looked at; without any training document all scores are those of
V = N = 0. A document lies in one block, so a text must fit into a worker several times over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.llm.common import expand, mixed, pack_blocks, squeeze, table
from spanguard.session import cut, ship_package

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = 40
_IS_WORD = np.uint64(1 << 16)  # the lowest bit of a key that always travels
KEPT, LEFT_OUT, TEST = 0, 1, 2


def split_of(key: Column) -> Column:
    """2 for test documents (crc32 of the id as text, modulo 7, is 2), 1 for those left out of the counts, 0 for the others."""
    code = F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.when(code % 7 == 2, TEST).when(F.floor(code / 7) % 10 == 0, LEFT_OUT).otherwise(KEPT).cast("int")


class _Numbers(dict):
    """Numbers of words from 2 on, as they come."""

    def __init__(self):
        super().__init__()
        self.next = count(2).__next__

    def __missing__(self, word):
        self[word] = value = self.next()
        return value


class Tokens:
    """Tokens of a block: hashes of distinct words, the word of each token, and where documents begin."""

    def __init__(self, data: bytes, starts: np.ndarray):
        get = _Numbers()
        lowered = data.lower()  # A-Z only, as bytes
        ids, sizes = [], []
        for a, b in zip(starts, starts[1:]):
            found = list(map(get.__getitem__, lowered[a:b].split()))
            ids.extend(found)
            ids.append(0)
            sizes.append(len(found) + 1)
        self.tokens = np.array(ids, np.int32)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, get), np.uint64, len(get))
        self.words = mixed(np.concatenate([[np.uint64(1), np.uint64(2)], words]))  # 0: the end, 1: the beginning
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.starts[:-1]] = 1
        pairs = context.astype(np.int64) * len(self.words) + self.tokens
        self.context = context
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        before, after = np.divmod(self.pairs, len(self.words))
        self.pair_keys = mixed(self.words[before] * _PRIME + self.words[after])
        # Keys of words and bigrams in one order, and where each of them stands in it.
        keys = np.concatenate([self.words | _IS_WORD, self.pair_keys & ~_IS_WORD])
        order = np.argsort(keys, kind="stable")
        self.order = order
        self.keys = keys[order]

    def counts(self) -> np.ndarray:
        """How often each key occurs, in key order; the beginning counts once per document."""
        words = np.bincount(self.tokens, minlength=len(self.words))
        words[1] = len(self.starts) - 1
        return np.concatenate([words, np.bincount(self.pair, minlength=len(self.pairs))])[self.order]

    def spread(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values in key order, by word and by bigram."""
        out = np.empty(len(values), values.dtype)
        out[self.order] = values
        return out[:len(self.words)], out[len(self.words):]


def _tokens(row) -> Tokens:
    starts = np.concatenate([[0], np.cumsum(np.frombuffer(row.sizes, np.int64))])
    return Tokens(expand(row.data), starts)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 if unseen, else one more than the whole part of its binary logarithm."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, _BUCKETS - 1), 0)


def _shares(block: Tokens, counts: np.ndarray, words_n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: bucket, bigram share, word share, count of the word."""
    word, pair = block.spread(counts)
    before = word[block.context]
    both = pair[block.pair]
    one = word[block.tokens]
    return bucket_of(before), both / np.maximum(before, 1), one / max(words_n, 1.0), one


def wide(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers if all fit, else as 64-bit ones, behind a byte that tells which."""
    size = 4 if not counts.size or counts.max() < 1 << 32 else 8
    return bytes([size]) + counts.astype(f"u{size}").tobytes()


def unwide(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], f"u{data[0]}").astype(np.int64)


class Model:
    """Weights by bucket: rows of (bigram, word, rest)."""

    def __init__(self, weights: np.ndarray, n: int, v: int):
        self.weights, self.n, self.v = weights, n, v

    def parts(self, bucket: np.ndarray, two: np.ndarray, one: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        w = (self.weights if weights is None else weights)[bucket]
        return w * np.stack([two, one, np.full(len(two), 1 / (self.v + 1))], axis=1)


_PART = "bucket bigint, block bigint, kind int, data binary"


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 12, block_bytes: int = 6 << 20,
          per_bucket: int = 1 << 20) -> tuple[DataFrame, DataFrame, Model]:
    """Blocks of documents, the counts sent back to each block, and the model."""
    ship_package(docs.sparkSession)
    # Documents without an id have blocks of their own.
    kind = split_of(F.col(key)) + F.when(F.col(key).cast("bigint").isNull(), 4).otherwise(0)
    blocks = pack_blocks(docs, key, text, block_bytes, kind).withColumn("named", F.col("kind") < 4).withColumn("kind", (F.col("kind") % 4).cast("int"))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = (int(total) // 8 // per_bucket).bit_length()

    def bucket(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = _tokens(row)
                counts = block.counts()
                buckets = bucket(block.keys)
                cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
                rows = []
                low = block.keys >> np.uint64(max(0, 16 - bits))  # its lower 48 bits travel; the place tells the others
                is_word = block.order < len(block.words)
                is_word &= block.order != 1  # the beginning is no token
                for a, b in zip(cuts, np.append(cuts[1:], len(buckets))):
                    part = low[a:b]
                    body = squeeze(np.int64(b - a).tobytes() + (part & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (part >> np.uint64(32)).astype(np.uint16).tobytes()
                                   + is_word[a:b].astype(np.uint8).tobytes() + wide(counts[a:b]))
                    rows.append((buckets[a], row.block, row.kind, body))
                yield pd.DataFrame(rows, columns=["bucket", "block", "kind", "data"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        bodies = [expand(x) for x in frame["data"]]
        sizes = [int.from_bytes(x[:8], "little") for x in bodies]
        parts = [(x[8:], n) for x, n in zip(bodies, sizes)]
        keys = np.concatenate([np.frombuffer(x[:4 * n], np.uint32).astype(np.uint64) | (np.frombuffer(x[4 * n:6 * n], np.uint16).astype(np.uint64) << np.uint64(32))
                               for x, n in parts])
        is_word = np.concatenate([np.frombuffer(x[6 * n:7 * n], np.uint8) for x, n in parts])
        counts = np.concatenate([unwide(x[7 * n:]) for x, n in parts])
        kinds = np.repeat(frame["kind"].to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)) != 0)
        held = np.diff(first, append=len(keys))
        kept = np.add.reduceat(np.where(kinds == KEPT, counts, 0)[order], first)
        all_ = kept + np.add.reduceat(np.where(kinds == LEFT_OUT, counts, 0)[order], first)
        words = is_word[order][first].astype(bool)
        back = np.empty((2, len(keys)), np.int64)
        back[0, order], back[1, order] = np.repeat(kept, held), np.repeat(all_, held)
        rows, end = [], 0
        for block, kind, n in zip(frame["block"], frame["kind"], sizes):
            rows.append((frame["bucket"].iloc[0], block, kind, squeeze(wide(back[:, end:end + n]))))
            end += n
        facts = np.array([(words & (kept > 0)).sum(), (words & (all_ > 0)).sum(), kept[words].sum(), all_[words].sum()], np.int64)
        rows.append((frame["bucket"].iloc[0], -1, -1, facts.tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "kind", "data"])

    counts = cut(blocks.mapInPandas(send, _PART).groupBy("bucket").applyInPandas(add, _PART))
    # Distinct words and tokens, summed over the places.
    def fact(i: int) -> Column:
        digits = F.hex(F.substring(F.col("data"), 8 * i + 1, 8))
        turned = F.concat(*[F.substring(digits, 15 - 2 * j, 2) for j in range(8)])
        return F.coalesce(F.sum(F.conv(turned, 16, 10).cast("bigint")), F.lit(0).cast("bigint"))

    v_kept, v_all, n_kept, n_all = counts.where("kind = -1").agg(*[fact(i) for i in range(4)]).first()

    def events(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = _tokens(row)
                found, two, one, _ = _shares(block, _joined(row.answers, 0), n_kept)
                yield pd.DataFrame([(squeeze(found.astype(np.uint8).tobytes() + two.tobytes() + one.tobytes()),)], columns=["data"])

    held = cut(with_counts(blocks.where(F.col("kind") == LEFT_OUT), counts).mapInPandas(events, "data binary"))
    model = Model(np.full((_BUCKETS, 3), 1 / 3), int(n_kept), int(v_kept))
    for _ in range(rounds):
        weights = model.weights

        def expect(frames: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            sums = np.zeros((_BUCKETS, 3))
            for frame in frames:
                for data in frame["data"]:
                    raw = expand(data)
                    n = len(raw) // 17
                    found = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
                    parts = model.parts(found, np.frombuffer(raw[n:9 * n], np.float64), np.frombuffer(raw[9 * n:], np.float64), weights)
                    parts /= parts.sum(axis=1, keepdims=True)
                    for i in range(3):
                        sums[:, i] += np.bincount(found, parts[:, i], minlength=_BUCKETS)
            yield pd.DataFrame({"b": np.arange(_BUCKETS), "s0": sums[:, 0], "s1": sums[:, 1], "s2": sums[:, 2]})

        found = held.mapInPandas(expect, "b int, s0 double, s1 double, s2 double").groupBy("b").agg(
            *[F.sort_array(F.collect_list(f"s{i}")).alias(f"s{i}") for i in range(3)])
        found = found.select("b", *[F.aggregate(f"s{i}", F.lit(0.0), lambda a, x: a + x).alias(f"s{i}") for i in range(3)])
        sums = np.zeros((_BUCKETS, 3))
        for r in found.collect():  # one row per frequency bucket
            sums[r["b"]] = r["s0"], r["s1"], r["s2"]
        seen = sums.sum(axis=1, keepdims=True)
        everywhere = sums.sum(axis=0) / sums.sum() if sums.sum() > 0 else np.full(3, 1 / 3)
        # A little of the mean keeps every bucket, seen or not, away from weights of nothing.
        model = Model((sums + everywhere * 1.0 + 1e-3) / (seen + 1.0 + 3e-3), model.n, model.v)
    return blocks, counts, Model(model.weights, int(n_all), int(v_all))


def with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    answers = counts.where("kind >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias("answers"))
    return blocks.join(answers, "block")


def _joined(answers, which: int) -> np.ndarray:
    """The counts sent back to a block, in key order: 0 of the kept, 1 of all training documents."""
    parts = [unwide(expand(x["data"])).reshape(2, -1)[which] for x in answers]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    blocks, counts, model = train(docs, key, text, **options)
    n, v = model.n, model.v

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = _tokens(row)
                found, two, one, seen = _shares(block, _joined(row.answers, 1), n)
                logs = np.log10(model.parts(found, two, one).sum(axis=1))
                base = np.log10((seen + 1) / (n + v + 1))
                at = block.starts[:-1]
                yield pd.DataFrame({
                    "id": pd.array(np.frombuffer(row.ids, np.int64) if row.named else [None] * (len(block.starts) - 1), "Int64"), "held_out": row.kind == TEST, "n_tokens": np.diff(block.starts),
                    "n_known": np.add.reduceat((seen > 0).astype(np.int64), at), "train_tokens": n,
                    "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at)})

    out = with_counts(blocks, counts).mapInPandas(
        run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", key)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document."""
    return score(table(spark, sf_dir, "documents"))
