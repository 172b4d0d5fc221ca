"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a byte string exactly one token can be the last one of its encoding. The encoder stores it: the
last token of a prefix is the token that ends there and whose left neighbour, the last token of the shorter prefix,
would not merge with it. Whether two tokens may stand side by side depends on the two alone and is remembered.
So bytes can be appended without a new start, and after an edit the prefixes before it stay as they are and those behind it need
work only until they agree with the earlier ones again.

Texts are cut by the pattern first, and each match is encoded on its own. Defined results: a null text is an empty one; ids have no
special tokens; any text round-trips.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.llm.common import give_back, table, texts_of
from spanguard.session import ship_package

MULTI = "byte_bpe_multi_50k.tiktoken"
_REMEMBER = 200_000
_HEAD = 6


class _Recent(dict):
    """Values met before. When there are too many they become the old ones, of which those that are met again stay."""

    def __init__(self, make, limit=_REMEMBER):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        known = self.old.get(key)
        self[key] = value = self.make(key) if known is None else known
        return value


class PrefixBPE:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        # Lengths of the tokens that end in given three bytes, the longest first; shorter tokens may end anywhere.
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {last: (*sorted(x, reverse=True), 2, 1) for last, x in lengths.items()}
        self.longest = max(map(len, ranks))
        self.alone: dict[int, bool] = {}
        self.joined: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[int, bool] = {}  # by left << 32 | right
        self.packed = _Recent(lambda piece: struct.pack("<%dI" % len(ids := self.encode_bytes(piece.encode("utf-8", "replace"))), *ids))
        # Pieces begin alike: the prefix tokens of a beginning are worked out once, and the rest is appended to them.
        self.heads = _Recent(self.prefixes, _REMEMBER // 4)

    @classmethod
    def load(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> PrefixBPE:
        with open(path, "rb") as rows:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}, pattern)

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """The encoding by merging the pair of lowest rank, leftmost first, down to `stop` tokens; used on single tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; none for a single byte."""
        if token not in self.joined:
            parts = self.merge(self.bytes_of[token], 2)
            self.joined[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.joined[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two.

        Merges come in the order of rank. Going back in time, the token of higher rank comes apart first, the right one
        of two equal ones, as merges go from left to right. A pair across the seam that joins with a lower
        rank than what has come apart would have been joined before that.
        """
        ranks, names = self.ranks, self.bytes_of
        undone = 1 << 60
        while True:
            both = ranks.get(names[left] + names[right])
            if both is not None and both < undone:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def fits(self, left: int | None, right: int) -> bool:
        """Whether `right` may follow `left`, or begin a piece if there is none."""
        if left is None:
            known = self.alone.get(right)
            if known is None:
                known = self.alone[right] = self.merge(self.bytes_of[right]) == [right]
            return known
        known = self.beside.get(left << 32 | right)
        if known is None:
            if len(self.beside) > 2 * _REMEMBER:
                self.beside.clear()
            known = self.beside[left << 32 | right] = self.stay_apart(left, right)
        return known

    def prefixes(self, data: bytes, last: list[int | None] | None = None, stop: int | None = None) -> list[int | None]:
        """The last token of each prefix of data[:stop]; `last` holds those of its first prefixes already, and is appended to."""
        last = [None] if last is None else last
        ranks, beside, fits, lengths, short = self.ranks.get, self.beside.get, self.fits, self.lengths.get, (2, 1)
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            for size in lengths(data[end - 3:end], short) if end > 2 else short:
                if size < end:
                    token = ranks(data[end - size:end])
                    if token is not None:
                        left = last[end - size]
                        known = beside(left << 32 | token)
                        if known or known is None and fits(left, token):
                            last.append(token)
                            break
                elif size == end:
                    token = ranks(data[:end])
                    if token is not None and fits(None, token):
                        last.append(token)
                        break
            else:
                raise ValueError("the rank table has no token for a byte")
        return last

    def edited(self, old: bytes, last: list[int | None], start: int, stop: int, new: bytes) -> tuple[bytes, list[int | None]]:
        """old[start:stop] replaced by new: the bytes and their prefix tokens, worked out near the edit only.

        Behind the edit the tokens are the earlier ones as soon as they agree at as many places in a row as the longest token has bytes.
        """
        data = old[:start] + new + old[stop:]
        shift = len(data) - len(old)
        out, same = last[:start + 1], 0
        for end in range(start + 1, len(data) + 1):
            self.prefixes(data, out, end)
            behind = end - start - len(new)
            same = same + 1 if behind > 0 and out[end] == last[end - shift] and behind >= len(self.bytes_of[out[end]]) else 0
            if same >= self.longest:
                return data, out + last[end - shift + 1:]
        return data, out

    def walk(self, last: list[int | None]) -> list[int]:
        """The encoding of the whole string, read back from its prefix tokens."""
        end, ids = len(last) - 1, []
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.walk(self.prefixes(piece, self.heads[piece[:_HEAD]].copy()))

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[str, PrefixBPE] = {}


def encoder(path: str) -> PrefixBPE:
    """One encoder per worker process and rank file."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE.load(path)
    return _LOADED[path]


def _column(batches: Iterator[pa.RecordBatch], make, kind: pa.DataType, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Replace the last column, some rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([make(x.as_py()) for x in batch.column(batch.num_columns - 1)], kind)], names=batch.schema.names)
        give_back()


def encode_texts(docs: DataFrame, path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Replace the text by its ids, packed as little-endian unsigned 32-bit integers; all other columns stay."""
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, output)]
    source = docs.select(*keep, F.col(text).cast("string").alias(output))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from _column(batches, lambda x: bpe.encode_packed(x or ""), pa.binary())

    return source.mapInArrow(run, source.withColumn(output, F.col(output).cast("binary")).schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the bytes that the packed ids stand for; all columns stay."""
    ship_package(encoded.sparkSession)
    keep = [c for c in encoded.columns if c != output]
    source = encoded.select(*keep, F.col(ids).alias(output))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from _column(batches, lambda x: bpe.decode(np.frombuffer(x or b"", "<u4").tolist()), pa.binary())

    return source.mapInArrow(run, source.schema)


def digests(decoded: DataFrame, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Replace ids and decoded bytes by n_tokens, ids_sha256 and decoded_sha256."""
    keep = [c for c in decoded.columns if c not in (ids, output, "n_tokens", "ids_sha256", "decoded_sha256")]
    return decoded.select(*keep, (F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(output, 256).alias("decoded_sha256"))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path(MULTI)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(decode_ids(encode_texts(docs, path), path))
