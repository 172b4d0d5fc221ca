"""Removal of repeated passages with suffix arrays built by two-stage sorting.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id. Documents are packed to
blocks. Two equal strings of `length` bytes share the smallest hash of their k-mers, so this hash is a key that brings equal
strings together wherever they are:

1. each block sends the keys of its strings, 32 bits each, and learns which occur in other documents;
2. strings with such a key are sorted within the block: only suffixes smaller than their successor are sorted directly, all others
   are induced by scanning the buckets of first bytes in order; adjacent common prefixes tell equal strings;
3. of each string, the document with the smallest id goes on to the task of its key, where strings of all blocks are sorted
   in the same way; with very many blocks this takes several rounds, so that a passage of a third of all documents never
   meets in one task.

No string is decided by its hash: hashes only choose where strings meet.

Blocks and buckets both grow in number with the input, and every block has keys for every bucket. So more is sent at once than is sorted
at once: a row to a bucket holds what `group` blocks send, and beyond the first 256 buckets, a bucket holds `group` times the keys that are
sorted together. That makes fewer rows by up to the square of `group`, while the memory of a sort stays.

Defined results: a null text is empty; documents shorter than `length` bytes stay as they are; a null id counts as the largest long; documents of
equal id do not remove each other's text; all is judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanguard.llm.common import expand, give_back, mixed, pack_blocks, rest_of, squeeze, table, unpack
from spanguard.session import ship_package

_CHUNK = 1 << 17
_HASHED = 1 << 14
_RUN = 64


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """The number of type `kind` that begins at each byte of `text`."""
    width = np.dtype(kind).itemsize
    return np.ndarray(max(0, len(text) - width + 1), kind, text, strides=(1,))


def _sorted_directly(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in the order of their suffixes, by comparison of some bytes at a time; what differs by then is not looked at again."""
    words = _words(np.append(text, np.zeros(8, np.uint8)), ">u8")
    heads = words[starts].astype(np.uint64)
    order = np.argsort(heads)
    starts, heads = starts[order], heads[order]
    del order
    new = np.append(True, heads[1:] != heads[:-1])
    at, done = np.arange(len(starts), dtype=np.int32), 8
    while done < depth:
        tied = ~(new & np.append(new[1:], True))
        if not tied.any():
            break
        at, group = at[tied], np.cumsum(new[tied], dtype=np.uint64)
        width = (64 - int(group[-1]).bit_length()) // 8
        part = starts[at]
        # A tied group keeps its places, so its number goes before the next bytes.
        heads = group << np.uint64(8 * width) | words[part + done].astype(np.uint64) >> np.uint64(64 - 8 * width)
        order = np.argsort(heads)
        starts[at], heads = part[order], heads[order]
        new = np.append(True, heads[1:] != heads[:-1])
        done += width
    return starts


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in the order of their suffixes, exact to `depth` bytes, by two-stage sorting.

    `text` holds bytes 1 to 255 in strings that end with a 0, and `depth` zeros at its end.
    """
    small = np.ones(len(text), bool)  # suffixes smaller than their successor; ends count as such
    np.greater(text[1:], text[:-1], out=small[:-1])
    alike = np.flatnonzero(text[1:] == text[:-1])  # in a run of one byte all are as the last one
    cuts = np.flatnonzero(np.diff(alike, append=len(text)) != 1)
    small[alike] = np.repeat(small[alike[cuts] + 1], np.diff(cuts, prepend=-1))
    small |= text == 0
    del alike, cuts
    # A suffix is induced from its successors up to the first small one.
    stop = np.minimum.accumulate(np.where(small, np.arange(len(text), dtype=np.int32), np.int32(len(text)))[::-1])[::-1][starts]
    reach = -np.bincount(stop + 1, minlength=len(text) + 1).astype(np.int32)
    del stop
    reach[starts] += 1
    used = np.cumsum(reach[:-1], dtype=np.int32) > 0
    del reach
    direct = _sorted_directly(text, np.flatnonzero(used & small).astype(np.int32), depth)
    induced = used & ~small
    heads = text[direct]
    limits = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def scan(part: np.ndarray) -> None:
        """Put each large suffix that precedes a sorted one at the end of the large part of its bucket."""
        order.append(part)
        before = part[part > 0] - 1
        before = before[induced[before]]
        if len(before):
            bytes_ = text[before]
            by_byte = np.argsort(bytes_, kind="stable")
            before, bytes_ = before[by_byte], bytes_[by_byte]
            cuts = np.flatnonzero(np.diff(bytes_)) + 1
            for group in np.split(before, cuts):
                waiting[text[group[0]]].append(group)

    for byte in range(256):
        while waiting[byte]:  # a run of one byte induces into its own bucket
            part = np.concatenate(waiting[byte])
            waiting[byte] = []
            scan(part)
        if limits[byte + 1] > limits[byte]:
            scan(direct[limits[byte]:limits[byte + 1]])
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    found = np.concatenate(order)
    return found[wanted[found]]


def same_as_before(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix has a common prefix of at least `depth` bytes with the one before it in order."""
    width = min(8, 1 << depth.bit_length() - 1)
    words = _words(text, f"u{width}")
    out = np.zeros(len(order), bool)
    for at in range(1, len(order), _CHUNK):
        one, two = order[at - 1:at + _CHUNK - 1], order[at:at + _CHUNK]
        one, same = one[:len(two)], np.arange(len(two))
        for step in [depth - width, *range(0, depth - width, width)]:  # neighbours in order differ near their ends
            same = same[words[one[same] + step] == words[two[same] + step]]
        out[at + same] = True
    return out


def smaller_elsewhere(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """For each start, whether the same `depth` bytes start in a document with a smaller id. `starts` ascend; `ids` belong to them."""
    if not len(starts):
        return np.zeros(0, bool)
    order = sort_suffixes(text, starts, depth)
    first = np.flatnonzero(~same_as_before(text, order, depth))
    index = np.empty(len(text), np.int32)
    index[starts] = np.arange(len(starts), dtype=np.int32)
    place = index[order]
    mine = ids[place]
    least = np.repeat(np.minimum.reduceat(mine, first), np.diff(first, append=len(order)))
    out = np.zeros(len(starts), bool)
    out[place] = mine > least
    return out


def window_keys(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each string of `length` bytes the smallest hash of its k-mers."""
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    span = length - k + 1
    for at in range(0, len(out), _HASHED):  # what is hashed at once stays in the cache
        part = data[at:at + _HASHED + length - 1]
        known, size = {1: part.astype(np.uint64) + np.uint64(1)}, 1
        power = {1: 0x9E3779B97F4A7C15}
        while size * 2 <= k:
            known[size * 2] = known[size][:-size] * np.uint64(power[size]) + known[size][size:]
            power[size * 2] = power[size] * power[size] % 2**64
            size *= 2
        h, done = known[size], size
        for step in sorted(known, reverse=True):
            if k - done >= step:
                h = h[:len(h) - step] * np.uint64(power[step]) + known[step][done:done + len(h) - step]
                done += step
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if span > width:
            h = np.minimum(h[:len(h) - (span - width)], h[span - width:])
        out[at:at + len(h)] = h
    return out


def key_runs(data: np.ndarray, starts: np.ndarray, length: int, k: int):
    """Runs of neighbouring strings of one document with one key: key, start, number of strings, document (an index)."""
    n = len(data)
    keys = window_keys(data, length, k)
    if not len(keys):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 3
    sizes = np.diff(starts)
    fits = np.arange(len(keys), dtype=np.int32) + length <= np.repeat(starts[1:], sizes)[:len(keys)]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (fits[1:] & ~fits[:-1])
    new |= ~fits
    begin = np.flatnonzero(new)
    ends = np.append(begin[1:], len(keys))
    ok = fits[begin]
    begin, ends = begin[ok], ends[ok]
    doc = np.searchsorted(starts, begin, side="right") - 1
    # Smallest hashes are small: they are mixed once more, so that buckets of equal ranges get equal shares.
    return mixed(keys[begin]), begin.astype(np.int32), (ends - begin).astype(np.int32), doc.astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    return squeeze(b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = expand(data)
    sizes = np.frombuffer(raw[:8 * len(kinds)], np.int64)
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s:e], kind) for e, s, kind in zip(ends, sizes, kinds)]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, small ones of either sign as small numbers, all their first bytes before all their second ones: these pack well."""
    steps = np.diff(x.astype(np.int64), prepend=0)
    return np.ascontiguousarray((steps << 1 ^ steps >> 63).view(np.uint8).reshape(-1, 8).T)


def _sums(planes: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum((steps >> 1 & np.int64(2**63 - 1)) ^ -(steps & 1))


def _pack_segments(subs: np.ndarray, counts: np.ndarray, ids: np.ndarray, blocks: np.ndarray, at: np.ndarray, data: np.ndarray) -> bytes:
    """Segments: parts of the bucket, numbers of strings, document ids, blocks, places in the block, bytes."""
    return _pack(subs.astype(np.uint8), counts.astype(np.uint8), _steps(ids), _steps(blocks), _steps(at), data)


def _unpack_segments(packed: bytes) -> list[np.ndarray]:
    subs, counts, ids, blocks, at, data = _unpack(packed, *[np.uint8] * 6)
    return [subs, counts, _sums(ids), _sums(blocks), _sums(at), data]


def _spans(owners: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (owner, place) as runs of neighbours: owner, first place, number of strings."""
    cuts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owners, prepend=-1) != 0))
    return owners[cuts], at[cuts], np.diff(cuts, append=len(at))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other; 32 bits wide where they fit."""
    size = size.astype(np.int64)
    total = int(size.sum())
    kind = np.int32 if not len(begin) or total < 1 << 30 and int(begin.max()) + int(size.max()) < 1 << 30 else np.int64
    out = np.repeat((begin - np.concatenate([[0], np.cumsum(size)[:-1]])).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def _strings(segments: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (data, numbers of strings) as one text with a 0 behind each, and the starts of all strings."""
    counts = np.concatenate([c for _, c in segments]).astype(np.int64)
    data = np.concatenate([d for d, _ in segments])
    sizes = counts + length - 1
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()) + length, np.uint8)
    text[_ranges(at, sizes)] = data + 1  # UTF-8 has no byte 255
    return text, _ranges(at, counts).astype(np.int32)


def _split(keys, begin, size):
    """Runs of at most _RUN strings."""
    parts = (size + _RUN - 1) // _RUN
    at = _ranges(np.zeros(len(size), np.int64), parts)
    index = np.repeat(np.arange(len(size)), parts)
    return keys[index], begin[index] + at * _RUN, np.minimum(_RUN, size[index] - at * _RUN)


_PART = "kind int, bucket bigint, block bigint, data binary"
#: Bytes of strings that are gathered before they are sent, and that a row holds at most.
_HAND_OVER = 16 << 20
#: So many buckets hold what is sorted at once; more than these grow instead.
_SMALL_BUCKETS = 255


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "data"])


def removed_strings(blocks: DataFrame, length: int = 50, k: int = 24, per_bucket: int = 1 << 17, fan_in: int = 4096, group: int = 8) -> DataFrame:
    """family and data: packed blocks, starts and numbers of strings that a document with a smaller id has, too. `blocks` have a column family."""
    blocks = blocks.select("family", "block", "ids", "sizes", "data", "n_bytes")
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n_keys = int(total) // 14
    bits = min(30, max(n_keys // (per_bucket * group), min(n_keys // per_bucket, _SMALL_BUCKETS)).bit_length())
    # Strings take several times the memory of keys, so those of a quarter of `per_bucket` keys are sorted at once.
    sub_bits = min(8, max(0, (4 * n_keys // per_bucket).bit_length() - bits))
    top, rest = np.uint64(64 - bits), np.uint64(32 - bits)

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> top).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    def part_of(keys: np.ndarray) -> np.ndarray:
        """Bucket and part of the bucket, as one number."""
        return (keys >> np.uint64(64 - bits - sub_bits)).astype(np.int64) if bits + sub_bits else np.zeros(len(keys), np.int64)

    def distinct(keys: np.ndarray, docs: np.ndarray):
        """Distinct keys in order, whether each is in several documents, and the place of each run's key."""
        order = np.argsort(keys)
        ordered, held = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(held, first) < np.maximum.reduceat(held, first) if len(keys) else np.zeros(0, bool)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        return ordered[first], several, place

    def edges_of(keys: np.ndarray) -> np.ndarray:
        """Where the buckets begin among keys in order."""
        return np.searchsorted(bucket_of(keys), np.arange((1 << bits) + 1))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row to a bucket: how many keys each block of the family sends, 32 bits of each, and whether several of the block's documents have it."""
        def message(family: int, held: list) -> pd.DataFrame:
            rows = []
            for bucket in range(1 << bits):
                counts, keys, several = np.zeros(group, np.int32), [], []
                for slot, low, many, edges in held:
                    a, b = edges[bucket:bucket + 2]
                    counts[slot] = b - a
                    keys.append((slot, low[a:b].tobytes()))
                    several.append((slot, many[a:b]))
                if counts.any():
                    ordered = [x for _, x in sorted(several, key=lambda x: x[0])]
                    rows.append((0, bucket, family, b"".join([counts.tobytes(), *[x for _, x in sorted(keys)], np.packbits(np.concatenate(ordered)).tobytes()])))
            return _frame(rows)

        now, held = None, []
        for frame in frames:
            for row in frame.itertuples():
                if held and now != row.family:
                    yield message(now, held)
                    held = []
                now = row.family
                _, starts, data = unpack(row.ids, row.sizes, row.data)
                keys, _, _, docs = key_runs(np.frombuffer(data, np.uint8), starts, length, k)
                keys, several, _ = distinct(keys, docs)
                held.append((row.block % group, ((keys >> rest) & np.uint64(0xFFFFFFFF)).astype(np.uint32), several, edges_of(keys)))
                del data, keys, docs, several
                give_back()
        if held:
            yield message(now, held)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """To each row, its numbers of keys and whether another document has each."""
        heads = [x[:4 * group] for x in frame["data"]]
        sizes = [int(np.frombuffer(x, np.int32).sum()) for x in heads]
        values = np.concatenate([np.frombuffer(x, np.uint32, n, 4 * group) for x, n in zip(frame["data"], sizes)])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * (group + n)), count=n) for x, n in zip(frame["data"], sizes)]).astype(bool)
        order = np.argsort(values)
        ordered = values[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        held = np.diff(first, append=len(values))
        shared = np.empty(len(values), bool)
        shared[order] = np.repeat((held > 1) | np.logical_or.reduceat(several[order], first), held)
        ends = np.cumsum(sizes)
        out = _frame([(1, b, family, head + np.packbits(shared[e - n:e]).tobytes())
                      for b, family, head, e, n in zip(frame["bucket"], frame["block"], heads, ends, sizes)])
        del values, several, order, ordered, first, held, shared
        give_back()
        return out

    answers = blocks.mapInPandas(send, _PART).groupBy("bucket").applyInPandas(answer, _PART)
    answers = answers.groupBy(F.col("block").alias("family")).agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))

    def removed(owners: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Messages, by family, that strings go; to any bucket, as they only pass."""
        order = np.argsort(owners, kind="stable")
        owners, at, n = owners[order], at[order], n[order]
        families = owners // group
        cuts = np.flatnonzero(np.diff(families, prepend=-1))
        buckets = (mixed(families[cuts].astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        return [(3, bucket, families[a], _pack(owners[a:b], at[a:b].astype(np.int64), n[a:b].astype(np.int64)))
                for bucket, a, b in zip(buckets, cuts, np.append(cuts[1:], len(owners)))]

    def strings_on(parts: np.ndarray, counts: np.ndarray, ids: np.ndarray, owners: np.ndarray, at: np.ndarray, data: np.ndarray) -> list[tuple]:
        """Messages, by bucket, of segments with their bytes one after the other."""
        order = np.argsort(parts, kind="stable")
        sizes = counts.astype(np.int64) + length - 1
        offset = (np.cumsum(sizes) - sizes)[order]
        parts, counts, ids, owners, at, sizes = (x[order] for x in (parts, counts, ids, owners, at, sizes))
        # A row holds the strings of one bucket, of a bounded number of bytes.
        pieces = np.cumsum(sizes) // _HAND_OVER
        cuts = np.flatnonzero((np.diff(parts >> sub_bits, prepend=-1) != 0) | (np.diff(pieces, prepend=0) != 0))
        return [(2, parts[a] >> sub_bits, owners[a], _pack_segments(
            parts[a:b] & ((1 << sub_bits) - 1), counts[a:b], ids[a:b], owners[a:b], at[a:b], data[_ranges(offset[a:b], sizes[a:b])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(parts)))]

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, spans, n_left = [], [], 0

        def message() -> pd.DataFrame:
            nonlocal left, spans, n_left
            rows = removed(*[np.concatenate(x) for x in zip(*spans)]) if spans else []
            rows += strings_on(*[np.concatenate(x) for x in zip(*left)]) if left else []
            left, spans, n_left = [], [], 0
            return _frame(rows)

        for frame in frames:
            for row in frame.itertuples():
                ids, starts, raw = unpack(row.ids, row.sizes, row.data)
                data = np.frombuffer(raw, np.uint8)
                keys, begin, size, docs = key_runs(data, starts, length, k)
                known, _, place = distinct(keys, docs)
                edges = edges_of(known)
                shared, slot = np.zeros(len(known), bool), row.block % group
                for x in row.answers:
                    counts = np.frombuffer(x["data"], np.int32, group)
                    if counts[slot]:
                        bits_of = np.unpackbits(np.frombuffer(x["data"], np.uint8, offset=4 * group), count=int(counts[:slot + 1].sum()))
                        shared[edges[x["bucket"]]:edges[x["bucket"] + 1]] = bits_of[-counts[slot]:]
                own = shared[place]
                keys, begin, size, docs = keys[own], begin[own], size[own], docs[own]
                del known, place, shared, own
                if not len(keys):
                    continue
                # The block's text with a 0 behind each document; a string's place moves by its document's number.
                text = np.zeros(len(data) + len(ids) + length, np.uint8)
                text[_ranges(starts[:-1] + np.arange(len(ids)), np.diff(starts))] = data + 1
                at = _ranges(begin, size)
                which = np.repeat(docs, size)
                gone = smaller_elsewhere(text, (at + which).astype(np.int32), ids[which], length)
                if gone.any():
                    spans.append(_spans(np.full(int(gone.sum()), row.block, np.int64), at[gone]))
                if not gone.all():
                    run, b2, s2 = _split(*_spans(np.repeat(np.arange(len(keys)), size)[~gone], at[~gone]))
                    order = np.argsort(part_of(keys[run]), kind="stable")
                    run, b2, s2 = run[order], b2[order], s2[order]
                    left.append((part_of(keys[run]), s2, ids[docs[run]], np.full(len(run), row.block, np.int64), b2, data[_ranges(b2, s2 + length - 1)]))
                    n_left += len(left[-1][-1])
                if n_left >= _HAND_OVER:
                    yield message()
                del raw, data, text, at, which, gone, keys, begin, size, docs
                give_back()
        yield message()

    def across(last: bool):
        def meet(frame: pd.DataFrame) -> pd.DataFrame:
            """Strings of the keys of a bucket: those removed and, but in the last round, those that go on; what is removed already passes."""
            rows = list(frame.loc[frame["kind"] == 3, ["kind", "bucket", "block", "data"]].itertuples(index=False, name=None))
            frame = frame[frame["kind"] == 2]
            if not len(frame):
                return _frame(rows)
            bucket = int(frame["bucket"].iloc[0])
            subs, counts, ids, owners, places, data = (np.concatenate(x) for x in zip(*map(_unpack_segments, frame["data"])))
            sizes = counts.astype(np.int64) + length - 1
            offset = np.cumsum(sizes) - sizes
            order = np.argsort(subs, kind="stable")
            ends = np.cumsum(np.bincount(subs))
            spans, left = [], []
            for a, b in zip(np.append(0, ends), ends):
                if a == b:
                    continue
                own = order[a:b]
                n = counts[own].astype(np.int64)
                text, starts = _strings([(data[_ranges(offset[own], sizes[own])], n)], length)
                gone = smaller_elsewhere(text, starts, np.repeat(ids[own], n), length)
                segment, inner = np.repeat(own, n), _ranges(np.zeros(len(n), np.int64), n)
                if gone.any():
                    spans.append(_spans(owners[segment[gone]], places[segment[gone]] + inner[gone]))
                if not last and not gone.all():
                    one, i, m = _spans(segment[~gone], inner[~gone])
                    left.append((subs[one] | np.int64(bucket << sub_bits), m, ids[one], owners[one], places[one] + i, data[_ranges(offset[one] + i, m + length - 1)]))
            rows += removed(*[np.concatenate(x) for x in zip(*spans)]) if spans else []
            rows += strings_on(*[np.concatenate(x) for x in zip(*left)]) if left else []
            del subs, counts, ids, owners, places, data, sizes, offset, order, spans, left, text, starts, gone, segment, inner, own, n
            give_back()
            return _frame(rows)
        return meet

    held = blocks.join(answers, "family").mapInPandas(within, _PART)
    groups = max(1, -(-int(n_blocks) // group))
    while True:
        groups = max(1, -(-groups // fan_in))
        # What is removed travels with the strings, so that a round is computed once.
        held = held.groupBy("bucket", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("_g")).applyInPandas(across(groups == 1), _PART)
        if groups == 1:
            return held.where("kind = 3").select(F.col("block").alias("family"), "data")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, block_bytes: int = 2 << 20,
                   per_bucket: int = 1 << 17, fan_in: int = 4096, keep: list[str] | None = None, as_text: bool = False, group: int = 8) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept of every document, behind the columns `keep` (the key alone).

    `kept` holds the remaining bytes or, `as_text`, what they spell, without characters that a cut goes through.
    """
    ship_package(docs.sparkSession)
    columns = [key] if keep is None else keep
    # Blocks that follow each other in a task are a family: they send and get their messages together.
    blocks = pack_blocks(docs, key, text, block_bytes, keep=columns).withColumn("family", F.expr(f"block div {group}"))
    spans = removed_strings(blocks, length, per_bucket=per_bucket, fan_in=fan_in, group=group).groupBy("family").agg(F.collect_list("data").alias("spans"))
    outputs = ["n_bytes", "n_removed", "n_spans", "kept"]
    columns = [c for c in columns if c not in outputs]

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                _, starts, raw = unpack(row["ids"], row["sizes"], row["data"])
                edge = np.zeros(len(raw) + 1, np.int32)
                for x in row["spans"] or ():
                    owners, first, n = _unpack(x, np.int64, np.int64, np.int64)
                    first, n = first[owners == row["block"]], n[owners == row["block"]]
                    np.add.at(edge, first, 1)
                    np.subtract.at(edge, first + n + length - 1, 1)
                gone = np.cumsum(edge[:-1]) > 0
                data, found = np.frombuffer(raw, np.uint8), []
                for a, b in zip(starts, starts[1:]):
                    out = gone[a:b]
                    runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if b > a else 0
                    left = data[a:b][~out].tobytes()
                    found.append((int(b - a), int(out.sum()), runs, left.decode("utf-8", "ignore") if as_text else left))
                rest = rest_of(row["rest"])
                cells = [rest.field(c) for c in columns]
                cells += [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
                yield pa.RecordBatch.from_arrays(cells, names=[*columns, *outputs])
                del row, raw, edge, gone, data, found, cells, rest
                give_back()

    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in outputs[:3]] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return blocks.join(spans, "family", "left").select("block", "ids", "sizes", "data", "rest", "spans").mapInArrow(clear, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages take from every document, and a digest of what is left."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
