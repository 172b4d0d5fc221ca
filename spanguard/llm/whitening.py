"""Whitening of embeddings by an incremental eigendecomposition.

1. One pass counts the vectors and sums their whole-number components exactly, so that every later pass centres before it multiplies.
2. Each task keeps the spectrum (eigenvalues, eigenvectors) of the scatter of the vectors that it has seen and applies centred vectors as
   rank-one updates: the new eigenvalues are the roots of the secular equation, components that the vector does not touch and
   equal eigenvalues are deflated, and the eigenvectors follow from the corrected vector that has these very roots. Batches of
   `compact` times d centred vectors are first turned to d vectors with the same scatter (the triangular factor), so that an update serves `compact` rows.
3. The spectra of the tasks are combined in a tree; the eigenpairs of one are successive rank-one updates of the other.
4. Rayleigh-Ritz refinement: a pass projects all vectors on the eigenvectors and sums the products; the eigenvectors of this small matrix
   turn the basis. A further pass measures the whitened covariance; it is repeated until its error is small.

A vector length of d costs d^2 numbers a task and in the driver, never anything that grows with the rows. Sums go through a tree of `fan_in`.
The table is read once a pass and should give the same rows each time.

Defined results: rows whose vector is null, empty or holds null or non-finite entries take no part; of vectors of several lengths only those of the
most frequent length do (the shorter, if two are equally frequent); a null id stays null; repeated rows each count and each return; components whose
eigenvalue is 0 up to rounding have no whitened value and are left out, so a table of equal vectors and an empty one give no rows;
whole components are held within 2^48; a deviation beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.llm.common import table
from spanguard.session import cut, ship_package

_EPS = np.finfo(np.float64).eps
_LIMIT = float(1 << 48)
#: Rows that are held as whole numbers at once.
_BATCH = 8192


def secular_roots(poles: np.ndarray, squares: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + weight * sum(squares / (poles - x)) as (pole next to it, difference from that pole).

    `poles` rise strictly, weight and squares are positive. All roots are narrowed at once between their poles by a rational step that keeps both poles,
    and by halving where that leaves the bracket.
    """
    n = len(poles)
    at = np.arange(n)
    gap = np.append(np.diff(poles), weight * squares.sum())
    middle = poles + gap / 2
    left = 1 + weight * (squares[:, None] / (poles[:, None] - middle[None, :])).sum(axis=0) >= 0
    near = np.where(left | (at == n - 1), at, at + 1)
    from_near = poles[:, None] - poles[near][None, :]
    upper_pole = np.append(from_near[at[1:], at[:-1]], gap[-1])
    low = np.where(left, 0.0, np.where(at == n - 1, gap / 2, -gap / 2))
    high = np.where(left, gap / 2, np.where(at == n - 1, gap, 0.0))
    x = (low + high) / 2
    below = np.where(at[:, None] <= at[None, :], squares[:, None], 0.0)
    with np.errstate(all="ignore"):
        for _ in range(100):
            away = from_near - x
            inverse = 1 / away
            value = 1 + weight * (squares @ inverse)
            done = np.abs(value) <= _EPS * n * (1 + weight * (squares @ np.abs(inverse)))
            if done.all():
                break
            low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
            inverse *= inverse
            head = weight * np.einsum("ij,ij->j", below, inverse)
            tail = weight * (squares @ inverse) - head
            d0, d1 = away[at, at], upper_pole - x
            a = (d0 + d1) * value - d0 * d1 * (head + tail)
            b, c = d0 * d1 * value, value - d0 * head - d1 * tail
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where((step > low) & (step < high), step, (low + high) / 2)
            if np.all(done | (np.abs(step - x) <= _EPS * np.abs(x))):
                break
            x = np.where(done, x, step)
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the matrix given by its own, plus weight times the outer product of v; weight >= 0."""
    z = vectors.T @ v
    square = float(z @ z)
    if not square * weight > 0:
        return values, vectors
    weight *= square
    z = z / math.sqrt(square)
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), weight)
    vectors = vectors.copy()
    values = values.copy()
    active = np.flatnonzero(weight * np.abs(z) > tolerance)
    # Equal eigenvalues: turn their plane so that only the later one is touched.
    if len(active) > 1:
        i, j = active[:-1], active[1:]
        product = np.abs(z[i] * z[j]) / (z[i] ** 2 + z[j] ** 2)
        if np.any((values[j] - values[i]) * product <= tolerance):
            kept, last = [], active[0]
            for here in active[1:]:
                length = math.hypot(z[last], z[here])
                c, s = z[here] / length, z[last] / length
                if (values[here] - values[last]) * abs(c * s) <= tolerance:
                    first, second = vectors[:, last].copy(), vectors[:, here].copy()
                    vectors[:, last], vectors[:, here] = c * first - s * second, s * first + c * second
                    a, b = values[last], values[here]
                    values[last], values[here] = a * c * c + b * s * s, a * s * s + b * c * c
                    z[last], z[here] = 0.0, length
                else:
                    kept.append(last)
                last = here
            active = np.array([*kept, last])
            active = active[np.argsort(values[active], kind="stable")]
    n = len(active)
    if not n:
        return values, vectors
    poles, touched = values[active], z[active]
    near, x = secular_roots(poles, touched * touched, weight)
    from_roots = (poles[:, None] - poles[near][None, :]) - x  # pole i minus root j
    # The vector for which the computed roots are exact keeps the eigenvectors orthogonal.
    i, j = np.arange(n)[:, None], np.arange(n - 1)[None, :]
    partner = np.where(j < i, j, j + 1)
    ratios = -from_roots[:, :-1] / (poles[partner] - poles[:, None])
    exact = np.sqrt(np.abs(ratios.prod(axis=1) * from_roots[:, -1] / weight))
    turned = np.copysign(exact, touched)[:, None] / from_roots
    turned /= np.sqrt((turned * turned).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ turned
    values[active] = poles[near] + x
    if np.any(values[1:] < values[:-1]):
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: count and sums of the fit list, components as rows, eigenvalues, shares of the trace, measured error."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _whole(column: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable rows of a list column, their lengths, and their components floor(scale * c) + offset one after another."""
    offsets, valid = np.asarray(column.offsets, np.int64), np.asarray(column.is_valid())
    lengths = np.where(valid, np.diff(offsets), 0)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    fine = np.isfinite(flat.fill_null(math.nan).to_numpy(zero_copy_only=False))
    bad = np.concatenate([[0], np.cumsum(~fine)])
    starts = offsets[:-1] - offsets[0]
    usable = valid & (bad[starts + lengths] == bad[starts])
    numbers = np.where(fine, flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(numbers * scale) + offset, -_LIMIT, _LIMIT).astype(np.int64)
    inside = np.repeat(usable, np.diff(offsets))
    return np.flatnonzero(usable), lengths[usable], whole[inside]


def _matrix(column: pa.Array, dim: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that take part, and their whole components."""
    rows, lengths, flat = _whole(column, scale, offset)
    if len(rows) and np.any(lengths != dim):
        flat = flat[np.repeat(lengths == dim, lengths)]
        rows = rows[lengths == dim]
    return rows, flat.reshape(len(rows), dim)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly; as Python integers where 64 bits may not do."""
    top = int(np.abs(x).max()) if x.size else 0
    if n * top + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(centred: np.ndarray) -> pa.Array:
    """Sums of squares as 64-bit integers, null beyond."""
    rough = (centred.astype(np.float64) ** 2).sum(axis=1)
    if centred.dtype != object and (not len(rough) or rough.max() < 2.0**62):
        return pa.array((centred * centred).sum(axis=1), pa.int64())
    exact = [sum(int(c) ** 2 for c in row) if r < 2.0**64 else 1 << 64 for row, r in zip(centred, rough)]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def _fold(parts: DataFrame, combine: Callable[[list[bytes]], bytes], fan_in: int) -> bytes | None:
    """One value out of rows (part, data), combined in a tree whose groups hold at most `fan_in` rows."""
    left = parts.count()
    while left > 1:
        groups = math.ceil(left / fan_in)

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")
            return pd.DataFrame({"part": [int(frame["group"].iloc[0])], "data": [combine(list(frame["data"]))]})

        # Parts are numbered without a gap, so that groups are of one size.
        parts = parts.select("part", "data", F.floor(F.col("part") / F.lit(fan_in)).alias("group"))
        parts = parts.groupBy("group").applyInPandas(run, "part bigint, data binary")
        left = groups
    row = parts.select("data").first()
    return None if row is None else bytes(row["data"])


def _numbered(df: DataFrame) -> DataFrame:
    """Rows (task, data), at most one a task, written once and numbered from 0."""
    rows = cut(df)
    tasks = [r["task"] for r in rows.select("task").orderBy("task").collect()]  # a number a task
    if tasks == list(range(len(tasks))):
        return rows.withColumnRenamed("task", "part")
    places = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tasks)] or [], "task bigint, part bigint")
    return rows.join(places, "task").select("part", "data")


def _add(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p, np.float64) for p in parts], axis=0).tobytes()


def _spectrum(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(data, np.float64)
    return numbers[:dim], numbers[dim:].reshape(dim, dim)


def fit(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100_000,
        fan_in: int = 16, compact: int = 16, tolerance: float = 1e-10, rounds: int = 6) -> Whitening | None:
    """The whitening of all vectors with whole components floor(scale * c) + offset; None if none of them varies."""
    ship_package(vectors.sparkSession)
    source = vectors.select(F.col(vector).cast("array<double>").alias("v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            _, lengths, flat = _whole(batch.column(0), scale, offset)
            for dim in np.unique(lengths[lengths > 0]):
                x = flat[np.repeat(lengths == dim, lengths)].reshape(-1, dim)
                for at in range(0, len(x), _BATCH):  # 2^13 components below 2^48 stay within 64 bits
                    mine = held.setdefault(int(dim), [0, np.zeros(dim, object)])
                    mine[0] += len(x[at:at + _BATCH])
                    mine[1] = mine[1] + x[at:at + _BATCH].sum(axis=0).astype(object)
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))],
                names=["dim", "n", "sums"])

    counted = cut(source.mapInArrow(count, "dim int, n bigint, sums array<decimal(38,0)>"))
    chosen = counted.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()
    if chosen is None:
        return None
    dim, n = chosen["dim"], int(chosen["n"])
    by_place = counted.where(F.col("dim") == dim).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    sums = tuple(int(r["s"]) for r in by_place.orderBy("i").collect())  # a row per component

    def deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            _, x = _matrix(batch.column(0), dim, scale, offset)
            for at in range(0, len(x), _BATCH):
                yield x[at:at + _BATCH]

    def row_of(data: np.ndarray) -> pa.RecordBatch:
        from pyspark import TaskContext
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data.tobytes()], pa.binary())],
                                          names=["task", "data"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, basis, seen = np.zeros(dim), np.eye(dim), False
        for x in deltas(batches):
            rows = _centred(x, n, sums).astype(np.float64) / n
            for at in range(0, len(rows), compact * dim):
                some = rows[at:at + compact * dim]
                for v in some if len(some) <= dim else np.linalg.qr(some, mode="r"):
                    values, basis = rank_one(values, basis, 1.0, v)
            seen = seen or len(x) > 0
        if seen:
            yield row_of(np.concatenate([values, basis.ravel()]))

    def merge(parts: list[bytes]) -> bytes:
        values, basis = _spectrum(parts[0], dim)
        for other in parts[1:]:
            for weight, v in zip(*(lambda e, u: (e, u.T))(*_spectrum(other, dim))):
                values, basis = rank_one(values, basis, max(float(weight), 0.0), v)
        return np.concatenate([values, basis.ravel()]).tobytes()

    fan = max(2, min(fan_in, (256 << 20) // (8 * dim * dim)))
    _, basis = _spectrum(_fold(_numbered(source.mapInArrow(grow, "task bigint, data binary")), merge, fan), dim)
    basis = np.linalg.qr(basis[:, ::-1])[0]  # falling eigenvalues

    def projected(turn: np.ndarray) -> np.ndarray:
        """The covariance along the columns of `turn`, over all vectors."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim, dim))
            for x in deltas(batches):
                y = (_centred(x, n, sums).astype(np.float64) / n) @ turn
                total += y.T @ y
            yield row_of(total)

        data = _fold(_numbered(source.mapInArrow(run, "task bigint, data binary")), _add, fan)
        return np.frombuffer(data, np.float64).reshape(dim, dim) / n

    eigenvalues = None
    for left in reversed(range(max(2, rounds))):
        inner = projected(basis)
        inner = (inner + inner.T) / 2
        if eigenvalues is not None:
            k = int(np.sum(eigenvalues[:components] > 16 * dim * _EPS * eigenvalues[0]))
            if not k:
                return None
            size = np.sqrt(eigenvalues[:k])
            error = float(np.abs(inner[:k, :k] / np.outer(size, size) - np.eye(k)).max())
            if error <= tolerance or not left:
                break
        eigenvalues, turn = np.linalg.eigh(inner)
        eigenvalues, turn = eigenvalues[::-1], turn[:, ::-1]
        basis, corner = np.linalg.qr(basis @ turn)
        basis = basis * np.where(np.diag(corner) < 0, -1.0, 1.0)
    rows = basis[:, :k].T
    rows = rows * np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])[:, None]
    return Whitening(n, sums, rows, eigenvalues[:k].copy(), eigenvalues[:k] / np.trace(inner), error)


_ROW = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", scale: int = 1024,
           offset: int = 100_000) -> DataFrame:
    """A row for each vector that takes part and each component (from 1)."""
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], _ROW)
    ship_package(spark)
    k, dim = model.components.shape
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(1), dim, scale, offset)
            centred = _centred(x, model.n, model.sums)
            # Projecting first and dividing by the root of the eigenvalue next would round the same; one product does both.
            y = (centred.astype(np.float64) / model.n) @ turn
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                 pa.array(np.full(len(each), model.n, np.int64)), _deviations(centred).take(pa.array(each)), pa.array(y.ravel()),
                 pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(len(each), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    slim = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return slim.mapInArrow(run, _ROW)


def op13_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the eight widest components of their covariance, scaled to unit variance."""
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
