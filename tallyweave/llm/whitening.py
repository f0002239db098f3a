"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed.  The only thing done with the vectors is the
product of the centred covariance with a few columns at once, one Spark job
that sums each block's share of ``X' (X u)`` with every entry centred exactly before
it is multiplied.  The driver holds matrices of dimension x a few dozen columns:

* Rayleigh-Ritz on an orthonormal subspace gives Ritz pairs and residuals;
* pairs whose residuals reach double precision are locked and projected out;
* for the others, the correction equations
  ``(I - QQ')(V - theta I)(I - QQ') t = -r`` are solved roughly by a few steps of
  MINRES, all of them in step with each other, so that one job serves all columns;
* the corrections extend the subspace, which is shrunk to its best Ritz vectors
  when it has grown to a fixed width.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, arrow_stream, stored

# The scaling's fixed values.
SCALE, OFFSET = 64, 1_000_000
BLOCK_BYTES = 1 << 20  # of one packed block of the fit list
EPS = float(np.finfo(np.float64).eps)
INNER, ROUNDS, WIDEST = 4, 200, 8  # MINRES steps; rounds before giving up; subspace in multiples of the pairs sought


def scaled_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of floor(64 c) + 1000000), width of the rows whose vector is not null and holds no null or non-finite entry."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("embedding")).filter("embedding is not null").filter(good)
    x = F.transform("embedding", lambda e: F.floor(e * SCALE) + OFFSET)
    return kept.select("vec_id", x.alias("x"), F.size("embedding").alias("width"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(-1, width)


def fit_list(vectors: DataFrame, width: int) -> DataFrame:
    """The distinct vectors in packed blocks: data (rows of int64), one row a block."""

    def pack(batch):
        yield {"key": [r.tobytes() for r in np.ascontiguousarray(_matrix(batch.column("x"), width))]}

    def block(batches):
        most = max(1, BLOCK_BYTES // (8 * width))
        held: list[bytes] = []
        for batch in batches:
            held += batch.column("key").to_pylist()
            while len(held) >= most:
                yield {"data": [b"".join(held[:most])]}
                del held[:most]
        if held:
            yield {"data": [b"".join(held)]}

    # a repeated vector leaves each task as one key
    distinct = arrow_map(vectors.filter(F.col("width") == width).select("x"), pack, "key binary").groupBy("key").agg(F.lit(1).alias("one"))
    return stored(arrow_stream(distinct.select("key"), block, "data binary"), "fit-list")


def _summed(blocks: DataFrame, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
    """Sum of ``share`` over all blocks: within tasks, then in a tree, so the driver receives few arrays whatever the number of tasks."""

    def one(batches):
        total = None
        for batch in batches:
            for data in batch.column("data"):
                own = share(np.frombuffer(data.as_buffer(), np.int64))
                total = own if total is None else total + own
        if total is not None:
            yield {"part": [np.ascontiguousarray(total).tobytes()]}

    def merge(batches):
        total = None
        for batch in batches:
            for part in batch.column("part"):
                own = np.frombuffer(part.as_buffer(), kind)
                total = own if total is None else total + own
        if total is not None:
            yield {"part": [total.tobytes()]}

    parts, tasks = arrow_stream(blocks, one, "part binary"), blocks.rdd.getNumPartitions()
    if tasks > 64:
        parts = arrow_stream(parts.repartition(math.isqrt(tasks)), merge, "part binary")
    total = np.zeros(int(np.prod(shape)), kind)
    for part in parts.toArrow().column("part"):
        total = total + np.frombuffer(part.as_buffer(), kind)
    return total.reshape(shape)


class Centre(NamedTuple):
    n: int
    sums: np.ndarray  # of each dimension, exact
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n with one rounding: whole and rest of S/n are taken off apart, the whole as an integer."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n


def centre_of(blocks: DataFrame, width: int) -> Centre | None:
    # sums relative to the offset stay far from the ends of int64; two halves keep them exact for any number of rows
    def halves(data):
        x = data.reshape(-1, width) - OFFSET
        low = x & 0xFFFFFFFF
        return np.concatenate([[len(x)], low.sum(axis=0), (x >> 32).sum(axis=0)])

    got = _summed(blocks, halves, (1 + 2 * width,), np.int64)
    n = int(got[0])
    if not n:
        return None
    sums = [int(low) + (int(high) << 32) + n * OFFSET for low, high in zip(got[1 : 1 + width], got[1 + width :])]
    start = Centre(n, np.array(sums, np.int64 if max(map(abs, sums)) < 2**63 else object), 0.0)
    squares = _summed(blocks, lambda data: (start.centred(data.reshape(-1, width)).astype(np.float64) ** 2).sum(axis=0), (width,))
    return start._replace(trace=float(squares.sum()) / n)


def product(blocks: DataFrame, centre: Centre, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """The function u -> V u for any number of columns; each call is one job."""

    def times(u: np.ndarray) -> np.ndarray:
        u = np.ascontiguousarray(u)

        def share(data):
            x = centre.centred(data.reshape(-1, width)).astype(np.float64)
            return x.T @ (x @ u)

        return _summed(blocks, share, u.shape) / centre.n

    return times


def orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``t`` add to the orthonormal columns of ``against``."""
    out = np.zeros((len(t), 0))
    for column in t.T:
        basis = np.concatenate([against, out], axis=1)
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.concatenate([out, column[:, None]], axis=1)
    return out


def minres(apply: Callable[[np.ndarray, np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, reach: float) -> np.ndarray:
    """MINRES for several symmetric systems at once, each column with its own; a column stops when its residual fell by ``reach``.

    ``apply(v, active)`` is called once a step with the columns still worked on.
    """
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    active = np.flatnonzero(beta > 0)
    cols = rhs.shape[1]
    v_old, v = np.zeros_like(rhs), np.zeros_like(rhs)
    v[:, active] = rhs[:, active] / beta[active]
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    c, c_old, s, s_old = np.ones(cols), np.ones(cols), np.zeros(cols), np.zeros(cols)
    eta, step, start = beta.copy(), np.zeros(cols), beta.copy()
    for _ in range(steps):
        if not len(active):
            break
        a = active
        product = apply(v[:, a], a)
        alpha = (v[:, a] * product).sum(axis=0)
        fresh = product - alpha * v[:, a] - step[a] * v_old[:, a]
        after = np.linalg.norm(fresh, axis=0)
        # two old rotations and a new one bring the column of the tridiagonal matrix into triangular form
        far, near = s_old[a] * step[a], c_old[a] * step[a]
        mid = c[a] * near + s[a] * alpha
        diagonal = -s[a] * near + c[a] * alpha
        size = np.hypot(diagonal, after)
        ok = size > 0
        size = np.where(ok, size, 1)
        new_c, new_s = diagonal / size, after / size
        direction = (v[:, a] - mid * w[:, a] - far * w_old[:, a]) / size
        x[:, a] += np.where(ok, new_c * eta[a], 0) * direction
        eta[a] = -new_s * eta[a]
        w_old[:, a], w[:, a] = w[:, a], direction
        c_old[a], s_old[a], c[a], s[a] = c[a], s[a], new_c, new_s
        v_old[:, a] = v[:, a]
        v[:, a] = fresh / np.where(after > 0, after, 1)
        step[a] = after
        active = a[ok & (after > EPS * start[a]) & (np.abs(eta[a]) > reach * start[a])]
    return x


class Pairs(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    residuals: np.ndarray
    jobs: int


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], width: int, sought: int, inner: int = INNER, rounds: int = ROUNDS, seed: int = 1) -> Pairs:
    """The ``sought`` largest eigenpairs of the symmetric positive semi-definite operator ``times``.

    A pair is locked when its residual is below 4 sqrt(width) units of double
    precision of the largest eigenvalue, or when it has stopped falling below 64
    times that: then it is the rounding of the products.
    """
    sought = min(sought, width)
    extra = min(width, sought + max(2, sought // 4))  # a few more than sought shield the last ones
    basis = orthonormal(np.random.default_rng(seed).standard_normal((width, extra)), np.zeros((width, 0)))
    image, jobs = times(basis), 1
    locked, values, residuals, before = np.zeros((width, 0)), [], [], {}
    for _ in range(rounds):
        projected = basis.T @ image
        theta, turn = np.linalg.eigh((projected + projected.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn  # Ritz vectors first
        largest = max([*values, theta[0] if len(theta) else 0.0, 0.0])
        left = sought - len(values)
        whole = basis.shape[1] + locked.shape[1] >= width  # the subspace is everything: nothing can be added
        residual = image[:, :left] - theta[:left] * basis[:, :left]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        near = 4 * EPS * np.sqrt(width) * largest
        done = 0  # locked from the largest on, so that none is passed over
        while done < len(size) and (whole or size[done] <= near or size[done] <= 64 * near and size[done] > 0.5 * before.get(len(values) + done, np.inf)):
            done += 1
        before = {len(values) + i: s for i, s in enumerate(size)}
        if done:
            locked = np.concatenate([locked, basis[:, :done]], axis=1)
            values += list(theta[:done])
            residuals += list(size[:done])
            basis, image = basis[:, done:], image[:, done:]
            before = {k: s for k, s in before.items() if k >= len(values)}
        if len(values) >= sought or not basis.shape[1]:
            break
        if basis.shape[1] + locked.shape[1] >= width:
            continue
        most = max(4 * extra, WIDEST * sought)
        if basis.shape[1] + extra > most:
            basis, image = basis[:, : 2 * extra], image[:, : 2 * extra]
        # the pairs sought and the few behind them are corrected together
        theta, count = theta[done:], min(extra, basis.shape[1])
        residual = image[:, :count] - theta[:count] * basis[:, :count]
        ritz = np.concatenate([locked, basis[:, :count]], axis=1)
        clear = lambda u: u - ritz @ (ritz.T @ u)  # noqa: E731, B023
        need = np.flatnonzero(np.linalg.norm(residual, axis=0) > near)
        if not len(need):
            need = np.arange(count)

        def shifted(u, active):
            nonlocal jobs
            jobs += 1
            inside = clear(u)  # noqa: B023
            return clear(times(inside) - theta[need[active]] * inside)  # noqa: B023

        t = minres(shifted, clear(-residual[:, need]), inner, 1e-3)
        fresh = orthonormal(clear(t), np.concatenate([locked, basis], axis=1))
        if not fresh.shape[1]:
            fresh = orthonormal(np.random.default_rng(seed + jobs).standard_normal((width, extra)), np.concatenate([locked, basis], axis=1))
        basis, image = np.concatenate([basis, fresh], axis=1), np.concatenate([image, times(fresh)], axis=1)
        jobs += 1
    else:
        raise ArithmeticError(f"residuals {size} after {rounds} rounds, {near} wanted")
    order = np.argsort(-np.array(values), kind="stable")
    return Pairs(np.array(values)[order], locked[:, order], np.array(residuals)[order], jobs)


class Whitener(NamedTuple):
    width: int
    centre: Centre
    values: np.ndarray
    turn: np.ndarray  # width x components: eigenvectors over the roots of their values
    identity_error: float
    jobs: int


def fit(vectors: DataFrame, width: int, components: int = 16) -> Whitener | None:
    """The whitening of the distinct vectors of one width; None without vectors or without variance.

    Components whose eigenvalue is below rounding (1e-12 of the largest) carry no variance and are left out.
    """
    blocks = fit_list(vectors, width)
    centre = centre_of(blocks, width)
    if centre is None or not centre.trace > 0:
        return None
    pairs = jacobi_davidson(product(blocks, centre, width), width, components)
    real = pairs.values > 1e-12 * pairs.values[0]
    values = pairs.values[real]
    turn = pairs.vectors[:, real] / np.sqrt(values)

    def share(data):
        y = centre.centred(data.reshape(-1, width)).astype(np.float64) @ turn
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    m = len(values)
    got = _summed(blocks, share, (m + m * m,))
    mean = got[:m] / centre.n
    spread = got[m:].reshape(m, m) / centre.n - np.outer(mean, mean)
    return Whitener(width, centre, values, turn, float(np.abs(spread - np.eye(m)).max()), pairs.jobs)


def _deviations(centre: Centre, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null if a long cannot hold it."""
    n, most = centre.n, 2**63
    if centre.sums.dtype != object and (int(np.abs(x).max(initial=0)) + 1) * n < most and int(np.abs(centre.sums).max()) < most // 2:
        whole, rest = np.divmod(centre.sums, n)
        gap = int(np.abs(x - whole).max(initial=0)) + 1
        if x.shape[1] * (gap * n) ** 2 < most:
            return (((x - whole) * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, centre.sums)) for row in x]
    return [d if d < most else None for d in exact]


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row with a whole finite vector.

    ``rows``: vec_id, embedding; further columns are not read.  The fit list is each
    distinct scaled vector once; each width is a table of its own with its own
    fit.  Repeated rows and rows with a null id are projected like any other.
    There are at most ``components`` components, fewer for narrower vectors or
    where the rest carries no variance (one vector only, or none: no rows).
    A deviation that a long cannot hold is null.
    """
    vectors = stored(scaled_vectors(rows).filter("width > 0"), "vectors")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = rows.sparkSession.createDataFrame([], schema)
    for (width,) in vectors.select("width").distinct().orderBy("width").collect():  # as many as there are widths, a few
        fitted = fit(vectors, width, components)
        if fitted is not None:
            out = out.union(_projected(vectors.filter(F.col("width") == width), fitted, schema))
    return out


def _projected(vectors: DataFrame, fitted: Whitener, schema: str) -> DataFrame:
    centre, m = fitted.centre, len(fitted.values)
    explained = fitted.values / centre.trace

    def one(batch):
        x = _matrix(batch.column("x"), fitted.width)
        y = centre.centred(x).astype(np.float64) @ fitted.turn
        rows = len(x)
        place = pa.array(np.repeat(np.arange(rows), m))
        yield {
            "vec_id": batch.column("vec_id").take(place),
            "component": np.tile(np.arange(1, m + 1, dtype=np.int32), rows),
            "n": np.full(rows * m, centre.n, np.int64),
            "deviation": pa.array(_deviations(centre, x), pa.int64()).take(place),
            "whitened": y.ravel(),
            "explained": np.tile(explained, rows),
            "identity_error": np.full(rows * m, fitted.identity_error),
        }

    return arrow_map(vectors.select("vec_id", "x"), one, schema)
