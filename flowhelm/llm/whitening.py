"""Whitening of vectors by the leading components of their covariance, found by Jacobi-Davidson iterations.

The covariance is never formed. Vectors are stored once as packed blocks of integers; a product of the covariance with a few
directions is one pass over the blocks (centred before multiplying, exactly rounded once) that returns one small table
of sums. All wanted components go on together: Rayleigh-Ritz over the search space gives Ritz pairs, pairs whose
residual has reached double precision are locked, largest first, and for the others the projected correction equations

    (I - PP')(V - e I)(I - PP') t = -residual,  P: locked and current Ritz vectors,

are solved by MINRES in step, one pass for each step of all of them. What is found extends the search space.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped, as are vectors whose length
isn't the most frequent one (ties: the longest). Repeated rows, null and equal ids are rows like others. Only
components whose eigenvalue is above rounding can be whitened: constant vectors and empty tables give no rows, vectors
of rank r at most r components. Within equal eigenvalues any basis of their space is right; signs make the largest
entry positive. Other columns are ignored. Entries are exact up to 2**40; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.session import stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_ENTRIES = 1 << 18
#: Residuals end at this share of the largest eigenvalue; the search space restarts beyond so many blocks of directions.
PRECISION = 2e-14
INNER_STEPS, OUTER_STEPS, SPACE_BLOCKS = 4, 120, 6

Product = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of vectors of one length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, dim)


def _whole(matrix: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * matrix).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows with finite vectors of the most frequent length, and that length."""
    c = F.col(column)
    infinite = F.lit(float("inf"))
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    rows = vectors.where(c.isNotNull()).where(finite & (F.size(c) > 0))
    common = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = 0 if common is None else common["d"]
    return rows.where(F.size(c) == dim), dim


def blocks(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Stored blocks of rows as packed integers (``wide``: of 8 bytes, else of 4), with their sums per dimension."""
    size = max(1, BLOCK_ENTRIES // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(_matrix(batch.column(0), dim))
            for at in range(0, len(whole), size):
                part = whole[at : at + size]
                wide = bool(len(part)) and int(np.abs(part).max()) >= 1 << 31
                data = part.astype("<i8" if wide else "<i4").tobytes()
                sums = pa.array([part.sum(axis=0).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([wide]), sums, pa.array([data], pa.binary())], names=["rows", "wide", "sums", "data"])

    return stored(vectors.select(column).mapInArrow(run, "rows long, wide boolean, sums array<long>, data binary"), "vectors")


def totals(packed: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and sums per dimension: one row a dimension reaches the driver."""
    rows = packed.agg(F.sum("rows")).first()[0] or 0
    sums = packed.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return rows, np.array([r["s"] for r in sorted(sums)], dtype=np.int64)


def centred(whole: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the difference is exact in integers and rounded by one division."""
    return (whole * np.int64(n) - sums) / np.float64(n)


def _summed(packed: DataFrame, dim: int, n: int, sums: np.ndarray, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the matrix that ``work`` makes of a block's centred rows; each task adds up its blocks."""
    columns = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for wide, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.frombuffer(data.as_buffer(), dtype="<i8" if wide else "<i4").reshape(-1, dim)
                part = work(centred(whole, n, sums))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(total[:, k]) for k in range(width)]], names=["i", *columns])

    schema = ", ".join(["i long", *[f"{c} double" for c in columns]])
    found = packed.select("wide", "data").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    return np.array([list(r)[1:] for r in sorted(found)])


def covariance_product(packed: DataFrame, dim: int, n: int, sums: np.ndarray) -> Product:
    """Product of the covariance with the columns of a matrix, one pass each."""

    def product(u: np.ndarray) -> np.ndarray:
        return _summed(packed, dim, n, sums, u.shape[1], lambda y: y.T @ (y @ u)) / n

    return product


def _orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Unit columns spanning what ``new`` adds to the bases (twice, so that rounding doesn't matter)."""
    found = np.zeros((new.shape[0], 0))
    for j in range(new.shape[1]):
        v = new[:, j]
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            for basis in (*bases, found):
                v = v - basis @ (basis.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            found = np.column_stack([found, v / left])
    return found


def corrections(product: Product, basis: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int, tolerance: float = 0.1) -> np.ndarray:
    """MINRES in step for all projected correction equations: a Lanczos step of each, one pass for all."""

    def project(x: np.ndarray) -> np.ndarray:
        return x - basis @ (basis.T @ x)

    b = -project(residuals)
    beta = np.linalg.norm(b, axis=0)
    x = np.zeros_like(b)
    goal = beta * tolerance
    active = beta > 0
    scale = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(b), b / scale
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    left = beta.copy()
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    gamma = beta
    for step in range(steps):
        if not active.any():
            break
        av = np.zeros_like(v)
        av[:, active] = product(v[:, active])
        av = project(av - v * values)
        if step:
            av = av - v_old * gamma
        alpha = (v * av).sum(axis=0)
        av = project(av - v * alpha)
        following = np.linalg.norm(av, axis=0)
        below = 0.0 if step == 0 else gamma
        # The new column of the tridiagonal matrix under the two rotations before, then its own rotation.
        epsilon = s_old * below
        delta_bar = c_old * below
        delta = c * delta_bar + s * alpha
        rho_bar = -s * delta_bar + c * alpha
        rho = np.hypot(rho_bar, following)
        safe = np.where(rho > 0, rho, 1.0)
        c_new, s_new = rho_bar / safe, following / safe
        direction = (v - w * delta - w_old * epsilon) / safe
        x = np.where(active, x + direction * (c_new * left), x)
        left = -s_new * left
        w_old, w = w, direction
        v_old, v = v, av / np.where(following > 0, following, 1.0)
        c_old, s_old, c, s = c, s, c_new, s_new
        gamma = following
        active = active & (np.abs(left) > goal) & (following > 1e-14 * np.abs(values).max(initial=0.0)) & (rho > 0)
    return project(x)


def leading_pairs(product: Product, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix that is known by its products, falling; unit eigenvectors; their residuals."""
    wanted = min(wanted, dim)
    block = min(dim, wanted + 2)  # two more than wanted, so that the last gap doesn't slow down the last pair
    space = _orthogonal(np.random.default_rng(seed).standard_normal((dim, block)))
    image = product(space)
    best, stuck = np.inf, 0
    for step in range(OUTER_STEPS):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        residuals = image - space * values
        size = np.linalg.norm(residuals, axis=0)
        floor = PRECISION * max(float(values[0]), np.finfo(float).tiny)
        reached = size[:wanted] <= floor
        locked = int(np.argmin(reached)) if not reached.all() else wanted
        worst = float(size[:wanted].max())
        stuck = stuck + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        if locked == wanted or space.shape[1] == dim or (stuck >= 3 and worst <= 50 * floor):
            break
        if space.shape[1] + block > max(SPACE_BLOCKS * block, 3 * wanted):
            space, image = space[:, : 2 * block], image[:, : 2 * block]
        open_ = np.arange(locked, min(block, space.shape[1]))
        open_ = open_[size[open_] > floor]
        steps = min(INNER_STEPS, dim)
        new = corrections(product, space[:, : max(wanted, int(open_.max(initial=0)) + 1)], values[open_], residuals[:, open_], steps)
        fresh = _orthogonal(np.column_stack([new, residuals[:, open_]]) if step % 4 == 3 else new, space)
        if not fresh.shape[1]:
            fresh = _orthogonal(np.random.default_rng(seed + step + 1).standard_normal((dim, 1)), space)
            if not fresh.shape[1]:
                break
        space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh)])
    if worst > 1e-10 * values[0]:
        raise ArithmeticError(f"residual {worst} of {values[0]} after {OUTER_STEPS} rounds")
    vectors = space[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[:wanted], vectors * signs, size[:wanted]


def whiten(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: its whitened value, beside what the fit says of all of them."""
    schema = T.StructType([
        T.StructField(id, vectors.schema[id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()), T.StructField("eigenvalue", T.DoubleType()), T.StructField("residual", T.DoubleType())])
    rows, dim = usable(vectors, column)
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    packed = blocks(rows, column, dim)
    n, sums = totals(packed)
    trace = float(_summed(packed, dim, n, sums, 1, lambda y: (y * y).sum(axis=0)[:, None]).sum() / n)
    if not trace:
        return vectors.sparkSession.createDataFrame([], schema)
    values, basis, residuals = leading_pairs(covariance_product(packed, dim, n, sums), dim, components)
    kept = int((values > dim * np.finfo(float).eps * values[0]).sum())
    values, residuals = values[:kept], residuals[:kept]
    scaled = basis[:, :kept] / np.sqrt(values)
    moments = _summed(packed, dim, n, sums, kept + 1, lambda y: np.column_stack([(z := y @ scaled).T @ z, z.sum(axis=0)])) / n
    error = float(np.abs(moments[:, :kept] - np.outer(moments[:, kept], moments[:, kept]) - np.eye(kept)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(_matrix(batch.column(1), dim))
            apart = whole * np.int64(n) - sums
            if len(apart) and dim * float(np.abs(apart).max()) ** 2 >= 2.0**62:
                exact = [sum(int(v) * int(v) for v in row) for row in apart.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((apart * apart).sum(axis=1), pa.int64())
            z = (apart / np.float64(n)) @ scaled
            m = len(z)
            each = pa.array(np.repeat(np.arange(m), kept))
            every = lambda x: pa.array(np.tile(x, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), every(np.arange(1, kept + 1, dtype=np.int32)), every(np.full(kept, n)), deviation.take(each), pa.array(z.ravel()),
                 every(explained), every(np.full(kept, error)), every(values), every(residuals)],
                names=schema.names)

    return rows.select(F.col(id), F.col(column)).mapInArrow(run, schema)
