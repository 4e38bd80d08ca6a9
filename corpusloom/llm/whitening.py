"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. Blocks of centred vectors, each read by the task that holds
it, give products with a few vectors at a time; their sums over the tasks are rows that
Spark adds up. On the driver live only the search space (some dozens of vectors of one
embedding's length) and the small dense problems in it:

* Rayleigh-Ritz in the search space gives the wanted pairs and their residuals;
* leading pairs whose residual reaches double precision are locked and projected out;
* for the others the projected correction equation is solved roughly by MINRES, all of them
  at once, so that one product over the data serves every equation;
* the solutions widen the search space, which is cut back to its best part when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.staging import Staging, ship

#: vectors of a packed block at most
BLOCK = 4096
#: entries beyond are taken as this; a block's sums then stay within a long
LARGEST = 1 << 50
#: pairs sought beyond the wanted ones, so that none of these is missed
GUARD = 4
#: numbers of a partial sum in one row
WIDTH = 16
INNER = 5
OUTER = 300
#: a residual of so many units of rounding of the largest eigenvalue ends the search
ROUNDINGS = 24
EPS = float(np.finfo(np.float64).eps)


def whole_entries(vectors: DataFrame, factor: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id`` and ``x``: every entry as a double times ``factor``, rounded down, plus
    ``shift``. Vectors that are null or hold a null or non-finite entry are left out."""
    good = F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    )
    most = float(LARGEST)

    def entry(c):
        near = F.greatest(F.least(c.cast("double") * factor, F.lit(most)), F.lit(-most))
        return F.floor(near) + F.lit(shift).cast("long")

    rows = vectors.where(F.col("embedding").isNotNull()).where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column, all of length ``dim``, as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(dim: int):
    """Blocks of at most ``BLOCK`` vectors as bytes, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def told() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(waiting)
            waiting[:] = [x[len(x) - len(x) % BLOCK :]] if len(x) >= BLOCK else []
            stop = len(x) - len(x) % BLOCK if len(x) >= BLOCK else len(x)
            for low in range(0, stop, BLOCK):
                part = np.ascontiguousarray(x[low : min(stop, low + BLOCK)], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()])], ["n", "x"])

        for batch in batches:
            waiting.append(_matrix(batch.column(0), dim))
            if sum(map(len, waiting)) >= BLOCK:
                yield from told()
        if sum(map(len, waiting)):
            yield from told()

    return run


def _summed(packed: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, size: int) -> np.ndarray:
    """The sum of ``part(block)``, an array of ``size`` numbers, over all blocks of integer
    vectors: each task adds up its own blocks, Spark the tasks. ``WIDTH`` numbers share a row."""
    whole = np.issubdtype(np.asarray(part(np.zeros((0, dim), np.int64))).dtype, np.integer)
    rows = -(-size // WIDTH)
    places = pa.array(np.arange(rows, dtype=np.int32))
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * WIDTH)

    def told(total: np.ndarray) -> pa.RecordBatch:
        filled = np.zeros(rows * WIDTH, np.int64 if whole else np.float64)
        filled[:size] = total
        return pa.RecordBatch.from_arrays([places, pa.ListArray.from_arrays(ends, pa.array(filled))], ["i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                block = part(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)).ravel()
                if whole:  # exact: only Spark's decimals add blocks
                    yield told(block)
                else:
                    total = block if total is None else total + block
        if total is not None:
            yield told(total)

    value = [F.col("v")[j].cast("decimal(38,0)") if whole else F.col("v")[j] for j in range(WIDTH)]
    parts = packed.select("x").mapInArrow(run, f"i int, v array<{'long' if whole else 'double'}>")
    found = np.zeros(rows * WIDTH, object if whole else np.float64)
    for i, *sums in parts.groupBy("i").agg(*(F.sum(v) for v in value)).collect():
        found[i * WIDTH : (i + 1) * WIDTH] = [int(v) for v in sums] if whole else sums
    return found[:size]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in longs where they cannot overflow, else in Python integers."""
    s = np.array(sums, object)
    most = max([int(np.abs(x).max(initial=0)) * n, *(abs(v) for v in sums)], default=0)
    return n * x - s.astype(np.int64) if most < 1 << 61 else x.astype(object) * n - s


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def _orthogonal(new: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """Orthonormal columns that widen the span of the ``known`` ones by ``new``."""
    sizes = np.linalg.norm(new, axis=0)
    new = new[:, sizes > 0] / sizes[sizes > 0]
    kept: list[np.ndarray] = []
    for column in new.T:
        before = np.column_stack([*known, *kept]) if known or kept else np.zeros((len(column), 0))
        for _ in range(3):
            column = column - before @ (before.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column[:, None])
    return np.column_stack(kept) if kept else np.zeros((len(new), 0))


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of one symmetric system per column of ``right``, side by side."""
    size = np.linalg.norm(right, axis=0)
    eta, gamma = size.copy(), size.copy()
    v, before = right.copy(), np.zeros_like(right)
    w, w_before, found = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, c_before = np.ones_like(size), np.ones_like(size)
    s, s_before = np.zeros_like(size), np.zeros_like(size)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=np.abs(b) > 1e-300)

    for _ in range(steps):
        v = over(v, np.broadcast_to(gamma, v.shape))
        image = apply(v)
        delta = (v * image).sum(axis=0)
        following = image - delta * v - gamma * before
        gamma_next = np.linalg.norm(following, axis=0)
        a0 = c * delta - c_before * s * gamma
        a1 = np.hypot(a0, gamma_next)
        a2 = s * delta + c_before * c * gamma
        a3 = s_before * gamma
        c_before, s_before = c, s
        c, s = over(a0, a1), over(gamma_next, a1)
        w_before, w = w, over(v - a3 * w_before - a2 * w, np.broadcast_to(a1, v.shape))
        found += c * eta * w
        eta = -s * eta
        before, v, gamma = v, following, gamma_next
    return found


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors (columns) of a
    symmetric ``dim`` x ``dim`` operator that is only known by ``product(block)``.

    Ends when the residual of every wanted pair is at most ``ROUNDINGS`` units of rounding
    of the largest eigenvalue, or when the search space is the whole space. Raises when
    ``OUTER`` rounds were not enough.
    """
    wanted = min(dim, k + GUARD)
    most = 4 * wanted
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = _orthogonal(np.random.default_rng(seed).standard_normal((dim, wanted)))
    image = product(basis)
    for _ in range(OUTER):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        bound = ROUNDINGS * EPS * max(np.abs(theta).max(initial=0), np.abs(values).max(initial=0))
        whole = basis.shape[1] + locked.shape[1] >= dim
        ready = np.ones(len(theta), bool) if whole else np.linalg.norm(residual, axis=0) <= bound
        n = int(np.argmin(ready)) if not ready.all() else len(ready)
        locked, values = np.column_stack([locked, basis[:, :n]]), np.concatenate([values, theta[:n]])
        basis, image, residual, theta = basis[:, n:], image[:, n:], residual[:, n:], theta[n:]
        # a guard pair need not be exact once the wanted ones are locked
        if len(values) >= min(k, dim) or not basis.shape[1]:
            break
        open_ = max(1, wanted - len(values))
        keep = 2 * wanted - len(values)
        if basis.shape[1] + open_ + locked.shape[1] > most and basis.shape[1] > keep:
            # products are taken afresh, so that rounding does not pile up in the combinations
            basis = _orthogonal(basis[:, :keep], locked)
            image = product(basis)
            continue
        u, shift = basis[:, :open_], theta[:open_]
        out = np.column_stack([locked, u])

        def correction(t: np.ndarray, out=out, shift=shift) -> np.ndarray:
            t = t - out @ (out.T @ t)
            t = product(t) - t * shift
            return t - out @ (out.T @ t)

        right = -residual[:, :open_]
        right -= out @ (out.T @ right)
        new = _orthogonal(minres(correction, right, INNER), locked, basis)
        if not new.shape[1]:  # nothing left to correct: look along a new direction
            new = _orthogonal(np.random.default_rng(seed + 1).standard_normal((dim, 1)), locked, basis)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    else:
        raise RuntimeError("the eigenvectors did not settle")
    # once more in the span of all locked pairs, with their products taken afresh
    locked = _orthogonal(locked)
    image = product(locked)
    theta, s = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    order = np.argsort(-theta, kind="stable")[: min(k, dim)]
    return theta[order], locked @ s[:, order]


def _fit(packed: DataFrame, dim: int, k: int) -> dict:
    """Size, sums, eigenpairs, trace and error of the whitening of one list of vectors."""
    n = int(packed.agg(F.sum("n")).first()[0])
    sums = list(_summed(packed, lambda x: x.sum(axis=0), dim, dim))
    trace = float(_summed(packed, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]), dim, 1)[0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            d = _centred(x, n, sums)
            return d.T @ (d @ block)

        return _summed(packed, part, dim, block.size).reshape(block.shape) / n

    values, vectors = jacobi_davidson(product, dim, k) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    real = values > 1e-12 * max(trace, 1e-300)
    values, vectors = values[real], vectors[:, real]
    scaled = vectors / np.sqrt(values)
    size = len(values)
    error = 0.0
    if size:
        mean = _summed(packed, lambda x: (_centred(x, n, sums) @ scaled).sum(axis=0), dim, size) / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ scaled - mean
            return w.T @ w

        covariance = _summed(packed, spread, dim, size * size).reshape(size, size) / n
        error = float(np.abs(covariance - np.eye(size)).max())
    return {"n": n, "sums": sums, "scaled": scaled, "explained": values / trace if size else values, "error": error}


def _project(model: dict, dim: int):
    n, sums, size = model["n"], model["sums"], model["scaled"].shape[1]

    def squares(x: np.ndarray) -> np.ndarray:
        d = deviations(x, n, sums)
        if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * max(dim, 1) >= 1 << 63:
            d = d.astype(object)
            return np.array([min(v, (1 << 63) - 1) for v in (d * d).sum(axis=1)], np.int64)
        return (d * d).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = _matrix(part.column(1), dim)
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(rows), size))),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * size, n, np.int64)),
                        pa.array(np.repeat(squares(x), size)),
                        pa.array((_centred(x, n, sums) @ model["scaled"]).ravel()),
                        pa.array(np.tile(model["explained"], rows)),
                        pa.array(np.full(rows * size, model["error"])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, k: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: for every
    row of ``rows(vec_id, x)`` (``x`` an array of whole numbers, see :func:`whole_entries`)
    its place along the ``k`` leading components, numbered from 1.

    The fit takes each distinct vector once (``n`` of them), so copies weigh nothing. Every
    row is projected, repeated ones and ones without vec_id too. Components along which
    nothing varies do not exist, so fewer than ``k`` may come back, none for a single
    distinct vector or an empty table. Vectors of different length have nothing in common:
    each length is fitted and whitened on its own. ``deviation`` is exact and cut to the
    range of a long; components of equal variance come in no particular order. Other
    columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    staging = Staging(spark)
    rows = staging.keep(rows.select("vec_id", "x"), "entries")
    found = spark.createDataFrame([], WHITENED)
    for (dim,) in sorted(rows.select(F.size("x")).distinct().collect()):
        if dim < 1:
            continue
        own = rows.where(F.size("x") == dim)
        packed = staging.keep(own.select("x").distinct().mapInArrow(_pack(dim), "n long, x binary"), "packed")
        model = _fit(packed, dim, k)
        staging.drop(packed)
        if model["scaled"].shape[1]:
            found = found.union(own.mapInArrow(_project(model, dim), WHITENED))
    return found
