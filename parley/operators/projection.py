"""Principal components of sparse vectors of any width, without a covariance matrix and without dense rows.

The covariance is only ever applied to a few directions: one pass sums x (x'V) over the rows x inside the tasks, and the mean is
taken out of the sum afterwards. Directions are improved by a block Krylov iteration with Rayleigh-Ritz steps, until the
residuals of the wanted ones vanish. The driver holds a bounded number of vectors of the width of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions that a pass adds, and those kept before the iteration starts anew from the best of them.
BLOCK = 14
KEPT = 160
#: A direction is found when its residual is below this share of the largest variance.
TOLERANCE = 1e-8
#: Rows whose products are held at once.
SLICE = 1024


@dataclass(frozen=True)
class Components:
    """Directions of largest variance (one a column), the variances, and the mean of the rows."""

    directions: np.ndarray
    variances: np.ndarray
    mean: np.ndarray


def sparse_rows(df: DataFrame, features: str) -> DataFrame:
    """(places, entries) of a column of vectors; rows without a vector are left out."""
    v = F.unwrap_udt(F.col(features))
    rows = df.where(F.col(features).isNotNull()).select(v.alias("v"))
    places = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.size("v.values") - 1))
    return rows.select(F.when(F.size("v.values") > 0, places).otherwise(F.array().cast("array<int>")).alias("places"),
                       F.col("v.values").alias("entries"))


def _flat(batch: pa.RecordBatch | pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and entry of the numbers of a batch."""
    places, entries = (batch.column(i) if isinstance(batch, pa.RecordBatch) else batch.field(i) for i in (0, 1))
    lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(lengths)), lengths), places.flatten().to_numpy(zero_copy_only=False),
            entries.flatten().to_numpy(zero_copy_only=False))


def _products(rows: np.ndarray, places: np.ndarray, entries: np.ndarray, n: int, directions: np.ndarray) -> np.ndarray:
    """x'V of each row x."""
    return np.column_stack([np.bincount(rows, entries * v[places], n) for v in directions.T])


def _summed(rows: DataFrame, size: int, directions: np.ndarray | None) -> tuple[np.ndarray, int]:
    """The sum of x (x'V) over all rows, or of x where no directions are given, and the number of rows."""
    width = 1 if directions is None else directions.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((size, width)), 0
        for batch in (b.slice(s, SLICE) for b in batches for s in range(0, b.num_rows, SLICE)):
            row, place, entry = _flat(batch)
            n = batch.num_rows
            count += n
            if shared.value is None:
                total[:, 0] += np.bincount(place, entry, size)
            elif n:
                scale = _products(row, place, entry, n, shared.value)
                for k in range(width):
                    total[:, k] += np.bincount(place, entry * scale[row, k], size)
        used = np.flatnonzero(total.any(1))
        # the number of rows travels as the entry of a place behind the last
        places = np.append(used, size)
        sums = np.vstack([total[used], np.full((1, width), float(count))])
        for s in range(0, len(places), 1 << 16):
            part = sums[s:s + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[s:s + (1 << 16)], pa.int64()), *[pa.array(c) for c in part.T]],
                names=["place", *[f"s{k}" for k in range(width)]])

    fields = ", ".join(f"s{k} double" for k in range(width))
    sums = rows.mapInArrow(partial, f"place long, {fields}").groupBy("place").agg(
        *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toArrow()
    total = np.zeros((size + 1, width))
    if sums.num_rows:
        total[sums["place"].to_numpy()] = np.column_stack([sums[f"s{k}"].to_numpy() for k in range(width)])
    shared.destroy()
    return total[:size], int(total[size, 0])


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that are not in ``basis``, orthonormal; none if there are none."""
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
    lengths = np.linalg.norm(new, axis=0)
    new = new[:, lengths > 1e-300] / lengths[lengths > 1e-300]
    q, r = np.linalg.qr(new)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    for _ in range(2):
        q = q - basis @ (basis.T @ q)
        q, _ = np.linalg.qr(q)
    return q


def principal_components(df: DataFrame, k: int, features: str = "features", seed: int = 42) -> Components:
    """The k directions of largest variance of a column of ML vectors, dense or sparse, of one width.

    Passes over the rows until they are found, each a sum of BLOCK vectors; write the rows first if they are costly.
    A direction's largest entry is positive.
    """
    first = df.where(F.col(features).isNotNull()).select(features).first()
    if first is None:
        raise ValueError("no vectors to project")
    size = first[0].size
    rows = sparse_rows(df, features)
    total, n = _summed(rows, size, None)
    mean = total[:, 0] / n

    def covariance(directions: np.ndarray) -> np.ndarray:
        return _summed(rows, size, directions)[0] / n - np.outer(mean, mean @ directions)

    start = np.random.default_rng(seed).standard_normal((size, min(BLOCK + k, size)))
    basis = _orthonormal(start, np.zeros((size, 0)))
    image = covariance(basis)
    while True:
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        block = min(BLOCK + k, basis.shape[1])
        rest = image @ mix[:, :block] - basis @ (mix[:, :block] * values[:block])
        wrong = np.linalg.norm(rest, axis=0)
        if wrong[:k].max() <= TOLERANCE * max(values[0], 1e-300) or basis.shape[1] >= size:
            break
        if basis.shape[1] + block > max(KEPT, 4 * block):
            best = mix[:, :2 * block]
            basis, image = basis @ best, image @ best
        new = _orthonormal(rest, basis)
        if not new.shape[1]:
            break
        basis, image = np.hstack([basis, new]), np.hstack([image, covariance(new)])
    directions = np.zeros((size, k))
    found = (basis @ mix)[:, :k]
    directions[:, :found.shape[1]] = found
    sign = np.sign(directions[np.abs(directions).argmax(0), np.arange(k)])
    variances = np.zeros(k)
    variances[:found.shape[1]] = np.maximum(values[:k], 0)
    return Components(directions * np.where(sign == 0, 1, sign), variances, mean)


def projected(df: DataFrame, components: Components, features: str = "features", prefix: str = "pc") -> DataFrame:
    """Add the coordinates of the centred vectors, ``pc1``, ``pc2`` .., inside the row; NULL without a vector."""
    k = components.directions.shape[1]
    shared = df.sparkSession.sparkContext.broadcast((components.directions, components.mean @ components.directions))

    @F.arrow_udf("array<double>")
    def coordinates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        directions, centre = shared.value
        for batch in batches:
            parts = [batch.slice(s, SLICE) for s in range(0, max(len(batch), 1), SLICE)]
            values = np.vstack([_products(*_flat(part), len(part), directions) for part in parts]) - centre
            yield pa.ListArray.from_arrays(np.arange(0, len(batch) * k + 1, k, dtype=np.int32), pa.array(values.ravel()))

    v = F.unwrap_udt(F.col(features))
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    flat = F.struct(F.when(F.size(v["values"]) > 0, places).otherwise(F.array().cast("array<int>")).alias("places"),
                    v["values"].alias("entries"))
    rows = df.withColumn("_at", coordinates(flat))
    known = F.col(features).isNotNull()
    return rows.withColumns({f"{prefix}{i + 1}": F.when(known, F.col("_at")[i]) for i in range(k)}).drop("_at")
