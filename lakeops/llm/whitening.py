"""Whitening of embeddings by their principal components, found by spectral divide and conquer.

Vectors are put on a grid of whole numbers, every distinct one counts once, and Spark adds up their
covariance. Its eigenvectors come from polar decompositions: the polar factor of ``V - s`` (QDWH, a
dynamically weighted Halley iteration) has eigenvalue 1 where V's is above ``s`` and -1 below, so
``(polar + 1) / 2`` projects on an invariant subspace. Bases of that space and of its complement
split V into two smaller blocks, which are split again until every block is a number.

What reaches the driver is one matrix of the size of a vector; the components are broadcast and
applied in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(np.float64).eps)
# Grid values beyond this are no longs; their entries count as not finite.
LARGEST = 2.0**62


# ------------------------------------------------------------------ eigenvectors


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its matrix sign if it is not singular.

    QDWH: every step applies the best rational function of type (3, 2) for singular values in
    ``[low, 1]``, by a QR decomposition while the weights are large and by a Cholesky one afterwards.
    """
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(size)
    x, one = a / norm, np.eye(size)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    for _ in range(30):
        before, square = x, low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            factor = np.linalg.cholesky(one + wc * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, half).T
        x = (x + x.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(5 * EPS):
            break
    return x


def invariant_bases(a: np.ndarray, projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the range of a spectral projector of ``a`` and of the complement; None
    if they do not decouple ``a`` to working precision."""
    size = len(a)
    start = np.random.default_rng(size).standard_normal((size, rank))
    for _ in range(4):
        q, _ = np.linalg.qr(projector @ start, mode="complete")
        inside, outside = q[:, :rank], q[:, rank:]
        if np.linalg.norm(outside.T @ a @ inside) <= 10 * size * EPS * np.linalg.norm(a):
            return inside, outside
        start = inside
    return None


def eigen_by_division(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix from the largest down, and unit eigenvectors as columns."""
    v = (v + v.T) / 2
    size = len(v)
    tiny = size * EPS * np.linalg.norm(v)
    values, vectors = [], []
    blocks = [(v, np.eye(size))]
    while blocks:
        a, basis = blocks.pop()
        off = a - np.diag(np.diag(a))
        if len(a) == 1 or np.linalg.norm(off) <= tiny * 1e-3:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            continue
        reach = np.abs(off).sum(axis=1)
        low, high = (np.diag(a) - reach).min(), (np.diag(a) + reach).max()
        shift = float(np.median(np.diag(a)))
        parts = None
        # The shift moves by halving until eigenvalues lie on both sides of it; a block whose
        # eigenvalues agree to working precision is a multiple of the identity.
        while parts is None and high - low > tiny * 1e-3:
            polar = polar_factor(a - shift * np.eye(len(a)))
            above = (np.trace(polar) + len(a)) / 2
            rank = round(float(above))
            if abs(above - rank) > 1e-6:
                shift += (high - shift) * 1e-3 + tiny
                if shift >= high:
                    break
                continue
            if 0 < rank < len(a):
                parts = invariant_bases(a, (polar + np.eye(len(a))) / 2, rank)
            if rank == 0:
                high = shift
            elif rank == len(a):
                low = shift
            elif parts is None:
                high = low + (high - low) * 0.77
            shift = (low + high) / 2
        if parts is None:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            continue
        for part in parts:
            inner = part.T @ a @ part
            blocks.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    q = np.array(vectors).T[:, order]
    # One step that makes the columns orthonormal to working precision, then Rayleigh quotients.
    q = q @ (1.5 * np.eye(size) - 0.5 * (q.T @ q))
    return np.einsum("ij,ij->j", q, v @ q), q


# ------------------------------------------------------------------ vectors in tasks


def grid(vectors: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: which rows are usable, the lengths of all rows, and the usable rows' grid values,
    one after the other."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        steps = np.floor(scale * values)
        bad = ~(np.abs(steps) < LARGEST)
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - sizes])
    kept = steps[np.repeat(usable, sizes)]
    return usable, sizes, kept.astype(np.int64) + offset


def packed(x: np.ndarray) -> bytes:
    """A vector as bytes: 32 bits an entry where that is enough, else 64."""
    small = x.astype("<i4")
    return small.tobytes() if (small == x).all() else x.astype("<i8").tobytes()


def unpacked(rows: pa.Array, dim: int) -> np.ndarray:
    """Vectors of ``dim`` entries from bytes, a row each."""
    sizes = pc.binary_length(rows).to_numpy(zero_copy_only=False)
    if len(rows) and (sizes == 4 * dim).all():
        flat = b"".join(rows.to_pylist())
        return np.frombuffer(flat, "<i4").reshape(-1, dim).astype(np.int64)
    out = [np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<i8").astype(np.int64) for b in rows.to_pylist()]
    return np.array(out, np.int64).reshape(-1, dim)


def _pack(scale: int, offset: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, sizes, x = grid(batch.column(0), scale, offset)
            sizes = sizes[usable]
            ends = np.cumsum(sizes)
            data = [packed(x[b - s : b]) for b, s in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["dim", "x"]
            )

    return pack


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening of vectors of ``dim`` entries.

    ``n`` distinct vectors with sums ``sums`` per entry; ``vectors`` holds a component per column.
    """

    dim: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE
    offset: int = OFFSET
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Grid values minus their mean: the whole part first, which is exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        # A component at a time, summed by row, so that equal rows get equal results wherever they stand;
        # a matrix product may round the last rows of a batch in another way.
        centred, weights = self.centred(x), self.vectors / np.sqrt(self.values)
        return np.stack([(centred * w).sum(axis=1) for w in weights.T], axis=1) if len(weights.T) else centred[:, :0]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of ``(n * x - sum) ** 2``, exact; None where that is no long."""
        if not len(x):
            return []
        most = max(int(np.abs(x).max()), *map(abs, self.sums), 1)
        if most * self.n < 1 << 62:
            gap = x * self.n - np.array(self.sums, np.int64)
            if self.dim * int(np.abs(gap).max()) ** 2 < 1 << 62:
                return (gap * gap).sum(axis=1).tolist()
        rows = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums)) for row in x.tolist()]
        return [row if row < 1 << 63 else None for row in rows]

    def whitened_column(self, embedding: Column) -> Column:
        """Struct of ``deviation`` and ``whitened`` (an entry per component); null for a row that is
        left out."""
        model = self
        kind = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

        def whiten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                usable, sizes, x = grid(batch, model.scale, model.offset)
                fits = sizes[usable] == model.dim
                x = x[np.repeat(fits, sizes[usable])].reshape(-1, model.dim)
                w = model.project(x)
                k = w.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * k, w.ravel())
                found = pa.StructArray.from_arrays(
                    [pa.array(model.deviations(x), pa.int64()), lists], fields=list(kind)
                )
                place = np.zeros(len(sizes), np.int64)
                here = usable & (sizes == model.dim)
                place[here] = np.arange(len(w))
                yield found.take(pa.array(place, mask=~here))

        whiten.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(whiten, "deviation long, whitened array<double>")(embedding)


def _sums(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = unpacked(batch.column(0), dim)
            if len(x):
                whole = x.astype(object) if np.abs(x).max() > 1 << 40 else x
                total = [a + int(b) for a, b in zip(total, whole.sum(axis=0))]
                n += len(x)
        cells = pa.array(range(-1, dim), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [cells, pa.array([str(t) for t in [n, *total]], pa.string())], names=["cell", "total"]
        )

    return add


def _products(model: Whitening, whiten: bool):
    """Sums of products of centred (or whitened) entries, by cell of the upper triangle."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.vectors.shape[1] if whiten else model.dim
        sums = np.zeros((size, size))
        for batch in batches:
            x = unpacked(batch.column(0), model.dim)
            y = model.project(x) if whiten else model.centred(x)
            sums += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array((i * size + j).astype(np.int64)), pa.array(sums[i, j])], names=["cell", "value"]
        )

    return multiply


def _covariance(fit: DataFrame, model: Whitening, whiten: bool) -> np.ndarray:
    size = model.vectors.shape[1] if whiten else model.dim
    cells = fit.mapInArrow(_products(model, whiten), "cell long, value double")
    v = np.zeros(size * size)
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():
        v[cell] = value / model.n
    v = v.reshape(size, size)
    return v + np.triu(v, 1).T


def fit_whitening(
    df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> Whitening | None:
    """Learns the whitening of a column of vectors (array of float or double).

    Left out are null and empty vectors, those with a null or non-finite entry (or one whose grid
    value ``floor(scale * c) + offset`` is no long) and those that are not of the most frequent
    length among distinct vectors (of equally frequent ones, the longest). Every distinct grid
    vector counts once. Components whose variance is zero to working precision are not given,
    so there may be fewer than asked for; None if there is nothing to learn from.
    """
    rows = df.select(named(vector_col).cast("array<double>").alias("v"))
    fit = stored(rows.mapInArrow(_pack(scale, offset), "dim int, x binary").where("dim > 0").distinct(), "fit")
    longest = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if longest is None:
        return None
    dim = longest.dim
    fit = fit.where(F.col("dim") == dim).select("x")
    # One line per entry of a vector.
    totals = fit.mapInArrow(_sums(dim), "cell int, total string").groupBy("cell")
    totals = dict(totals.agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string")).collect())
    n, sums = int(totals[-1]), tuple(int(totals[i]) for i in range(dim))
    empty = Whitening(dim, n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, scale, offset)
    v = _covariance(fit, empty, False)
    values, vectors = eigen_by_division(v)
    kept = min(components, int((values > dim * EPS * values[0]).sum())) if values[0] > 0 else 0
    if kept == 0:
        return empty
    parts = (dim, n, sums, values[:kept], vectors[:, :kept], float(np.trace(v)), scale, offset)
    error = np.abs(_covariance(fit, Whitening(*parts), True) - np.eye(kept)).max()
    return Whitening(*parts, float(error))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """A line per usable row and component; no lines if all usable vectors are equal."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(rows)
    if model is None or not len(model.values):
        nothing = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], nothing)
    found = rows.select("vec_id", model.whitened_column(F.col("embedding").cast("array<double>")).alias("w"))
    lines = found.where(F.col("w").isNotNull()).select(
        "vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "whitened")
    )
    shares = F.array(*[F.lit(e) for e in model.explained])
    return lines.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
