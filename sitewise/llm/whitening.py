"""Embedding whitening on distributed block matrices.

Method: entries become whole numbers; the centred rows are indexed 0, 1, .. and dealt into blocks of
``rows_per_block`` rows (MLlib's ``BlockMatrix``). The scatter matrix is the blocks' transpose times the
blocks, its middle dimension split over many tasks, so that no task sees all rows; its eigenvectors are
taken on the driver (one matrix of dimension x dimension). The blocks times the whitening matrix (leading
eigenvectors over the roots of their eigenvalues) are the projected rows.

Sums and deviations are exact whole numbers, and rows are centred as (n x - S) / n from them, so no digits
are lost to the common offset.

Bounds: the driver gets the sums and the scatter matrix (dimension and its square), one pair of numbers
for each block (MLlib plans a product by the blocks' coordinates), and one row count for each input task.

Defined cases: rows without a vector, with a null entry, or with one which is not finite are left out,
and so are vectors of another length than the commonest (of equally common lengths the longest counts);
entries too large for a long are taken at its limits; a component without variance (eigenvalue up to
1e-12 of the largest) is projected to 0 and does not count in ``identity_error``; if there is no variance at
all, ``explained`` is 0; equal rows get equal results; an empty table gives an empty table; other columns
are kept, those named like an output give way to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.prefix import prefix_sums
from sitewise.sources.scratch import stored

OUTPUTS = ("n", "deviation", "whitened", "explained", "identity_error")
#: Eigenvalues below this share of the largest are rounding.
NOTHING = 1e-12
#: Blocks multiplied in one task, and the most tasks (each sends one partial product).
BLOCKS_PER_TASK, MOST_TASKS = 8, 2048
#: Largest whole number an entry may reach before it is shifted.
FARTHEST = 9e18


def whole_entries(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * entry) + shift of each entry, as longs."""
    scaled = F.transform(vector, lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-FARTHEST)), F.lit(FARTHEST)))
    return F.transform(scaled, lambda c: F.floor(c) + F.lit(shift).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def whiten(
    vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000,
    rows_per_block: int = 1024,
) -> DataFrame:
    """The rows fit for use, without the vector, with ``n`` (their number), ``deviation`` (sum over the
    dimensions of (n x - S)^2, decimal, null beyond 38 digits), ``whitened`` (one double for each component,
    by falling eigenvalue), ``explained`` (each component's share of the variance) and ``identity_error``
    (largest entry of the whitened rows' covariance less the identity)."""
    others = [c for c in vectors.columns if c != vector and c.lower() not in OUTPUTS]
    fit = vectors.where(usable(F.col(vector)))
    lengths = fit.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    row = F.struct(F.lit(0).alias("none"), *others)
    rows = fit.where(F.size(vector) == (lengths.d if lengths else 0)).select(
        row.alias("row"), whole_entries(F.col(vector), scale, shift).alias("x"), F.monotonically_increasing_id().alias("id")
    )
    if lengths is None:
        return _result(rows.withColumns({"n": F.lit(0).cast("bigint"), "deviation": F.lit(None).cast("decimal(38,0)")}), others, F.array().cast("array<double>"), [], 0.0)
    rows = _indexed(stored(rows, "whitening-rows"))
    n, dim = lengths.n, lengths.d
    exact = _exact(n, _sums(rows))

    indexed = rows.select("index", array_to_vector(exact("x")["centred"]).alias("vector"))
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), n, dim).toBlockMatrix(rows_per_block, dim)
    # Read by both products and their plans; a block which is lost is dealt again from the stored rows.
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(blocks) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    top, axes, trace = values[order], axes[:, order], float(np.trace(covariance))
    there = top > NOTHING * max(float(values.max()), 0.0)
    projection = axes * np.where(there, 1 / np.sqrt(np.where(there, top, 1)), 0)

    whitened = stored(projected(blocks, projection), "whitening-rows")
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = _identity_error(whitened, n, np.flatnonzero(there))
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(top, there)]
    both = rows.withColumn("deviation", exact("x")["deviation"].try_cast("decimal(38,0)")).join(whitened, "index")
    return _result(both.withColumn("n", F.lit(n).cast("bigint")), others, F.col("whitened"), explained, error)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The middle dimension is split over tasks, each with some blocks of rows;
    PySpark's own ``multiply`` has no argument for that, MLlib's has."""
    count = -(-blocks.numRows() // blocks.rowsPerBlock)
    tasks = min(-(-count // BLOCKS_PER_TASK), MOST_TASKS)
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def projected(blocks: BlockMatrix, projection: np.ndarray) -> DataFrame:
    """Rows (index, whitened) of the blocks times a small matrix."""
    dim, k = projection.shape
    context = blocks.blocks.context
    right = context.parallelize([((0, 0), Matrices.dense(dim, k, projection.flatten("F")))], 1)
    product = blocks.multiply(BlockMatrix(right, dim, k, dim, k)).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("whitened"))


def _indexed(rows: DataFrame) -> DataFrame:
    """Add ``index`` 0, 1, ..: an id holds its task and its place there; the tasks' counts do the rest."""
    task, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = prefix_sums(counts, [], ["task"], {"upto": F.col("rows")}).select("task", (F.col("upto") - F.col("rows")).alias("ahead"))
    placed = rows.withColumn("task", task).join(F.broadcast(ahead), "task")
    return placed.withColumn("index", F.col("ahead") + place).drop("task", "ahead", "id")


def _sums(rows: DataFrame) -> list[int]:
    """Exact sum of each dimension."""
    entries = rows.select(F.posexplode("x").alias("dimension", "entry"))
    sums = entries.groupBy("dimension").agg(F.sum(F.col("entry").cast("decimal(20,0)")).alias("sum")).collect()
    return [int(r["sum"]) for r in sorted(sums)]


def _exact(n: int, sums: list[int]):
    """Centred entries as doubles and the deviation as digits, from whole numbers."""
    reach = max(map(abs, sums))
    total = np.array(sums, dtype=np.int64 if reach < 1 << 62 else object)

    @F.pandas_udf("struct<centred:array<double>,deviation:string>")
    def exact(x: pd.Series) -> pd.DataFrame:
        entries = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(sums)), dtype=np.int64)
        largest = max(int(entries.max()), -int(entries.min())) if entries.size else 0
        small = n * largest + reach < 1 << 62
        away = n * (entries if small else entries.astype(object)) - total
        # Squares and their sum in 64 bits where they fit, else in Python's numbers.
        fits = small and len(sums) * (int(np.abs(away).max()) if away.size else 0) ** 2 < 1 << 62
        squares = away * away if fits else away.astype(object) ** 2
        return pd.DataFrame({
            "centred": list((away / n).astype(np.float64)), "deviation": [str(int(s)) for s in squares.sum(axis=1)],
        })

    return exact


def _identity_error(whitened: DataFrame, n: int, there: np.ndarray) -> float:
    if not len(there):
        return 0.0
    w = [F.col("whitened")[int(i)] for i in there]
    means = whitened.agg(*(F.avg(x) for x in w)).first()
    centred = [x - F.lit(float(m)) for x, m in zip(w, means)]
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    sums = whitened.agg(*(F.sum(centred[i] * centred[j]) for i, j in pairs)).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(sums, pairs))


def _result(rows: DataFrame, others: list[str], whitened: Column, explained: list[float], error: float) -> DataFrame:
    shares = F.array(*map(F.lit, explained)).cast("array<double>")
    return rows.select(
        *(F.col("row")[c].alias(c) for c in others), "n", "deviation", whitened.alias("whitened"),
        shares.alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
