"""Whitening of embeddings with MLlib's BlockMatrix.

Entries become whole numbers, x = floor(1024 c) + 100000. The centred vectors are numbered and cut into blocks of rows; the
scatter is the transposed block matrix times itself, its eigenvectors are found on the driver (a matrix of dimension x dimension), and the
block matrix times the whitening matrix projects the rows. Products along the rows are split into as many partial sums as there are blocks
(``numMidDimSplits``), so that no task holds more than a few blocks; the sums of the fit list and the deviations are whole-number arithmetic.

Defined results: rows whose vector is null, empty, holds null or non-finite entries, or entries of 2**52 / 1024 or more in size, take no part, nor do
rows of another length than the most frequent one (of equally frequent ones the shortest); repeated rows and null ids stay; a component without variance
has whitened 0 and its share of the identity error; a deviation beyond 64 bits is null; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.functions.numbering import number_rows
from callstrata.llm.text import read, staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of a block of the matrix (8 bytes each).
CELLS = 1 << 18
LARGEST = float(2**52)


def whole(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part, of any length."""
    fit = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(cast(c AS double)) * {0} < {1}D)".format(SCALE, LARGEST)
    x = f"transform(embedding, c -> floor({SCALE} * cast(c AS double)) + {SHIFT}L)"
    return rows.filter(fit).select("vec_id", F.expr(x).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """vec_id, x, i (0-based) of the rows of the most frequent length."""
    rows = staged(rows.withColumn("row_no", F.monotonically_increasing_id()))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("x") == (length["d"] if length else 0))
    return staged(number_rows(rows, "row_no", "i").select("vec_id", "x", (F.col("i") - 1).cast("long").alias("i")))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    high, low = F.shiftright("v", 32), F.col("v").bitwiseAND(2**32 - 1)  # both sums stay within 64 bits
    found = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(high).alias("high"), F.sum(low).alias("low"), F.count("*").alias("n")).collect()
    return (found[0]["n"] if found else 0), [r["high"] * 2**32 + r["low"] for r in sorted(found, key=lambda r: r["k"])]


def block_matrix(rows: DataFrame, column: str, height: int, n: int, d: int) -> BlockMatrix:
    """Blocks of ``height`` rows of the vectors of ``column`` (array of double), indexed by ``i``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("i").alias("index"), array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(height, d)


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b, the sums over the middle dimension taken in ``splits`` parts first."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transposed matrix times itself, on the driver: as large as the square of the number of columns."""
    return product(m.transpose(), m, m.numRowBlocks).toLocalMatrix().toArray()


def whitening(scattered: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix (dimension x components) that whitens centred rows, and each component's share of the variance."""
    v = scattered / n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    total = float(np.trace(v))
    real = value > max(total, 0.0) * 1e-13
    w = np.where(real, vector / np.sqrt(np.where(real, value, 1.0)), 0.0)
    return w, np.where(real, value, 0.0) / total if total > 0 else np.zeros(len(value))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = numbered(whole(rows))
    n, s = sums(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d = len(s)
    height = max(64, CELLS // d)
    mean = F.array(*[F.lit(v / n) for v in s])
    exact = F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in s])
    centred = rows.withColumn("c", F.zip_with("x", mean, lambda x, m: x.cast("double") - m))
    matrix = block_matrix(centred, "c", height, n, d)
    w, explained = whitening(scatter(matrix), n, components)
    k = len(explained)
    local = BlockMatrix(rows.sparkSession.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, w.ravel(order="F").tolist()))], 1), d, k)
    projected = product(matrix, local)
    told = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    told = staged(told.select(F.col("index").alias("i"), vector_to_array("vector").alias("z")))
    error = float(np.abs(scatter(block_matrix(told, "z", height, n, k)) / n - np.eye(k)).max())

    # a part of more than ten digits has a square beyond 64 bits
    part = F.zip_with("x", exact, lambda x, t: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - t).try_cast("decimal(10,0)"))
    square = F.aggregate(part, F.lit(0).cast("decimal(38,0)"), lambda a, y: (a + y * y).cast("decimal(38,0)"))
    facts = rows.select("vec_id", "i", square.try_cast("long").alias("deviation"))
    shares = F.array(*[F.lit(float(e)) for e in explained])
    out = facts.join(told, "i").select("vec_id", "deviation", F.posexplode(F.arrays_zip("z", shares.alias("e"))).alias("p", "v"))
    return out.select("vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.col("v")["z"].alias("whitened"), F.col("v")["e"].alias("explained"), F.lit(error).alias("identity_error"))


def op12_block_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
