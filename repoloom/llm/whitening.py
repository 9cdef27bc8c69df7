"""Embedding whitening: covariance of distinct vectors with weights, each distinct vector whitened once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
PIECE_ROWS = 50_000
BATCH = 4096
LIMIT = float(1 << 61)


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): floor(scale * c) + shift for every entry c, as longs.

    Rows whose vector is null or empty or holds null, NaN or infinite entries
    are left out, and so are rows whose length is not that of most rows (of
    equally many, the longer).  Entries beyond 2^61 after scaling stay at
    2^61.
    """
    c = F.col("v")
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf))))
    sizes = rows.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size(c) == (sizes["size"] if sizes else 0))
    near = lambda e: F.least(F.greatest(F.floor(e * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long") + shift
    return rows.select("id", F.transform(c, near).alias("x"))


def matrices(batches, name: str = "x"):
    """(batch, its lists of longs or doubles as the rows of a matrix)."""
    for batch in batches:
        if batch.num_rows:
            lists = batch.column(batch.schema.get_field_index(name))
            yield batch, lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(df: DataFrame, sums, kind: str) -> np.ndarray:
    """Column sums of the matrix rows that `sums` makes of the batches of each partition."""
    ddl = f"v array<{kind}>"

    def parts(batches):
        total = None
        for more in sums(batches):
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["v"])

    found = df.mapInArrow(parts, ddl).select(F.posexplode("v").alias("at", "e")).groupBy("at").agg(F.sum(F.col("e").cast("decimal(38,0)") if kind == "long" else F.col("e")).alias("e"))
    rows = {r["at"]: r["e"] for r in found.collect()}
    return np.array([int(rows[i]) if kind == "long" else rows[i] for i in range(len(rows))], object if kind == "long" else np.float64)


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights of vectors(x, w), and of the entries of x in each dimension times their weights, exact."""

    def sums(batches):
        for batch, x in matrices(batches):
            w = batch.column(batch.schema.get_field_index("w")).to_numpy()
            # halves of 32 bits: their sums fit into longs over a partition of up to 2^31 weights
            high, low = x >> 32, x & 0xFFFFFFFF
            yield np.concatenate(([w.sum()], w @ high, w @ low))

    out = summed(vectors, sums, "long")
    if not len(out):
        return 0, []
    half = (len(out) - 1) // 2
    return int(out[0]), [(int(a) << 32) + int(b) for a, b in zip(out[1:half + 1], out[half + 1:], strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles: whole means are taken off as integers first."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance of vectors(x, w), divisor n: a product of centred matrices in every partition, then their sum."""

    def products(batches):
        for batch, x in matrices(batches):
            w = batch.column(batch.schema.get_field_index("w")).to_numpy().astype(np.float64)
            y = centred(x, n, sums)
            yield (y * w[:, None]).T @ y

    size = len(sums)
    return summed(vectors, products, "double").reshape(size, size) / n


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, the largest entry of a vector positive; of directions without variance the eigenvalue is 0."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    values[values <= len(cov) * np.finfo(float).eps * max(values[0], 0)] = 0
    return values, vectors * np.where(sign == 0, 1, sign)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Sums of (n * x - S)^2 over the dimensions, exact; None where a long can't hold one."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    away = x - whole
    bound = n * (int(np.abs(away).max(initial=0)) + 1)
    if bound * bound * len(sums) < 1 << 63:
        y = n * away - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in away.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, shift: int = SHIFT, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every remaining row and component.

    Which rows remain, and the integers x, see integer_vectors.  Identical x
    are one vector; in the fit it counts once (weights="one") or as often as
    it occurs ("counts"), n and the sums S accordingly.  Each distinct vector
    is whitened once and joined back to its rows; repeated rows and null ids
    stay rows.  A component without variance (all rows equal; fewer vectors
    than dimensions) has no square root to divide by: `whitened` is null and
    `explained` 0 there.  `deviation` is null beyond the longs.  An empty
    table gives no rows.

    At most a matrix of dimensions squared leaves a task or reaches the driver.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    rows = integer_vectors(embeddings, id_col, vector_col, scale, shift)
    # 128 bits name a vector; the rows of a common one are spread over pieces
    rows = stored(rows.select("id", "x", F.xxhash64("x").alias("ha"), F.xxhash64(F.lit("second"), "x").alias("hb")))
    weight = F.count("*") if weights == "counts" else F.first(F.lit(1).cast("long"))
    vectors = stored(rows.groupBy("ha", "hb").agg(F.first("x").alias("x"), weight.alias("w")))
    n, sums = totals(vectors)
    names = [F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened"]
    if not n:
        none = rows.select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"))
        return none.where("false").select(*names, F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    cov = covariance(vectors, n, sums)
    values, axes = principal(cov, components)
    live = values > 0
    trace = float(np.trace(cov))
    explained = [float(v) / trace if trace else 0.0 for v in values]
    scaled = axes * np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0.0)

    def white(batches):
        for batch, x in matrices(batches):
            for at in range(0, batch.num_rows, BATCH):
                some = x[at:at + BATCH]
                out = centred(some, n, sums) @ scaled
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(deviations(some, n, sums), pa.int64()),
                     pa.FixedSizeListArray.from_arrays(out.ravel(), out.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["ha", "hb", "w", "deviation", "y"])

    each = stored(vectors.select("ha", "hb", "x", "w").mapInArrow(white, "ha long, hb long, w long, deviation long, y array<double>"))
    error = identity_error(each, n, live)
    pieces = rows.count() // PIECE_ROWS + 1
    out = spread_join(rows.select("id", "ha", "hb"), each.select("ha", "hb", "deviation", "y"), ["ha", "hb"], F.pmod(F.xxhash64("id"), F.lit(pieces)))
    parts = F.posexplode(F.arrays_zip("y", F.array(*[F.lit(e) for e in explained]).alias("explained"), F.array(*[F.lit(bool(v)) for v in live]).alias("live")))
    return out.select("id", "deviation", parts.alias("at", "c")).select(
        "id", "deviation", (F.col("at") + 1).alias("component"), F.when(F.col("c.live"), F.col("c.y")).alias("whitened"), F.col("c.explained").alias("explained")
    ).select(*names, "explained", F.lit(error).alias("identity_error"))


def identity_error(each: DataFrame, n: int, live: np.ndarray) -> float:
    """Largest entry of the covariance of each(y, w) minus the identity, over the components with variance."""
    kept = np.flatnonzero(live)
    if not len(kept):
        return 0.0

    def sums(batches):
        for batch, y in matrices(batches, "y"):
            yield batch.column(batch.schema.get_field_index("w")).to_numpy().astype(np.float64) @ y[:, kept]

    mean = summed(each.select("w", "y"), sums, "double") / n

    def products(batches):
        for batch, y in matrices(batches, "y"):
            w = batch.column(batch.schema.get_field_index("w")).to_numpy().astype(np.float64)
            y = y[:, kept] - mean
            yield (y * w[:, None]).T @ y

    cov = summed(each.select("w", "y"), products, "double").reshape(len(kept), -1) / n
    return float(np.abs(cov - np.eye(len(kept))).max())
