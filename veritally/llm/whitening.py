"""Whitening of embeddings by the weighted covariance of their distinct quantised vectors.

Each entry c becomes the integer x = floor(64 * c) + 1,000,000. Rows with the same x are grouped once,
and the number of rows, or one, is the weight of a distinct vector in the fit. Sums per dimension are
exact integers; the covariance is a weighted product of centred vectors, a matrix per task, added up in
rounds. Its eigenvectors are found on the driver: the matrix depends on the dimension only, which is
bounded. Each distinct vector is projected once, and the rows fetch their vector's result by key. A
vector that more than one row in `SHARE` has is copied under several keys, so that no task gets all of
its rows; there are fewer than `SHARE` such vectors, at any size of the table.

Vectors are known by two 64-bit hashes, 128 bits together.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritally.llm.common import bounded_batches, staged

SCALE, SHIFT = 64, 1_000_000
MOST_DIMENSIONS = 4_096
SHARE = 200
#: Eigenvalues below this part of the largest, times the dimension, are rounding.
ROUNDING = 2.0 ** -50


class Whitening(NamedTuple):
    """n: weight of the fit; sums: per dimension; vectors: components as columns, by falling value."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def live(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > (self.values[0] if len(self.values) else 0.0) * ROUNDING * max(len(self.sums), 1)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x, k1, k2 of the rows whose vector is there and has finite entries only."""
    c = F.col(vector_col).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long"))
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad)
    out = kept.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return out.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(13), "x", F.lit(17))})


def _matrix(column) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; an error where 64 bits do not hold it."""
    if len(x) and (np.abs(x).max(initial=0) > 2.0 ** 62 / max(n, 1)):
        raise OverflowError("entries are too large for exact 64-bit deviations of so many vectors")
    return n * x - sums


def _sum_partials(partials: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Adds up binary vectors of `size` doubles in rounds; the driver gets eight at most."""

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    while tasks > 8:
        tasks = -(-tasks // 16)
        partials = partials.repartition(tasks).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"]) for r in partials.toLocalIterator()), np.zeros(size))


def fit(distinct: DataFrame, weights: str = "one") -> Whitening:
    """The model of distinct vectors x with their number of rows `copies`.

    weights: "one" counts each distinct vector once, "count" as often as it occurs. Vectors of several
    lengths, or of more than `MOST_DIMENSIONS` entries, are an error. No vectors: a model of none.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights: {weights}")
    w = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    shape = distinct.agg(F.sum(w).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if shape["n"] is None:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    n, d = shape["n"], shape["most"]
    if shape["least"] != d or d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {shape['least']} to {d} entries; they need one length, of {MOST_DIMENSIONS} at most")
    weighted = distinct.select("x", w.alias("w"))

    def sums(batches):
        total = [0] * d
        for b in batches:
            x, w = _matrix(b.column(0)), b.column(1).to_numpy()
            if len(x) and np.abs(x).max() * float(w.sum()) >= 2.0 ** 63:
                raise OverflowError("entries are too large for exact 64-bit sums")
            total = [a + int(v) for a, v in zip(total, w @ x, strict=True)]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array(total, pa.int64())], ["i", "s"])

    s = np.zeros(d, np.int64)
    for r in weighted.mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():
        s[r["i"]] = r["s"]

    def product(batches):
        total = np.zeros((d, d))
        for b in batches:
            z, w = _centred(_matrix(b.column(0)), n, s) / n, b.column(1).to_numpy()
            total += (z * w[:, None]).T @ z
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    tasks = max(1, len(distinct.inputFiles()))
    v = _sum_partials(weighted.mapInArrow(product, "m binary"), tasks, d * d).reshape(d, d) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1, 1)
    return Whitening(n, s, vectors, values, float(np.trace(v)))


def projected(distinct: DataFrame, model: Whitening, components: int) -> DataFrame:
    """k1, k2, copies, deviation and the whitened components of each distinct vector, computed once."""
    c = min(components, len(model.sums))
    live = model.live()[:c]
    turn = model.vectors[:, :c] / np.sqrt(np.where(live, model.values[:c], 1.0))
    n, s = model.n, model.sums

    def project(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z = _centred(_matrix(b.column(3)), n, s)
            if float((z.astype(float) ** 2).sum(1).max()) >= 2.0 ** 63:
                raise OverflowError("a deviation does not fit into 64 bits")
            white = (z / n) @ turn
            flat = pa.array(white.ravel(), pa.float64(), mask=np.tile(~live, len(white)))
            at = pa.array(np.arange(len(white) + 1) * c, pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array((z * z).sum(1), pa.int64()), pa.ListArray.from_arrays(at, flat)], ["k1", "k2", "copies", "deviation", "white"])

    return distinct.select("k1", "k2", "copies", "x").mapInArrow(project, "k1 long, k2 long, copies long, deviation long, white array<double>")


def identity_error(white: DataFrame, model: Whitening, components: int, weights: str = "one") -> float | None:
    """Largest entry of |covariance of the whitened vectors - identity|, over components with variance."""
    live = np.flatnonzero(model.live()[:components])
    if not len(live):
        return None
    c, n = len(live), model.n

    def part(batches, mean, size):
        total = np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            y = _matrix(b.column(0))[:, live]
            w = np.ones(len(y)) if weights == "one" else b.column(1).to_numpy().astype(float)
            total += (w @ y) if mean is None else (((y - mean) * w[:, None]).T @ (y - mean)).ravel()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    tasks, source = max(1, len(white.inputFiles())), white.select("white", "copies")
    mean = _sum_partials(source.mapInArrow(lambda b: part(b, None, c), "m binary"), tasks, c) / n
    cov = _sum_partials(source.mapInArrow(lambda b: part(b, mean, c * c), "m binary"), tasks, c * c).reshape(c, c) / n
    return float(np.abs(cov - np.eye(c)).max())


def joined_back(rows: DataFrame, white: DataFrame) -> DataFrame:
    """rows (vec_id, k1, k2) with their vector's columns; frequent vectors are spread over several keys."""
    total = rows.count()
    many = F.col("copies") * SHARE > total
    part = max(1, total // SHARE)
    white = white.withColumn("keys", F.when(many, F.ceil(F.col("copies") / part)).otherwise(1).cast("int"))
    hot = [(r["k1"], r["k2"], r["keys"]) for r in white.where("keys > 1").select("k1", "k2", "keys").collect()]  # fewer than SHARE
    salt = F.lit(0)
    if hot:
        keys = F.create_map(*[F.lit(x) for k1, k2, n in hot for x in (f"{k1}:{k2}", n)])[F.concat_ws(":", "k1", "k2")]
        salt = F.when(keys.isNotNull(), F.pmod(F.xxhash64("place"), keys).cast("int")).otherwise(0)
    copies = white.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))).drop("keys", "copies")
    return rows.withColumn("salt", salt).join(copies, ["k1", "k2", "salt"]).drop("salt", "k1", "k2", "place")


def whitened(rows: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries go. Components are numbered
    from 1 by falling eigenvalue; each one's largest entry is positive. There are as many as dimensions,
    `components` at most. A component without variance (as in a table of one distinct vector) has a null
    `whitened` and explains 0.0; identity_error is over the others, null if there are none. n and
    deviation are exact; entries so large that they do not fit into 64 bits are an error, as are
    vectors of several lengths. Repeated rows and null ids each get their rows; empty table: no rows.
    Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    x = quantised(rows, id_col, vector_col)
    distinct = staged(x.groupBy("x", "k1", "k2").agg(F.count("*").alias("copies")), "whitening-distinct")
    model = fit(distinct, weights)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not model.n:
        return spark.createDataFrame([], schema)
    white = staged(projected(distinct, model, components), "whitening-projected")
    error = identity_error(white, model, components, weights)
    share = np.where(model.live(), model.values, 0.0)[:components] / (model.trace or 1.0)
    keyed = staged(x.select("vec_id", "k1", "k2").withColumn("place", F.monotonically_increasing_id()), "whitening-rows")
    out = joined_back(keyed, white).select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in share]), F.col("i") + 1)
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
