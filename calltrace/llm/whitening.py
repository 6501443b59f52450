"""Embedding whitening: exact fixed-point sums, blockwise QR of the centred rows, and a bidiagonal qd solver for the directions.

Vectors become fixed-point integers, ``floor(1024 c) + 100000``, so that counts and sums are exact. Each task folds its centred
rows, block by block, into one upper triangle by QR; triangles are folded 16 at a time over rounds of a grouped job until one is
left, so the driver holds d x d numbers and no task more than 16 triangles. That triangle R has the singular values and right
singular vectors of all centred rows; the covariance is never formed. :mod:`calltrace.llm.bidiagonal` reduces R to bidiagonal
form by Householder reflections, finds its singular values by dqds and their vectors by twisted factorisations.

Rows whose vector is null, empty, or holds a null, a non-finite entry or one of 2^30 or more are left out. Where vectors of several
lengths remain, the most frequent length (the longer one of a tie) is whitened and the others are left out. Directions without
variance are no components, so constant or single vectors give no rows, as an empty table does. Repeated rows and null ids
count and come back like all others.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from calltrace.functions.work import materialize, release
from calltrace.llm.bidiagonal import right_singular
from calltrace.llm.text import bounded_batches, free_name

#: Triangles folded by one task.
FAN = 16
#: Fixed-point numbers stay below this size.
LIMIT = float(1 << 40)


def _fixed(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the column: the rows that have it and no unusable entry, and their fixed-point integers."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(size[size > 0]).tolist():
        own = size == d
        m = values[np.repeat(own, size)].reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(m * 1024.0) + 100000.0
            good = (np.abs(x) < LIMIT).all(axis=1)  # false for nan
        if good.any():
            out.append((np.flatnonzero(own)[good], x[good].astype(np.int64)))
    return out


def _sums(vectors: DataFrame) -> DataFrame:
    """``(len, pos, n, total)`` over all usable vectors: exact sums for each length and dimension."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _fixed(batch.column(0)):
                n, s = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                held[x.shape[1]] = [n + len(x), s + x.sum(axis=0).astype(object)]
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], names=["len", "pos", "n", "total"]
            )

    parts = vectors.mapInArrow(run, "len int, pos int, n long, total decimal(38,0)")
    return parts.groupBy("len", "pos").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


class _Centre:
    """Fixed-point rows less their mean: exactly, as multiples of 1/n, or as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * int(w) for s, w in zip(sums, self.whole, strict=True)]  # 0 <= rest < n

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray) -> list[Decimal]:
        """Sums over dimensions of (n x - S)^2."""
        y = x - self.whole
        bound = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if bound * bound * y.shape[1] < 1 << 62 else object
        z = y.astype(kind) * self.n - np.array(self.rest, kind)
        return [Decimal(int(v)) for v in (z * z).sum(axis=1)]


def _fold(have: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x if have is None else np.vstack([have, x]), mode="r")


def _triangle(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows."""
    d = len(sums)

    def rows(batches):
        centre, r = _Centre(n, sums), None
        for batch in batches:
            for _, x in _fixed(batch.column(0)):
                if x.shape[1] == d:
                    r = _fold(r, centre.doubles(x))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = None
        for one in pdf.sort_values("part")["r"]:
            r = _fold(r, np.asarray(one).reshape(-1, d))
        return pd.DataFrame({"part": [key[0]], "r": [r.ravel()]})

    level = materialize(vectors.mapInArrow(rows, "part long, r array<double>"), "whitening-triangles")
    while (count := level.count()) > 1:
        # parts are not numbered without gaps, and hashing spreads them evenly enough
        dealt = level.withColumn("to", F.pmod(F.xxhash64("part"), F.lit(-(-count // FAN)))).groupBy("to")
        after = materialize(dealt.applyInPandas(fold, "part long, r array<double>"), "whitening-triangles")
        release(level)
        level = after
    found = level.first()
    release(level)
    return np.zeros((1, d)) if found is None else np.array(found.r).reshape(-1, d)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count, exact sums, and per component (in columns) its direction and eigenvalue; ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    """Fit on all usable vectors."""
    bounded_batches(vectors.sparkSession)
    only = vectors.select(F.col(column).alias("v"))
    sums = materialize(_sums(only), "whitening-sums")
    best = sums.groupBy("len").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("len")).first()
    if best is None:
        release(sums)
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    s = [int(r.total) for r in sums.where(F.col("len") == best.len).orderBy("pos").collect()]  # one number per dimension
    release(sums)
    squares, v, total = right_singular(_triangle(only, best.n, s), components)
    return Whitening(best.n, tuple(s), v, squares / best.n, total / best.n)


def whitened(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The columns of ``vectors`` but ``column``, with ``deviation`` (decimal, exact) and ``whitened`` (array of doubles) of each usable vector."""
    bounded_batches(vectors.sparkSession)
    rest = [c for c in vectors.columns if c != column]
    names = [free_name(c, rest) for c in ("deviation", "whitened")]
    schema = vectors.select(*rest).schema.add(names[0], "decimal(38,0)").add(names[1], ArrayType(DoubleType()))
    n, sums = model.n, list(model.sums)
    scale = model.directions / np.sqrt(model.eigenvalues)

    def run(batches):
        centre = _Centre(n, sums)
        for batch in batches:
            for at, x in _fixed(batch.column(column)):
                if x.shape[1] != len(sums):
                    continue
                w = centre.doubles(x) @ scale
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in rest] + [pa.array(centre.deviation(x), pa.decimal128(38, 0)), lists], names=[*rest, *names])

    if not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(run, schema)


def identity_error(rows: DataFrame, components: int, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of ``column`` less the identity; 0 without components."""
    k = range(components)
    w = F.col(column)
    sums = [F.sum(w[i]).alias(f"s{i}") for i in k] + [F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i in k for j in range(i + 1)]
    got = rows.agg(F.count("*").alias("n"), *sums).first()
    if not got.n:
        return 0.0
    return max((abs(got[f"p{i}_{j}"] / got.n - got[f"s{i}"] * got[f"s{j}"] / got.n**2 - (i == j)) for i in k for j in range(i + 1)), default=0.0)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation past 64 bits is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    rows = whitened(vectors, model)
    error = identity_error(rows, len(model.eigenvalues))
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    out = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("pos", "whitened"))
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )
