"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded with zeros to a power of two, goes through three rounds of random
sign flips and Hadamard transforms, a fast stand-in for a random rotation; its hash is
the nearest of the 2d signed axes. A key joins ``hashes`` of them, and there are
``tables`` keys. A row enters one bucket a table. A query also probes the buckets of its
next nearest axes: ``probes`` a table, whatever the number of rows. (``least`` above 0
asks for more in tables so small that a query would meet fewer than about that many rows;
what is found then depends on the table's size.)

Equal vectors are one class. What meets in the buckets is a class's sketch: the unit
vector in 16-bit steps, with the exact length of what the rounding left. So each
cosine is known to within a bound, and a class goes on only if it may be among a query's
nearest: none is lost to the sketch. The vectors of the few classes left are fetched, their
cosines taken in double precision and ranked with ties to the smaller id.

A bucket with more than ``hot`` classes or queries is cut into chunks that each meet in a
task's work of their own. Of a class only the smallest ids that can be anyone's nearest are
kept; a vector that a third of all rows hold is one row in the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import on_path, stored

STEPS = 32767


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; powers of two keep huge and tiny components exact."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows through the Walsh-Hadamard transform, which keeps lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, count: int, seed: int = 42) -> Iterator[np.ndarray]:
    """``count`` pseudo-rotations of the unit rows ``x``."""
    d = 1 << max(x.shape[1] - 1, 0).bit_length()
    rng = np.random.default_rng([seed, d])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for _ in range(count):
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d))
        yield y


def axes(y: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` nearest signed axes of each row (numbered 2i, and 2i + 1 for the
    negative one), and how far each component is below the largest."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    at = np.argsort(-both, axis=1, kind="stable")[:, :best]
    near = np.take_along_axis(both, at, 1)
    return at.astype(np.int64), near[:, :1] - near


def keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(row, table, probe) bucket keys, the row's own first."""
    out, turned = [], rotations(x, tables * hashes)
    for _ in range(tables):
        side = 2 * (1 << max(x.shape[1] - 1, 0).bit_length())
        got = [axes(next(turned), min(probes, side)) for _ in range(hashes)]
        picks = np.array(list(product(*[range(g[0].shape[1]) for g in got])))
        key, far = np.zeros((len(x), len(picks)), np.int64), np.zeros((len(x), len(picks)))
        for i, (at, below) in enumerate(got):
            key = key * side + at[:, picks[:, i]]
            far += below[:, picks[:, i]] ** 2
        out.append(np.take_along_axis(key, np.argsort(far, axis=1, kind="stable")[:, :probes], 1))
    return np.stack(out, axis=1)


def sketched(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(k1, k2, d, s, step, off, keys): the class of each row of (k1, k2, e), its sketch, the
    size of a sketch's step, the length lost to it, and its keys, table by table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            size = e.value_lengths().to_numpy()
            flat, ends = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                step = np.abs(x).max(1) / STEPS
                q = np.rint(x / step[:, None])
                off = np.sqrt(((x - q * step[:, None]) ** 2).sum(1))
                k = keys(x, tables, hashes, probes)
                flat_k = pa.array(k.reshape(-1))
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * (k.shape[1] * k.shape[2]), flat_k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(pa.array(at)), batch.column("k2").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)),
                     pa.array([r.tobytes() for r in q.astype("<i2")], pa.binary()), pa.array(step), pa.array(off), lists],
                    ["k1", "k2", "d", "s", "step", "off", "keys"])

    return rows.select("k1", "k2", "e").mapInArrow(run, "k1 long, k2 long, d int, s binary, step double, off double, keys array<long>")


def in_buckets(sketches: DataFrame, tables: int) -> DataFrame:
    """A row for each key of each class: the class, its sketch, and table ``t`` and key ``h``."""
    each = F.size("keys") / tables
    return sketches.select("*", F.posexplode("keys").alias("_i", "h")).withColumn("t", F.floor(F.col("_i") / each).cast("int")).drop("keys", "_i")


def bounded(q: pd.DataFrame, c: pd.DataFrame, most: int, block: int = 256) -> Iterator[pd.DataFrame]:
    """(q1, q2, k1, k2, low, high) of the classes ``c`` that may be among the ``most``
    nearest of a query among ``c``; their cosine lies between low and high."""
    def read(f: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(f["s"]), "<i2").reshape(len(f), -1) * f["step"].to_numpy()[:, None]

    a, b = read(q), read(c)
    off_a, off_b = q["off"].to_numpy(), c["off"].to_numpy()
    for lo in range(0, len(a), block):
        rows = slice(lo, lo + block)
        near = a[rows] @ b.T
        give = off_a[rows, None] + (1 + off_a[rows, None]) * off_b + 1e-12
        low = near - give
        least = np.partition(low, -most, axis=1)[:, -most] if len(c) > most else np.full(len(near), -np.inf)
        i, j = np.nonzero(near + give >= least[:, None])
        yield pd.DataFrame({"q1": q["k1"].to_numpy()[rows][i], "q2": q["k2"].to_numpy()[rows][i], "k1": c["k1"].to_numpy()[j],
                            "k2": c["k2"].to_numpy()[j], "low": low[i, j], "high": (near + give)[i, j]})


def meet(data: DataFrame, asked: DataFrame, most: int, hot: int, chunk: int, total: int) -> DataFrame:
    """Per query and class that share a bucket and may be among the query's ``most`` nearest:
    (q1, q2, k1, k2, low, high), once for each bucket."""
    bucket = ["d", "t", "h"]
    many = lambda df, name: df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(
        *bucket, F.ceil(F.col("n") / hot).cast("int").alias(name))
    crowded = many(data, "_dp").join(many(asked, "_qp"), bucket, "full")
    crowded = stored(crowded, "crowded-buckets")
    piece = lambda n: F.pmod(F.xxhash64("k1", "k2"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    data = data.join(crowded, bucket, "left").withColumn("p", piece(F.col("_dp"))).withColumn("o", every("_qp"))
    asked = asked.join(crowded, bucket, "left").withColumn("o", piece(F.col("_qp"))).withColumn("p", every("_dp"))
    both = data.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))).drop("_dp", "_qp")
    both = both.withColumn("g", F.pmod(F.xxhash64(*bucket, "p", "o"), F.lit(max(1, -(-total // chunk)))))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby([*bucket, "p", "o"], sort=False):
            q, c = own[own["asks"]], own[~own["asks"]]
            if len(q) and len(c):
                out += bounded(q, c, most)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q1", "q2", "k1", "k2", "low", "high")})

    return both.groupBy("g").applyInPandas(join, "q1 long, q2 long, k1 long, k2 long, low double, high double")


def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine in double precision; components are scaled by powers of two, which is exact."""
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        x, y = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (x, y))
        out[i] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
    return pd.Series(out)


def nearest(vecs: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", tables: int = 4,
            hashes: int = 1, probes: int = 24, least: int = 0, hot: int = 4096, chunk: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``
    the ``k`` other vectors found with the largest cosine, nearest first, ties to the
    smaller id; all that were found if they are fewer.

    Rows take no part if their id or vector is null or the vector is empty, all zero, or
    holds a null or a non-finite number. Only vectors of one length are compared. Rows
    equal in id and vector are one; other rows of a query's id are candidates like any, and
    each is a query of its own. An empty table gives no rows. Other columns are not read."""
    on_path(vecs.sparkSession)
    e = F.col("e")
    rows = vecs.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("e"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = rows.where(F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(7), "e")})
    cls = ["k1", "k2"]
    asks = F.col("vec_id") % every == 0
    ids = stored(rows.select("vec_id", *cls).distinct(), "neighbour-ids")
    # only these ids of a class can be nearest to anyone
    members = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*cls).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    members = stored(members, "neighbour-members")
    n = members.where("_r = 1").count()
    longest = (rows.agg(F.max(F.size("e"))).first()[0] or 1)
    side = (2 << max(longest - 1, 0).bit_length()) ** hashes
    wide = min(side, max(probes, -(-side * least // max(n, 1))))
    one = lambda df: df.groupBy(*cls).agg(*[F.first(c).alias(c) for c in ("d", "s", "step", "off", "keys")])
    data = stored(one(sketched(rows, tables, hashes, 1)), "neighbour-sketches")
    asked = stored(one(sketched(rows.where(asks), tables, hashes, wide)), "neighbour-queries")
    total = n * tables + asked.count() * tables * wide
    found = stored(meet(in_buckets(data, tables), in_buckets(asked, tables), k + 1, hot, chunk, total), "neighbour-met")
    pair = found.groupBy("q1", "q2", *cls).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("low")))
    edge = pair.withColumn("_r", place).where(F.col("_r") == k + 1).select("q1", "q2", F.col("low").alias("edge"))
    pair = pair.join(edge, ["q1", "q2"], "left").where(F.col("edge").isNull() | (F.col("high") >= F.col("edge")))
    pair = stored(pair.select("q1", "q2", *cls), "neighbour-pairs")
    # one vector of each class: that of its smallest id
    wanted = pair.select(*cls).union(pair.select("q1", "q2")).distinct()
    first = members.where("_r = 1").join(wanted, cls, "left_semi").select("vec_id", *cls)
    vector_of = stored(rows.groupBy("vec_id", *cls).agg(F.first("e").alias("e")).join(first, ["vec_id", *cls]).drop("vec_id"), "neighbour-vectors")
    query = vector_of.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("e").alias("qe"))
    exact = pair.join(vector_of, cls).join(query, ["q1", "q2"]).select("q1", "q2", *cls, F.pandas_udf(cosines, "double")("qe", "e").alias("score"))
    listed = exact.join(members.drop("_r"), cls)
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", *cls)
    best = listed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    best = best.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score", *cls))).alias("best"))
    out = ids.where(asks).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(best, ["q1", "q2"])
    other = F.filter("best", lambda x: (x["vec_id"] != F.col("query_id")) | (x["k1"] != F.col("q1")) | (x["k2"] != F.col("q2")))
    out = out.select("query_id", F.posexplode(F.slice(other, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
