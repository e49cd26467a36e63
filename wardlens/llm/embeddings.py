"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Equal vectors of a label form a class, linked throughout; only one vector per class goes
on. A table's hash of a normalised vector x is made of ``width``-quantised random
projections, floor((a.x + b) / w) for ``projections`` Gaussian a and uniform b. Vectors
of one label that share a hash in any of ``tables`` tables are compared by cosine in
double precision. A pair counts in the first table where it meets, so link counts need
no list of pairs: a bucket returns for each class its number of links there and its root
in a spanning forest.

At distance c a projection keeps two vectors together with probability
p(c) = 1 - 2 Phi(-w/c) - 2c/(sqrt(2 pi) w) (1 - exp(-w^2/2c^2)). At cosine 0.93
(c = 0.374), w = 3, 12 projections and 20 tables miss a pair with probability 0.0013;
closer pairs less. Unrelated vectors (c = 1.41) meet in a table with probability 0.004.

A bucket with more than ``hot`` classes is cut into chunks by a hash, and each pair of
chunks is a task's work of its own; all of its pairs are still compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import stored
from wardlens.llm.graph import components
from wardlens.llm.simhash import forest


def hash_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int = 42) -> np.ndarray:
    """(row, table) 32-bit hashes of unit vectors."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    mult = rng.integers(1, 1 << 62, projections, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    q = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections)
    return ((q * mult).sum(2) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bucket_links(x: np.ndarray, keys: np.ndarray, weight: np.ndarray, side: np.ndarray | None, table: int, cosine: float,
                 block: int = 512):
    """Links in one bucket: (number of linked vectors per row, root position per row).
    ``side``: None to compare all pairs, else only those of side 0 with side 1."""
    norm = np.sqrt((x * x).sum(1))
    count = np.zeros(len(x), np.int64)
    left, right = (np.arange(len(x)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def pairs():
        for lo in range(0, len(left), block):
            rows = left[lo:lo + block]
            near = (x[rows] @ x[right].T) / (norm[rows, None] * norm[right]) >= cosine
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            if side is None:
                i, j = i[i < j], j[i < j]
            if table:
                first = ~(keys[i, :table] == keys[j, :table]).any(1)
                i, j = i[first], j[first]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            yield i, j

    return count, forest(len(x), pairs())


def near_vectors(vecs: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = 0.93, tables: int = 20, projections: int = 12, width: float = 3.0, hot: int = 4096,
                 chunk: int = 20_000) -> DataFrame:
    """One row per row of ``vecs``: vec_id, n_links, component_id, kept.

    Rows link with nothing (n_links 0, a component of their own, kept) if their id,
    label or vector is null or the vector is empty, all zero, or holds a null or a
    non-finite number; vectors of different lengths are not compared. Repeated rows are
    vectors like others and link with each other. Rows that share an id are one node. An
    empty table gives no rows. Other columns are not read."""
    e = F.col("e")
    rows = vecs.select(F.col(id_col).alias("vec_id"), F.col(label).alias("l"), F.col(vector).alias("e"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    fine = F.coalesce(fine & F.col("l").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumns({"k1": F.when(fine, F.xxhash64("l", "e")), "k2": F.when(fine, F.xxhash64("e", "l", F.lit(7)))})
    rows = rows.withColumn("c", F.when(fine, F.struct("k1", "k2")))
    ids = stored(rows.select("vec_id", "c"), "vector-ids")
    cls = rows.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"),
                                                      F.first("l").alias("l"), F.first("e").alias("e"))

    @F.pandas_udf("array<int>")
    def keyed(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        for _, at in pd.Series(np.arange(len(v))).groupby(v.map(len).to_numpy()):
            x = np.stack(v.iloc[at].to_numpy()).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            for i, k in zip(at, hash_keys(x, tables, projections, width)):
                out.iloc[i] = k
        return out

    cls = stored(cls.withColumn("keys", keyed("e")), "vector-classes")
    n = cls.count()
    t = cls.select("*", F.posexplode("keys").alias("t", "h")).withColumn("d", F.size("e"))
    bucket = ["l", "d", "t", "h"]
    crowded = t.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    t = t.join(crowded.select(*bucket, F.ceil(F.col("n") / hot).cast("int").alias("parts")), bucket, "left")
    mine = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    other = F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))
    t = t.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    t = t.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).drop("other", "parts")
    deal = max(1, -(-n * tables // chunk))
    t = t.withColumn("g", F.pmod(F.xxhash64(*bucket, "p", "q"), F.lit(deal)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, table, _, p, q), own in pdf.groupby([*bucket, "p", "q"], sort=False):
            if len(own) < 2:
                continue
            x = np.stack(own["e"].to_numpy()).astype(np.float64)
            keys = np.stack(own["keys"].to_numpy())
            side = None if p == q else (own["mine"].to_numpy() == q).astype(np.int64)
            ids = own["id"].to_numpy()
            count, root = bucket_links(x, keys, own["m"].to_numpy(), side, int(table), cosine)
            at = np.flatnonzero(count)
            out.append(pd.DataFrame({"k1": own["k1"].to_numpy()[at], "k2": own["k2"].to_numpy()[at], "id": ids[at],
                                     "n": count[at], "root": ids[root[at]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["k1", "k2", "id", "n", "root"]).astype("int64")

    t = t.select("g", "c.k1", "c.k2", "id", "m", "e", "keys", *bucket, "mine", "p", "q")
    found = stored(t.groupBy("g").applyInPandas(join, "k1 long, k2 long, id long, n long, root long"), "vector-links")
    links = found.groupBy(F.struct("k1", "k2").alias("c")).agg(F.sum("n").alias("n"))
    # ids that stand for several classes tie their components
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    cls = cls.select("c", "id", "m").join(links, "c", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    cls = cls.select("c", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    got = ids.join(cls, "c", "left")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
