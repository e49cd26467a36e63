"""Exact k-nearest-neighbour join by pivots, and synthetic minority oversampling.

Rows are points of numbers and levels; a differing level adds ``mismatch`` squared to the
squared distance, so distances obey the triangle inequality.

1. Equal points are one point that keeps its k + 1 smallest keys: copies on a third of all
   rows are one row from here on.
2. A bounded number of points are pivots. Every point belongs to its nearest pivot's cell, and
   each cell reports its size, its radii and its k + 1 smallest radii: one row per pivot.
3. A point's k + 1 nearest lie within the (k + 1)-th smallest of d(point, pivot) + radius over
   those short lists. A cell is visited only if the triangle and the bisector inequalities let
   some member be as near.
4. Points and visitors meet cell by cell, crowded cells in pieces; a piece keeps the k + 1
   nearest of each visitor (a bounded heap) and looks only at members whose radius can match.
5. The pieces' short lists are merged.

Nothing is sampled or capped: the bounds leave out only what cannot be among the nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Widening of bounds, far above the rounding of distances.
SLACK = 1e-9


def points_of(df: DataFrame, key: str, numeric: Sequence[str], nominal: Sequence[str], most: int) -> DataFrame:
    """(x, z, keys): distinct points, their numbers and hashed levels, and their ``most``
    smallest keys."""
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in numeric]).cast("array<double>")  # -0.0 is 0.0
    z = F.array(*[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("NAN"))) for c in nominal]).cast("array<bigint>")
    rows = df.select(F.col(key).alias("_key"), x.alias("x"), z.alias("z"))
    first = Window.partitionBy("x", "z").orderBy("_key")
    kept = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    return kept.groupBy("x", "z").agg(F.array_sort(F.collect_list("_key")).alias("keys"))


def squared_distances(ax: np.ndarray, az: np.ndarray, bx: np.ndarray, bz: np.ndarray, mismatch: float) -> np.ndarray:
    """Squared distances of all rows of a and b, by differences (equal points are at 0)."""
    out = np.zeros((len(ax), len(bx)))
    for i in range(ax.shape[1]):
        d = ax[:, i][:, None] - bx[:, i]
        out += d * d
    for i in range(az.shape[1]):
        out += (az[:, i][:, None] != bz[:, i]) * (mismatch * mismatch)
    return out


def knn_join(df: DataFrame, key: str, numeric: Sequence[str], nominal: Sequence[str] = (), k: int = 5, mismatch: float = 1.0,
             pivots: int = 32, hot: int = 2000, block: int = 256) -> DataFrame:
    """(key, rank, neighbour, distance): the ``k`` rows nearest to each row, nearest first, ties
    to the smaller key; all others if they are fewer.

    Keys are unique and not null, and numbers not null; a missing level is a level. The
    number of ``pivots`` only moves work. Two small tables come to the driver: the pivots and
    a row for each."""
    spark = df.sparkSession
    most = k + 1
    pts = points_of(df, key, numeric, nominal, most).withColumn("_h", F.md5(F.concat_ws("|", F.col("x").cast("string"), F.col("z").cast("string"))))
    ps = pts.orderBy("_h").limit(pivots).select("x", "z").collect()
    pts = pts.withColumn("pid", F.xxhash64("_h")).drop("_h")
    key_type = df.schema[key].dataType.simpleString()
    if not ps:
        return spark.createDataFrame([], f"{key} {key_type}, rank int, neighbour {key_type}, distance double")
    mat = lambda col, n, t: np.array([list(v) for v in col], t).reshape(len(col), n)
    p_x, p_z = mat([r["x"] for r in ps], len(numeric), float), mat([r["z"] for r in ps], len(nominal), np.int64)
    apart = np.sqrt(squared_distances(p_x, p_z, p_x, p_z, mismatch))

    def to_pivots(pdf):
        return np.sqrt(squared_distances(mat(pdf["x"], len(numeric), float), mat(pdf["z"], len(nominal), np.int64), p_x, p_z, mismatch))

    def home(parts):
        for pdf in parts:
            to = to_pivots(pdf)
            pdf["cell"] = to.argmin(1).astype("int32")
            pdf["r"] = to.min(1)
            yield pdf

    schema = f"x array<double>, z array<bigint>, keys array<{key_type}>, pid long, cell int, r double"
    pts = pts.mapInPandas(home, schema)
    near = Window.partitionBy("cell").orderBy("r", "pid")
    sizes = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    short = pts.select("cell", "r", "pid", F.size("keys").alias("m")).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most)
    short = short.groupBy("cell").agg(F.collect_list(F.struct("r", "m")).alias("short"))
    cells = {r["cell"]: r for r in sizes.join(short, "cell").collect()}  # a row a pivot, ``most`` radii each
    names = sorted(cells)
    lo, hi = (np.array([cells[c][x] for c in names]) for x in ("lo", "hi"))
    pieces = {c: -(-cells[c]["n"] // hot) for c in names}
    listed = [(i, s["r"], s["m"]) for i, c in enumerate(names) for s in cells[c]["short"]]
    at, radius, copies = (np.array(v) for v in zip(*listed))
    between = apart[:, names]

    def deal(parts):
        for pdf in parts:
            to = to_pivots(pdf)[:, names]
            # the ``most`` nearest lie within this distance: a place in all cells' short lists
            d = to[:, at] + radius
            order = np.argsort(d, axis=1, kind="stable")
            have = np.cumsum(copies[order], axis=1) >= most
            reach = np.where(have.any(1), np.take_along_axis(d, order, 1)[np.arange(len(d)), have.argmax(1)], np.inf)
            reach = reach * (1 + SLACK) + SLACK
            may = (to - hi <= reach[:, None]) & (lo - to <= reach[:, None])
            # members of a cell are nearer to its pivot than to the point's own
            own, gap = pdf["r"].to_numpy(), between[pdf["cell"].to_numpy()]
            with np.errstate(divide="ignore", invalid="ignore"):
                half = (to * to - (own * own)[:, None]) / (2 * gap)
            may &= (gap == 0) | (half <= (reach * (1 + SLACK) + SLACK)[:, None])
            row, cell = np.nonzero(may)
            n = np.array([pieces[names[c]] for c in cell], np.int64) if len(cell) else np.zeros(0, np.int64)
            row_, cell_ = np.repeat(row, n), np.repeat(cell, n)
            piece = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64)
            out = pdf.iloc[row_][["pid", "x", "z"]].copy()
            out["asks"], out["to"], out["piece"] = True, np.array(names, "int32")[cell_], piece.astype("int32")
            out["r"], out["reach"], out["keys"] = to[row_, cell_], reach[row_], [[] for _ in row_]
            mine = pdf[["pid", "x", "z", "r", "keys"]].copy()
            mine["asks"], mine["to"], mine["reach"] = False, pdf["cell"], 0.0
            mine["piece"] = [int(p) % pieces[c] for p, c in zip(pdf["pid"], pdf["cell"])]
            yield pd.concat([out, mine])[["asks", "to", "piece", "pid", "x", "z", "r", "keys", "reach"]]

    dealt = pts.mapInPandas(deal, f"asks boolean, to int, piece int, pid long, x array<double>, z array<bigint>, r double, keys array<{key_type}>, reach double")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("r", kind="stable")
        out = []
        if len(q) and len(c):
            qx, qz, cx, cz = mat(q["x"], len(numeric), float), mat(q["z"], len(nominal), np.int64), mat(c["x"], len(numeric), float), mat(c["z"], len(nominal), np.int64)
            radius, keys = c["r"].to_numpy(), c["keys"].to_numpy()
            copies = np.array([len(x) for x in keys])
            pids, reach, to = q["pid"].to_numpy(), q["reach"].to_numpy(), q["r"].to_numpy()
            order = np.argsort(to, kind="stable")
            for lo in range(0, len(order), block):
                rows = order[lo:lo + block]
                # only members whose radius differs from the visitor's by no more than its reach
                a = int(np.searchsorted(radius, (to[rows] - reach[rows]).min() - SLACK, "left"))
                b = int(np.searchsorted(radius, (to[rows] + reach[rows]).max() + SLACK, "right"))
                if a >= b:
                    continue
                d = squared_distances(qx[rows], qz[rows], cx[a:b], cz[a:b], mismatch)
                # the edge is the distance within which ``most`` rows lie; its ties stay
                edge = np.partition(d, most - 1, axis=1)[:, most - 1] if b - a >= most else np.full(len(rows), np.inf)
                i, j = np.nonzero(d <= edge[:, None])
                heap = pd.DataFrame({"pid": pids[rows][i], "d": np.sqrt(d[i, j]), "_m": a + j})
                heap = heap.loc[np.repeat(heap.index, copies[heap["_m"]])]
                at = heap.groupby(["pid", "_m"]).cumcount().to_numpy()
                heap["neighbour"] = [keys[m][t] for m, t in zip(heap["_m"], at)]
                heap = heap.sort_values(["pid", "d", "neighbour"], kind="stable").groupby("pid").head(most)
                out.append(heap[["pid", "neighbour", "d"]])
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "neighbour": [], "d": []})

    found = dealt.groupBy("to", "piece").applyInPandas(meet, f"pid long, neighbour {key_type}, d double")
    order = Window.partitionBy("pid").orderBy("d", "neighbour")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    best = best.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("d", "neighbour"))).alias("best"))
    # back to every row: points are joined by their values' hash
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in numeric]).cast("array<double>")
    z = F.array(*[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("NAN"))) for c in nominal]).cast("array<bigint>")
    rows = df.select(F.col(key), F.xxhash64(F.md5(F.concat_ws("|", x.cast("string"), z.cast("string")))).alias("pid"))
    mine = rows.join(best, "pid").select(key, F.posexplode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col(key)), 1, k)).alias("rank", "b"))
    return mine.select(key, (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.neighbour").alias("neighbour"), F.col("b.d").alias("distance"))


def smote(df: DataFrame, key: str, label: str, numeric: Sequence[str], nominal: Sequence[str] = (), k: int = 5,
          share: float = 0.5, minority: int = 1, mismatch: float | None = None, **knn) -> DataFrame:
    """Synthetic rows that bring the ``minority`` class to ``share`` of the table: key (of the row
    each starts from), copy, neighbour, numeric and nominal columns, label.

    A synthetic row lies on the line from its row to one of its ``k`` nearest of the class, at a
    place drawn from a hash of (key, copy); a level is the most frequent among the neighbours
    (ties to the smaller). Rows serve in md5 order, in whole rounds first. ``mismatch`` is a differing
    level's distance; by default the median of the numeric columns' deviations in the class.
    Missing numbers are -1 and missing levels NAN while neighbours are sought, and are turned
    back at the end, as elsewhere in this library. A class of one row has no neighbours and
    gives none."""
    from wardlens.operators.features import LEVEL_FILL, NUMERIC_FILL, fill_na, unfill_na
    from wardlens.operators.split import ranked
    n, few = df.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col(label) == minority)).first()
    new = max(0, -(-int((n - few) * share * 1e6) // int((1 - share) * 1e6)) - few) if few > 1 else 0
    rare = fill_na(df.where(F.col(label) == minority).select(key, label, *[F.col(c).cast("double").alias(c) for c in numeric],
                                                            *[F.col(c).cast("string").alias(c) for c in nominal]), [*numeric, *nominal])
    if mismatch is None:
        dev = sorted(v or 0.0 for v in rare.agg(*[F.stddev_pop(c) for c in numeric]).first()) if numeric and nominal else []
        mismatch = (dev[(len(dev) - 1) // 2] + dev[len(dev) // 2]) / 2 if dev else 1.0
    knn_ = knn_join(rare, key, numeric, nominal, k, mismatch, **knn)
    rounds = -(-new // few) if few else 0
    base = ranked(rare, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(rounds))) if rounds else F.lit(0))
    base = base.where((F.col("copy") >= 1) & ((F.col("copy") - 1) * F.lit(few) + F.col("_rank") <= F.lit(new)))
    piece = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
    base = base.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string"))))
    near = knn_.join(rare.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in [*numeric, *nominal]]), "neighbour")
    near = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", *[f"_n_{c}" for c in [*numeric, *nominal]]))).alias("near"))
    out = base.join(near, key).withColumn("_to", F.element_at("near", (piece(0) % F.size("near") + 1).cast("int")))
    gap = piece(1).cast("double") / F.lit(float(1 << 32))

    def mode(c):
        values = F.array_sort(F.transform("near", lambda x: x[f"_n_{c}"]))
        each = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda w: w == v))).alias("n"), v.alias("v")))
        return F.array_min(each)["v"]

    out = out.select(key, "copy", F.col("_to.neighbour").alias("neighbour"),
                     *[F.round(F.col(c) + gap * (F.col(f"_to._n_{c}") - F.col(c)), 9).alias(c) for c in numeric],
                     *[mode(c).alias(c) for c in nominal], F.lit(minority).alias(label))
    return unfill_na(out, [*numeric, *nominal])
