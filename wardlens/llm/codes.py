"""Vector code compression: product codes whose nearest entries are found in GNATs.

Every component x becomes the integer floor(1024 x); a vector is cut into ``parts``
consecutive parts. Each part position has a codebook of up to 256 entries, begun from
the smallest ids and refined by ``rounds`` of nearest-entry assignment and componentwise
floor means. All arithmetic on components, distances and means is in integers, so
reruns and other engines give the same codes.

Nearest entries are found in a geometric near-neighbour access tree over the entries: a
node holds split points chosen far from each other, every other entry goes to its
nearest split, and for each (split, child) the node stores the range of distances from
the split to the child's entries. By the triangle inequality a child whose range cannot
come within the best distance so far is left out whole. Bounds are taken from square
roots and widened by more than their rounding; a subtree is left out only if its bound is
strictly above the best, and entries are compared by their integer squared distances,
ties to the lower index.

Each round is one pass over the written integer vectors: a task returns the sums of its
parts per entry, Spark adds them, and at most parts x 256 rows come to the driver. The
codebooks go back to the tasks; their size depends on the vector's length alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import on_path, stored

SCALE = 1024
#: Squared distances up to here are exact in double precision, and in 64-bit integers.
EXACT, LARGEST = 1 << 52, 1 << 62


def squared(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer squared distances of the rows of ``x`` (n, d) and ``p`` (m, d)."""
    if not x.size or not p.size:
        return np.zeros((len(x), len(p)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(p).max()), 1)
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), p.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    if 4 * most * most * x.shape[1] >= LARGEST:
        raise ValueError("squared distances of these components do not fit 64 bits")
    return np.stack([((x - q) ** 2).sum(1) for q in p], axis=1)


class Gnat:
    """A tree over ``points`` (rows of integers) that finds each query's nearest row."""

    def __init__(self, points: np.ndarray, ids: np.ndarray | None = None, fanout: int = 16, leaf: int = 24):
        ids = np.arange(len(points)) if ids is None else ids
        self.children: list[Gnat | None] = []
        if len(points) <= leaf:
            self.points, self.ids = points, ids
            return
        # split points by farthest-first choice
        chosen, least = [0], squared(points, points[:1])[:, 0]
        while len(chosen) < fanout and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, squared(points, points[chosen[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(points)), chosen)
        self.points, self.ids = points[chosen], ids[chosen]
        if len(chosen) == 1:  # all points are equal: the lowest index is the only answer
            self.ids = ids[ids.argmin():][:1]
            return
        d = squared(points[rest], self.points)
        home = d.argmin(1)
        root = np.sqrt(d.astype(np.float64))
        m = len(chosen)
        self.lo, self.hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for j in range(m):
            own = home == j
            if own.any():
                self.lo[:, j], self.hi[:, j] = root[own].min(0), root[own].max(0)
                self.children.append(Gnat(points[rest[own]], ids[rest[own]], fanout, leaf))
            else:
                self.children.append(None)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest point to each row of ``x``; of equally
        near ones the lowest index."""
        best, arg = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        if len(x):
            self._visit(x, np.arange(len(x)), best, arg)
        return arg, best

    def _visit(self, x, rows, best, arg):
        d2 = squared(x[rows], self.points)
        least = d2.min(1)
        index = np.where(d2 == least[:, None], self.ids, np.iinfo(np.int64).max).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (index < arg[rows]))
        best[rows[better]], arg[rows[better]] = least[better], index[better]
        if not self.children:
            return
        d, home = np.sqrt(d2.astype(np.float64)), d2.argmin(1)
        for j, child in enumerate(self.children):
            if child is not None and (own := home == j).any():
                child._visit(x, rows[own], best, arg)
        for j, child in enumerate(self.children):
            if child is None:
                continue
            # the distance of anything under the child is at least this
            bound = np.maximum(d - self.hi[:, j], self.lo[:, j] - d).max(1)
            slack = 1e-9 * (d.max(1) + self.hi[:, j].max() + 1)
            may = (home != j) & (bound <= np.sqrt(best[rows].astype(np.float64)) + slack)
            if may.any():
                child._visit(x, rows[may], best, arg)


def cuts(d: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``d`` components begin and end."""
    return [d * i // parts for i in range(parts + 1)]


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def entry_sums(vectors: DataFrame, trees, d: int, parts: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): of the parts nearest to each entry their number and
    componentwise sums."""
    at, wide = cuts(d, parts), max(np.diff(cuts(d, parts)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(256, np.int64) for _ in range(parts)]
        s = [np.zeros((256, wide), np.int64) for _ in range(parts)]
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for p, tree in enumerate(trees.value):
                own = x[:, at[p]:at[p + 1]]
                entry, _ = tree.nearest(own)
                n[p] += np.bincount(entry, minlength=256)
                np.add.at(s[p][:, :own.shape[1]], entry, own)
        part, entry = np.nonzero(np.stack(n))
        cols = [part.astype(np.int32), entry.astype(np.int32), np.stack(n)[part, entry], *np.stack(s)[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "entry", "n", *[f"s{i}" for i in range(wide)]])

    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(wide))
    got = vectors.select("v").mapInArrow(add, schema)
    return got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)])


def compress(vecs: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
             entries: int = 256, rounds: int = 4, fanout: int = 16) -> DataFrame:
    """One row per vector of ``vecs``: vec_id, code (an entry's index in each part, two hex
    digits each), error (squared distance to the coded vector), label_error (error summed
    over rows of one label, null labels together) and codebooks_sha256.

    Rows whose vector is null, holds a null or a non-finite number, or is shorter than the
    table's longest are left out. Null ids come last in the order of ids; rows that share
    an id are ordered by their vectors; repeated rows are rows of their own. A length that
    ``parts`` does not divide is cut as evenly as it can be. Fewer vectors than ``entries``
    make as many entries. An empty table gives no rows. Components whose squared distances
    do not fit 64 bits raise an error. Other columns are not read."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    spark = vecs.sparkSession
    on_path(spark)
    e = F.col("e")
    rows = vecs.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("e"))
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("e", lambda x: F.floor(x.cast("double") * SCALE))
    v = stored(rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", v.alias("v")), "code-vectors")
    d = v.agg(F.max(F.size("v"))).first()[0]
    d = 0 if d is None else d
    v = v.where(F.size("v") == d)
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].to_pylist()
    whole = np.array(first, np.int64).reshape(len(first), d)
    at = cuts(d, parts)
    books = [whole[:, at[p]:at[p + 1]].copy() for p in range(parts)]
    tree = lambda: spark.sparkContext.broadcast([Gnat(b, fanout=fanout) for b in books])
    for _ in range(rounds if len(first) else 0):
        for r in entry_sums(v, tree(), d, parts).toArrow().to_pylist():  # at most parts * entries rows
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    trees = tree()
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            got = [t.nearest(x[:, at[p]:at[p + 1]]) for p, t in enumerate(trees.value)]
            codes = np.stack([g[0] for g in got], axis=1).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(sum(g[1] for g in got), pa.int64())], ["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    coded = v.mapInArrow(encode, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    coded = stored(coded, "codes")
    total = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels").withColumnRenamed("label", "_label")
    out = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = """a{k} as (select rid, part, arg_min(entry, dist * 1024 + entry) entry, min(dist) dist from
 (select p.rid, p.part, c.entry, (p.q + c.q - 2 * list_dot_product(p.v, c.v))::hugeint dist from p join c{k} c using (part)) group by rid, part)"""
    update = """m{k} as (select part, entry, list(floor_mean order by pos) v from
 (select a.part, a.entry, pos, ((s - ((s % n) + n) % n) // n)::double floor_mean from
  (select a.part, a.entry, pos, sum(x)::hugeint s, count(*)::hugeint n from
   (select a{j}.part, a{j}.entry, unnest(p.v) x, unnest(range(len(p.v))) pos from a{j} join p using (rid, part)) a group by all) a) group by part, entry),
c{k} as (select c{j}.part, c{j}.entry, coalesce(m{k}.v, c{j}.v) v, list_dot_product(coalesce(m{k}.v, c{j}.v), coalesce(m{k}.v, c{j}.v)) q
 from c{j} left join m{k} using (part, entry))"""
    steps = [nearest.format(k=0)]
    for k in range(1, 5):
        steps += [update.format(k=k, j=k - 1), nearest.format(k=k)]
    return """with e as (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select rid, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] v, list_dot_product(v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)],
  v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)]) q from e, (select unnest(range(4)) part)),
f as (select rid, row_number() over (order by vec_id nulls last, v) - 1 entry from e qualify entry < 256),
c0 as (select part, entry, v, q from f join p using (rid)),
""" + ",\n".join(steps) + """,
b as (select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, pos)) codebooks_sha256 from
 (select part, entry, unnest(v) x, unnest(range(len(v))) pos from c4)),
r as (select rid, string_agg(printf('%02x', entry), '' order by part) code, sum(dist)::bigint error from a4 group by rid)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256
from e join r using (rid), b"""


ORACLE = _sql()
