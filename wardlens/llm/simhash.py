"""SimHash near-duplicates, joined by walking pairs of binary-trie nodes.

Fingerprints: each word shingle votes with its 64-bit hash; a bit is set if more
than half of the shingles set it. Link: at most ``max_bits`` differing bits.

Join. The 64 bits are cut into ``max_bits + 1`` blocks. If two fingerprints differ
in at most ``max_bits`` bits, then read round a ring from one of the blocks they
differ in at most ``l - 1`` bits within the first ``l`` blocks, for every ``l``
(cycle lemma). So each fingerprint enters one trie per block, its bits rotated to
begin there; pairs of trie nodes are walked together from the root, accumulating
differing bits, and a pair is dropped once it exceeds the budget of its depth. The
first block's budget is zero, so tries fall apart into sub-tries by that block, and
Spark deals the sub-tries to tasks. Nothing is missed and no pair that differs more
is linked.

A sub-trie with more than ``hot`` fingerprints is dealt on by its second block, whose
budget is one bit: it goes, for each bit of the block, to the part that agrees in all
its other bits. Fingerprints are distinct, so what is left in a part that lies round
one centre is bounded by the number of words within ``max_bits`` of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import LOWER, on_path, stored, unused
from wardlens.llm.graph import components

FULL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of a text: A-Z lower-cased, ASCII-white-space words,
    repeated shingles counted each time; fewer words than a shingle make one shingle;
    null or no words give zero. Works through long texts in blocks of shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    k = min(shingle, len(words))
    n = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        h = np.array([h64(joined[a:b - 1], seed) for a, b in zip(starts[lo:hi], ends[lo + k - 1:hi + k - 1])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42,
                     name: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of ``text`` as a signed long (the same 64 bits)."""
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.fromiter((fingerprint(t, shingle, seed) for t in s), np.uint64, len(s)).view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def _widths(max_bits: int) -> list[int]:
    m = max_bits + 1
    return [64 // m + (i < 64 % m) for i in range(m)]


def trie_pairs(v: np.ndarray, roots: list[tuple[int, int]], widths: list[int], limit: int = 1 << 18):
    """Yield arrays (i, j) of positions in ``v`` whose words differ within the budgets.
    ``v``: sorted unsigned words within each root's range; a root's words agree in the
    first block. ``limit``: node pairs expanded at a time."""
    max_bits = len(widths) - 1
    edge = np.cumsum(widths)
    budget = np.searchsorted(edge, np.arange(1, 65))  # of a prefix of 1..64 bits
    ones: dict[int, np.ndarray] = {}
    lo, hi = (np.array(x, np.int64) for x in zip(*roots))
    stack = [(widths[0], lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > limit:
            h = len(al) // 2
            stack += [(d, *(x[:h] for x in (al, ah, bl, bh, err))), (d, *(x[h:] for x in (al, ah, bl, bh, err)))]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= max_bits)
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al) or d == 64:
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
                tuple(x[~same] for x in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kids))
        ok = (ah > al) & (bh > bl) & (err <= budget[d]) & ((al != bl) | (ah - al > 1))
        if ok.any():
            stack.append((d + 1, *(x[ok] for x in (al, ah, bl, bh, err))))


def forest(n: int, pairs) -> np.ndarray:
    """Root (smallest position) of each of ``n`` positions under ``pairs`` of arrays."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            while (root[root] != root).any():
                root = root[root]
            i, j = root[i], root[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
    while (root[root] != root).any():
        root = root[root]
    return root


def fingerprint_links(prints: DataFrame, col: str, max_bits: int = 4, hot: int = 50_000,
                      chunk: int = 50_000) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints within ``max_bits`` bits,
    directly or through other linked fingerprints: each sub-trie returns a spanning
    forest of its links, so a crowded one never emits all of its pairs."""
    widths = _widths(max_bits)
    edge = [0, *np.cumsum(widths).tolist()]
    fp = F.col(col)
    turn = [F.struct(F.lit(i).alias("r"), (
        fp if not i else F.shiftleft(fp, edge[i]).bitwiseOR(F.shiftrightunsigned(fp, 64 - edge[i]))).alias("w"),
        F.lit(64 - widths[i]).alias("s1"), F.lit(widths[(i + 1) % len(widths)]).alias("w2")) for i in range(max_bits + 1)]
    t = prints.select(F.explode(F.array(*turn)).alias("t")).select("t.*")
    t = t.withColumn("k", F.expr("shiftrightunsigned(w, s1)"))
    n = prints.count()
    crowded = t.groupBy("r", "k").count().where(F.col("count") > hot).select("r", "k", F.lit(True).alias("hot"))
    t = t.join(crowded, ["r", "k"], "left")
    if max_bits:  # the second block: its value but for one bit, whichever
        part = F.expr("concat(cast(b as string), ':', "
                      "cast(shiftrightunsigned(w, s1 - w2) & ~shiftleft(1L, b) as string))")
        cool = t.where("hot is null").withColumn("p", F.lit(""))
        warm = t.where("hot").withColumn("b", F.explode(F.expr("sequence(0, w2 - 1)"))).withColumn("p", part).drop("b")
        t = cool.unionByName(warm)
    else:
        t = t.withColumn("p", F.lit(""))
    deal = max(1, -(-n * (max_bits + 1) // chunk))
    t = t.select("r", "w", "k", "p", F.pmod(F.xxhash64("r", "k", "p"), F.lit(deal)).alias("g"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, own in pdf.groupby("r", sort=False):
            w = own["w"].to_numpy().view(np.uint64)
            sub = own.groupby(["k", "p"], sort=False).ngroup().to_numpy()
            order = np.lexsort((w, sub))
            w, sub = w[order], sub[order]
            cut = np.flatnonzero(np.diff(sub)) + 1
            roots = [x for x in zip([0, *cut], [*cut, len(w)]) if x[1] - x[0] > 1]
            if not roots:
                continue
            turned = [*widths[r:], *widths[:r]]
            root = forest(len(w), trie_pairs(w, roots, turned))
            linked = np.flatnonzero(root != np.arange(len(w)))
            s = np.uint64(edge[r])
            back = w if not s else (w >> s) | (w << (np.uint64(64) - s))
            out.append(pd.DataFrame({"a": back[linked].view(np.int64), "b": back[root[linked]].view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})

    return t.groupBy("g").applyInPandas(join, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42,
                   max_bits: int = 4, hot: int = 50_000) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links, its own included.

    Null or word-less texts have fingerprint zero and link like any other; repeated
    rows and equal fingerprints are linked; a null id keeps its row and gets its
    group's smallest id (null if there is none); an empty table gives no rows. Other
    columns are not read."""
    rows = stored(add_fingerprints(docs.select(id_col, text), text, shingle, seed, "_fp").select(id_col, "_fp"), "simhash")
    return rows.join(fingerprint_groups(rows, id_col, "_fp", max_bits, hot).drop("component"), "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_groups(rows: DataFrame, id_col: str, col: str, max_bits: int = 4, hot: int = 50_000) -> DataFrame:
    """(``col``, component, component_id) of every distinct fingerprint of ``rows``: a
    fingerprint that names the group, and its smallest id."""
    prints = stored(rows.groupBy(col).agg(F.min(id_col).alias("_first")), "prints")
    found = stored(components(fingerprint_links(prints, col, max_bits, hot)).withColumnRenamed("node", col), "roots")
    least = prints.join(found, col).groupBy("root").agg(F.min("_first").alias("_least"))
    linked = found.join(least, "root").select(col, "root", "_least")
    return prints.join(linked, col, "left").select(
        col, F.coalesce("root", col).alias("component"), F.coalesce("_least", "_first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42,
             max_bits: int = 4, hot: int = 50_000) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, nulls
    last; of several with that id, the one whose columns have the smallest hash; of rows
    equal in full, one. Texts meet only their own fingerprint's verdict, one row a group."""
    on_path(docs.sparkSession)
    tie = F.xxhash64(*[F.col(c) for c in docs.columns])
    at, = unused(docs, "_row")
    row = docs.withColumn(at, F.struct(F.col(id_col).alias("_id"), tie.alias("_tie")))
    ids = row.select(F.col(at).alias("_row"), F.col(text).alias("_text"))
    ids = add_fingerprints(ids.select("_row", "_row._id", "_row._tie", "_text"), "_text", shingle, seed, "_fp")
    ids = stored(ids.select("_row", "_id", "_tie", "_fp"), "simhash-rows")
    groups = fingerprint_groups(ids, "_id", "_fp", max_bits, hot).select("_fp", "component")
    order = F.struct(F.col("_id").isNull().alias("null"), F.col("_id"), F.col("_tie"))
    best = ids.join(groups, "_fp").groupBy("component").agg(F.min(order).alias("o")).select(F.struct("o._id", "o._tie").alias("_row"))
    best = stored(ids.join(best, "_row").groupBy("_row").count().withColumnRenamed("_row", at), "simhash-best")
    pick = lambda b: row.join(b.select(at).hint("shuffle_hash"), at, "left_semi").select(*docs.columns)
    return pick(best.where("count = 1")).unionByName(pick(best.where("count > 1")).dropDuplicates())
