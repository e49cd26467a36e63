"""Gated recurrent language model of whole documents.

Symbols. The most frequent training words are symbols of the model, and so is the end of
a document; all other words share ``buckets`` symbols by a hash of their last three
bytes. A word of a bucket is then drawn from the bucket's smoothed training counts, so
every text has a probability. Counts cover all training documents.

Model. A gated recurrent unit reads symbol after symbol; the next symbol is predicted by
a class softmax and a softmax within the class (symbols by frequency, equal classes).
Training is truncated backpropagation in numpy over windows of ``steps`` symbols with
the state carried on; every training document is used in one of ``rounds`` rounds. In a
round ``workers`` tasks stream their documents from the common weights, and the weights
are averaged by symbols seen. The weights are some 80,000 numbers whatever the input.

Words are looked up once; training and scoring read the symbols stored then. Scoring
reads each whole document, windows one after the other with the state carried across them. Counts of the ``frequent`` most frequent words are broadcast (a fixed
number of words of at most 64 bytes); all rarer words of a document meet their counts
in a join.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import LOWER, stored

CLASSES, MEMBERS = 32, 32
#: Bound of output weights.
CLIP = 4.0
END = b""


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words and the end (the empty word)."""
    return [*(text or "").encode().translate(LOWER).split(), END]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all tokens of ``docs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for t in batch.column(0).to_pylist():
                got.update(tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())],
                                             ["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Symbols, and the counts of the frequent words."""

    def __init__(self, counts: DataFrame, frequent: int, buckets: int):
        self.buckets, n_words = buckets, CLASSES * MEMBERS - buckets - 1
        self.total, self.distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
        top = counts.where(F.length("word").between(1, 64)).orderBy(F.desc("n"), "word").limit(frequent).toArrow()
        words, n = top["word"].to_pylist(), top["n"].to_numpy()
        ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
        known = [END, *words]
        self.index = {w: i for i, w in enumerate(known)}
        self.count = np.array([ends, *n.tolist()], np.int64)
        self.bucket = np.array([zlib.crc32(w[-3:]) % buckets for w in known])
        own = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words[:n_words]], "word binary")
        b = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(buckets)).alias("b")
        rare = counts.where(F.length("word") > 0).join(F.broadcast(own), "word", "left_anti").groupBy(b).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        self.bucket_n, self.bucket_v = np.zeros(buckets), np.zeros(buckets)
        for r in rare:
            self.bucket_n[r["b"]], self.bucket_v[r["b"]] = r["n"], r["v"]
        size = np.concatenate([n[:n_words], np.zeros(n_words - len(n[:n_words])), [ends], self.bucket_n])
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        self.symbol = {w: int(rank[i]) for i, w in enumerate(words[:n_words])}
        self.symbol[END] = int(rank[n_words])
        self.bucket_symbol = rank[n_words + 1:].tolist()
        self.size = np.sort(size)[::-1]

    def symbols(self, words: list[bytes], most: int = 200_000) -> np.ndarray:
        """Symbol of each word. Words seen are remembered, at most about ``most``."""
        seen = self.__dict__.setdefault("seen", {})
        if len(seen) > most:
            seen.clear()
        new = set(words).difference(seen)
        get, bs, k = self.symbol.get, self.bucket_symbol, self.buckets
        for w in new:
            s = get(w)
            seen[w] = bs[zlib.crc32(w[-3:]) % k] if s is None else s
        return np.fromiter(map(seen.__getitem__, words), np.int16, len(words))


class Gru:
    """Weights: x (symbol, 3H) input, u (H, 3H) recurrent, c and cb class, m and mb members."""

    NAMES = ("x", "u", "c", "cb", "m", "mb")

    def __init__(self, size: np.ndarray, hidden: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        p = (size + 0.1).reshape(CLASSES, MEMBERS)
        f = np.float32
        self.w = {
            "x": rng.normal(0, 0.3, (len(size), 3 * hidden)).astype(f),
            "u": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f),
            "c": np.zeros((hidden, CLASSES), f), "cb": np.log(p.sum(1) / p.sum()).astype(f),
            "m": np.zeros((CLASSES, hidden, MEMBERS), f), "mb": np.log(p / p.sum(1, keepdims=True)).astype(f),
        }
        self.w["m"] += rng.normal(0, 0.01, self.w["m"].shape).astype(f)
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            n = self.w[k].size
            self.w[k] = flat[at:at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return self

    def forward(self, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step: inputs and fresh (a document begins) are (step, lane),
        states (step, unit, lane), so that a gate is one run of memory. With ``keep``, adds
        the states before, the gates (z, r, n) and the candidates' recurrent part."""
        k = self.hidden
        # sigmoid(a) = 1 / (1 + exp(-a)) and tanh(a) = 1 - 2 / (1 + exp(2 a)): signs and factor go into the weights
        scale = np.repeat(np.array([-1, -1, 2], np.float32), k)
        u = np.ascontiguousarray((self.w["u"] * scale).T)
        gates = np.ascontiguousarray((self.w["x"] * scale)[inputs].transpose(0, 2, 1))
        out = np.empty((len(inputs), *h.shape), gates.dtype)
        before, inner = (np.empty_like(out), np.empty_like(out)) if keep is not None else (None, None)
        any_fresh = fresh.any(1).tolist()
        hu = np.empty(gates.shape[1:], gates.dtype)
        part = np.empty(h.shape, gates.dtype)
        for t in range(len(inputs)):
            if any_fresh[t]:
                h = np.where(fresh[t], gates.dtype.type(0), h)
            np.matmul(u, h, out=hu)
            zr, n = gates[t, :2 * k], gates[t, 2 * k:]
            zr += hu[:2 * k]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[k:], hu[2 * k:], out=part)
            n += part
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            if keep is not None:
                before[t], inner[t] = h, hu[2 * k:]
            new = out[t]
            np.subtract(h, n, out=new)
            new *= zr[:k]
            new += n
            h = new
        if keep is not None:
            inner *= np.float32(0.5)
            keep += [before, gates, inner]
        return out

    def predict(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Log-probability of each target after state ``h`` (rows); with ``grads``, adds the
        output layer's gradients there and returns also the states' gradient.

        States lie in [-1, 1] and weights within the clip, so no exponential overflows."""
        c = target // MEMBERS
        order = np.argsort(c.astype(np.uint8), kind="stable")  # rows by class
        h, c, t = h[order], c[order], target[order] % MEMBERS
        rows, ones = np.arange(len(h)), np.ones(len(h), h.dtype)
        a = h @ self.w["c"]
        a += self.w["cb"]
        logp = a[rows, c]
        np.exp(a, out=a)
        s = a @ np.ones(CLASSES, a.dtype)
        logp -= np.log(s)
        dh = None
        if grads is not None:
            a /= s[:, None]
            a[rows, c] -= 1
            grads["c"] += h.T @ a
            grads["cb"] += ones @ a
            dh = a @ self.w["c"].T
        edge = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        there = [(k, slice(edge[k], edge[k + 1])) for k in range(CLASSES) if edge[k] < edge[k + 1]]
        b = np.empty((len(h), MEMBERS), a.dtype)
        for k, i in there:
            np.matmul(h[i], self.w["m"][k], out=b[i])
            b[i] += self.w["mb"][k]
        logp += b[rows, t]
        np.exp(b, out=b)
        s = b @ np.ones(MEMBERS, b.dtype)
        logp -= np.log(s)
        if grads is not None:
            b /= s[:, None]
            b[rows, t] -= 1
            for k, i in there:
                grads["m"][k] += h[i].T @ b[i]
                grads["mb"][k] += ones[i] @ b[i]
                dh[i] += b[i] @ self.w["m"][k].T
        back = np.empty_like(order)
        back[order] = rows
        return logp[back], None if dh is None else dh[back]

    def gradients(self, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean negative log-probability over a window, and the last state."""
        k, u = self.hidden, self.w["u"]
        grads = {n: np.zeros_like(w) for n, w in self.w.items() if n not in ("x", "u")}
        keep: list = []
        out = self.forward(h, inputs, fresh, keep)
        before, gates, inner = keep
        _, d_out = self.predict(out.transpose(0, 2, 1).reshape(-1, k), target.ravel(), grads)
        d_out = np.ascontiguousarray(d_out.reshape(*inputs.shape, k).transpose(0, 2, 1))
        z, r, n = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
        by_n = (1 - z) * (1 - n * n)
        by_z = (before - n) * z * (1 - z)
        by_r = inner * r * (1 - r)
        back = np.empty_like(gates)
        d_n = np.empty_like(out)
        dh = np.zeros_like(out[0])
        any_fresh = fresh.any(1).tolist()
        for t in range(len(inputs) - 1, -1, -1):
            dh += d_out[t]
            dn = np.multiply(dh, by_n[t], out=d_n[t])
            g = back[t]
            np.multiply(dh, by_z[t], out=g[:k])
            np.multiply(dn, by_r[t], out=g[k:2 * k])
            np.multiply(dn, r[t], out=g[2 * k:])
            dh *= z[t]
            dh += u @ g
            if any_fresh[t]:
                dh[:, fresh[t]] = 0
        grads["u"] = np.matmul(before, back.transpose(0, 2, 1)).sum(0)
        back[:, 2 * k:] = d_n
        flat, dx = inputs.ravel(), back.transpose(0, 2, 1).reshape(-1, 3 * k)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        s, first = np.unique(flat[order], return_index=True)
        grads["x"] = np.zeros_like(self.w["x"])
        grads["x"][s] = np.add.reduceat(dx[order], first, axis=0)
        n = np.float32(target.size)
        return {x: g / n for x, g in grads.items()}, out[-1]


def lanes(docs: list[np.ndarray], width: int, start: int, first: list[int] | None = None):
    """Documents dealt to at most ``width`` lanes, most loaded first: target symbols,
    inputs, beginnings and document numbers as (step, lane) arrays, and the lanes' loads.
    Whole documents follow each other in a lane. ``first``: what is read before each
    document, if not ``start``."""
    size = np.array([len(d) for d in docs])
    n = int(max(1, min(width, size.sum() // max(1, size.max()), len(docs))))
    heap, queue = [(0, j) for j in range(n)], [[] for _ in range(n)]
    for i in np.argsort(-size, kind="stable").tolist():
        load, j = heap[0]
        queue[j].append(i)
        heapq.heapreplace(heap, (load + int(size[i]), j))
    load = np.array([x for x, _ in sorted(heap, key=lambda x: x[1])])
    by = np.argsort(-load, kind="stable")
    shape = (int(load.max()), n)
    target, prev = np.zeros(shape, np.int16), np.full(shape, start, np.int16)
    fresh, doc = np.zeros(shape, bool), np.zeros(shape, np.int32)
    for lane, j in enumerate(by.tolist()):
        at = 0
        for i in queue[j]:
            end = at + len(docs[i])
            target[at:end, lane], doc[at:end, lane], fresh[at, lane] = docs[i], i, True
            prev[at + 1:end, lane] = docs[i][:-1]
            if first is not None:
                prev[at, lane] = first[i]
            at = end
    return target, prev, fresh, doc, load[by]


def windows(load: np.ndarray, steps: int) -> Iterator[tuple[slice, slice]]:
    """(steps, lanes) of windows in which all lanes named have symbols throughout."""
    at, live = 0, len(load)
    while at < load[0]:
        while load[live - 1] <= at:
            live -= 1
        end = min(at + steps, int(load[live - 1]))
        yield slice(at, end), slice(0, live)
        at = end


def _parts(batch: list[np.ndarray], most: int = 2_500_000) -> Iterator[list[int]]:
    """Rows of a batch, some ``most`` symbols at a time."""
    part, size = [], 0
    for i, d in enumerate(batch):
        part.append(i)
        size += len(d)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(docs: DataFrame, end: int, size: np.ndarray, hidden: int = 16, steps: int = 16, width: int = 512,
          rounds: int = 2, rate: float = 0.01, stretch: int = 512, workers: int | None = None) -> np.ndarray:
    """Weights after ``rounds`` rounds over ``docs`` (symbols as little-endian int16), each
    document in one of them.
    Training carries the state through ``stretch`` symbols at most; scoring through all.
    ``end``: the symbol of a document's end; ``size``: the symbols' counts."""
    sc = docs.sparkSession.sparkContext
    now = Gru(size, hidden).flat()
    share = F.pmod(F.xxhash64("symbols"), F.lit(rounds))
    for k in range(rounds):
        common = sc.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            net = Gru(size, hidden).load(common.value)
            m1 = {x: np.zeros_like(w) for x, w in net.w.items()}
            m2 = {x: np.zeros_like(w) for x, w in net.w.items()}
            seen, turn = 0, 0
            for batch in batches:
                rows = [np.frombuffer(b, "<i2") for b in batch.column(0).to_pylist()]
                for part in _parts(rows, 1_000_000):
                    # long documents in stretches, so that no lane is left alone
                    own = [(int(rows[i][a - 1]) if a else end, rows[i][a:a + stretch])
                           for i in part for a in range(0, len(rows[i]), stretch)]
                    first, own = zip(*own)
                    total = sum(map(len, own))
                    target, prev, fresh, _, load = lanes(own, int(np.clip(total // 2000, 8, width)), end, first)
                    h = np.zeros((hidden, len(load)), np.float32)
                    for s, l in windows(load, steps):
                        g, h = net.gradients(h[:, l], prev[s, l], fresh[s, l], target[s, l])
                        turn += 1
                        seen += target[s, l].size
                        fix = np.float32(rate * np.sqrt(1 - 0.999 ** turn) / (1 - 0.9 ** turn))
                        for x, w in net.w.items():
                            m1[x] += np.float32(0.1) * (g[x] - m1[x])
                            m2[x] += np.float32(0.001) * (g[x] * g[x] - m2[x])
                            w -= fix * m1[x] / (np.sqrt(m2[x]) + np.float32(1e-7))
                            if x in ("c", "m"):
                                np.clip(w, -CLIP, CLIP, out=w)
            if seen:
                flat = net.flat()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen),
                     pa.array(np.full(len(flat), seen, np.int64))], ["i", "w", "n"])

        own = docs.where(share == k).select("symbols")
        got = own.coalesce(workers or sc.defaultParallelism).mapInArrow(learn, "i int, w double, n long")
        mean = got.groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()  # one row per weight
        if len(mean):
            now = now.copy()
            now[mean["i"].to_numpy()] = mean["w"].to_numpy()
    return now


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text: str = "text", hidden: int = 16,
          steps: int = 32, width: int = 512, frequent: int = 200_000, buckets: int = 128, **fit) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score
    (smoothed word counts) and score (the model), both log10 probabilities of the text.

    ``training``: documents to learn from, or a condition on ``docs`` that says which of
    them (null: no); words are then looked up once for both.
    A null or word-less text is the end alone. With no training documents every word
    counts 0 and the model is near uniform. Repeated rows are scored alike, one by one;
    null ids are allowed; an empty table gives no rows. Other columns are not read."""
    sc = docs.sparkSession.sparkContext
    within = isinstance(training, Column)
    counts = stored(word_counts(docs.where(training) if within else training, text), "word-counts")
    voc = Vocabulary(counts, frequent, buckets)
    shared, end = sc.broadcast(voc), voc.symbol[END]
    size, kind = voc.size, docs.schema[id_col].dataType.simpleString()
    per_word, per_bucket = voc.total + 0.1 * (voc.distinct + 1), voc.bucket_n + 0.1 * (voc.bucket_v + 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        symbol_of = voc.symbols(list(voc.index))
        base_of = np.log10((voc.count + 0.1) / per_word)
        own_of = np.log10((voc.count + 0.1) / per_bucket[voc.bucket])
        own_of[[voc.index[w] for w in voc.symbol if w in voc.index]] = 0.0
        for batch in batches:
            rows = []
            for t in batch.column(3).to_pylist():
                words = tokens(t)
                at = np.fromiter(map(voc.index.get, words, repeat(-1)), np.int32, len(words))
                there = at[at >= 0]
                symbols = symbol_of[at]
                rare = Counter()
                if len(there) < len(at):
                    out = np.flatnonzero(at < 0)
                    own = [words[i] for i in out.tolist()]
                    symbols[out] = voc.symbols(own)
                    rare.update(own)
                rows.append((len(words), int(np.count_nonzero(voc.count[there])), float(base_of[there].sum()),
                             float(own_of[there].sum()), list(rare), list(rare.values()), symbols.astype("<i2").tobytes()))
            cols = list(zip(*rows)) or [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.binary())),
                 pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.binary())],
                ["doc_id", "row", "learn", "n_tokens", "known", "base", "own", "rare", "times", "symbols"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru(size, hidden).load(weights.value)
        for batch in batches:
            rows = [np.frombuffer(b, "<i2") for b in batch.column(6).to_pylist()]
            like = np.zeros(len(rows))
            for part in _parts(rows):
                target, prev, fresh, doc, load = lanes([rows[i] for i in part], width, end)
                h = np.zeros((hidden, len(load)), np.float32)
                sums = np.zeros(len(part))
                for s, l in windows(load, steps):
                    out = net.forward(h[:, l], prev[s, l], fresh[s, l])
                    logp, _ = net.predict(out.transpose(0, 2, 1).reshape(-1, hidden), target[s, l].ravel())
                    sums += np.bincount(doc[s, l].ravel(), logp, len(part))
                    h = out[-1]
                like[part] = sums / np.log(10)
            own = pa.array(batch.column(5).to_numpy(zero_copy_only=False) + like)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], own], ["doc_id", "row", "n_tokens", "known", "base", "own"])

    def looked_up(df: DataFrame, doc: Column, learn: Column, label: str) -> DataFrame:
        rows = df.select(doc.alias("doc_id"), F.monotonically_increasing_id().alias("row"), learn.alias("learn"), F.col(text).alias("text"))
        return stored(rows.mapInArrow(look_up, f"doc_id {kind}, row long, learn boolean, n_tokens long, known long, base double, "
                                               "own double, rare array<binary>, times array<long>, symbols binary"), label)

    seen = looked_up(docs, F.col(id_col), F.coalesce(training, F.lit(False)) if within else F.lit(False), "lm-symbols")
    taught = seen.where("learn") if within else looked_up(training, F.lit(None).cast(kind), F.lit(True), "lm-training")
    weights = sc.broadcast(train(taught, end, size, hidden, **fit))
    got = stored(seen.select("doc_id", "row", "n_tokens", "known", "base", "own", "symbols").mapInArrow(
        read, f"doc_id {kind}, row long, n_tokens long, known long, base double, own double"), "lm-scores")
    rare = seen.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own_bucket = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(buckets)).cast("int") + 1
    of = F.element_at(F.array(*[F.lit(float(x)) for x in per_bucket]), own_bucket)
    own = F.col("times") * F.log10((F.col("n") + 0.1) / of)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))).alias("known2"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(per_word))).alias("base2"), F.sum(own).alias("own2"))
    zero = F.lit(0.0)
    return got.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("own2", zero)).alias("score"))
