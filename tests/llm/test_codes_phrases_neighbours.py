"""Operators 11 to 13 against brute force on small tables, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from wardlens.llm import codes, neighbours, phrases
from wardlens.llm.common import table

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    return table(spark, SF, "embeddings")


def frame(spark, rows, dim_type="double"):
    """(vec_id, embedding, label) with columns that clash with names used inside."""
    table(spark, SF, "embeddings")
    return spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], f"vec_id long, embedding array<{dim_type}>, label int, code int, keys string, score double")


# --- 11 codes --------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["spread", "clumped", "equal", "large", "flat"])
def test_gnat_is_exact_with_ties(kind):
    rng = np.random.default_rng(5)
    p = {"spread": lambda n: rng.integers(-500, 500, (n, 6)), "clumped": lambda n: rng.integers(0, 3, (n, 4)) + 100 * rng.integers(0, 4, (n, 1)),
         "equal": lambda n: np.full((n, 3), 7), "large": lambda n: rng.integers(-2**27, 2**27, (n, 4)), "flat": lambda n: np.zeros((n, 0), np.int64)}[kind]
    points, x = p(256).astype(np.int64), p(700).astype(np.int64)
    x[:256] = points
    if kind == "clumped":  # half-way points tie
        x[300:500] = (points[:200] + points[50:250]) // 2
    d = ((x[:, None, :] - points[None]) ** 2).sum(2)
    arg, best = codes.Gnat(points).nearest(x)
    assert (arg == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, _, v in kept), default=0)
    kept = [k for k in kept if len(k[2]) == d]
    cut = [d * i // parts for i in range(parts + 1)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2]))[:entries]
    books = [[v[cut[p]:cut[p + 1]] for _, _, v in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[cut[p]:cut[p + 1]], e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in kept:
                own[near(p, v)[1]].append(v[cut[p]:cut[p + 1]])
            new.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])])
        books = new
    got = [[near(p, v) for p in range(parts)] for _, _, v in kept]
    error = [sum(d2 for d2, _ in g) for g in got]
    by = Counter()
    for (_, lab, _), e in zip(kept, error):
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in g), e, by[lab], digest) for (i, lab, _), g, e in zip(kept, got, error)), key=str)


def test_codes_equal_brute_force(spark, vectors):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in vectors.limit(60).collect()]
    rows += [(None, rows[0][1], None), (3, rows[1][1], 1), (3, rows[1][1], 1), (900, None, 1), (901, [1.0, None], 1), (902, [NAN] * 64, 2), (903, [INF] * 64, 2), (904, [], 2), (905, [0.5], 3)]
    got = codes.compress(frame(spark, rows), entries=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 4, 16, 3)


def test_codes_of_uneven_parts_few_rows_and_none(spark):
    rows = [(i, [0.001 * i, -0.5, 3.0, 0.25 * i, 1.0, -7.5], i % 2) for i in range(9)]
    assert sorted(map(tuple, codes.compress(frame(spark, rows)).collect()), key=str) == brute_codes(rows, 4, 256, 4)
    assert codes.compress(frame(spark, [])).count() == 0
    empty = codes.compress(frame(spark, [(1, [], None), (2, [], None)])).collect()
    assert [(r.code, r.error, r.label_error) for r in empty] == [("00000000", 0, 0)] * 2


# --- 12 phrases ------------------------------------------------------------------

def brute_phrases(rows, top, least, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[(lang or "und", tuple(w[i:i + k]))] += 1
    out = []
    longer = {}
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= least:
            for q in (p[:2], p[1:]):
                longer[(lang, q)] = max(a, longer.get((lang, q), 0))
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * longer.get((lang, p), -1) >= share * a):
            s, _, l, r = min((10**6 * a * a // (f[(lang, p[:k])] * f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, n[lang], s))
    got = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        got += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(got)


def text_rows(seed=1, docs=120):
    """Zipf-like words, fixed expressions, and pairs that longer expressions swallow."""
    rng = np.random.default_rng(seed)
    vocab = [f"W{i}" if i % 3 else f"é{i}" for i in range(60)]
    fixed = ["New York City", "ad hoc", "a b c", "b c d", "x\ty  z"]
    out = []
    for i in range(docs):
        w = [vocab[min(int(rng.zipf(1.3)) - 1, 59)] for _ in range(40)]
        w += [fixed[j] for j in rng.integers(0, len(fixed), 12)]
        rng.shuffle(w)
        text = " ".join(x + (rng.choice([".", ",", "\n", "!", ""], p=[.05, .05, .05, .05, .8])) for x in w)
        out.append((text, [None, "en", "fr", "und"][i % 4]))
    return [*out, (None, "en"), ("", "en"), (" \t\n", "de"), ("same same same. " * 30, "en"), ("same same same. " * 30, "en"), ("z " * 3000, None)]


@pytest.mark.parametrize("top", [3, 40, 2000])
def test_phrases_equal_brute_force(spark, top):
    """A short list is settled by few expansions, a longer one by several rounds."""
    rows = text_rows()
    table(spark, SF, "documents")
    df = spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], "text string, lang string, phrase string, n int, a int").repartition(3)
    got = phrases.mine(df, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, top, 10, 50)


@pytest.mark.parametrize("bits", [6, 12])
def test_phrases_do_not_depend_on_bitmap_size(spark, bits):
    rows = text_rows(2, 60)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.mine(df, top=25, least=5, bits=bits).collect())) == brute_phrases(rows, 25, 5, 50)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(none).count() == 0
    assert phrases.mine(spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15, 10**15 + 1, 10**15), (3 * 10**12 + 1, 3 * 10**12 + 7, 3 * 10**12 + 5), (10, 11, 13)], "a long, l long, r long")
    got = [r.s for r in big.select(phrases.score("a", "l", "r").alias("s")).collect()]
    assert got == [10**6 * a * a // (l * r) for a, l, r in [(10**15, 10**15 + 1, 10**15), (3 * 10**12 + 1, 3 * 10**12 + 7, 3 * 10**12 + 5), (10, 11, 13)]]


# --- 13 neighbours -----------------------------------------------------------------

def brute_nearest(rows, every, k):
    """Per query: the scores of its k nearest, and the whole ranking."""
    ok = {(i, tuple(v)): np.array(v, float) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for (i, v), x in ok.items():
        if i % every == 0:
            near = []
            for (j, w), y in ok.items():
                if (j, w) != (i, v) and len(w) == len(v):
                    a, b = x / np.abs(x).max(), y / np.abs(y).max()
                    near.append((-(a @ b) / math.sqrt((a @ a) * (b @ b)), j))
            out[(i, v)] = sorted(near, key=lambda t: (round(t[0], 12), t[1]))[:k]
    return out


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).standard_normal((20, 32))
    y = neighbours.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(neighbours.hadamard(y), x)


def test_bounds_hold_the_cosine():
    rng = np.random.default_rng(1)
    import pandas as pd
    x = neighbours.unit(rng.standard_normal((300, 16)))
    step = np.abs(x).max(1) / neighbours.STEPS
    q = np.rint(x / step[:, None])
    f = pd.DataFrame({"k1": range(300), "k2": 0, "s": [r.tobytes() for r in q.astype("<i2")], "step": step,
                      "off": np.sqrt(((x - q * step[:, None]) ** 2).sum(1))})
    got = pd.concat(neighbours.bounded(f[:40], f, 6))
    true = (x @ x.T)[got.q1, got.k1]
    assert (got.low <= true).all() and (true <= got.high).all()
    for i in range(40):
        assert set(np.argsort(-(x @ x[i]))[:6]) <= set(got.k1[got.q1 == i])


def test_neighbours_equal_brute_force_when_all_buckets_are_probed(spark, vectors):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in vectors.collect()]
    base = rows[10][1]
    rows += [(1000 + i, base, 1) for i in range(60)] + [(2000 + i, [x * 10.0**(150 if i % 2 else -150) for x in rows[20][1]], 1) for i in range(4)]
    rows += [(50, base, 1), (50, base, 1), (None, base, 1), (3000, None, 1), (3050, [0.0] * 64, 1), (3100, [NAN] * 64, 1), (3150, [1.0, None], 1), (3200, [], 1), (3250, [1.0, 2.0], 1),
             (3300, [-2.0, 1.0], 1), (3301, [2.0, 4.0], 1)]
    want = brute_nearest(rows, 50, 5)
    got = neighbours.nearest(frame(spark, rows), every=50, k=5, least=10**6).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    lists = {}
    for (i, _), near in want.items():
        lists.setdefault(i, []).append([(rank + 1, j, -s) for rank, (s, j) in enumerate(near)])
    assert set(by) == {i for i, ls in lists.items() if any(ls)}
    for i, ls in lists.items():
        flat = sorted(x for own in ls for x in own)
        for a, b in zip(sorted(by.get(i, [])), flat, strict=True):
            tied = sum(abs(x[2] - b[2]) < 1e-12 for x in flat) > 1  # scaled copies differ in the last bit or not at all
            assert a[0] == b[0] and abs(a[2] - b[2]) < 1e-12 and (a[1] == b[1] or tied)


@pytest.mark.parametrize("hashes,hot,chunk", [(1, 20, 100), (2, 4096, 20_000)])
def test_neighbour_recall_with_crowded_buckets_cut(spark, vectors, hashes, hot, chunk):
    rng = np.random.default_rng(3)
    center = rng.standard_normal((12, 24))
    x = np.repeat(center, 40, axis=0) + 0.3 * rng.standard_normal((480, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute_nearest(rows, 20, 5)
    got = neighbours.nearest(frame(spark, rows), every=20, k=5, hashes=hashes, probes=12, least=1, hot=hot, chunk=chunk).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    pairs = {(i, j) for (i, _), near in want.items() for _, j in near}
    assert len(found & pairs) >= 0.9 * len(pairs)
    exact = {(i, j): -s for (i, _), near in want.items() for s, j in near}
    assert all(abs(r.score - exact[(r.query_id, r.vec_id)]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_neighbours_of_nothing_and_of_few(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    two = [(0, [1.0, 0.0], 1), (7, [1.0, 1.0], 1)]
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(frame(spark, two)).collect()] == [(0, 1, 7)]
    assert neighbours.nearest(frame(spark, two[1:])).count() == 0


def test_neighbour_probes_do_not_follow_the_number_of_rows(spark, monkeypatch):
    seen, plain = [], neighbours.sketched
    monkeypatch.setattr(neighbours, "sketched", lambda rows, tables, hashes, probes: (seen.append(probes), plain(rows, tables, hashes, probes))[1])
    rng = np.random.default_rng(5)
    for n in (60, 600):
        neighbours.nearest(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((n, 64)))]))
    assert seen[:2] == seen[2:]


def test_neighbour_recall_of_a_small_table(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((20, 64)), 20, axis=0) + 0.9 * rng.standard_normal((400, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    pairs = {(i, j) for (i, _), near in brute_nearest(rows, 20, 5).items() for _, j in near}
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(frame(spark, rows), every=20, k=5).collect()}
    assert len(found & pairs) >= 0.9 * len(pairs)
