"""Training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wardlens.llm import chat, embeddings, graph, langid, lm, mixing, packing, quality, sharding, simhash, substrings
from wardlens.llm.common import numbered, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n_words long, g string"


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def docs_pdf(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, clashing names."""
    table(spark, SF, "documents")
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(None, "a null id"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, long), (5, "same row twice here"),
             (5, "same row twice here"), (6, "same row twice here"), (7, "x"), (8, "123 !? 456"), (9, "Ünï çødé tëxt　ok ~ a~b"),
             (10, "start " + passage + " end"), (11, passage), (12, "rep " * 100), (13, "other " + passage + " <|endoftext|>")]
    rows = [(i, t, None if i in (1, 7) else "en", None if i == 2 else f"s{(i or 0) % 3}", 1, 9, "k", 5, "g") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], SCHEMA)


# --- helpers -------------------------------------------------------------------

def test_numbered_is_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("v"))
    got = numbered(df, ["g"], ["v"], "k", 8).toPandas()
    assert len(got) == 500
    for _, own in got.groupby("g"):
        assert sorted(own.k) == list(range(len(own)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, None), (300, 301), (301, 300)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language ----------------------------------------------------------------

def test_language_held_out_accuracy_and_mixture(docs, docs_pdf):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs, model).toPandas().merge(docs_pdf[["doc_id", "lang"]], on="doc_id")
    test = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]]
    assert len(got) == len(docs_pdf) and (test.lang_pred == test.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    by = {x: " ".join(docs_pdf[docs_pdf.lang == x].text.str.slice(0, 400).head(5)) for x in ("en", "de")}
    en, de = by["en"].split()[:200], by["de"].split()[:100]
    share = langid.infer([" ".join(en + de)], model[1])[0]
    top = dict(zip(model[0], share))
    assert abs(top["en"] - 2 / 3) < 0.15 and abs(top["de"] - 1 / 3) < 0.15


def test_language_edges(docs, odd, none):
    model = langid.fit(docs)
    got = {tuple(r[:2]): r for r in langid.identify(odd, model).select("doc_id", "lang_pred", "score").collect()}
    for i in (1, 2, 3, 8):
        assert (i, "und") in got and got[(i, "und")].score == 0
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert empty[0] == [] and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


# --- 2 simhash -----------------------------------------------------------------

def brute_fingerprint(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    if not w:
        return 0
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    of = [find(i) for i in range(len(fps))]
    least = {r: min(ids[i] for i in range(len(fps)) if of[i] == r) for r in set(of)}
    return [least[r] for r in of]


def test_simhash_equals_brute_force(docs, docs_pdf):
    got = simhash.simhash_groups(docs).toPandas().sort_values("doc_id")
    pdf = docs_pdf.sort_values("doc_id")
    fps = np.array([brute_fingerprint(t) for t in pdf.text], np.uint64)
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == brute_groups(fps, pdf.doc_id.tolist())


@pytest.mark.parametrize("hot", [50_000, 60])
def test_trie_join_finds_all_links(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [base]
    for k in range(1, 7):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
        fps.append(x)
    near = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    fps = np.concatenate([*fps, near])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "doc_id long, f long")
    got = df.join(simhash.fingerprint_groups(df, "doc_id", "f", 4, hot), "f").toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == brute_groups(fps, list(range(len(fps))))


def test_simhash_edges(odd, none):
    got = simhash.simhash_groups(odd).toPandas()
    assert len(got) == odd.count()
    zero = got[got.doc_id.isin([1, 2, 3])]
    assert set(zero.fingerprint) == {"0" * 16} and set(zero.component_id) == {1}
    assert set(got[got.doc_id.isin([5, 6])].component_id) == {5}
    assert simhash.simhash_groups(none).count() == 0
    one = simhash.keep_one(odd).toPandas()
    assert list(one.columns) == odd.columns and sorted(one.doc_id.dropna()) == sorted(set(got.component_id.dropna()))
    assert simhash.keep_one(none).count() == 0


# --- 3 shards ------------------------------------------------------------------

def test_shards_are_even_gapless_and_keep_groups(docs, docs_pdf):
    got = sharding.shard(docs, 8).toPandas().merge(docs_pdf[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(docs_pdf)
    assert (got["size"] == [len(t.encode()) + 1 for t in got.text]).all()
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.02 * load.mean()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    small = got[got.groupby("text")["size"].transform("sum") * 512 < got["size"].sum()]
    assert (small.groupby("text").shard.nunique() == 1).all()


def test_hot_group_is_spread(spark, odd, none):
    hot = spark.range(900).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") < 400, "the hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard(hot, 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and load.max() - load.min() <= 0.03 * load.mean()
    got = sharding.shard(odd, 8).toPandas()
    assert len(got) == odd.count() and got[got.doc_id == 1][["size", "text_crc32"]].values.tolist() == [[1, 0]]
    assert sharding.shard(none, 8).count() == 0


# --- 4 mixing ------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mix_meets_targets(docs, docs_pdf):
    got = mixing.curriculum(docs).toPandas()
    size = Counter()
    for s, t in zip(docs_pdf.source, docs_pdf.text):
        size[s] += len(words(t))
    want = brute_targets(size)
    assert len(got) == len(docs_pdf) and ((got.taken == got.copies * got["size"]) & (got.copies <= 2)).all()
    for s, own in got.groupby("source"):
        assert math.isclose(own.target.iloc[0], want[s]) and own.source_size.iloc[0] == size[s]
        assert abs(own.taken.sum() - want[s]) <= own["size"].max() / 2 + 1
        assert all(len(p) == c and all(0 <= x <= 1 for x in p) for p, c in zip(own.positions, own.copies))
    again = mixing.curriculum(docs.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values("doc_id")[key].values.tolist() == again.sort_values("doc_id")[key].values.tolist()


def test_curriculum_inverts_demand(docs):
    """A source's words up to time t follow its integrated schedule t + a (t^2 - t)."""
    got = mixing.curriculum(docs).toPandas().explode("positions").dropna(subset="positions")
    tilt = dict(zip(sorted(got.source.unique()), [(-0.5, 0.0, 0.5)[i % 3] for i in range(30)]))
    for s, own in got.groupby("source"):
        own = own.sort_values("positions")
        had = own["size"].cumsum() - own["size"] / 2
        t, a = own.positions.astype(float), tilt[s]
        off = (t + a * (t * t - t) - had / own.target).abs().max()
        assert off <= own["size"].max() / own.target.iloc[0] + 1e-6


def test_mix_edges(spark, odd, none):
    got = mixing.curriculum(odd).toPandas()
    assert len(got) == odd.count() and (got["size"] == 0).sum() == 3
    assert mixing.curriculum(none).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.curriculum(blank).collect()] == [0, 0]
    out = mixing.reorder(odd)
    assert out.columns == odd.columns
    taken = mixing.curriculum(odd).groupBy().agg(F.sum("copies")).first()[0]
    assert out.count() == taken and mixing.reorder(none).count() == 0


# --- 5 embeddings --------------------------------------------------------------

def brute_links(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v) and rows[i][0] is not None]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, i in enumerate(ok):
        for j in ok[a + 1:]:
            x, y = (np.array(rows[k][1], float) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return [(r[0], n[i], least[find(i)] if i in set(ok) else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("hot", [4096, 16])
def test_vectors_equal_brute_force(spark, odd, hot):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 64))
    rows = []
    for k in range(240):
        v = base[k % 40] + rng.standard_normal(64) * rng.choice([0.0, 0.15, 0.25, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], k % 40 % 3))
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(30)] + [(300, rows[0][1], rows[0][2])]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [1.0, None], 1), (404, [1.0, float("nan")], 1),
             (405, [float("inf"), 1.0], 1), (406, rows[0][1], None), (407, [1.0, 0.0], 1), (408, [2.0, 0.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_vectors(df, hot=hot).toPandas()
    as_key = lambda x: tuple(-1 if v is None or pd.isna(v) else int(v) for v in x)
    want = sorted(as_key(x) for x in brute_links(rows))
    assert sorted(as_key(x) for x in got[["vec_id", "n_links", "component_id"]].itertuples(index=False)) == want
    assert (got.kept == ((got.vec_id == got.component_id) | got.vec_id.isna())).all()
    assert embeddings.near_vectors(df.limit(0)).count() == 0


# --- 6 repeated passages ---------------------------------------------------------

def brute_repeats(texts, k):
    ws = [words(t) for t in texts]
    n = Counter(tuple(w[i:i + k]) for w in ws for i in range(len(w) - k + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i:i + k])] > 1:
                gone.update(range(i, i + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot,bits", [(5000, 28), (3, 8)])
def test_repeats_equal_brute_force(docs, odd, hot, bits):
    for df in (docs.select("doc_id", "text"), odd):
        pdf = df.toPandas()
        got = substrings.remove_repeats(df, hot=hot, bits=bits).select("doc_id", "repeats.*").collect()
        want = Counter((None if pd.isna(i) else i, *r) for i, r in zip(pdf.doc_id, brute_repeats(pdf.text, 35)))
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_repeats_within_a_text_and_empty(spark, none):
    rng = np.random.default_rng(1)
    texts = ["a " * 200, "a b " * 40, " ".join(rng.choice(["x", "y"], 3000)), None, "a " * 34]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.remove_repeats(df, window=12, anchor=5).orderBy("doc_id").select("repeats.*").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute_repeats(texts, 12)
    assert substrings.remove_repeats(none).count() == 0


# --- 7 packing -----------------------------------------------------------------

def test_packing_round_trip(docs, odd, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    for df, cap in ((docs.select("doc_id", "text"), 4096), (odd, 512)):
        pdf = df.toPandas()
        got = packing.pack(df, corpus_pipeline.TOKENIZER, cap=cap, with_ids=True).toPandas()
        want = Counter()
        for i, t in zip(pdf.doc_id, pdf.text):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            for k, s in enumerate(range(0, len(ids), cap)):
                raw = ids[s:s + cap].tobytes()
                want[(None if pd.isna(i) else i, k, s, len(raw) // 4, zlib.crc32(raw), raw)] += 1
        cols = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        assert Counter((None if pd.isna(r[0]) else r[0], *r[1:5], bytes(r[5])) for r in got[cols].itertuples(index=False)) == want
        g = got.sort_values(["sequence_id", "offset"])
        assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
        load = g.groupby("sequence_id").length.sum()
        assert load.max() <= cap and len(load) <= 1.05 * math.ceil(load.sum() / cap) + 2
    assert packing.pack(none, corpus_pipeline.TOKENIZER).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    hist = Counter(np.minimum(4096, rng.lognormal(6.3, 1.0, 60_000).astype(int) + 1).tolist())
    got = packing.plan(dict(hist), 4096)
    have = Counter()
    for lengths, n in got:
        assert sum(lengths) <= 4096 and n > 0
        for x in lengths:
            have[x] += n
    assert have == hist
    used, least = sum(n for _, n in got), math.ceil(sum(x * n for x, n in hist.items()) / 4096)
    assert used <= 1.005 * least + 1
    assert packing.plan({}, 4096) == []


# --- 8 quality -----------------------------------------------------------------

def brute_stats(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    out = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)]
    return [*out, out[0] < 10 or 100 * out[4] > 20 * out[0]]


def test_quality_statistics_and_outliers(docs, odd, none):
    for df in (docs, odd):
        pdf = df.select("doc_id", "text").toPandas()
        got = quality.rate(df).select("doc_id", *quality.STATS, "base_failed", "kept").collect()
        key = lambda i: None if pd.isna(i) else int(i)
        assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((key(i), *brute_stats(t)) for i, t in zip(pdf.doc_id, pdf.text))
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.rate(none).count() == 0
    assert abs(quality.chi2_quantile(0.75, 5) - 6.6257) < 1e-3 and abs(quality.chi2_cdf(6.6257, 7) - 0.5310) < 1e-3


def test_quality_rejects_planted_outliers(spark, odd):
    rng = np.random.default_rng(4)
    vocab = [f"w{'abcdefgh'[i % 8] * (i % 7 + 1)}{i}" for i in range(3000)]
    clean = [" ".join(rng.choice(vocab, int(rng.lognormal(5, 0.7)) + 12)) for _ in range(600)]
    junk = ["### ".join(rng.choice(vocab, 80)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en", "a" if i % 3 else "b") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    got = quality.rate(df, least=100).toPandas().set_index("doc_id").kept
    assert got[:600].mean() > 0.99 and not got[600:].any()


@pytest.mark.parametrize("kind", ["lines", "phrases"])
def test_quality_rejects_repeats_within_the_limits(spark, kind):
    """Repeated lines alone, and repeated phrases alone, reject texts of usual length."""
    rng = np.random.default_rng(8)
    vocab = [f"w{'abcdefgh'[i % 8] * (i % 7 + 1)}{i}" for i in range(3000)]

    def clean():
        w = rng.choice(vocab, int(rng.lognormal(5, 0.5)) + 20)
        return "\n".join(" ".join(x) for x in np.array_split(w, len(w) // 10 + 1))

    def junk():
        if kind == "lines":  # 56 of 84 lines come again; no 5 words in a row do
            return "\n".join("more" if i % 3 else " ".join(rng.choice(vocab, 3)) for i in range(84))
        w = rng.choice(vocab, 150).tolist()  # 30 of 150 words, the most that the limit lets pass
        return "\n".join(" ".join(x) for x in np.array_split(w[:120] + w[:15] + w[135:], 15))
    texts = [clean() for _ in range(900)] + [junk() for _ in range(20)]
    texts += [t + "\n" + t.split("\n")[0] for t in texts[:20] if len(t.split()) > 160]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = quality.rate(df).toPandas().set_index("doc_id")
    assert not got.base_failed[900:920].any() and not got.kept[900:920].any()
    assert got.kept[:900].mean() > 0.99 and got.kept[920:].all()  # one repeated line is no reason


# --- 9 chat --------------------------------------------------------------------

def test_chat_keeps_maximal_conversations(spark, odd):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "ok")]
    convs = {1: a[:2], 2: a, 3: a, 4: a[:3], 5: [("user", "hi"), ("assistant", "no")], 6: a[:1], 7: [("user", None)], 8: [(None, "hi")],
             9: [("user", f"t{i}") for i in range(600)]}
    rows = [(c, t, r, x, 0) for c, ts in convs.items() for t, (r, x) in enumerate(ts)]
    rows += [rows[0], (None, 0, "user", "lost", 0)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")).toPandas()
    assert sorted(set(got.conv_id)) == [2, 5, 7, 8, 9]
    assert got[got.conv_id == 2].chat.tolist() == ["".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in a)]
    nine = got[got.conv_id == 9].sort_values("part")
    assert nine.part.tolist() == [0, 1, 2] and set(nine.n_turns) == {600}
    assert "".join(nine.chat) == "".join(f"<|user|>\nt{i}\n<|end|>\n" for i in range(600))
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_parts_are_bounded_whatever_the_turn_numbers(spark):
    """Turns without a number, under one number or far apart: 256 turns a part, in order."""
    turns = {1: lambda i: None, 2: lambda i: 7, 3: lambda i: 10**12 + 86_400 * i}
    rows = [(c, n(i), "user", f"c{c}t{i}") for c, n in turns.items() for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render(df).toPandas().sort_values(["conv_id", "part"])
    for c, own in got.groupby("conv_id"):
        assert own.part.tolist() == [0, 1, 2] and set(own.n_turns) == {600}
        assert own.chat.str.count("<.end.>").tolist() == [256, 256, 88]
        texts = re.findall(r"c\dt\d+", "".join(own.chat))
        assert sorted(texts) == sorted(f"c{c}t{i}" for i in range(600))
    assert texts == [f"c3t{i}" for i in range(600)]
    p = chat.turn_prefixes(df).groupBy("conv_id").agg(F.max("pos"), F.count_distinct("pos")).collect()
    assert sorted(map(tuple, p)) == [(c, 600, 600) for c in (1, 2, 3)]


# --- 10 language model -----------------------------------------------------------

def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, lm.CLASSES * lm.MEMBERS).astype(float)
    net = lm.Gru(size, 4)
    net.w = {k: w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for k, w in net.w.items()}
    x, y = rng.integers(0, 1024, (5, 3)), rng.integers(0, 1024, (5, 3))
    fresh = rng.random((5, 3)) < 0.3
    h = rng.normal(0, 1, (4, 3))

    def loss():
        out = np.empty((5, 3, 4))
        s = h
        for t in range(5):
            s = net.forward(s, x[t:t + 1], fresh[t:t + 1])[0].astype(np.float64)
            out[t] = s.T
        return -net.predict(out.reshape(-1, 4), y.ravel())[0].mean()
    g, _ = net.gradients(h, x, fresh, y)
    for k, w in net.w.items():
        hit = np.flatnonzero(np.abs(g[k].ravel()) > 1e-3)
        for i in rng.choice(hit, min(6, len(hit)), replace=False):
            old = w.flat[i]
            w.flat[i] = old + 1e-2
            up = loss()
            w.flat[i] = old - 1e-2
            down = loss()
            w.flat[i] = old
            assert abs((up - down) / 2e-2 - g[k].flat[i]) < 0.03 * abs(g[k].flat[i]) + 3e-4


def test_lanes_and_windows_cover_documents():
    docs = [np.arange(100 * i, 100 * i + n, dtype=np.int16) for i, n in enumerate((5, 40, 1, 17, 33, 2))]
    target, prev, fresh, doc, load = lm.lanes(docs, 3, 999)
    seen = Counter()
    for s, l in lm.windows(load, 7):
        seen.update(zip(doc[s, l].ravel().tolist(), target[s, l].ravel().tolist(), prev[s, l].ravel().tolist()))
    assert seen == Counter((i, x, d[k - 1] if k else 999) for i, d in enumerate(x.tolist() for x in docs) for k, x in enumerate(d))


def test_lm_scores(docs, docs_pdf, odd, none):
    low = {c: c + 32 for c in range(65, 91)}
    tokens = {i: [*words(t.translate(low)), ""] for i, t in zip(docs_pdf.doc_id, docs_pdf.text)}
    n = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(n.values()), len(n)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    train = docs.where(learn)
    got = lm.score(docs, learn, frequent=500).toPandas().set_index("doc_id")
    apart = lm.score(docs, train, frequent=500).toPandas().set_index("doc_id").loc[got.index]
    assert (apart.base_score - got.base_score).abs().max() < 1e-9 and (apart.n_known == got.n_known).all()
    assert abs(apart.score.sum() / got.score.sum() - 1) < 0.01
    assert len(got) == len(tokens) and set(got.train_tokens) == {total}
    for i, ws in tokens.items():
        r = got.loc[i]
        assert r.n_tokens == len(ws) and r.n_known == sum(n[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((n[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), rel_tol=1e-9)
    held = got[[zlib.crc32(str(i).encode()) % 10 == 0 for i in got.index]]
    assert held.score.sum() > held.base_score.sum()
    got = lm.score(odd, train, frequent=500).toPandas()
    assert len(got) == odd.count() and set(got[got.doc_id.isin([1, 2, 3])].n_tokens) == {1} and np.isfinite(got.score).all()
    assert lm.score(none, train, frequent=500).count() == 0
    got = lm.score(odd, none).toPandas()
    assert (got.n_known == 0).all() and np.isfinite(got.score).all()


# --- pipeline --------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none.select(docs.columns), SF).columns == docs.columns
    dup = spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(["one two three four five six seven eight nine ten eleven"] * 3)], docs.schema)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs.union(dup), SF).toPandas()
    assert (kept.doc_id >= 100).sum() == 1
    cut = corpus_pipeline.substring_dedup(spark, docs, SF).toPandas().set_index("doc_id").text
    assert cut[10] == "start end" and cut[11] == "" and cut[13] == "other <|endoftext|>" and cut[9].startswith("Ünï")
    good = corpus_pipeline.quality_rules(spark, docs, SF).toPandas().doc_id.tolist()
    assert sorted(good) == [4, 10, 11, 13]


def test_pipeline_runs_whole(spark, docs):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.doc_id.nunique() > 100
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_registered_queries():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    own = [k for k in q if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in own) == list(range(1, 11)) and "pipeline" in q
    assert {k for k in own if k in o} == {"op4_curriculum_mix", "op6_phrase_automata", "op9_snapshot_chats"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "sequence_packing"]
