"""Phrase collocation mining by best-first growth.

Texts, with A-Z lower-cased, are cut at punctuation and line ends into pieces and those at
blanks into words. A phrase of two or three words that occurs ``least`` times or more is a
candidate; each way of cutting it in two gives floor(10^6 a^2 / (l r)) for its count a and
the counts l and r of the sides, and the lowest is its score. A candidate is dropped
if a longer one that holds it occurs at least half as often.

Phrases grow from counted prefixes. A phrase occurs no more often than any part of it, so
only frequent words are joined to pairs, and only frequent pairs grow. A longer phrase
whose prefix occurs p times and whose first word f times scores at most floor(10^6 p / f):
with k = 1, a <= p and r >= a. So the frontier is expanded from the best bound down:

1. ``theta`` is a language's score at a rank among its pairs, at first twice the rank asked for.
2. Prefixes with a bound of theta or more are expanded to the right, and the pairs that
   score theta or more are expanded to the left. Now every phrase that scores theta or
   more is known, with all that could drop it.
3. A language with as many survivors as asked for (ties come along, since all of a score
   are known), or with no phrase left below theta, is settled. For the others the rank is
   doubled twice and the frontier goes on down.

Counting is a pass over the texts a level: a task counts its phrases by numbers of its own
words and Spark adds up. Which phrases to count goes to the tasks as bitmaps of a fixed
size; a false positive costs work, never a result, since joins with the exact counts follow.
Pairs take two passes, by hash and then by words, so that rare pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import on_path, stored
from wardlens.llm.substrings import _has, bitmap

#: bytes.translate table: A-Z to lower case, what ends a piece to a full stop.
PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
MILLION = 1_000_000
TURN = 31


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def pair_hash(lang: Column, a: Column, b: Column) -> Column:
    """The first word's hash, with the second's turned by ``TURN`` bits."""
    h = word_hash(lang, b)
    return word_hash(lang, a).bitwiseXOR(F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN)))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ ((b << np.uint64(TURN)) | (b >> np.uint64(64 - TURN)))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, numbers, words) of about ``size`` bytes of text at a time: the words of whole
    texts as numbers into the list of distinct words, where 0 is a piece's end."""
    def numbered(lang, own):
        number = {b".": 0}  # never a word
        ids = np.array([number.setdefault(w, len(number)) for w in b".".join(own).replace(b".", b" . ").split()], np.int64)
        return lang, ids, list(number)

    parts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            own = text.as_py().translate(PIECES)
            parts.setdefault(lang, []).append(own)
            held[lang] = held.get(lang, 0) + len(own) + 1
            if held[lang] >= size:
                yield numbered(lang, parts.pop(lang))
                held[lang] = 0
    for lang, own in parts.items():
        yield numbered(lang, own)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _neighbours(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each word and the next are both ``known`` words of one piece."""
    known[0] = False
    on = known[ids]
    return on[:-1] & on[1:]


def phrase_counts(texts: DataFrame, size: int, words=None, pairs=None, right=None, left=None, chunk: int = 4 << 20) -> DataFrame:
    """(lang, w1, ..., n): occurrences of phrases of ``size`` words in ``texts`` (lang,
    text as bytes). Bitmaps (broadcast) choose what is counted: pairs of two of ``words`` that
    are in ``pairs``; triples of two of ``pairs`` of which the first is in ``right`` or the
    second in ``left``."""
    names = [f"w{i + 1}" for i in range(size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, number in _chunks(batches, chunk):
            v = len(number)
            vocab = pa.array(number, pa.binary())
            if size == 1:
                n = np.bincount(ids, minlength=v)
                n[0] = 0
                at = np.flatnonzero(n)
                cols, n = [at], n[at]
            else:
                h = _word_hashes(lang, number)
                on = np.flatnonzero(_neighbours(ids, _has(words.value, h)))
                a, b = ids[on], ids[on + 1]
                g = _pairs(h[a], h[b])
                here = _has(pairs.value, g)
                if size == 2:
                    key, n = np.unique(a[here] * v + b[here], return_counts=True)
                    cols = [key // v, key % v]
                else:
                    on, a, b, g = on[here], a[here], b[here], g[here]
                    grows, ends = _has(right.value, g), _has(left.value, g)
                    at = np.flatnonzero((np.diff(on) == 1) & (grows[:-1] | ends[1:]))
                    _, pair = np.unique(a * v + b, return_inverse=True)
                    key, first, n = np.unique(pair[at] * v + b[at + 1], return_index=True, return_counts=True)
                    at = at[first]
                    cols = [a[at], b[at], b[at + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), *[vocab.take(pa.array(c)).cast(pa.string()) for c in cols],
                 pa.array(n, pa.int64())], ["lang", *names, "n"])

    schema = "lang string, " + "".join(f"{w} string, " for w in names) + "n long"
    return texts.mapInArrow(count, schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(n, start) if len(h) else n


def frequent_pairs(texts: DataFrame, words, least: int, total: int, chunk: int = 4 << 20, hold: int = 3_000_000, row: int = 500) -> DataFrame:
    """(anchor): hashes of pairs of two of ``words`` that occur ``least`` times or more.

    Most pairs of a text are rare and number as many as its words, so they are counted by hash
    in blocks: a task sends sorted blocks of hashes and counts, dealt by ranges of the hash so
    that a range holds about a million of ``total`` words' pairs, and a range is added up as
    arrays. Two pairs that share a hash are counted together, which lets more through."""
    ranges = max(64, total >> 20)
    schema = pa.schema([("range", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h, n = _summed(*map(np.concatenate, zip(*held)))
            where = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cut = np.flatnonzero(np.diff(where)) + 1
            ends = [0, *cut.tolist(), len(h)]
            spans = [(lo, min(lo + row, b)) for a, b in zip(ends, ends[1:]) for lo in range(a, b, row)]
            counts = n.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([int(where[a]) for a, _ in spans], pa.int64()), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                                               pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], schema=schema)

        for lang, ids, number in _chunks(batches, chunk):
            w = _word_hashes(lang, number)
            on = np.flatnonzero(_neighbours(ids, _has(words.value, w)))
            g = _pairs(w[ids[on]], w[ids[on + 1]])
            held.append(_summed(g, np.ones(len(g), np.int64)))
            size += len(held[-1][0])
            if size >= hold:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, at = [], [], None

        def out():
            keys, counts = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in h]), np.concatenate([np.frombuffer(x, np.uint32) for x in n]).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys[counts >= least].view(np.int64))], ["anchor"])

        for batch in batches:
            for r, x, y in zip(batch.column("range").to_pylist(), batch.column("h").to_pylist(), batch.column("n").to_pylist()):
                if h and r != at:
                    yield out()
                    h, n = [], []
                at = r
                h.append(x)
                n.append(y)
        if h:
            yield out()

    sent = texts.mapInArrow(blocks, "range long, h binary, n binary").repartition("range").sortWithinPartitions("range")
    return sent.mapInArrow(add, "anchor long")


def score(a: str, l: str, r: str) -> Column:
    """floor(10^6 a^2 / (l r)) in exact decimals."""
    big = [f"cast({x} as decimal(19,0))" for x in (a, a, l, r)]
    return F.expr(f"cast(({big[0]} * {big[1]} * {MILLION}BD) div ({big[2]} * {big[3]}) as long)")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least: int = 10, share: int = 50,
         bits: int = 26) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l,
    r, n, score, by score and count from the highest, then by the phrase's bytes.

    Null languages are ``und``; null texts have no words; repeated rows count each time;
    languages without a phrase, and empty tables, give no rows. Texts are read whole,
    whatever their length. Other columns are not read."""
    spark = docs.sparkSession
    on_path(spark)
    sc = spark.sparkContext
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    texts = texts.where(F.col("text").isNotNull())
    mark = lambda df, h: sc.broadcast(bitmap(df.select(h.alias("anchor")), bits))
    w = stored(phrase_counts(texts, 1, chunk=8 << 20).withColumnRenamed("w1", "w"), "words")
    total = w.groupBy("lang").agg(F.sum("n").alias("words"))
    often = stored(w.where(F.col("n") >= least), "frequent-words")
    words = mark(often, word_hash(F.col("lang"), F.col("w")))
    many = int(w.agg(F.sum("n")).first()[0] or 0)
    twice = sc.broadcast(bitmap(stored(frequent_pairs(texts, words, least, many), "pair-hashes"), bits))
    pair = phrase_counts(texts, 2, words, twice).where(F.col("n") >= least).withColumnRenamed("n", "a")
    for i in (1, 2):
        pair = pair.join(often.select("lang", F.col("w").alias(f"w{i}"), F.col("n").alias(f"f{i}")), ["lang", f"w{i}"])
    pair = pair.withColumns({"score": score("a", "f1", "f2"), "bound": F.expr(f"(a * {MILLION}) div f1")})
    pair = stored(pair.select("lang", "w1", "w2", "a", "f1", "f2", "score", "bound"), "pairs")
    h = pair_hash(F.col("lang"), F.col("w1"), F.col("w2"))
    pairs = mark(pair, h)

    best = Window.partitionBy("lang").orderBy(F.desc("score"))
    done, open_, rank = [], stored(pair.groupBy("lang").agg(F.count(F.lit(1)).alias("pairs")), "open-languages"), 2 * top
    while open_.count():
        edge = pair.join(open_.select("lang"), "lang", "left_semi").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rank)
        edge = edge.groupBy("lang").agg(F.min("score").alias("edge"))
        theta = stored(open_.join(edge, "lang").select("lang", F.when(F.col("pairs") > rank, F.col("edge")).otherwise(F.lit(0)).alias("theta")), "frontier")
        here = stored(pair.join(theta, "lang").where(F.col("bound") >= F.col("theta")), "expanded")
        tops = stored(here.where(F.col("score") >= F.col("theta")), "leading-pairs")  # a pair's bound is at least its score
        triple = phrase_counts(texts, 3, words, pairs, mark(here, h), mark(tops, h)).where(F.col("n") >= least).withColumnRenamed("n", "a3")
        first = pair.select("lang", "w1", "w2", F.col("f1").alias("l1"), F.col("a").alias("l2"))
        second = pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2"))
        triple = triple.join(first, ["lang", "w1", "w2"]).join(second, ["lang", "w2", "w3"])
        triple = stored(triple.withColumns({"s1": score("a3", "l1", "r1"), "s2": score("a3", "l2", "r2")}), "triples")
        over = triple.select("lang", "w1", "w2", "a3").union(triple.select("lang", "w2", "w3", "a3")).groupBy("lang", "w1", "w2").agg(F.max("a3").alias("over"))
        left = tops.join(over, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("over") < share * F.col("a"), F.lit(True)))
        left = left.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
        front = F.col("s1") <= F.col("s2")
        long = triple.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("a3").alias("a"), F.when(front, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(front, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
        long = long.join(theta, "lang").where(F.col("score") >= F.col("theta")).drop("theta")
        found = stored(left.unionByName(long), "survivors")
        state = open_.join(theta, "lang").join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left")
        settled = stored(state.select("lang", "pairs", ((F.coalesce("n", F.lit(0)) >= top) | (F.col("theta") == 0)).alias("settled")), "settled-languages")
        done.append(found.join(settled.where("settled"), "lang", "left_semi"))
        open_ = settled.where("not settled").select("lang", "pairs")
        rank *= 4
    if not done:
        done = [pair.select("lang", F.lit("").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")]
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


ORACLE = r"""
with d as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
p as (select row_number() over () pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') w from d),
u as (select pid, lang, unnest(w) w1, generate_subscripts(w, 1) i from p),
t as (select lang, w1, lead(w1) over x w2, lead(w1, 2) over x w3 from u window x as (partition by pid order by i)),
f1 as (select lang, w1, count(*) a from t group by all),
f2 as (select lang, w1, w2, count(*) a from t where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) a from t where w3 is not null group by all having a >= 10),
c2 as (select f2.*, x.a l, y.a r from f2 join f1 x using (lang, w1) join f1 y on y.lang = f2.lang and y.w1 = f2.w2 where f2.a >= 10),
c3 as (select f3.*, x.a x1, yz.a yz, xy.a xy, z.a z from f3 join f1 x using (lang, w1) join f2 xy using (lang, w1, w2)
  join f2 yz on yz.lang = f3.lang and yz.w1 = f3.w2 and yz.w2 = f3.w3 join f1 z on z.lang = f3.lang and z.w1 = f3.w3),
o as (select lang, w1, w2, max(a) a from (select lang, w1, w2, a from f3 union all select lang, w2, w3, a from f3) group by all),
s3 as (select *, (1000000::hugeint * a * a) // (x1::hugeint * yz) k1, (1000000::hugeint * a * a) // (xy::hugeint * z) k2 from c3),
z as (select c2.lang, c2.w1 || ' ' || c2.w2 phrase, c2.a, l, r, (1000000::hugeint * c2.a * c2.a) // (l::hugeint * r) score
  from c2 left join o using (lang, w1, w2) where o.a is null or 100 * o.a < 50 * c2.a
 union all select lang, w1 || ' ' || w2 || ' ' || w3, a, case when k1 <= k2 then x1 else xy end, case when k1 <= k2 then yz else z end, least(k1, k2) from s3),
n as (select lang, sum(a) n from f1 group by lang)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from
 (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from z) join n using (lang) where rank <= 2000
"""
