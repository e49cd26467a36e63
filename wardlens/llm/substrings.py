"""Repeated-passage removal with sharded Aho-Corasick automata.

A window is ``window`` consecutive words of one text. Every word that lies in a window
whose word sequence starts anywhere else, in the same text or another, is removed.

1. Anchors. In each window the ``anchor``-word phrase with the smallest hash is the
   window's anchor, so equal windows have equal anchors. Anchors are counted over all
   texts; a window whose anchor occurs once cannot recur. The recurring anchors go to
   the tasks as a bitmap of fixed size. A false positive costs work, never a result.
2. Segments. Neighbouring windows with the same recurring anchor form a segment.
   Segments are dealt to shards by their anchor, so all copies of a window meet. An
   anchor with ``hot`` or more occurrences is dealt by whole windows instead: equal
   windows still meet, and they collapse to one row a task before the shuffle.
3. Shards. A shard confirms the windows that recur, compiles them into pyahocorasick
   automata over word numbers, a bounded number of words at a time, and streams its
   segments through them to find every occurrence.
4. The occurrences go back to their texts as spans of words.

Texts are known by the first 128 bits of their SHA-256, so copies share their spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import on_path, stored, unused

SEGMENT = pa.schema([("route", pa.int64()), ("sid", pa.binary()), ("seg", pa.binary()), ("n", pa.int64()),
                     ("key", pa.binary()), ("pos", pa.int64())])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every run of ``k`` values, by doubling."""
    base = 0x9E3779B97F4A7C15
    n = len(h) - k + 1
    out, done, step, width = None, 0, h, 1
    while k:
        if k & 1:
            part = step[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        k >>= 1
        if k:
            step = step[:-width] * np.uint64(pow(base, width, 1 << 64)) + step[width:]
            width *= 2
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def sliding(a: np.ndarray, k: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every run of ``k`` values."""
    n, width = len(a) - k + 1, 1
    while 2 * width <= k:
        a = best(a[:-width], a[width:])
        width *= 2
    return best(a[:n], a[k - width:k - width + n])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    for i, t in enumerate(batch.column("text")):
        if t.is_valid:
            yield i, t.as_py().encode().split()


def _window_anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    phrases = rolling(h, anchor)
    return phrases, sliding(phrases, window - anchor + 1, np.minimum)


def anchor_counts(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, n): occurrences of each anchor phrase over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, words in _texts(batch):
                if len(words) >= window:
                    phrases, least = _window_anchors(_word_hashes(words), window, anchor)
                    pad = np.zeros(window - anchor, np.uint64)
                    chosen = sliding(np.concatenate([pad, least, pad]), window - anchor + 1, np.maximum)
                    found.append(phrases[phrases == chosen])
            v, n = np.unique(np.concatenate(found) if found else np.array([], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return texts.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of ``2**bits`` remainders that an anchor has: 2**bits / 8 bytes."""
    at = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    got = anchors.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((anchor & {(1 << bits) - 1}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = v & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def segments(texts: DataFrame, window: int, anchor: int, recurring, hot) -> DataFrame:
    """Candidate segments. Of a segment's rows within a batch the first carries its
    words and its number ``n`` of occurrences there; each carries text key and position."""
    longest = window - anchor + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, crowded = recurring.value, hot.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            copies: dict[bytes, int] = {}
            for k in keys:
                copies[k] = copies.get(k, 0) + 1
            seen: dict[bytes, list] = {}
            rows: list[tuple] = []
            for i, words in _texts(batch):
                n = copies.pop(keys[i], 0)
                if not n or len(words) < window:
                    continue
                h = _word_hashes(words)
                least = _window_anchors(h, window, anchor)[1]
                here = np.flatnonzero(_has(known, least))
                if not len(here):
                    continue
                a = least[here]
                warm = _has(crowded, a)
                new = np.ones(len(here), bool)
                new[1:] = (np.diff(here) > 1) | (a[1:] != a[:-1]) | warm[1:]
                first = np.flatnonzero(new)
                runs = np.diff([*first, len(here)])
                whole = rolling(h, window).view(np.int64) if warm.any() else None
                routes = a.view(np.int64)
                for f, run in zip(first.tolist(), runs.tolist()):
                    for off in range(0, run, longest):
                        p = int(here[f + off])
                        seg = b" ".join(words[p:p + window - 1 + min(longest, run - off)])
                        sid = xxhash.xxh3_128_digest(seg)
                        got = seen.get(sid)
                        if got is None:
                            seen[sid] = got = [len(rows), 0]
                            rows.append((int(whole[p] if warm[f] else routes[f]), sid, seg, 0, keys[i], p))
                        else:
                            rows.append((None, sid, None, None, keys[i], p))
                        got[1] += n
            cols = [list(c) for c in zip(*rows)] or [[] for _ in SEGMENT]
            for at, n in seen.values():
                cols[3][at] = n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SEGMENT)], schema=SEGMENT)

    return texts.mapInArrow(cut, "route long, sid binary, seg binary, n long, key binary, pos long")


def recurring(segs: list[np.ndarray], times: np.ndarray, window: int) -> Iterator[tuple]:
    """The distinct windows of ``segs`` that occur more than once, where segment i occurs
    ``times[i]`` times. Windows meet by hash and are compared word by word."""
    size = np.array([len(s) for s in segs])
    flat = np.concatenate(segs)
    if len(flat) < window:
        return
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(segs)), size)
    starts = np.flatnonzero(np.arange(len(flat)) + window <= ends[owner])  # windows within one segment
    h = rolling(flat.astype(np.uint64), window)[starts]
    order = np.argsort(h, kind="stable")
    h, starts = h[order], starts[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    n = np.bincount(group, weights=times[owner[starts]], minlength=len(first)) if len(first) else np.zeros(0)
    for lo in range(0, len(starts), 1 << 14):
        at = np.arange(lo, min(lo + (1 << 14), len(starts)))
        at = at[n[group[at]] > 1]
        rows = np.lib.stride_tricks.sliding_window_view(flat, window)
        same = (rows[starts[at]] == rows[starts[first[group[at]]]]).all(1)
        n[np.unique(group[at[~same]])] = -1  # different windows share the hash
    for g in np.flatnonzero(n > 1):
        p = starts[first[g]]
        yield tuple(flat[p:p + window].tolist())
    clash = np.flatnonzero(n < 0)
    if len(clash):
        count: dict[tuple, int] = {}
        for k in np.flatnonzero(np.isin(group, clash)):
            w = tuple(flat[starts[k]:starts[k] + window].tolist())
            count[w] = count.get(w, 0) + int(times[owner[starts[k]]])
        yield from (w for w, c in count.items() if c > 1)


def locate(group: list[tuple[bytes, bytes, int]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """(sid, from, to) of the words in recurring windows of ``group``: (sid, words,
    occurrences) of distinct segments that hold all copies of their windows."""
    number: dict[bytes, int] = {}
    segs = [[number.setdefault(w, len(number) + 1) for w in seg.split(b" ")] for _, seg, _ in group]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for w in recurring([np.array(s, np.int64) for s in segs], np.array([n for _, _, n in group], np.int64), window):
        automaton.add_word(w, 1)
    if not len(automaton):
        return
    automaton.make_automaton()
    for s, (sid, _, _) in zip(segs, group):
        lo = hi = -1
        for end, _ in automaton.iter(tuple(s)):
            if end - window + 1 > hi:
                if hi > 0:
                    yield sid, lo, hi
                lo = end - window + 1
            hi = end + 1
        if hi > 0:
            yield sid, lo, hi


def covers(segs: DataFrame, window: int, words: int = 100_000) -> DataFrame:
    """(sid, lo, hi): the recurring words of each segment, shard by shard. An automaton
    is compiled from whole anchors' segments with about ``words`` words."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[bytes, bytes, int]] = []
        size, at = 0, None

        def out():
            rows = list(zip(*locate(group, window))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()),
                                               pa.array(rows[2], pa.int64())], ["sid", "lo", "hi"])

        for batch in batches:
            for route, sid, seg, n in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[-1][0] == sid:
                    group[-1] = (sid, seg, group[-1][2] + n)
                    continue
                if route != at and size >= words:
                    yield out()
                    group, size = [], 0
                group.append((sid, seg, n))
                size, at = size + seg.count(b" ") + 1, route
        if group:
            yield out()

    dealt = segs.where("seg is not null").select("route", "sid", "seg", "n").repartition("route")
    return dealt.sortWithinPartitions("route", "sid").mapInArrow(shard, "sid binary, lo long, hi long")


def repeated_spans(texts: DataFrame, window: int = 35, anchor: int = 8, bits: int = 28, hot: int = 5000) -> DataFrame:
    """(key, spans): for texts (key, text) with repeated words, their spans of words as
    from * 2^32 + to. A text's spans are bounded by its length."""
    spark = texts.sparkSession
    counts = stored(anchor_counts(texts, window, anchor).where("n > 1"), "anchors")
    known = spark.sparkContext.broadcast(bitmap(counts, bits))
    crowded = spark.sparkContext.broadcast(bitmap(counts.where(F.col("n") >= hot), bits - 4))
    segs = stored(segments(texts, window, anchor, known, crowded), "segments")
    found = stored(covers(segs, window), "covers")
    span = F.shiftleft(F.col("pos") + F.col("lo"), 32) + F.col("pos") + F.col("hi")
    return segs.select("sid", "key", "pos").join(found, "sid").select("key", span.alias("span")).distinct().groupBy(
        "key").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, anchor: int = 8, bits: int = 28,
                   hot: int = 5000) -> DataFrame:
    """``docs`` with a struct column ``repeats``: n_words, n_removed, kept (the words left,
    joined by one space; null if nothing was removed) and kept_sha256 (of the words left,
    joined by one space, whether or not any was removed).

    A null text has no words. Texts shorter than a window keep every word. Repeated rows
    are copies: from a window's length up they lose all words. An empty table gives no
    rows. Other columns are kept as they are; one named ``repeats`` is replaced."""
    key = F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))
    on_path(docs.sparkSession)
    spans = repeated_spans(docs.select(key.alias("key"), F.col(text).alias("text")), window, anchor, bits, hot)

    @F.pandas_udf("n_words long, n_removed long, kept string, kept_sha256 string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans):
            words = t.encode().split() if t is not None else []
            n = len(words)
            kept = None
            if s is not None:
                s = np.asarray(s, np.int64)
                open_ = np.bincount(s >> 32, minlength=n + 1) - np.bincount(s & 0xFFFFFFFF, minlength=n + 1)
                left = (np.cumsum(open_)[:n] == 0).tolist()
                words = [w for w, x in zip(words, left) if x]
            joined = b" ".join(words)
            if s is not None:
                kept = joined.decode()
            rows.append((n, n - len(words), kept, hashlib.sha256(joined).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])

    k, at = unused(docs, "_key", "_spans")
    spans = spans.select(F.col("key").alias(k), F.col("spans").alias(at)).hint("shuffle_hash")
    joined = docs.withColumn(k, key).join(spans, k, "left")
    return joined.withColumn("repeats", keep(F.col(text), F.col(at))).drop(k, at)
