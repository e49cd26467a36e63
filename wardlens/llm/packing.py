"""Packing token sequences by a configuration linear program.

Texts become token ids, an end id, and pieces of at most ``cap`` tokens. How many pieces
have each length is a histogram of at most ``cap`` numbers, whatever the table's size;
only it goes to the driver, which makes the plan:

1. Pieces longer than ``cap / 16`` fall into classes of ``width`` tokens. A
   configuration says how many pieces of each class share a sequence. The linear
   program (fewest sequences such that every class is covered) is solved by
   multiplicative weights: a class's price falls exponentially with the share of it
   that is covered, and knapsack dynamic programming over the prices finds the next
   configuration to raise.
2. The solution is rounded down, then the largest fractions up while pieces are left,
   and classes are filled with their exact lengths.
3. What is left, with the short pieces, goes best-fit decreasing into the gaps, many
   equal pieces and sequences at a time.

The plan says, for each length, which of its pieces go where: arrays whose size follows
the histogram and the number of program rounds. It is broadcast; pieces are numbered
within their length in parallel and look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import LOWER, numbered, stored


class WordIds:
    """Token ids of words, as bytes of little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space: a text's ids are its words' ids in a row. New
    words are encoded many at a time, parted by a separator that is a token of its own.
    Where the tokenizer lower-cases, A-Z are lower-cased first (but not in texts that
    could hold a special token's name), and where it parts a letter from a mark after it,
    a word that ends so takes the ids of its two parts. Two generations of at most
    ``limit`` words are kept, so memory is bounded and frequent words stay."""

    SEPARATOR = "~"
    MARKS = ".,!?;:"

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.new, self.old = limit, {}, {}
        upper = "".join(map(chr, range(65, 91)))
        mark = self.encode(self.SEPARATOR)
        self.sep = int(mark[0]) if len(mark) == 1 else None
        self.lower = self.encode(upper).tolist() == self.encode(upper.lower()).tolist()
        self.marks = {m.encode()[0] for m in self.MARKS if all(
            self.encode(w + m).tolist() == [*self.encode(w), *self.encode(m)] for w in ("the", "aztq", upper.lower()))}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, text: bytes | str | None) -> list[bytes]:
        raw = text if isinstance(text, bytes) else (text or "").encode()
        if self.lower and b"<" not in raw:
            raw = raw.translate(LOWER)
        return raw.split()

    def learn(self, words: set[bytes]) -> None:
        """Make sure that ``new`` has all of ``words``."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old, marks = self.new, self.old, self.marks
        todo, parted = set(), []
        for w in words.difference(new):
            got = old.get(w)
            if got is not None:
                new[w] = got
            elif len(w) > 1 and w[-1] in marks and 97 <= w[-2] <= 122:
                parted.append(w)
            else:
                todo.add(w)
        for w in parted:
            for x in (w[:-1], w[-1:]):
                if x not in new:
                    got = old.get(x)
                    if got is None:
                        todo.add(x)
                    else:
                        new[x] = got
        sep = self.SEPARATOR.encode()
        alone = [w for w in todo if self.sep is None or sep in w]
        rest = [w for w in todo if self.sep is not None and sep not in w]
        for w in alone:
            new[w] = self.encode(w.decode()).tobytes()
        for lo in range(0, len(rest), 10_000):
            part = rest[lo:lo + 10_000]
            ids = self.encode((b" " + sep + b" ").join(part).decode())
            cut = np.flatnonzero(ids == self.sep).tolist()
            raw = ids.tobytes()
            for w, a, b in zip(part, [-1, *cut], [*cut, len(ids)], strict=True):
                new[w] = raw[4 * a + 4:4 * b]
        for w in parted:
            new[w] = new[w[:-1]] + new[w[-1:]]

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.new.__getitem__, words))


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", cap: int = 4096,
           end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                split = [known.words(t) for t in part.column(1).to_pylist()]
                known.learn(set().union(*split))
                row, rest = [], []
                for i, words in enumerate(split):
                    raw = known.ids(words) + end
                    for k, at in enumerate(range(0, len(raw), 4 * cap)):
                        p = raw[at:at + 4 * cap]
                        row.append(i)
                        rest.append((k, at // 4, len(p) // 4, zlib.crc32(p), *([p] if with_ids else [])))
                cols = list(zip(*rest))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                    ["doc_id", *names[:len(cols)]])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(cut, schema)


def configurations(sizes: np.ndarray, demand: np.ndarray, units: int, rounds: int = 1500, eps: float = 0.2) -> dict[tuple, float]:
    """Configuration (count of each size) -> how often, covering ``demand``; ``sizes``
    ascending, in units of which a sequence has ``units``."""
    eta = np.log(len(sizes) + 1) / eps
    had = np.zeros(len(sizes))
    use: dict[tuple, float] = {}
    upto = np.searchsorted(sizes, np.arange(units + 1), "right")
    for _ in range(rounds):
        if had.min() >= 1:
            break
        price = np.exp(-eta * np.minimum(had - had.min(), 50 / eta)) / demand
        best, pick = np.zeros(units + 1), np.full(units + 1, -1)
        for w in range(1, units + 1):
            best[w] = best[w - 1]
            if k := upto[w]:
                c = price[:k] + best[w - sizes[:k]]
                j = int(c.argmax())
                if c[j] > best[w]:
                    best[w], pick[w] = c[j], j
        count, w = np.zeros(len(sizes), np.int64), units
        while w > 0:
            if pick[w] >= 0:
                count[pick[w]] += 1
                w -= sizes[pick[w]]
            else:
                w -= 1
        on = count > 0
        step = eps * float((demand[on] / count[on]).min())
        had[on] += step * count[on] / demand[on]
        key = tuple(count.tolist())
        use[key] = use.get(key, 0.0) + step
    return use


def plan(histogram: dict[int, int], cap: int, width: int = 32) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), holding every piece."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if cap in left:
        out.append(((cap,), left.pop(cap)))
    units, short = max(1, cap // width), cap // 16
    classes: dict[int, list[int]] = {}
    for n in sorted((n for n in left if n > short and -(-n // width) <= units), reverse=True):
        classes.setdefault(-(-n // width), []).append(n)
    if classes:
        sizes = np.array(sorted(classes))
        have = np.array([sum(left[n] for n in classes[s]) for s in sizes.tolist()])
        use = configurations(sizes, have.astype(float), units)
        exact = [[[n, left[n]] for n in classes[s]] for s in sizes.tolist()]
        turns = [(c, int(use[c])) for c in sorted(use, key=lambda c: (-use[c], c))]
        turns += [(c, 1) for c in sorted(use, key=lambda c: (int(use[c]) - use[c], c))]
        for c, whole in turns:
            on = [(k, a) for k, a in enumerate(c) if a]
            times = min([whole, *[int(have[k]) // a for k, a in on]])
            while times > 0:
                even = min([times, *[exact[k][0][1] // a for k, a in on]])
                lengths: list[int] = []
                for k, a in on:
                    need = a * max(even, 1)
                    have[k] -= need
                    while need:
                        n, c_n = exact[k][0]
                        took = min(need, c_n)
                        lengths += [n] * (took // max(even, 1))
                        left[n] -= took
                        need -= took
                        exact[k][0][1] -= took
                        if not exact[k][0][1]:
                            exact[k].pop(0)
                out.append((tuple(sorted(lengths, reverse=True)), max(even, 1)))
                times -= max(even, 1)
    # best-fit decreasing into the gaps, by groups of equal sequences
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    count = np.zeros(cap + 1, np.int64)

    def put(lengths: tuple[int, ...], n: int, gap: int) -> None:
        gaps.setdefault(gap, []).append((lengths, n))
        count[gap] += n

    for lengths, n in out:
        put(lengths, n, cap - sum(lengths))
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        c = left[n]
        while c:
            fit = int(np.argmax(count[n:] > 0)) + n
            if count[fit]:
                lengths, m = gaps[fit].pop()
                count[fit] -= m
            else:
                lengths, m, fit = (), c, cap
            each = min(fit // n, c)
            now = min(m, c // each)
            if m > now and lengths:
                put(lengths, m - now, fit)
            put(lengths + (n,) * each, now, fit - each * n)
            c -= now * each
    return [x for g in sorted(gaps) for x in gaps[g]]


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first piece number, pieces in a sequence, first sequence,
    offset in the sequence): piece k of a row is in sequence (k - first) // pieces."""
    seq, used, rows = 0, {}, {}
    for lengths, n in groups:
        at = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            rows.setdefault(x, []).append((used.get(x, 0), each, seq, at))
            used[x] = used.get(x, 0) + n * each
            at += each * x
        seq += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", cap: int = 4096, end_id: int = 1,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and the piece's token ids).

    A null or empty text is the end id alone. Only texts above ``cap`` tokens are cut.
    Repeated rows are packed one by one; null ids are allowed; an empty table gives no
    rows. Columns other than the two named are not read."""
    p = stored(pieces(docs, tokenizer, id_col, text, cap, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}  # cap rows at most
    where = p.sparkSession.sparkContext.broadcast(places(plan(histogram, cap)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"sequence_id": np.zeros(len(k), np.int64), "offset": np.zeros(len(k), np.int64)})
        ks = k.to_numpy()
        for x, at in pd.Series(np.arange(len(k))).groupby(length.to_numpy()):
            rows, i = where.value[x], ks[at.to_numpy()]
            r = rows[np.searchsorted(rows[:, 0], i, "right") - 1]
            turn, slot = np.divmod(i - r[:, 0], r[:, 1])
            out.iloc[at.to_numpy(), 0] = r[:, 2] + turn
            out.iloc[at.to_numpy(), 1] = r[:, 3] + slot * x
        return out

    n = numbered(p, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_k", 256)
    n = n.withColumn("_place", place("length", "_k"))
    ids = [F.col("ids")] if with_ids else []
    return n.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *ids)
