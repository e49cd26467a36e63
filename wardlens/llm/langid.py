"""Language identification as inference of a multilingual mixture.

Model: hashed counts of lower-cased letter trigrams (with word edges) per language over
all labelled training texts, additively smoothed. Its size is 2^17 numbers a language.

Inference: a text's units are its runs of letters (cut every 24 letters, for scripts
without spaces), each drawn from one of the text's languages. A unit's likelihood in a
language is the product of its trigrams' probabilities. Expectation-maximisation
estimates the proportions of a set of languages. The set grows from the likeliest single
language: the language whose share the likelihood asks for most is tried, and stays if
the log-likelihood rises by more than ``penalty`` * ln(units). The predicted language is
the one with the largest proportion; its score is that proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 17
UNIT = 24
_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of every letter, first letter of every unit, text of every unit)."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    c = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[c]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    c = np.where(letter, c, 32).astype(np.uint64)
    h = (c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F)
         + c[at + 1] * np.uint64(0x165667B19E3779F9))
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    first = np.flatnonzero(~letter[at - 1])  # of each run of letters
    length = np.diff([*first, len(at)])
    n = -(-length // UNIT)
    run = np.repeat(np.arange(len(first)), n)
    unit = first[run] + UNIT * (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    return h.astype(np.int64), unit, np.searchsorted(ends, at[unit] - 1, "right")


def _parts(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """Texts a few at a time, with their rows; nulls are left out."""
    rows, part, size = [], [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        rows.append(i)
        part.append(t)
        size += len(t)
        if size > most:
            yield rows, part
            rows, part, size = [], [], 0
    if part:
        yield rows, part


def gram_counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, gram, n) over all texts with a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = {x: i for i, x in enumerate(sorted(set(langs)))}
            got = [np.zeros(0, np.int64)]
            for rows, part in _parts(batch.column(0).to_pylist()):
                h, unit, doc = grams(part)
                code = np.array([names[langs[i]] for i in rows])
                own = np.repeat(code[doc], np.diff([*unit, len(h)])) if len(h) else h
                v, n = np.unique((own << BITS) | h, return_counts=True)
                got.append(np.stack([v, n]).ravel("F"))
            v, n = np.concatenate(got).reshape(-1, 2).T
            back = np.array(list(names), object)
            yield pa.RecordBatch.from_arrays([pa.array(back[v >> BITS], pa.string()), pa.array(v & ((1 << BITS) - 1)),
                                              pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select(text.alias("text"), lang.cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.1, most: int = 500) -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and log-probabilities (trigram bucket, language).

    The table is 2^17 numbers a language; more than ``most`` languages are refused, so
    what goes to the driver and to the tasks is bounded."""
    counts = gram_counts(docs, F.col(text), F.col(lang)).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    if len(names) > most:
        raise ValueError(f"{len(names)} languages; at most {most} can be learned")
    n = np.zeros((1 << BITS, len(names)))
    code = {x: i for i, x in enumerate(names)}
    n[counts["gram"].to_numpy(), [code[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    return names, np.log((n + smooth) / (n.sum(0) + smooth * (1 << BITS))).astype(np.float32)


def _em(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions after ``rounds``, and each text's log-likelihood (up to a constant)."""
    for _ in range(rounds):
        r = p * share[doc]
        r /= r.sum(1, keepdims=True) + 1e-300
        share = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((p * share[doc]).sum(1) + 1e-300), starts)


def infer(texts: list[str], table: np.ndarray, rounds: int = 12, penalty: float = 1.0) -> np.ndarray:
    """Proportions (text, language); all zero for a text without a letter."""
    out = np.zeros((len(texts), table.shape[1]))
    h, unit, doc = grams(texts)
    if not len(h) or not table.shape[1]:
        return out
    ll = np.add.reduceat(table[h], unit, axis=0).astype(np.float64)
    top = ll.max(1, keepdims=True)
    p = np.exp(np.maximum(ll - top, -300))
    own, starts = np.unique(doc, return_index=True)  # texts that have units
    n = np.diff([*starts, len(doc)]).astype(float)
    single = np.add.reduceat(ll - top, starts, axis=0)
    share = np.zeros_like(single)
    share[np.arange(len(own)), single.argmax(1)] = 1.0
    like = single.max(1)
    open_ = np.arange(len(own))
    for _ in range(table.shape[1] - 1):
        # units of the texts still growing
        take = np.concatenate([np.arange(starts[i], starts[i] + int(n[i])) for i in open_]) if len(open_) < len(own) else slice(None)
        q, m = p[take], n[open_]
        begin = np.concatenate([[0], np.cumsum(m)[:-1]]).astype(np.int64)
        d = np.repeat(np.arange(len(open_)), m.astype(np.int64))
        pull = np.add.reduceat(q / ((q * share[open_][d]).sum(1, keepdims=True) + 1e-300), begin, axis=0) / m[:, None]
        pull[share[open_] > 0] = 0
        new = pull.argmax(1)
        trial = 0.8 * share[open_]
        trial[np.arange(len(open_)), new] += 0.2
        trial, got = _em(q, d, begin, m, trial, rounds)
        better = (pull.max(1) > 1) & (got - like[open_] > penalty * np.log(m + 1))
        share[open_[better]], like[open_[better]] = trial[better], got[better]
        open_ = open_[better]
        if not len(open_):
            break
    out[own] = share
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, and the mixture as languages
    (largest proportion first) and shares.

    A null text, a text without a letter, and every text if nothing was learned get
    ``und`` with score 0 and an empty mixture; ties go to the first language in order;
    null ids are allowed; repeated rows are judged alike; an empty table gives no rows.
    Other columns are not read."""
    names = model[0]
    kind = docs.schema[id_col].dataType.simpleString()
    learned = docs.sparkSession.sparkContext.broadcast(model[1])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            langs, shares = [[] for _ in best], [[] for _ in best]
            for rows, part in _parts(batch.column(1).to_pylist()):
                for i, share in zip(rows, infer(part, learned.value)):
                    if share.any():
                        order = [j for j in np.argsort(-share, kind="stable").tolist() if share[j] > 0]
                        langs[i], shares[i] = [names[j] for j in order], [min(1.0, float(share[j])) for j in order]
                        best[i], score[i] = langs[i][0], shares[i][0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(score), pa.array(langs, pa.list_(pa.string())),
                 pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "shares"])

    schema = f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, schema)
