"""Toxicity by a convolutional text classifier.

Words are hashed to rows of an embedding table, each whole and by its beginnings
of some bytes, and the rows added up; filters over one, two and three
neighbouring words, the maximum of each over the whole text and a logistic
unit give the score. The table has rows for all hashes that the training texts
hold often enough, and a zero row for others. Everything is trained here, in
numpy, on a bounded sample of labelled rows (``MOST_POSITIVE``,
``MOST_NEGATIVE``, texts of ``MOST_CHARS`` at most): their hashed words are all
that reaches the driver. Training goes on until rows kept out of the fit say
that it doesn't help.

Thresholds are calibrated by language on rows kept out of the fit. The language
is guessed from the text's own function words, and each score is shifted so
that its language's threshold lies at 0.5: neither labels nor any column but
the text enter a score.

For scoring, embedding times filter is tabulated once, so a word costs a few
table rows; texts are scored whole, whatever their length.

Defined cases: a null or empty text is scored as one without known words; rows
are scored one by one, so repeated rows have equal scores; conflicting labels
of one id count as toxic; without labels of both kinds every score is 0; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import bytehash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_POSITIVE, MOST_NEGATIVE, MOST_CHARS = 3000, 4000, 60_000
HASH_BITS, SEEN = 22, 3
BEGINNINGS = (5, 7)  # bytes of a word that are hashed besides the whole of it
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 8
EPOCHS, PATIENCE, BATCH, RATE = 4, 2, 48, 0.05

#: Function words by which a language is guessed: fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with are this be on it",
    "de": "der die das und ist nicht mit von den auch ein eine für auf sich",
    "fr": "le la les des et est une dans que qui pour pas du un sur",
    "es": "el los las una que por para con del se como más pero en y",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def hashed_words(texts: bytehash.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and of their beginnings: words x kinds, where each text's begin)."""
    texts = texts.lower_ascii()
    start, end, first = texts.words(_APART)
    prefix, kinds = bytehash.Prefix(texts.data), []
    for k, size in enumerate((None, *BEGINNINGS)):
        hashes = prefix.hash(start, end if size is None else np.minimum(end, start + size))
        kinds.append((bytehash.mix(hashes + np.uint64(k)) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.stack(kinds, axis=1), first


def _hash_of(words: list[str]) -> np.ndarray:
    _, _, texts = next(bytehash.texts_of(pa.array([" ".join(words)])))
    return hashed_words(texts)[0][:, 0]


@dataclass
class Model:
    row_of: np.ndarray  # table row by word hash; row 0 is zero
    tables: list[list[np.ndarray]]  # by width and offset: rows x filters
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    shift: np.ndarray  # logit of the threshold, by language

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The logit of each text before calibration."""
        return np.maximum(_pooled(self.tables, self.bias, *_padded(self.row_of[ids], first)), 0).reshape(len(first) - 1, -1) @ self.out + self.base


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero rows after each, so that every text has a window of every width and none crosses a border."""
    pad = max(WIDTHS)
    length = np.diff(first)
    starts = first + pad * np.arange(len(first))
    out = np.zeros((starts[-1], rows.shape[1]), rows.dtype)
    out[np.arange(len(rows)) + np.repeat(pad * np.arange(len(length)), length)] = rows
    return out, starts


def _pooled(tables: list[list[np.ndarray]], bias: list[np.ndarray], rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x widths x filters: the maximum of every filter over every text."""
    found = np.empty((len(starts) - 1, len(WIDTHS), FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        n = len(rows) - width + 1
        total = np.zeros((n, FILTERS), np.float32)
        for offset in range(width):
            for kind in range(rows.shape[1]):
                total += tables[k][offset][rows[offset : offset + n, kind]]
        # A window that begins in the last padding reaches into the next text.
        for j in range(1, width):
            total[starts[1:-1] - j] = -np.inf
        found[:, k] = np.maximum.reduceat(total, starts[:-1], axis=0) + bias[k]
    return found


def languages(ids: np.ndarray, first: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The language whose function words a text has most of; the last if it has none."""
    counts = np.stack([np.concatenate([[0], np.cumsum(np.isin(ids[:, 0], w))])[first] for w in words])
    counts = np.diff(counts, axis=1)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(words))


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model | None:
    """Fit on hashed texts; every fifth calibrates the thresholds. None without both kinds."""
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    counted = lambda kind: np.bincount(  # noqa: E731  in how many texts each hash is
        np.concatenate([np.zeros(0, np.int32), *[np.unique(texts[i]) for i in np.flatnonzero(~aside & (toxic == kind))]]), minlength=1 << HASH_BITS
    )
    bad, good = counted(True), counted(False)
    seen = bad + good
    common = np.flatnonzero(seen >= SEEN)
    row_of = np.zeros(1 << HASH_BITS, np.int32)
    row_of[common] = np.arange(1, len(common) + 1)
    rows = [row_of[t] for t in texts]

    # The first of an embedding's numbers begins as what counts say of its word, which half of the filters look at;
    # from random numbers alone, maxima hardly ever fall on the few telling words.
    table = rng.normal(0, 0.1, (len(common) + 1, SIZE)).astype(np.float32)
    table[:, 0] = np.concatenate([[0], _telling(bad[common], good[common], toxic[~aside])])
    table[0] = 0
    filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, base = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.float32(0)
    past = [np.full_like(p, 1e-2) for p in (table, *filters, *bias, out)]
    fit = np.flatnonzero(~aside)
    weight = np.where(toxic, 0.5 / max(toxic[fit].mean(), 1e-6), 0.5 / max(1 - toxic[fit].mean(), 1e-6))
    tables = lambda: [[table @ f[o] for o in range(w)] for f, w in zip(filters, WIDTHS, strict=True)]

    words = [_hash_of(w.split()) for w in FUNCTION_WORDS.values()]
    kept = np.flatnonzero(aside)
    first_kept = np.cumsum([0, *[len(texts[i]) for i in kept]])
    flat_kept = np.concatenate([np.zeros((0, 1 + len(BEGINNINGS)), np.int32), *[texts[i] for i in kept]])
    model, best_loss, waited = None, np.inf, 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            flat, starts = _padded(np.concatenate([rows[i] for i in batch]), np.cumsum([0, *[len(rows[i]) for i in batch]]))
            x = table[flat].sum(axis=1)
            conv = []
            for f, w in zip(filters, WIDTHS, strict=True):
                n = len(flat) - w + 1
                conv.append(sum(x[o : o + n] @ f[o] for o in range(w)))
            best = np.stack([[c[a : z - w + 1].argmax(axis=0) + a for a, z in zip(starts[:-1], starts[1:])] for c, w in zip(conv, WIDTHS, strict=True)], 1)
            top = np.stack([np.take_along_axis(c, best[:, k], 0) + b for k, (c, b) in enumerate(zip(conv, bias, strict=True))], 1)
            hidden = np.maximum(top, 0).reshape(len(batch), -1)
            p = 1 / (1 + np.exp(-(hidden @ out + base)))
            error = ((p - toxic[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g_out = hidden.T @ error + 1e-5 * out
            g_top = (error[:, None] * out).reshape(top.shape) * (top > 0)
            g_table, g_filters, g_bias = {}, [np.zeros_like(f) for f in filters], [g_top[:, k].sum(axis=0) for k in range(len(WIDTHS))]
            touched, pushed = [], []
            for k, w in enumerate(WIDTHS):
                for o in range(w):
                    places = best[:, k] + o
                    g_filters[k][o] = np.einsum("bfs,bf->sf", x[places], g_top[:, k])
                    touched.append(flat[places].reshape(-1))  # a word's rows get the same
                    pushed.append(np.repeat((g_top[:, k][:, :, None] * filters[k][o].T[None]).reshape(-1, SIZE), flat.shape[1], axis=0))
            touched, pushed = np.concatenate(touched), np.concatenate(pushed)
            ids, inverse = np.unique(touched, return_inverse=True)
            g = np.zeros((len(ids), SIZE), np.float32)
            np.add.at(g, inverse, pushed)
            past[0][ids] += g * g
            table[ids] -= RATE * g / np.sqrt(past[0][ids])
            table[0] = 0
            for p_, q, g_ in zip((*filters, *bias, out), past[1:], (*g_filters, *g_bias, g_out), strict=True):
                q += g_ * g_
                p_ -= RATE * g_ / np.sqrt(q)
            base -= np.float32(RATE) * error.sum()

        now = Model(row_of, tables(), [b.copy() for b in bias], out.copy(), float(base), np.zeros(len(LANGUAGES), np.float32))
        loss = _balanced_loss(now.raw(flat_kept, first_kept), toxic[kept])
        if loss < best_loss:
            best_loss, model, waited = loss, now, 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    model.shift = _thresholds(model.raw(flat_kept, first_kept), toxic[kept].astype(bool), languages(flat_kept, first_kept, words))
    return model


def _telling(bad: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How surely a word speaks for toxic texts: its log odds less their standard error, nothing below zero."""
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    return (0.3 * np.maximum(odds - np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)), 0)).astype(np.float32)


def _balanced_loss(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Cross entropy, both kinds weighing alike."""
    each = np.logaddexp(0, np.where(toxic, -logit, logit))
    return sum(float(each[k].mean()) for k in (toxic.astype(bool), ~toxic.astype(bool)) if k.any())


def _thresholds(logit: np.ndarray, toxic: np.ndarray, language: np.ndarray) -> np.ndarray:
    """By language the logit that separates best, drawn towards that of all texts where there are few."""

    def best(x: np.ndarray, y: np.ndarray) -> float:
        if not y.any() or y.all():
            return 0.0
        order = np.argsort(x)
        x, y = x[order], y[order]
        # Errors of both kinds, as shares, when the cut lies before each text.
        missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()
        false = 1 - np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
        k = np.flatnonzero(np.isclose(missed + false, (missed + false).min()))
        k = int(k[len(k) // 2])
        low, high = x[max(k - 1, 0)], x[min(k, len(x) - 1)]
        return float(low + (high - low) / 4)  # a gap between both kinds belongs rather to toxic texts, of which there are fewer

    overall = best(logit, toxic)
    found = np.full(len(LANGUAGES), overall, np.float32)
    for k in range(len(LANGUAGES)):
        own = language == k
        n = min(int(toxic[own].sum()), int((~toxic[own]).sum())) if own.any() else 0
        if n:
            found[k] = (n * best(logit[own], toxic[own]) + 10 * overall) / (n + 10)
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample_words(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed words and labels of the training sample: rows outside the held-out fold, of either kind, in order of a hash."""
    labels = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = None
    for kind, most in ((F.col("toxic"), MOST_POSITIVE), (~F.col("toxic"), MOST_NEGATIVE)):
        part = labels.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in bytehash.texts_of(batch.column(2)):
                ids, first = hashed_words(texts)
                words = [ids[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(words, pa.binary())], names=["doc_id", "toxic", "words"]
                )

    texts = docs.select("doc_id", "text").filter(F.length("text") <= MOST_CHARS)
    joined = texts.join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    # One text of each id, so that no more rows than chosen ids reach the driver, however often an id is repeated.
    one = joined.mapInArrow(run, "doc_id long, toxic boolean, words binary").groupBy("doc_id", "toxic").agg(F.min_by("words", F.xxhash64("words")).alias("words"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [np.frombuffer(r["words"], np.int32).reshape(-1, 1 + len(BEGINNINGS)) for r in rows], np.array([r["toxic"] for r in rows], bool)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    words = [_hash_of(w.split()) for w in FUNCTION_WORDS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, z, texts in bytehash.texts_of(batch.column(1)):
                if model is None:
                    p = np.zeros(z - a)
                else:
                    ids, first = hashed_words(texts)
                    x = model.raw(ids, first) - model.shift[languages(ids, first, words)]
                    p = 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -60, 60)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(*sample_words(docs, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
