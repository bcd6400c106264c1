"""Language identification by unigram models over the pieces of a fixed vocabulary, all segmentations summed.

A text is cut into runs of letters and marks, in lower case, each with a blank
before it. For every language a unigram model gives each piece of a public
vocabulary a probability, and a word's probability is the sum over all its
segmentations into pieces, by the forward algorithm. A text's language is the
one of the highest posterior: the share of the language's training rows times
the probabilities of its words.

The piece probabilities are fitted by expectation maximisation. The words of
the training sample are counted per language in Spark; each round runs forward
and backward over these words where they lie and sums expected piece counts.
What reaches the driver is one number per language and piece.

Training rows have a language and are not held out (``held_out``). At most
about ``SAMPLE_ROWS`` of each language are used, chosen by a hash of the row;
languages with fewer rows give all. Scoring reads every word of every text: the
distinct words of a batch are scored once, then summed per text.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as
does every text when nothing can be learnt; repeated rows each get their own
row; a null id is held out; an empty table gives an empty result; columns other
than id, text and language are not read.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import bytehash
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 2000  # training rows of a language, about
ROUNDS = 3  # of expectation maximisation, from equal probabilities
SMOOTHING = 0.1  # added to every piece's expected count
UNKNOWN = "und"
_CACHED = 200_000  # words whose scores a worker remembers
_AT_ONCE = 20_000  # words whose lattice is built at one time
_NOT_IN_WORDS = r"[^\p{L}\p{M}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def held_out(id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: the checksum of the id as text is divisible by five."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Pieces:
    """Finds the pieces of a vocabulary in many words at once, by hashes per length."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            pieces = sorted({base64.b64decode(line.split()[0]) for line in lines if line.strip()} | {bytes([b]) for b in range(256)})
        self.size = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            joined = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * length
            hashes = bytehash.Prefix(joined).hash(at, at + length)
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], ids[order]


class Lattice:
    """All pieces at all places of some words.

    Places are numbered through: a word of n bytes has n + 1. ``edges`` lead
    from place ``source`` to ``target`` by ``piece``; they are sorted by the
    target's distance from its word's start, which makes ``levels``.
    """

    def __init__(self, words: list[bytes], pieces: Pieces):
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        left = starts[word + 1] - np.arange(len(data))  # bytes from here to the word's end
        prefix = bytehash.Prefix(data)
        found = []
        for length, (hashes, ids) in pieces.by_length.items():
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            keys = prefix.hash(at, at + length)
            place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            hit = hashes[place] == keys
            found.append((at[hit], np.full(hit.sum(), length), ids[place[hit]]))
        at, length, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        level = at - starts[word[at]] + length
        order = np.lexsort((at, word[at], level))
        at, length, self.piece, level = at[order], length[order], piece[order], level[order]
        self.word = word[at]
        self.source = at + self.word
        self.target = self.source + length
        self.first = starts[:-1] + np.arange(len(words))
        self.last = starts[1:] + np.arange(len(words))
        self.places = len(data) + len(words)
        self.levels = np.searchsorted(level, np.arange(1, sizes.max(initial=0) + 2))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """By place and language: the log of the summed probability of all ways there. ``log_p``: piece x language."""
        alpha = np.zeros((self.places, log_p.shape[1]))
        for a, z in zip(self.levels, self.levels[1:]):
            if a == z:
                continue
            ways = alpha[self.source[a:z]] + log_p[self.piece[a:z]]
            target = self.target[a:z]
            cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            alpha[target[cut]] = _log_sums(ways, cut)
        return alpha

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        """The same from each place to the word's end."""
        beta = np.zeros((self.places, log_p.shape[1]))
        left = np.repeat(self.last, self.last - self.first + 1)[self.source] - self.source if len(self.source) else self.source
        order = np.lexsort((self.target, self.source, left))
        left = left[order]
        levels = np.searchsorted(left, np.arange(1, left.max(initial=0) + 2))
        for a, z in zip(levels, levels[1:]):
            if a == z:
                continue
            edges = order[a:z]
            ways = beta[self.target[edges]] + log_p[self.piece[edges]]
            source = self.source[edges]
            cut = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
            beta[source[cut]] = _log_sums(ways, cut)
        return beta

    def scores(self, log_p: np.ndarray) -> np.ndarray:
        """Word x language: log probability of the word."""
        return self.forward(log_p)[self.last]

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By piece: how often it is expected in words that come ``times`` often, by a model of one language."""
        alpha, beta = self.forward(log_p)[:, 0], self.backward(log_p)[:, 0]
        log_share = alpha[self.source] + log_p[self.piece, 0] + beta[self.target] - alpha[self.last][self.word]
        return np.bincount(self.piece, np.exp(log_share) * times[self.word], len(log_p))


def _log_sums(ways: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of the rows from each cut to the next."""
    most = np.maximum.reduceat(ways, cut)
    sizes = np.diff(np.append(cut, len(ways)))
    return most + np.log(np.add.reduceat(np.exp(ways - np.repeat(most, sizes, axis=0)), cut))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts, encoded by their distinct values; where each text's words end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.utf8_lower(pc.replace_substring_regex(texts.fill_null("").cast(pa.large_string()), _NOT_IN_WORDS, " "))
    parts = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return pc.list_flatten(parts).dictionary_encode(), ends


def _slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with some megabytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(sizes):
        base = sizes[row - 1] if row else 0
        end = max(int(np.searchsorted(sizes, base + most, "right")), row + 1)
        yield batch.slice(row, end - row)
        row = end


def _chunks(words: list[bytes]) -> Iterator[tuple[int, int]]:
    for a in range(0, len(words), _AT_ONCE):
        yield a, min(a + _AT_ONCE, len(words))


def count_words(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                words, ends = words_of(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                n_words = max(len(words.dictionary), 1)
                of_row = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
                pair, n = np.unique(of_row.astype(np.int64) * n_words + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                columns = [langs.dictionary.take(pa.array(pair // n_words)), words.dictionary.take(pa.array(pair % n_words)).cast(pa.string()), pa.array(n)]
                found = pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
                yield found.filter(pc.not_equal(found.column("word"), ""))

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """languages, their log shares, and log_p: piece x language."""

    def __init__(self, languages: list[str], log_share: np.ndarray, log_p: np.ndarray):
        self.languages, self.log_share, self.log_p = languages, log_share, log_p


def _smoothed(counts: np.ndarray) -> np.ndarray:
    return np.round(np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)), 6)


def train(rows: DataFrame, pieces: Pieces, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the rows (id, lang, text) to learn from; None without any."""
    spark = rows.sparkSession
    rows = rows.filter("lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    scale = 1 << 20
    most = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, -(-scale * sample_rows // n))))
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < most[F.col("lang")]
    words = materialize(count_words(rows.filter(drawn)), "language-words")
    languages = sorted(counts)
    place = {lang: i for i, lang in enumerate(languages)}
    log_p = np.full((pieces.size, len(languages)), -np.log(pieces.size))
    known = spark.sparkContext.broadcast(pieces)  # a vocabulary file
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(log_p)  # one number per piece and language

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    mine = batch.filter(pa.array(langs == lang))
                    words = [b" " + w.encode() for w in mine.column("word").to_pylist()]
                    times = mine.column("n").to_numpy()
                    p = current.value[:, [place[lang]]]
                    for a, z in _chunks(words):
                        more = Lattice(words[a:z], known.value).expected(p, times[a:z])
                        found[lang] = found.get(lang, 0) + more
            for lang, counts in found.items():
                at = np.flatnonzero(counts)
                columns = [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "n"])

        expected = words.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        summed = np.zeros_like(log_p)
        for r in expected.toLocalIterator():  # at most one row per language and piece
            summed[r["piece"], place[r["lang"]]] = r["n"]
        log_p = _smoothed(summed)
    n = np.array([counts[lang] for lang in languages], float)
    return Model(languages, np.log(n / n.sum()), log_p)


def predict(docs: DataFrame, model: Model | None, pieces: Pieces, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of the predicted language."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((model, pieces))  # sized by vocabulary and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = shared.value
        row: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages)))
        for batch in batches:
            for part in _slices(batch, text):
                words, ends = words_of(part.column(text))
                distinct = words.dictionary.to_pylist()
                if len(row) > _CACHED:
                    row, scores = {}, scores[:0]
                new = [w for w in distinct if w and w not in row]
                row.update(zip(new, range(len(row), len(row) + len(new))))
                encoded = [b" " + w.encode() for w in new]
                scores = np.concatenate([scores, *(Lattice(encoded[a:z], pieces).scores(model.log_p) for a, z in _chunks(encoded))])
                by_word = np.array([row.get(w, -1) for w in distinct], np.int64)
                at = by_word[words.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0))
                doc, at = doc[at >= 0], at[at >= 0]
                logs = np.stack([np.bincount(doc, scores[at, k], part.num_rows) for k in range(len(model.languages))], axis=1)
                logs += model.log_share
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs[np.arange(len(best)), best][:, None]).sum(axis=1)
                lettered = pc.match_substring_regex(part.column(text), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                named = pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], pa.string())
                score = pa.array(np.where(lettered, np.round(np.clip(share, 0, 1), 6), 0.0))
                yield pa.RecordBatch.from_arrays([*part.columns, named, score], names=[*part.schema.names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, rank_file: str | None = None, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score: learnt from the rows not held out, predicted for all."""
    pieces = Pieces(rank_file or default_vocabulary())
    learn = docs.filter(~held_out(id)).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    found = predict(rows, train(learn, pieces), pieces)
    return found.select(F.col("id").alias(id), "held_out", "lang_pred", "score")
