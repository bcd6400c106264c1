"""Exact histogram of encoded lengths, and what it answers for every context limit.

Texts are encoded where they are read; only their length leaves the task, and
equal lengths are combined there. Totals, quantiles and what a context limit
would cut off then come from suffix sums over the histogram, whose size is that
of the set of distinct lengths. The sums run in chunks of neighbouring lengths
(``running_total``), so that no task orders the whole histogram.

Defined cases: a null or empty text has no tokens and counts as a document of
length 0; repeated rows count each; an empty table gives an empty histogram.
Other columns are not read.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import running_total
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CACHED = 400_000  # words whose length a worker remembers
_CHUNK = 256  # lengths summed in one window


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that splits texts into words."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def token_lengths(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens): one row per row of ``docs``."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)  # a model file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        encoder = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})

        class Lengths(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= _CACHED:
                    self.clear()
                self[word] = n = len(encoder.encode_ordinary(word))
                return n

        find, length = regex.compile(pattern).findall, Lengths()
        for batch in batches:
            counts = [sum(map(length.__getitem__, find(t))) if (t := value.as_py()) else 0 for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(text).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)"""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def by_limit(counts: DataFrame) -> DataFrame:
    """One row per length L of the written histogram, read as a context limit.

    n_docs of that length, docs_longer and tokens_longer beyond it,
    truncated_tokens = sum of min(length, L), lost_tokens, and quantile: the
    share of documents that fit. Between two lengths truncated_tokens grows by
    docs_longer for each token of the limit.
    """
    rows = counts.withColumn("_all", F.lit(0))
    tokens = F.col("n_tokens") * F.col("n_docs")
    # Suffix sums: lengths in descending order, chunks of them numbered from the longest.
    chunk = -F.floor(F.col("n_tokens") / _CHUNK)
    order = [F.col("n_tokens").desc()]
    rows = running_total(rows, ["_all"], chunk, order, "docs_from", F.col("n_docs"))
    rows = running_total(rows, ["_all"], chunk, order, "tokens_from", tokens)
    totals = counts.agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    docs, total = totals.select("docs").scalar(), totals.select("tokens").scalar()
    longer, tokens_longer = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - tokens
    truncated = total - tokens_longer + longer * F.col("n_tokens")
    return rows.select(
        "n_tokens", "n_docs", longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"),
        truncated.alias("truncated_tokens"), (total - truncated).alias("lost_tokens"), ((docs - longer) / docs).alias("quantile"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """(truncated_tokens) for any limit, from the rows of ``by_limit``: the next longer length, taken back."""
    at = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "truncated_tokens", "docs_longer", "n_docs")))
    beyond = limits.agg(at.alias("a"), F.max("truncated_tokens").alias("all"))
    back = F.col("a.truncated_tokens") - (F.col("a.n_tokens") - limit) * (F.col("a.docs_longer") + F.col("a.n_docs"))
    return beyond.select(F.coalesce(back, F.col("all"), F.lit(0)).alias("truncated_tokens"))


def length_quantile(limits: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    return limits.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def digest(docs: DataFrame) -> DataFrame:
    counts = materialize(histogram(token_lengths(docs, *default_vocabulary())), "token-histogram")
    return by_limit(counts)
