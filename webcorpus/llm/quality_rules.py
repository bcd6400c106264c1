"""Quality rules judged per document and per host.

A document fails for itself when it is short or repeats itself. What it and
its neighbours break is also summed by host: the share of rule-breaking
documents of a host is shrunk towards that of all hosts with a beta prior
estimated from the hosts themselves, and documents of a host whose shrunk
share passes a limit go with it. A host with few documents thus needs far more
evidence than one with thousands.

Everything is column functions. The only thing that moves between tasks is one
partial count per host and task, and the host's verdict back to narrow rows.

Defined cases: a null or blank text has no words and fails; a null source
counts as the empty one; rows are judged one by one, so repeated ids or rows change
nothing; an empty table gives an empty result. Columns of the input with the
names used here are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import with_once
from ..session import materialize

_GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\x0c\r"

MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of words in windows that occur twice
MAX_SYMBOLS = 10  # per cent of words
MAX_DUPLICATE_LINES = 30  # per cent of lines
HOST_LIMIT = 0.5


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array when there are none."""
    trimmed = F.btrim(text, F.lit(_GAP_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))


def _covered(windows: Column, size: int) -> tuple[Column, Column, Column]:
    """Three steps, each over the one before: windows in order, starts of those that recur, words that these cover."""
    ordered = F.array_sort(F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.array_sort(
        F.filter(
            F.transform(
                F.col("_ordered"),
                lambda x, i: F.when(
                    (x["h"] == F.get("_ordered", i - 1)["h"]) | (x["h"] == F.get("_ordered", i + 1)["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
    )
    gaps = F.zip_with(
        F.slice("_starts", 2, F.size("_starts")),
        F.slice("_starts", 1, F.size("_starts") - 1),
        lambda after, before: F.least(after - before, F.lit(size)),
    )
    total = F.aggregate(gaps, F.lit(size), lambda a, g: a + g)
    return ordered, starts, total


def document_features(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", size: int = 5) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, broken (any rule), base_failed."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = with_once(base, _words=words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = with_once(
        base,
        _hashes=F.transform("_words", lambda w: F.xxhash64(w)),
        _lines=lines,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
    )
    base = with_once(
        base.drop("_text", "_words"),
        _windows=F.transform(
            F.when(F.col("n_words") >= size, F.sequence(F.lit(0), F.col("n_words").cast("int") - size)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(size)]),
        ),
    )
    ordered, starts, total = _covered(F.col("_windows"), size)
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))  # most texts repeat nothing and need no order
    nothing = F.array().cast("array<int>")
    base = with_once(
        base,
        _ordered=F.when(repeats, ordered),
        _n_lines=F.size("_lines"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    )
    base = with_once(base, _starts=F.coalesce(starts, nothing))
    base = with_once(base, n_repeat_words=F.when(F.size("_starts") > 0, total).otherwise(0).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (
            base_failed
            | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > MAX_DUPLICATE_LINES * F.col("_n_lines"))
        ).alias("broken"),
        base_failed.alias("base_failed"),
    )


def host_rates(counts: DataFrame, host: str = "host") -> DataFrame:
    """(host, n_docs, n_broken) with ``shrunk_rate`` added: the mean of the host's beta posterior.

    The prior is fitted by moments: its mean is the share over all documents,
    its strength comes from how much more the hosts' shares differ than chance
    alone would make them.
    """
    n, k = F.col("n_docs"), F.col("n_broken")
    totals = counts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count(F.lit(1)).alias("hosts"))
    mean = totals.select((F.col("k") / F.col("n")).alias("mean")).scalar()
    hosts = totals.select("hosts").scalar()
    docs = totals.select("n").scalar()
    with_mean = counts.withColumn("_mean", mean)
    spread = with_mean.agg((F.sum(n * F.pow(k / n - F.col("_mean"), 2)) / F.sum(n)).alias("spread")).scalar()
    by_chance = F.col("_mean") * (1 - F.col("_mean"))
    between = F.greatest(spread - by_chance * hosts / docs, F.lit(1e-9))
    strength = F.least(F.greatest(by_chance / between - 1, F.lit(1.0)), F.lit(1e6))
    return with_mean.withColumn("shrunk_rate", (k + F.col("_mean") * strength) / (n + strength)).drop("_mean")


def judge(features: DataFrame, host: str = "source") -> DataFrame:
    """Add shrunk_rate and kept to features that carry their host. Read three times: give a written table."""
    features = features.withColumn("_host", F.coalesce(F.col(host), F.lit("")))
    counts = features.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("broken")).alias("n_broken")
    )
    rates = host_rates(counts).select(F.col("_host"), "shrunk_rate")
    return (
        features.join(rates, "_host")
        .withColumn("kept", ~F.col("base_failed") & (F.col("shrunk_rate") <= HOST_LIMIT))
        .drop("_host")
    )


def digest(docs: DataFrame) -> DataFrame:
    """One narrow row per document: the counts and both verdicts."""
    features = materialize(document_features(docs, ("doc_id", "source")), "quality-features")
    return judge(features).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("shrunk_rate", 9).alias("shrunk_rate"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Each text is judged once: verdicts travel in the row, without what has
    failed by then; the hosts' counts come from the written rows, and the few
    bad hosts are written too, so that their size is known before the anti join
    that takes them out.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    judged = materialize(
        document_features(row.select("_row", F.col("_row")["source"].alias("_source"), F.col("_row")["text"].alias("text")), ("_row", "_source"))
        .select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), F.coalesce("_source", F.lit("")).alias("_host"), "base_failed", "broken"),
        "quality-judged",
        compression="zstd",
    )
    counts = judged.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("broken")).alias("n_broken"))
    bad = materialize(host_rates(counts).filter(F.col("shrunk_rate") > HOST_LIMIT).select("_host"), "quality-hosts")
    return judged.filter(~F.col("base_failed")).join(bad, "_host", "left_anti").select("_row.*")
