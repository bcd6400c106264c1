r"""Personal data and the words that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers, each with
its own test of plausibility. Deleting them is not enough when another word
points to the same person: a word in a document with a protected value discloses
it as far as it raises the value's probability. From counts of whole documents,

    disclosure(value, word) = pmi(value, word) / ic(value)
                            = log2(N * n(value, word) / (n(value) * n(word))) / log2(N / n(value)),

the share of the value's information that the word alone conveys; 1 means that
the word occurs only with this value. Wherever it stands in a document with the
value, the word is generalised from ``GENERALISE`` on and removed from ``REMOVE``
on, provided that ``SUPPORT`` different texts hold both: copies of one text are
one witness, and below that number every rare word would seem to disclose. Only
documents that hold the value are touched. Words inside protected values go with
these.

Everything is column functions. Positions come from marking the matches in the
text and adding up the lengths between the marks. Per-word counts of the corpus
are combined within tasks before they are shuffled; what else moves are the
distinct words of documents that hold a value which ``SUPPORT`` texts hold, dealt
by value, word and text, so that a frequent value is spread.

Defined cases: a null text is empty and has no spans; repeated rows each get
the same result; ids may be repeated with other texts; a character U+0001 in a
text counts as U+0002; an empty table gives an empty result. Other columns are
kept by ``sanitise`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import with_once
from ..operators.skew import lookup_join
from ..session import materialize, settled

# The patterns are fixed. Possessive repeats and \G only spare the regex engine from trying starts that cannot match.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(_PATTERNS)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*+"
_MARK, _NO_MARK = "\u0001", "\u0002"
_MASKED_WORD = r"[\p{L}\p{N}\x01][\p{L}\p{N}\x01'’-]*+"

SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95

_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _plausible(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: str, test) -> Column:
    """The plausible matches of a text, as spans: text between marks is alternately outside and inside a match."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(
            end.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(state["inside"] & test(part), F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    return F.aggregate(parts, start, step, lambda state: state["spans"])


def _unmarked(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(_MARK), F.lit(_NO_MARK)), F.lit(""))


def base_spans(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``keep`` columns, ``_text`` and ``_base``: the spans of every kind, kinds in order, then by start."""
    rows = docs.select(*keep, _unmarked(F.col(text)).alias("_text"))
    none = F.array().cast(f"array<{_SPAN}>")
    signs = {"email": "@", "phone": "+"}
    found = {
        f"_{kind}": F.when(
            F.contains("_text", F.lit(signs[kind])) if kind in signs else F.lit(True),
            _matches(F.col("_text"), pattern, kind, lambda v, kind=kind: _plausible(kind, v)),
        ).otherwise(none)
        for kind, pattern in _PATTERNS.items()
    }
    return with_once(rows, **found).select(*keep, "_text", F.concat(*found).alias("_base"))


def _masked(text: Column, spans: Column) -> Column:
    """The text, as long as before, with U+0001 for every letter and digit of a protected value."""

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(state["at"], s["start"])
        value = F.regexp_replace(F.substring(text, start + 1, s["end"] - start), r"[\p{L}\p{N}]", _MARK)
        before = F.substring(text, state["at"] + 1, start - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["end"] > state["at"], F.concat(state["out"], F.array(before, value))).otherwise(state["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        by_start, start, step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )


def _terms_of(text: Column, pattern: str = _WORD) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.lower(w)))


def _values(spans: DataFrame) -> DataFrame:
    """_id, _key and every protected value of a row, once."""
    values = F.array_distinct(F.transform("_base", lambda v: F.concat_ws(":", v["kind"], F.lower(v["value"]))))
    return spans.filter(F.size("_base") > 0).select("_id", "_key", F.explode(values).alias("entity"))


def _supported(spans: DataFrame) -> DataFrame:
    """(entity, n_entity) of the values that stand in enough different texts; no other can have a disclosing word."""
    return (
        _values(spans)
        .groupBy("entity", "_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity")
        .agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= SUPPORT)
        .drop("texts")
    )


def _together(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per row of ``spans``, value and distinct word outside of protected values: _id, _key, entity, term."""
    held = lookup_join(_values(spans).distinct(), entities.select("entity"), ["entity"], ["_key"], "inner")
    held = held.groupBy("_id", "_key").agg(F.collect_list("entity").alias("_held"))
    texts = spans.filter(F.size("_base") > 0).join(held, ["_id", "_key"])
    words = _terms_of(_masked(F.col("_text"), F.col("_base")), _MASKED_WORD)
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~F.contains(w, F.lit(_MARK)))
    return texts.select("_id", "_key", "_held", F.explode(words).alias("term")).select("_id", "_key", F.explode("_held").alias("entity"), "term")


def disclosing_terms(together: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of words that pass the lower threshold, from counts over all documents."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = (
        together.groupBy("entity", "term", "_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= SUPPORT)
    )
    terms = docs.select(F.explode(_terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    both, e, t = F.col("n_both"), F.col("n_entity"), F.greatest("n_term", "n_both")
    disclosure = F.log2(total * both / (e * t)) / F.log2(total / e)
    return (
        pairs.join(entities, "entity")
        .join(terms, "term")
        .filter(e < total)
        .select("entity", "term", disclosure.alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE)
    )


def _term_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(_id, _key, _terms) of the rows that hold disclosing words and the value they disclose: all their places."""
    entities = materialize(_supported(spans), "pii-values")
    together = materialize(_together(spans, entities), "pii-together")
    terms = materialize(disclosing_terms(together, docs, entities), "pii-disclosing")
    chosen = (
        lookup_join(together, terms, ["entity", "term"], ["_key"], "inner")
        .groupBy("_id", "_key", "term")
        .agg(F.max("disclosure").alias("d"))
        .groupBy("_id", "_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("_found"))
    )
    rows = spans.filter(F.size("_base") > 0).dropDuplicates(["_id", "_key"]).join(chosen, ["_id", "_key"])
    places = F.filter(
        _matches(F.col("_text"), _WORD, "term", lambda v: F.map_contains_key("_found", F.lower(v))),
        lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])),  # part of a protected value itself
    )
    rows = with_once(rows.select("_id", "_key", "_found", "_text", "_base"), _places=places)
    kind = lambda s: F.when(F.element_at("_found", F.lower(s["value"])) >= REMOVE, F.lit("removed")).otherwise(F.lit("term"))
    named = F.transform("_places", lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    return rows.select("_id", "_key", F.array_sort(named).alias("_terms"))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the fingerprint of the base spans, and all spans."""
    docs = docs.select("doc_id", "text")
    spans = materialize(
        base_spans(docs, ("doc_id",), "text").select(
            "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64("_text").alias("_key"), "_base",
            F.when(F.size("_base") > 0, F.col("_text")).alias("_text"),
        ),
        "pii-spans",
    )
    terms = _term_spans(docs, spans)
    both = spans.join(terms, ["_id", "_key"], "left")
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size("_base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.concat("_base", F.coalesce("_terms", F.array().cast(f"array<{_SPAN}>")))
    return both.select(
        "doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(every).alias("spans"),
        F.size(F.coalesce("_terms", F.array())).cast("long").alias("n_term"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span's characters exchanged for its kind; overlapping spans become one gap."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        sign = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(before, sign))).otherwise(state["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        by_start, start, step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with protected values and disclosing words replaced in ``text``; n_chars, if there, follows the new text."""
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    row = row.select("_row", F.coalesce(F.col("_row")["doc_id"].cast("long"), F.lit(-1)).alias("_id"), F.col("_row")["text"].alias("text"))
    found = base_spans(row, ("_row", "_id"), "text").select("_row", "_id", F.xxhash64("_text").alias("_key"), "_base")
    found = materialize(found, "pii-rows", compression="zstd")
    plain = _unmarked(F.col("_row")["text"]).alias("_text")  # not written again beside its row
    terms = settled(lambda: _term_spans(docs.select("text"), found.select("_id", "_key", plain, "_base")), "pii-terms")
    both = found.join(terms, ["_id", "_key"], "left").select("_row", "_base", "_terms", plain)
    spans = F.concat("_base", F.coalesce("_terms", F.array().cast(f"array<{_SPAN}>")))
    text = F.when(F.size(spans) > 0, _replaced(F.col("_text"), spans)).otherwise(F.col("_row")["text"])
    both = with_once(both, _clean=text)
    columns = [
        F.col("_clean").alias(c) if c == "text"
        else F.length("_clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("_row")[c].alias(c)
        for c in docs.columns
    ]
    return both.select(*columns)
