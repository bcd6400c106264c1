"""Disclosing words are counted and replaced in whole documents."""

import random

from pyspark.sql import functions as F

from webcorpus.llm import sanitisation


def test_disclosing_words_far_from_the_value(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, f"QUIXOTE's heading\n{fill(60)} write to jo.doe@mail.org or jo {fill(60)}\nQuixote {fill(40)} Dulcinea, quixote") for i in range(5)]
    rows += [(10 + i, f"Panza {fill(60)} panza@mail.org {fill(60)}") for i in range(2)]  # too few texts
    rows += [(20 + i, f"{fill(50)} often a@b.org {fill(50)}") for i in range(4)] + [(30 + i, fill(30) + " often or heading jo") for i in range(50)]
    rows += [(100 + i, fill(60) + " to write") for i in range(300)] + [(2000, "Quixote alone"), (2001, None)]
    rows += [rows[0], (1, "Quixote without it")]  # a repeated row, a repeated id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sanitisation.sanitise(docs).collect()
    assert len(clean) == len(rows)
    texts = dict(rows[:-2])
    for r in clean:
        if r.doc_id < 5 and r.text != "Quixote without it":
            assert "uixote" not in r.text and "Dulcinea" not in r.text and "[EMAIL]" in r.text and " or jo " in r.text and "heading" in r.text
        elif r.doc_id in (10, 11):
            assert r.text == texts[r.doc_id].replace("panza@mail.org", "[EMAIL]")
        elif 20 <= r.doc_id < 24:
            assert r.text == texts[r.doc_id].replace("a@b.org", "[EMAIL]")
        elif r.doc_id != 1:
            assert r.text == texts[r.doc_id]
    spans = {r.doc_id: r for r in sanitisation.digest(docs.filter("doc_id <> 1")).collect()}
    assert spans[0].n_term == 4 and spans[2000].n_term == 0
    at = [(int(a), int(z)) for k, a, z in (x.split(":") for x in spans[0].spans.split(",")) if k == "removed"]
    assert {texts[0][a:z] for a, z in at} == {"QUIXOTE's", "Quixote", "Dulcinea", "quixote"}


def test_masked_text_keeps_places(spark):
    texts = ["a jo.doe@mail.org-é b 4111 1111 1111 1111 c +49 (30) 1234567", "v12.3.4.5x +1 4111111111111 y", "none", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = sanitisation.base_spans(docs).select("_text", "_base", sanitisation._masked(F.col("_text"), F.col("_base")).alias("m")).collect()
    for r in rows:
        inside = {i for b in r._base for i in range(b.start, b.end)}
        assert r.m == "".join("\u0001" if i in inside and c.isalnum() else c for i, c in enumerate(r._text))
