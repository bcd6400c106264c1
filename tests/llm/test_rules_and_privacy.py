"""Quality rules, sanitisation, licence scans: against plain Python."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from webcorpus.llm import license_scan, quality_rules, sanitisation

SCHEMA = "doc_id long, text string, source string"


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é#", "  ", "\t", "\x0b", " ", "long "]) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [None, "", " \n ", "a b c d e " * 2000, "x" * 5000]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(7, texts[7], None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_words int")
    found = quality_rules.digest(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(dict(enumerate(texts))[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality_rules.digest(docs.limit(0)).count() == 0


def test_bad_hosts_go_with_their_documents(spark):
    good = " ".join(f"word{k}" for k in range(30))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 20}") for i in range(400)]
    rows += [(5000, "short", "once"), (5001, good, "once")]  # one failure of two proves little
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {1000 + i for i in range(400)} | {5001}
    assert ids == {r.doc_id for r in quality_rules.digest(docs).filter("kept").collect()}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        n = [int(c) for c in reversed(digits)]
        return 13 <= len(n) <= 19 and sum(n[::2] + [sum(divmod(2 * x, 10)) for x in n[1::2]]) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark):
    rng = random.Random(2)
    bits = ["1", "2.", "a@", "b.c", "_", "-", " ", "+4", ".5", "é", "25", "@", "x.y", "😀", "0.0", "4111 1111 1111 1111", "\u0001", "+49 (30) 1234567", "%", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(300)] + [None, "", "9" * 4000 + " " + "a" * 5000 + "@" + "x.y" * 2000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = sanitisation.digest(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, texts[r.doc_id] or "") if passes(k, m[0])]
        listed = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in PATTERNS)


def test_disclosing_words(spark):
    rng = random.Random(5)
    fill = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, f"{fill(20)} Quixote jo.doe@mail.org of {fill(20)}") for i in range(5)] + [(100 + i, fill(60) + " of") for i in range(300)]
    rows += [(900 + i, "same words here a.b@c.de zebra") for i in range(9)]  # copies are one witness
    rows += [(2000, "Quixote alone"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    clean = {r.doc_id: r for r in sanitisation.sanitise(docs).collect()}
    assert all("Quixote" not in clean[i].text and "[EMAIL]" in clean[i].text for i in range(5))
    assert clean[900].text == "same words here [EMAIL] zebra"
    assert clean[2000].text == "Quixote alone" and clean[2001].text is None
    assert all(clean[d].text == t for d, t in rows if 100 <= d < 900)
    assert clean[0].n_chars == len(clean[0].text)
    assert sanitisation.sanitise(docs.limit(0)).columns == docs.columns


def test_native_plans(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], SCHEMA)
    for frame in (quality_rules.digest(docs), sanitisation.digest(docs), license_scan.scan(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_licences(spark):
    texts = [
        "First line\nReleased under the MIT License.\nlast", "Licensed under CC BY-NC 4.0.", "The general public reserved all seats.", None, "",
        "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "He was under the impression that mit is a word.",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "y")], "doc_id long, text string, family string")
    found = sorted((r.doc_id, r.paragraph_no, r.family) for r in license_scan.scan(docs).collect())
    assert found == [(0, 1, "mit"), (1, 0, "cc-by-nc"), (1, 0, "cc-by-nc"), (5, 0, "reserved"), (6, 0, "gpl")]
    assert license_scan.scan(docs.limit(0)).count() == 0
