"""N-gram join, repeated bytes, decontamination: against brute force on small tables."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webcorpus.llm import components, decontamination, ngram_jaccard, repeated_bytes

SCHEMA = "doc_id long, text string"


def brute_components(rows, size=5, percent=75):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    lists, parent = defaultdict(list), {d: d for d in sets}
    for doc, shingles in sets.items():
        for s in shingles:
            lists[s].append(doc)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, shingles in sets.items():
        for other, common in Counter(o for s in shingles for o in lists[s] if o < doc).items():
            if 100 * common >= percent * (len(shingles) + len(sets[other]) - common):
                a, b = find(doc), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(400)}"
    rows, line = [], " ".join(word() for _ in range(30))
    for group in range(6):
        base = [word() for _ in range(rng.choice([3, 6, 9, 12, 40, 150]))]
        for _ in range(12):
            text = [w if rng.random() > 0.03 * (group % 3) else word() for w in base]
            rows.append(" ".join(text[: len(text) - rng.randrange(2)]) + ("\n" + line if group == 3 else ""))
    rows += [rows[0], rows[0], "", " \n\t ", None, "one", "ONE", "one two", line]
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA + ", tokens string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link(docs).collect()}
    assert found == brute_components(rows)


def test_join_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other")], SCHEMA)
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_jaccard.link(docs).collect()), key=str)
    assert found == sorted([(0, 2, None), (2, 2, 2), (3, 2, 2), (3, 2, 2), (3, 1, 2)], key=str)
    assert ngram_jaccard.link(docs.limit(0)).count() == 0

def test_keep_first_goes_by_text(spark):
    text = "a b c d e f"
    rows = [(None, text), (2, text), (3, text), (3, text), (3, "other"), (4, "A B C D E F"), (5, "x"), (5, "x"), (5, "y z"), (6, "y z"), (7, ""), (7, ""), (7, None), (8, None), (None, "only")]
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA + ", _node string, component_id int")
    found = sorted(((r.doc_id, r.text or "") for r in ngram_jaccard.keep_first(docs).collect()), key=repr)
    # The copies of the first text go but for id 2's; of one id equal rows stay once, and an empty text equals a null one.
    assert found == sorted([(2, text), (3, "other"), (5, "x"), (5, "y z"), (7, ""), (8, ""), (None, "only")], key=repr)
    unique = spark.createDataFrame([(1, text), (2, text), (3, "other"), (4, None)], SCHEMA)
    assert sorted(r.doc_id for r in ngram_jaccard.keep_first(unique).collect()) == [1, 3, 4]
    assert ngram_jaccard.keep_first(unique.limit(0)).count() == 0


def test_unlike_members_of_a_group_and_a_common_line(spark):
    """Near copies, a group around 0.6, and one line in most texts; many more of each than a tile holds."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    line, near, far = [" ".join(word() for _ in range(n)) for n in (20, 60, 80)]
    edited = lambda text, share: " ".join(w if rng.random() > share else word() for w in text.split())
    rows = [line + "\n" + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(300)]
    rows += [edited(near, 0.01) for _ in range(200)] + [edited(far, 0.05) for _ in range(200)] + [near] * 50
    rng.shuffle(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()}
    assert found == brute_components(list(enumerate(rows)))


def test_the_driver_keeps_no_tables_and_no_filters(spark, monkeypatch):
    """Joins of small tables would each leave a hash relation with the driver, and filters their bits."""
    plans, filters = [], []
    write, build = components.materialize, ngram_jaccard.key_filter

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    def built(*args):
        filters.append(build(*args))
        return filters[-1]

    monkeypatch.setattr(components, "materialize", written)
    monkeypatch.setattr(ngram_jaccard, "materialize", written)
    monkeypatch.setattr(ngram_jaccard, "key_filter", built)
    rows = near_copies(3)
    result = ngram_jaccard.link(spark.createDataFrame(rows, SCHEMA))
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]
    assert len(filters) > 5 and not [f for f in filters if os.path.exists(f._bits._path)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result.collect()} == brute_components(rows)


def test_all_shingles_are_counted(spark):
    tokens = spark.createDataFrame([([i % 50, 70_000 * (i % 3), i],) for i in range(400)], "tokens array<long>")
    expected = Counter(x for i in range(400) for x in (i % 50, 70_000 * (i % 3), i))
    assert {r["at"]: r.c for r in ngram_jaccard._listed_counts(tokens).collect()} == {k: v for k, v in expected.items() if v > 1}


def test_boundary_follows_costs():
    assert ngram_jaccard.boundary() == 8
    assert [ngram_jaccard.least_overlap(a, b) for a, b in ((4, 4), (8, 8), (8, 10), (100, 100))] == [4, 7, 8, 86]


def brute_removed(rows, length=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeated_bytes(spark):
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [junk(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(12)]
    rows = [(i, "".join(rng.choice([junk(rng.randrange(120)), rng.choice(passages)]) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    rows += [(900, "a" * 199), (901, "a" * 201), (902, "ab" * 400), (903, None), (904, ""), (None, rows[1][1]), (5, "q" * 150 + passages[4]), rows[2], rows[2]]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA + ", n_bytes int")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in repeated_bytes.remove_repeats(docs).collect()), key=key) == sorted(brute_removed(rows), key=key)
    assert repeated_bytes.remove_repeats(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    item = lambda n: [f"t{rng.randrange(300)}" for _ in range(n)]
    items = [(i, item(rng.choice([15, 30, 60]))) for i in range(10)] + [(50, ["Short,", "ITEM", "here"]), (51, [])]
    rows = []
    for i, words in items[:10]:
        changed = list(words)
        changed[7] = "zzz"
        rows += [(i, " ".join(["x%d" % k for k in range(30)] + changed)), (100 + i, "clean " + " ".join(f"c{rng.randrange(900)}" for _ in range(80)))]
    rows += [(300, "a short item here."), (301, "short item there"), (302, None), (None, " ".join(items[0][1])), (303, "")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA + ", item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(60, None), items and (0, " ".join(items[0][1]))], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect())
    assert found == [(i, i) for i in range(10)] + [(300, 50)]
    kept = decontamination.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and kept.filter("doc_id < 100").count() == 0
    assert kept.count() == len(rows) - 11
    assert decontamination.leaks(docs.limit(0), bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def brute_passages(items, docs):
    """(doc, item) pairs: (surely found, allowed), by comparing every item with every place of every document."""
    words = lambda text: re.findall("[a-z0-9]+", (text or "").lower())
    sure, allowed = set(), set()
    for item, text in items:
        x = words(text)
        if len(x) < decontamination.LEAST:
            continue
        need = min(decontamination.ENOUGH, -(-3 * len(x) // 4))
        for doc, y in ((d, words(t)) for d, t in docs):
            for base in range(-len(x), len(y)):
                same = [a == y[base + i] for i, a in enumerate(x) if 0 <= base + i < len(y)]
                run = total = bad = 0  # a stretch from each start whose equal words outweigh the unequal ones
                longest = 0
                best = 0
                for s in same:
                    run = run + 1 if s else 0
                    longest = max(longest, run)
                    total, bad = (total + s, bad + (not s)) if total - 2 * bad + (1 if s else -2) > 0 else (0, 0)
                    best = max(best, total)
                if best >= need:
                    allowed.add((doc, item))
                    whole = len(same) == len(x)
                    if longest >= decontamination.SPAN or len(x) < decontamination.SPAN and whole:
                        sure.add((doc, item))
    return sure, allowed


def test_passages_against_all_items_and_documents(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 30, 40])]
    docs = []
    for item, text in items:
        x = text.split()
        for changes in range(4):
            for _ in range(6):
                y = list(x)
                for i in rng.sample(range(len(x)), min(changes, len(x))):
                    y[i] = "changed"
                docs.append(" ".join([word() for _ in range(rng.randrange(9))] + y + [word() for _ in range(rng.randrange(9))]).upper())
    x = items[-1][1].split()
    docs.append(" ".join(x[:12] + ["no"] * 6 + x[18:24] + ["no"] + x[25:32]))  # the first stretch is too short, the second is enough
    docs += ["w1 w2", "", None, " ".join(x) * 2, ("filler " * 60_000) + " ".join(x), docs[0], docs[0]]
    docs = list(enumerate(docs))
    sure, allowed = brute_passages(items, [(d, t) for d, t in docs if t is None or len(t) < 9999])
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA + ", item_id int, h string")
    bench = spark.createDataFrame([*items, items[5], (99, None), (98, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, bench).collect()}
    long = next(d for d, t in docs if t and len(t) > 9999)
    assert (long, 14) in found
    found = {(d, i) for d, i in found if d != long}
    assert sure <= found <= allowed and len(sure) > 150
    gone = {d for d, _ in docs} - {r.doc_id for r in decontamination.drop_leaking(table, bench).collect()}
    assert gone == {d for d, _ in found} | {long}
    assert decontamination.leaks(table.limit(0), bench).count() == decontamination.leaks(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(3, 12))
def test_short_masks_ignore_every_allowed_change(n):
    from itertools import combinations

    for changed in combinations(range(n), n - -(-3 * n // 4)):
        assert any(not set(changed) & set(m) for m in decontamination.short_masks(n))
