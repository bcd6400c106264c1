"""The conversation trie against a dictionary of prefixes, over odd and long conversations."""

import hashlib
import random
import zlib

import pytest

from webcorpus.llm import conversation_trie as ct


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = {}
    for c, x in full.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], set()).add(c)
    below, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            below.setdefault(p[:-1], set()).add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in below)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if full[c] == p))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def check(spark, rows, rebuild=True):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, id string").repartition(5)
    found = ct.digest(table, rebuild)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, rebuild)


@pytest.mark.parametrize("rebuild", [True, False])
def test_small_alphabet(spark, rebuild):
    rng = random.Random(3)
    rows = []
    for c in [*range(-7, 90), 10**12, 10**12 + 3]:
        if rng.random() < 0.2:
            continue
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([None, turn, turn, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    rows += [(None, 0, "user", "a"), rows[0], rows[0]]
    check(spark, rows, rebuild)


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(ct, "STRETCH", 16)
    monkeypatch.setattr(ct, "_MEMBERS", 8)
    monkeypatch.setattr(ct, "_AT_ONCE", 3000)
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(20 + c % 3)]  # near and exact copies of more than a stretch
    rows += [(1000, t, "user", f"turn {min(t, 300)}") for t in range(700)] + [(1001, t, "user", f"own {t}") for t in range(3)]
    rows += [(2000 + c, t, "user", f"{c % 300} {t}") for c in range(600) for t in range(2)]  # more children than 48
    check(spark, rows)


def test_layouts_grow():
    tree = ct.RadixTree()
    keys = [bytes([a, b]) for a in range(256) for b in (0, a)] + [b"", b"\x05", b"\x07\x07\x01"]
    for i, key in enumerate(keys):
        tree.insert(key, (1, i, 0, 0))
    seen = {tree.keys[k][:end]: sums[0] for k, _, end, sums in tree.edges()}
    for prefix in {k[:n] for k in keys for n in range(len(k) + 1)}:
        if prefix in seen:
            assert seen[prefix] == sum(k.startswith(prefix) for k in keys)
    assert set(keys) <= set(seen) and tree.root.children.room == 256


def test_odd_tables(spark):
    check(spark, [(5, None, None, None)])
    check(spark, [(c, 0, "user", "same") for c in range(30)])
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert ct.digest(empty).count() == 0
