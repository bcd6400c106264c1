"""Segmentations summed one by one, held-out accuracy, odd rows."""

import itertools
import math
import zlib

import numpy as np
import pytest

from webcorpus.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return language_id.Pieces(language_id.default_vocabulary())


def _segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:z] for a, z in zip(at, at[1:])]


def test_forward_sums_all_segmentations(pieces):
    import base64

    with open(language_id.default_vocabulary(), "rb") as lines:
        known = sorted({base64.b64decode(x.split()[0]) for x in lines} | {bytes([b]) for b in range(256)})
    number = {p: i for i, p in enumerate(known)}
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(pieces.size), 2).T + 1e-12)
    words = [b" the", b" und", " für".encode(), b" a", b" thething", b" zqzq", "日本".encode(), b" the"]
    lattice = language_id.Lattice(words, pieces)
    scores, times = lattice.scores(log_p), np.array([1, 2, 1, 3, 1, 1, 1, 4])
    expected = np.zeros(pieces.size)
    for i, word in enumerate(words):
        ways = [[number[p] for p in way] for way in _segmentations(word) if all(p in number for p in way)]
        for k in range(2):
            assert scores[i, k] == pytest.approx(math.log(sum(math.exp(log_p[w, k].sum()) for w in ways)))
        for w in ways:
            share = math.exp(log_p[w, 0].sum() - scores[i, 0])
            np.add.at(expected, w, share * times[i])
    assert lattice.expected(log_p[:, :1], times) == pytest.approx(expected)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.filter("text rlike '\\\\p{L}'").collect()}
    found = language_id.digest(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    for out in (True, False):
        mine = [truth[r.doc_id] == r.lang_pred for r in found if r.doc_id in truth and r.held_out == out]
        assert len(mine) > 100 and sum(mine) >= 0.98 * len(mine)


def test_odd_rows(spark):
    text = {"en": "the cat and the dog went over the hill ", "de": "der hund und die katze gehen über den berg "}
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text["en" if i % 2 else "de"] * (i % 3 + 1), "en" if i % 2 else "de", 7) for i in ids]
    odd = [(100, None, "en", 1), (101, "", None, 1), (102, "12 - 34\n", "de", 1), (103, text["de"] * 20_000, None, 1), (103, text["de"] * 20_000, None, 1),
           (None, text["en"], "en", 1), (104, "x" * 30_000, None, 1), (105, "ÜBER DEN BERG", None, 1), (106, "日本語", None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    found = language_id.digest(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(((r.doc_id, r.lang_pred) for r in found.collect() if r.doc_id is None or r.doc_id >= 100), key=repr)
    assert dict(got) | {104: 0, 106: 0} == {100: "und", 101: "und", 102: "und", 103: "de", None: "en", 104: 0, 105: "de", 106: 0}
    assert len(got) == len(odd)
    assert language_id.digest(docs.limit(0)).count() == 0
    unlabelled = language_id.digest(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
