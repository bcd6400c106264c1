"""Token alignment against whole-text encoding and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import pytest

from webcorpus.llm import token_alignment


def brute(texts, links="end"):
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = token_alignment.default_tokenizers()
    a, b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    chars, found, counts = token_alignment.byte_characters(), [], Counter()
    for text in texts:
        if not text:
            found.append(([], [], [], []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            end, side = 0, []
            for part in parts:
                side.append((end, end + len(part)))
                end += len(part)
            spans.append(side)
        cuts = {z for _, z in spans[0]} & {z for _, z in spans[1]}
        sides = []
        for ids, side in zip((ids_a, ids_b), spans):
            parts = [[]]
            for i, (_, z) in zip(ids, side):
                parts[-1].append(str(i))
                if z in cuts:
                    parts.append([])
            sides.append([",".join(p) for p in parts[:-1]])
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        if links == "end":
            ending = {v: j for j, (_, v) in zip(ids_b, spans[1])}
            linked = [(i, ending[z]) for i, (_, z) in zip(ids_a, spans[0]) if z in ending]
        else:
            linked = [(i, j) for i, (x, z) in zip(ids_a, spans[0]) for j, (u, v) in zip(ids_b, spans[1]) if x < v and u < z]
        counts.update(linked)
        found.append((ids_a, ids_b, groups, linked))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
         hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for x, y, g, k in found
    ]


def rows(found):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()), key=repr)


@pytest.mark.parametrize("links", ["end", "overlap"])
def test_random_texts(spark, links):
    rng = random.Random(7)
    bits = ["a", " ", "  ", "   ", "\n", "\t ", " ", "\u0085", "　", "   ", "é ", "日本 ", "あ", "😀", "the", " ing", "it's", "Ünder", "12", "();", "<|endoftext|>",
            "<0x41>", "<s>", "\u0000", "x" * 40, "ا", "\r\n", "е ", "__"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += [None, "", " ", "   ", "a ", "▁", "a▁b", "word " * 600, "é" * 700, "\n", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, block int").repartition(3)
    expected = sorted(((i, *r) for i, r in enumerate(brute(texts, links))), key=repr)
    assert rows(token_alignment.digest(docs, links=links)) == expected
    assert sum(r[1] > 0 for r in expected) > 250


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = docs.select("doc_id", "text").collect()
    expected = sorted(((r.doc_id, *x) for r, x in zip(given, brute([r.text for r in given]))), key=repr)
    assert rows(token_alignment.digest(docs)) == expected


def test_odd_tables(spark):
    docs = spark.createDataFrame([("x", "a b"), ("x", "a b"), (None, "c"), ("y", None)], "doc_id string, text string")
    assert [r[0] for r in rows(token_alignment.digest(docs))] == ["x", "x", "y", None]
    assert token_alignment.digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_alignment.digest(docs, links="both")
