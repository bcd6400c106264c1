"""What the stages of the pipeline leave in the scratch folder, and what they shuffle."""

import random
import re

import corpus_pipeline
import pytest
from webcorpus import session
from webcorpus.llm import decontamination, ngram_jaccard, quality_rules, sanitisation

SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture
def scratch(spark, tmp_path, monkeypatch):
    """The scratch folder of this test alone."""
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/tables/{name}-{random.random()}")
    return lambda: {re.sub(r"-0.*", "", p.name): p for p in (tmp_path / "tables").iterdir()}


@pytest.fixture
def docs(spark):
    """Texts that a code can hardly be made shorter for: letters at random; a third of them hold the same address and a word with it."""
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(300))
    texts = [prose() + (" zoe zoe@example.org" if i % 3 == 0 else "") for i in range(300)]
    texts += texts[:20] + [None, "", "too short"]
    return spark.createDataFrame([(i, t, f"s{i % 4}", 1) for i, t in enumerate(texts)], SCHEMA).repartition(2)


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_stages_leave_only_what_their_result_reads(spark, scratch, docs, tmp_path):
    given = size(docs.write.parquet(f"{tmp_path}/given") or tmp_path / "given")
    passages = spark.createDataFrame([(1, docs.first().text or "a b c d")], "item_id long, text string")
    left = set()
    for make, more in (
        (lambda: ngram_jaccard.keep_first(docs), {"jaccard-several", "jaccard-decisions"}),
        (lambda: decontamination.drop_leaking(docs, passages), {"leak-verdicts"}),
        (lambda: sanitisation.sanitise(docs), {"pii-rows", "pii-terms"}),
        (lambda: quality_rules.keep_good(docs), {"quality-judged", "quality-hosts"}),
    ):
        make().collect()
        left |= more
        assert set(scratch()) == left
    assert size(scratch()["pii-rows"]) < 1.1 * given  # each text once
    assert size(scratch()["quality-judged"]) < 1.1 * given


def test_good_rows_are_not_shuffled_for_a_few_hosts(spark, scratch, docs):
    found = quality_rules.keep_good(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_the_pipeline_keeps_the_rows_of_one_stage(spark, scratch, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() == 300
    assert set(scratch()) == {"pipeline-sanitisation"}
