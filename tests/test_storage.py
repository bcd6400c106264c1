"""Trees of files, order of lines, durations, settled paths."""

import json
import random

import pytest
from pyspark.sql import functions as F

from webcorpus.operators.report import busy_seconds, site_stats
from webcorpus.operators.uploads import inventory_diff
from webcorpus.plans.site_run import settle_paths
from webcorpus.sinks.file_tree import FileTreeWriter
from webcorpus.sinks.tables import export_tree
from webcorpus.sources.tables import read_failures, read_log


def test_a_tree_and_its_manifest(spark, tmp_path):
    parts = spark.range(300).select(
        F.concat(F.lit("d"), F.col("id") % 7).alias("dir"), F.concat(F.lit("f"), F.col("id") % 50, F.lit(".md")).alias("filename"), F.col("id").alias("part"),
        F.concat(F.col("id"), F.lit(" é\n")).alias("text"))
    for _ in range(2):  # a second run replaces the files
        export_tree(parts, str(tmp_path / "t"))
    expected = {}
    for i in range(300):
        expected.setdefault(f"d{i % 7}/f{i % 50}.md", []).append(f"{i} é\n")
    found = {str(p.relative_to(tmp_path / "t")): p.read_text() for p in (tmp_path / "t").rglob("*.md")}
    assert found == {k: "".join(v) for k, v in expected.items()}
    committed = [json.loads(p.read_text()) for p in (tmp_path / "t/_manifest").glob("*.json")]
    assert len(committed) == 2
    for job in committed:
        listed = [line for part in job["parts"] for line in (tmp_path / "t" / part).read_text().split()]
        assert sorted(listed) == sorted(expected) and job["files"] == len(expected) and job["bytes"] == sum(len(t.encode()) for t in found.values())
    assert not [p for p in (tmp_path / "t").rglob(".*") if p.is_file() and not p.name.endswith(".crc")]


def test_a_task_that_dies_leaves_no_partial_file(tmp_path):
    writer = FileTreeWriter(str(tmp_path))

    def rows():
        yield {"dir": "d", "filename": "whole.md", "part": 0, "text": "one"}
        yield {"dir": "d", "filename": "partial.md", "part": 0, "text": "first"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["whole.md"]  # whole, and in no manifest
    done = writer.write(iter([{"dir": "d", "filename": "whole.md", "part": 0, "text": "again"}]))
    writer.abort([done, None])
    assert not list((tmp_path / "_manifest").rglob("*.txt")) and not list((tmp_path / "_manifest").glob("*.json"))
    writer.commit([])
    assert json.loads(next((tmp_path / "_manifest").glob("*.json")).read_text())["files"] == 0


def test_lines_in_order_over_files_of_unlike_size(spark, tmp_path):
    sizes = {"a.log": 1, "b.log": 4000, "c.log": 3, "d.log": 0}
    expected = []
    for name, n in sizes.items():
        lines = [f"{name} {i}" for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        expected += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # b.log is split
    try:
        rows = read_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(rows, key=lambda r: r.line_no)] == expected and sorted(r.line_no for r in rows) == list(range(len(expected)))
    assert read_log(spark, str(tmp_path / "none")).isEmpty()


def test_failures_as_array_and_by_line(spark, tmp_path):
    records = [{"file_path": f"{i}.md", "reason": "r", "response": "x", "file_size": i} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "lines.json").write_text("".join(json.dumps(r) + "\n" for r in records))
    (tmp_path / "broken.json").write_text("[{")
    for name, n in (("array", 3), ("lines", 3), ("broken", 0), ("none", 0)):
        assert read_failures(spark, str(tmp_path / f"{name}.json")).filter("file_path is not null").count() == n


def test_busy_time_is_the_union_of_intervals(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, 90])) for s in (rng.randrange(1000) / 4 for _ in range(300))] + [("c", 3.0, 2.0), ("d", 0.0, 25.0)]
    fetches = spark.createDataFrame([(s, float(a), float(z)) for s, a, z in rows], "site string, started double, ended double")
    found = {r.site: r.busy for r in busy_seconds(fetches, 10).groupBy("site").agg(F.sum("busy").alias("busy")).collect()}
    for site in "abd":
        total, reached = 0.0, float("-inf")
        for a, z in sorted((a, z) for s, a, z in rows if s == site):
            total += max(0.0, z - max(a, reached))
            reached = max(reached, z)
        assert found[site] == pytest.approx(total)
    seeds = spark.createDataFrame([("a",), ("b",), ("e",)], "site string")
    nothing = spark.createDataFrame([], "site string, converted boolean")
    stats = {r.site: r for r in site_stats(seeds, nothing, nothing, fetches.filter("site = 'a'")).collect()}
    assert stats["e"].duration_seconds == 0 and stats[None].websites_processed == 3 and stats["a"].busy_seconds == pytest.approx(found["a"])


def test_settled_paths_move_a_text_once(spark):
    rows = [("s", i, f"u{i}", i, "d", f"f{i % 3}", "text" * i) for i in range(9)]
    markdown = spark.createDataFrame(rows, "site string, page_id long, url string, fifo_rank long, dir string, filename string, markdown string")
    kept, lost = settle_paths(markdown)
    assert sorted(r.page_id for r in kept.collect()) == [6, 7, 8] and sorted(r.page_id for r in lost.collect()) == list(range(6))
    assert "markdown" not in lost.columns
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange") == 2  # the texts, and the winners' keys


def test_listings_that_differ(spark):
    listing = lambda rows: spark.createDataFrame(rows, "file_path string, size long")
    found = inventory_diff(listing([("a", 1), ("b", 2), ("c", 3)]), listing([("b", 2), ("c", 4), ("d", 0)])).collect()
    assert sorted(map(tuple, found)) == [("a", "removed"), ("c", "resized"), ("d", "added")]
