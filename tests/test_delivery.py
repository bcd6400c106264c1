"""Logs, ledger, attempts, reports, run registry, readers and writers."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from webcorpus.operators import logs, report, runs, seeds, uploads
from webcorpus.plans.analysis import analyse
from webcorpus.plans.delivery_run import plan_delivery, settle_delivery
from webcorpus.schemas import ATTEMPTS, FAILURES, RESPONSES
from webcorpus.sinks import tables as sinks
from webcorpus.sources import tables as sources

HEAD = "2025-04-07 16:49:26,707 - INFO - "
LINES = {
    "Successfully uploaded a/b.md": ("success", None, "a/b.md", None, None),
    "Successfully uploaded a/b c.md (12 bytes) in 0.5s": ("success", None, "a/b c.md", 12, 0.5),
    "Successfully uploaded: 16": ("other", None, None, None, None),
    "Failed to upload a/b.md (9 bytes). Status: 500, Response: x. y": ("failed", None, "a/b.md", 9, None),
    "Failed to upload a/b.md. Status: 413, Response: ": ("failed", None, "a/b.md", None, None),
    "Error uploading a/b.md (9 bytes): boom: (1 bytes)": ("failed", None, "a/b.md", 9, None),
    "Error uploading a/b.md: boom": ("failed", None, "a/b.md", None, None),
    "Skipping image file: a/p.png": ("skipped", "image file", "a/p.png", None, None),
    "Unsupported file type: a/q": ("skipped", "unsupported file type", "a/q", None, None),
    "Found 222 files to process": ("other", None, None, None, None),
}


def lines_of(spark, messages, head=HEAD):
    return spark.createDataFrame([(i, head + m) for i, m in enumerate(messages)], "line_no long, value string")


def test_log_lines(spark):
    rows = logs.parse_log(lines_of(spark, LINES)).orderBy("line_no").collect()
    assert [(r.kind, r.reason, r.file_path, r.file_size, r.upload_duration) for r in rows] == list(LINES.values())
    assert {r.ts for r in rows} == {datetime(2025, 4, 7, 16, 49, 26, 707000)} and {r.level for r in rows} == {"INFO"}


def test_where_the_rules_for_log_lines_differ_from_plain_marker_splitting(spark):
    """The plain rule, as SQL: cut after the marker, a failed path at its first dot. It misreads sizes, counts and paths."""
    log = logs.parse_log(lines_of(spark, LINES))
    plain = log.withColumn("old", F.expr("""CASE
        WHEN contains(message, 'Successfully uploaded') THEN 'success|' || trim(split(message, 'Successfully uploaded')[1])
        WHEN contains(message, 'Failed to upload') THEN 'failed|' || trim(split(split(message, 'Failed to upload')[1], '[.]')[0])
        WHEN contains(message, 'Skipping') THEN 'skipped|' || trim(split(message, ':')[1])
        WHEN contains(message, 'Unsupported file type') THEN 'skipped|' || trim(split(message, 'Unsupported file type:')[1]) END"""))
    new = F.when(F.col("kind") != "other", F.concat_ws("|", "kind", "file_path"))
    differ = [r.old for r in plain.filter(~F.col("old").eqNullSafe(new)).orderBy("line_no").collect()]
    assert differ == ["success|a/b c.md (12 bytes) in 0.5s", "success|: 16", "failed|a/b", "failed|a/b", None, None]


def test_lines_without_a_head(spark):
    row = logs.parse_log(lines_of(spark, ["Upload Summary:"], head="")).first()
    assert (row.ts, row.level, row.kind, row.message) == (None, None, "other", "Upload Summary:")


def test_tail_and_union(spark):
    log = logs.union_logs(lines_of(spark, "abc"), lines_of(spark, "de"))
    assert [r.value[-1] for r in logs.tail(log, ["source", "line_no"], 3).collect()] == ["c", "d", "e"]


def test_attempts_and_ledger(spark):
    inventory = spark.createDataFrame([("o/a.md", 3), ("o/b.pdf", 4), ("o/c.png", 5), ("o/d", 6), ("o/old.md", 7)], "file_path string, size long")
    ledger = spark.createDataFrame([("o/old.md", None), ("o/gone.md", None)], "file_path string, first_uploaded_at timestamp")
    planned = plan_delivery(inventory, ledger)
    assert {r.file_path: (r.status, r.reason, r.mime) for r in planned.collect()} == {
        "o/a.md": ("eligible", None, "text/markdown"), "o/b.pdf": ("eligible", None, "application/pdf"),
        "o/c.png": ("skipped", "image file", None), "o/d": ("skipped", "unsupported file type", None)}
    ts = datetime(2025, 1, 1)
    responses = spark.createDataFrame(
        [("r1", ts, "o/a.md", 200, "ok", None, 3, 1.0, 2.504), ("r1", ts, "o/b.pdf", 500, "no", None, None, 1.0, 2.0), ("r1", ts, "o/e.md", None, None, "boom", 1, 1.0, None)], RESPONSES)
    done = settle_delivery(planned, responses, ledger, "r1", ts)
    assert done["counts"].first().asDict() == {"run_id": "r1", "success": 1, "failed": 2, "skipped": 2, "total": 5}
    assert [tuple(r) for r in done["ledger"].collect()] == [("o/a.md", ts)]
    attempts = {r.file_path: r for r in done["attempts"].collect()}
    assert attempts["o/a.md"].upload_duration == 1.5 and attempts["o/a.md"].reason is None
    assert (attempts["o/b.pdf"].reason, attempts["o/b.pdf"].response, attempts["o/b.pdf"].file_size) == ("API Error: 500", "no", 0)
    assert (attempts["o/e.md"].status, attempts["o/e.md"].reason) == ("failed", "boom")
    merged = ledger.unionByName(done["ledger"])
    assert uploads.merge_ledger(merged, done["attempts"]).isEmpty()  # merging twice adds nothing
    assert [r.file_path for r in uploads.dangling_entries(ledger, inventory).collect()] == ["o/gone.md"]


def test_retry_takes_the_last_attempt(spark):
    day = lambda d: datetime(2025, 1, d)
    rows = [("r1", day(1), "a.md", "failed", "x"), ("r2", day(2), "a.md", "success", None), ("r1", day(1), "b.md", "success", None), ("r2", day(2), "b.md", "failed", "y"),
            ("r1", day(1), "c.md", "failed", "z"), ("r1", day(1), "d.csv", "failed", "z")]
    attempts = spark.createDataFrame([(*r, None, None, None) for r in rows], ATTEMPTS)
    present = spark.createDataFrame([("a.md", 1), ("b.md", 1), ("d.csv", 1)], "file_path string, size long")
    found = {r.file_path: (r.status, r.reason, r.failed_for) for r in uploads.retry_candidates(attempts, present).collect()}
    assert found == {"b.md": ("eligible", None, "y"), "c.md": ("failed", "File no longer exists", "z")}


def test_failure_defaults(spark):
    df = spark.createDataFrame([("failed", None, None, None, None, None), ("failed", "r", "b", "p", 3, None)], FAILURES)
    assert {tuple(r) for r in uploads.failure_details(df).select("file_path", "reason", "response", "file_size").collect()} == {
        ("Unknown file", "Unknown reason", "", 0), ("p", "r", "b", 3)}


def test_rate_without_attempts(spark):
    row = report.success_rate(spark.createDataFrame([], "status string, file_path string")).first()
    assert (row.succeeded, row.failed, row.rate) == (0, 0, None)


def test_analysis_documents(spark, tmp_path):
    first = lines_of(spark, ["Successfully uploaded o/a.md (3 bytes) in 1.0s", "Failed to upload o/b.pdf (4 bytes). Status: 500, Response: no", "Skipping image file: o/c.png"])
    retry = lines_of(spark, ["Successfully uploaded o/a.md", 'Successfully uploaded o/q"t.md', "Failed to upload o/b.pdf. Status: 500, Response: no"])
    failures = [spark.createDataFrame([(0, "o/b.pdf", "API Error: 500", "no", 4)], "line_no long, file_path string, reason string, response string, file_size long")] * 2
    inventory = spark.createDataFrame([("o/a.md", 3), ("o/b.pdf", 4), ("o/c.png", 5), ("o/x", 1)], "file_path string, size long")
    out = analyse([first, retry], failures, inventory, "2025-01-01 00:00:00", directory="o")

    sinks.write_lines(out["stats"], str(tmp_path / "stats"))
    document = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "stats").glob("part-*"))))
    assert document["file_counts"] == {"extension_counts": {".md": 1, ".pdf": 1, ".png": 1, "no_extension": 1}, "total_files": 4}
    assert document["successful_files"] == ["o/a.md", 'o/q"t.md'] and document["failed_files"] == ["o/b.pdf", "o/b.pdf"] and document["skipped_files"] == ["o/c.png"]
    assert document["failure_analysis"]["reason_counts"] == {"API Error: 500": 2} and len(document["failure_analysis"]["detailed_failures"]) == 2
    assert document["supported_extensions"][".md"] == "Markdown" and document["timestamp"] == "2025-01-01 00:00:00"

    sinks.write_lines(out["summary"], str(tmp_path / "summary"))
    summary = "".join(p.read_text() for p in sorted((tmp_path / "summary").glob("part-*")))
    assert "Total files in o directory: 4\n" in summary and "Success rate for uploadable files: 50.00%\n" in summary
    assert summary.index("=== FILE EXTENSIONS ===") < summary.index(".md: 1 files") < summary.index("=== UPLOAD RESULTS ===") < summary.index("API Error: 500: 2 files")

    sinks.write_report(out["report"], str(tmp_path / "report"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert [(r["File Path"], r["Status"], r["File Size (bytes)"], r["Upload Duration (s)"]) for r in rows] == [
        ("o/a.md", "Success", "3", "1.0"), ('o/q"t.md', "Success", "0", None), ("o/c.png", "Skipped", "5", None), ("o/b.pdf", "Failed", "4", None), ("o/b.pdf", "Failed", "4", None)]


def test_documents_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "line_no long, value string")
    failures = spark.createDataFrame([], "line_no long, file_path string, reason string, response string, file_size long")
    out = analyse([empty], [failures], spark.createDataFrame([], "file_path string, size long"), "now")
    text = "\n".join(r.line for r in out["stats"].orderBy("section", "ord").collect())
    assert json.loads(text)["successful_files"] == []
    summary = [r.line for r in out["summary"].orderBy("section", "ord").collect()]
    assert "All uploadable files were successfully processed!" in summary and not any("Success rate" in s or "REASONS" in s for s in summary)


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" https://h/a \n\n# note\nhttps://h/a\nh2.org\nnonsense\nhttp://h3\n")
    lines = sources.read_seed_list(spark, str(tmp_path / "seeds.txt"))
    good, bad = seeds.split_seeds(lines)
    assert [r.url for r in good.orderBy("seed_id").collect()] == ["https://h/a", "https://h/a", "http://h3"]
    assert [r.url for r in bad.orderBy("seed_id").collect()] == ["# note", "h2.org", "nonsense"]
    candidates = seeds.candidate_seeds(lines)
    assert [r.url for r in candidates.orderBy("seed_id").collect()] == ["https://h/a", "h2.org", "nonsense", "http://h3"]
    probes = spark.createDataFrame([("https://h/a", 404, 200), ("https://h2.org", 301, None), ("https://nonsense", None, None), ("http://h3", 404, 404)],
                                   "url string, head_status int, get_status int")
    live = seeds.live_seeds(candidates, probes)
    sinks.append_live_seeds(live, str(tmp_path / "live"))
    sinks.append_live_seeds(live.limit(0), str(tmp_path / "live"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "live")).collect()) == ["h2.org", "https://h/a"]


def test_readers(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.md").write_text("abc")
    (tmp_path / "tree/sub/b.pdf").write_text("de")
    found = sources.read_inventory(spark, str(tmp_path / "tree"), below=f"{tmp_path}/")
    assert sorted(tuple(r) for r in found.collect()) == [("tree/a.md", 3), ("tree/sub/b.pdf", 2)]
    assert sources.read_log(spark, str(tmp_path / "none")).isEmpty() and sources.read_ledger(spark, str(tmp_path / "none")).isEmpty()
    assert sources.read_failures(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "failed.json").write_text(json.dumps([{"status": "failed", "reason": "r", "file_path": "p"}, {"file_path": "q", "file_size": 3}]))
    assert sorted((r.file_path, r.reason, r.file_size) for r in sources.read_failures(spark, str(tmp_path / "failed.json")).collect()) == [("p", "r", None), ("q", None, 3)]
    (tmp_path / "bad.json").write_text("[{")
    assert sources.read_failures(spark, str(tmp_path / "bad.json")).isEmpty()
    documents = {"good": {"version": 1, "last_run_timestamp": "2025-04-07T17:25:14.393034", "uploaded_files": ["x.md", "y.md"]},
                 "missing": {"version": 1, "uploaded_files": ["x"]}, "wrong": {"version": 1, "last_run_timestamp": None, "uploaded_files": "x"}}
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=2))
    ledger = {name: [r.file_path for r in sources.read_ledger_document(spark, str(tmp_path / f"{name}.json")).collect()] for name in [*documents, "bad", "none"]}
    assert ledger == {"good": ["x.md", "y.md"], "missing": [], "wrong": [], "bad": [], "none": []}


def test_runs(spark, tmp_path):
    for job, status, start in (("a", "running", "2025-01-01T00:00:00"), ("b", "running", "2025-01-03T00:00:00"), ("c", "stopped", None)):
        (tmp_path / f"{job}.json").write_text(json.dumps({"job_id": job, "status": status, "start_time": start, "cmd_args": ["x"], "pid": 1}, indent=2))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "a.log").write_text("x")
    found = runs.reconcile(sources.read_runs(spark, str(tmp_path)), spark.createDataFrame([("b",)], "job_id string"))
    assert [(r.job_id, r.status) for r in runs.newest_first(found).collect()] == [("b", "running"), ("a", "completed"), ("c", "stopped")]
    assert runs.find_run(found, "zz").isEmpty() and runs.find_run(found, "a").first().status == "completed"
    stopped = {r.job_id: r.status for r in runs.stop_run(found, "b").collect()}
    assert stopped == {"a": "completed", "b": "stopped", "c": "stopped"}


def test_markdown_and_attempt_tables(spark, tmp_path):
    rows = spark.createDataFrame([("o/h", "a.md", "x"), ("o/h2/s", "b.md", "y")], "dir string, filename string, markdown string")
    sinks.write_markdown(rows, str(tmp_path / "md"))
    assert {(r.host, r.markdown) for r in spark.read.parquet(str(tmp_path / "md")).collect()} == {("h", "x"), ("h2", "y")}
    attempts = spark.createDataFrame([("r1", datetime(2025, 1, 1), "a", "failed", "x", None, 1, None)], ATTEMPTS)
    sinks.append_attempts(attempts, str(tmp_path / "attempts"))
    sinks.append_attempts(attempts.withColumn("run_id", F.lit("r2")), str(tmp_path / "attempts"))
    assert spark.read.parquet(str(tmp_path / "attempts")).count() == 2
