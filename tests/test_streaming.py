"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from webcorpus.operators.logs import parse_log
from webcorpus.plans.delivery_run import deliver
from webcorpus.sinks.tables import append_ledger
from webcorpus.sources.tables import read_ledger
from webcorpus.streaming import follow, log_tail

LINES = [f"2025-01-01 00:0{i % 6}:00,000 - INFO - {m}{i % 4}.md" for i, m in enumerate(
    ["Successfully uploaded u/", "Failed to upload u/", "Skipping image file: u/", "Successfully uploaded: "] * 6)]


def rotate(folder, chunks):
    folder.mkdir()
    for i, chunk in enumerate(chunks):
        (folder / f"log-{i}.txt").write_text("\n".join(chunk) + "\n")


def test_following_a_log(spark, tmp_path):
    rotate(tmp_path / "in", [LINES[:10], LINES[10:]])
    follow.write_stream(follow.follow_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "in/log-9.txt").write_text(LINES[0] + "\n")  # arrives later; only it is read
    follow.write_stream(follow.follow_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = parse_log(spark.createDataFrame([(v,) for v in LINES + LINES[:1]], "value string"))
    columns = ["ts", "kind", "file_path"]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_running_counts(spark, tmp_path):
    rotate(tmp_path / "in", [LINES[:10], LINES[10:]])
    counts = follow.running_counts(follow.follow_log(spark, str(tmp_path / "in")), "1 hour")
    follow.write_stream(counts, str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    batch = parse_log(spark.createDataFrame([(v,) for v in LINES], "value string")).filter("kind <> 'other'")
    expected = {(r.kind, r.n) for r in batch.groupBy("kind").agg(F.count_distinct("file_path").alias("n")).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected


def test_deliveries_go_to_the_ledger_once(spark, tmp_path):
    schema = "file_path string, size long"
    parts = [[("a.md", 1), ("b.png", 1), ("c.pdf", 1), ("old.md", 1), ("a.md", 1)], [("a.md", 1), ("d.txt", 1), ("fails.md", 1)], [("fails.md", 1), ("e.md", 1)]]
    ledger, attempts = str(tmp_path / "ledger"), str(tmp_path / "attempts")
    append_ledger(spark.createDataFrame([("old.md", None)], "file_path string, first_uploaded_at timestamp"), ledger)
    asked = []

    def send(files):
        asked.append(sorted(r.file_path for r in files.collect()))
        code = F.when((F.col("file_path") == "fails.md") & F.lit(len(asked) == 2), 500).otherwise(200)
        return files.selectExpr("'r' as run_id", "timestamp '2025-01-01' as ts", "file_path", "cast(null as string) as response", "cast(null as string) as error", "size",
                                "0D as started", "1D as ended").withColumn("http_status", code)

    when = F.lit("2025-01-01").cast("timestamp")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        follow.stream_delivery(stream, send, ledger, attempts, "r", when, str(tmp_path / "state"))
    assert asked == [["a.md", "c.pdf"], ["d.txt", "fails.md"], ["e.md", "fails.md"]]
    deliver(spark.createDataFrame(parts[1], schema), send, ledger, attempts, "r", when, "1")  # the second batch again, as after a failure
    assert asked[3] == ["d.txt"]  # what it delivered itself is asked for again; the rest is known
    assert sorted(r.file_path for r in read_ledger(spark, ledger).collect()) == ["a.md", "c.pdf", "d.txt", "e.md", "fails.md", "old.md"]
    sent = spark.read.parquet(attempts).filter("status <> 'skipped'").collect()
    assert sorted((r.batch, r.file_path, r.status) for r in sent) == [
        ("r-0", "a.md", "success"), ("r-0", "c.pdf", "success"), ("r-1", "d.txt", "success"), ("r-2", "e.md", "success"), ("r-2", "fails.md", "success")]


def test_appended_bytes_last_lines_and_replaced_files(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.log").write_text("a0\na1\na2\na3 begins")
    (folder / "b.log").write_text("b0\n")
    (folder / ".hidden").write_text("x\n")

    def run(**options):
        before = set(map(tuple, spark.read.parquet(out).collect())) if (tmp_path / "out").exists() else set()
        follow.write_stream(follow.tail_lines(spark, str(folder), **options).select("file", "offset", "value"), out, state)
        return sorted(v for _, _, v in set(map(tuple, spark.read.parquet(out).collect())) - before)

    assert run(last=2) == ["a1", "a2", "b0"]
    with open(folder / "a.log", "a") as log:
        log.write(" and ends\na4\n")
    (folder / "c.log").write_text("c0\nc1\n")
    assert run(last=2) == ["a3 begins and ends", "a4", "c0", "c1"]
    assert run(last=2) == []
    (folder / "a.log").write_text("new\n")
    assert run(last=2) == ["new"]
    assert follow.tail_lines(spark, str(tmp_path / "none")).isStreaming


def test_ranges_of_a_file_give_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(log_tail, "_RANGE", 7)
    monkeypatch.setattr(log_tail, "_BLOCK", 5)
    lines = ["", "x", "a longer line than a range", "é", "", "end"]
    (tmp_path / "l").write_text("\n".join(lines) + "\nopen")
    reader = log_tail.LogTailReader(str(tmp_path / "l"), None)
    end = reader.latestOffset()
    found = [r for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in found] == lines and len({r["offset"] for r in found}) == len(lines)
    for n in range(8):
        start = log_tail.LogTailReader(str(tmp_path / "l"), n).initialOffset()
        found = [r["value"] for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        assert found == lines[len(lines) - min(n, len(lines)):]
