"""File names and page-file pairs against brute force, and both under skew."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from webcorpus.operators.files import file_sections, name_files, page_files, with_anchors
from webcorpus.operators.numbering import digest_chunk, running_total
from webcorpus.operators.skew import hot_keys, lookup_join


def one_by_one(urls):
    """Names in MD5 order: first the names nobody contests, then the numbered ones."""
    order = sorted(urls, key=lambda u: (hashlib.md5(f"{u} s".encode()).hexdigest(), u))
    names, later = {}, []
    for url in order:
        want = url.rsplit("/", 1)[1]
        if want in names.values():
            later.append((url, want))
        else:
            names[url] = want
    for url, want in later:
        base, ext = os.path.splitext(want)
        k = 1
        while f"{base}_{k}{ext}" in names.values():
            k += 1
        names[url] = f"{base}_{k}{ext}"
    return names


def named(spark, urls):
    df = spark.createDataFrame([("s", u, None) for u in urls], "site string, file_url string, content_type string")
    return {r.file_url: r.filename for r in name_files(df, "o").collect()}


def test_names_without_conflicts(spark):
    urls = [f"https://h/{i}/a.pdf" for i in range(3)] + ["https://h/x/b.pdf", "https://h/x/a.tar.gz", "https://h/y/a.tar.gz"]
    found = named(spark, urls)
    assert sorted(found.values()) == ["a.pdf", "a.tar.gz", "a.tar_1.gz", "a_1.pdf", "a_2.pdf", "b.pdf"]
    assert found == one_by_one(urls)


def test_names_skip_numbers_others_ask_for(spark):
    rng = random.Random(3)
    names = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_4.pdf", "a_1_1.pdf", "a_01.pdf", "b", "b_1", "b_3"]
    names = [n if "." in n else n + ".x" for n in names]
    urls = [f"https://h/{i}/{rng.choice(names[:2] if i % 2 else names)}" for i in range(120)]
    found = named(spark, urls)
    assert found == one_by_one(urls)
    assert len(set(found.values())) == len(urls)


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a", "b", "/", "rep", ".pdf", "?u=https://h", "://", " ", "'", "é", "<", "x" * 5]
    sites = {"s": "h", "t": "h2"}
    pages, files = [], []
    for i in range(60):
        site, host = rng.choice(list(sites.items()))
        url = f"{rng.choice(['http', 'https'])}://{host}/" + "".join(rng.choice(pieces[:4]) for _ in range(rng.randrange(4)))
        pages.append((site, i, url))
    for i in range(60):
        site, host = rng.choice(list(sites.items()))
        files.append((site, f"{rng.choice(['http', 'https', 'ftp'])}://{host}" + rng.choice(["", "/"]) + "".join(rng.choice(pieces) for _ in range(rng.randrange(7)))))
    long_file, long_page = "https://h/" + "l" * 3000 + ".pdf", "https://h/" + "m" * 2500
    files += [("s", long_file), ("s", long_page + "/z.pdf"), ("s", long_page[:-1] + "n.pdf")]
    pages += [("s", 100, long_page)]
    full = []
    for site, i, url in pages:
        texts = [rng.choice(files)[1] for _ in range(3)] + [rng.choice(pieces) for _ in range(3)] + (["(" + long_file + "y"] if i % 7 == 0 else [])
        rng.shuffle(texts)
        full.append((site, i, url, "x".join(texts)))
    files = sorted(set(files))
    pages = spark.createDataFrame(full, "site string, page_id long, page_url string, html string")
    found = page_files(with_anchors(pages, "page_url"), spark.createDataFrame(files, "site string, file_url string"), pages)
    expected = {(s, i, f) for s, i, u, html in full for t, f in files if s == t and (f in html or u in f)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 100


def test_sections_come_in_parts(spark):
    pages = spark.createDataFrame([("s", 1, "https://h/")], "site string, page_id long, page_url string")
    files = spark.createDataFrame([("s", f"https://h/{i}.pdf", f"o/h/files/{i}.pdf") for i in range(25)], "site string, file_url string, local_path string")
    pairs = files.select("site", F.lit(1).cast("long").alias("page_id"), "file_url")
    rows = file_sections(pairs, pages, files, "o", part_size=10).orderBy("part").collect()
    assert [r.n_files for r in rows] == [10, 10, 5]
    text = "".join(r.section for r in rows)
    assert text.startswith("\n\n## Downloaded Files\n\n- [") and text.count("\n- [") == 25


def test_running_total_of_a_hot_key(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.col("id").cast("string").alias("name"))
    out = running_total(rows, ["key"], digest_chunk(F.col("name")), [F.md5("name"), "name"], "n").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.key, []).append((hashlib.md5(r.name.encode()).hexdigest(), r.name, r.n))
    assert len(groups["hot"]) == 3000
    for members in groups.values():
        assert [n for *_, n in sorted(members)] == list(range(1, len(members) + 1))


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    left = lookup_join(rows, table, ["key"], ["id"])
    assert {(r.id, r.key, r.twice) for r in left.collect()} == {
        (i, 0 if i % 3 == 0 else i, 2 * (0 if i % 3 == 0 else i) if (i % 3 == 0 or i < 3000) else None) for i in range(6000)}
    assert left.count() == 6000


def test_lookup_join_reads_its_input_once_and_splits_hot_keys(spark):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, -1).otherwise(F.col("id")).alias("key"))
    table = spark.createDataFrame([(-1, "hot"), (-1, "twice"), (5, "five"), (None, "never")], "key long, name string")
    joined = lookup_join(rows.mapInArrow(count, rows.schema), table, ["key"], ["id"])
    found = joined.collect()
    assert passed.value == 40_000
    expected = {"hot": 13_333, "twice": 13_333, "five": 1, None: 40_000 - 13_333 - 1}
    names = [r.name for r in found]
    assert {n: names.count(n) for n in expected} == expected and len(found) == sum(expected.values())
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString() and joined.columns == ["key", "id", "name"]


def test_hot_keys_fill_more_than_a_partition():
    assert hot_keys([(7, 500), (8, 126), (9, 125), (10, 1)], 1000, 8) == [(7, 4), (8, 2)]
    assert hot_keys([], 0, 8) == []
