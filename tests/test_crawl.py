"""The crawl against a plain first-in first-out queue."""

import random
from collections import deque

import pytest

from webcorpus.operators.robots import robots_policies, with_robots
from webcorpus.plans.crawl import crawl, fetchable_pages, link_graph, parse_archive
from webcorpus.plans.site_run import run_sites, settle_paths
from webcorpus.sinks.tables import document_parts, export_tree


def graph_of(spark, edges):
    """edges: url -> list of targets, for every page that can be fetched."""
    rows = [(url, i, [(p, t) for p, t in enumerate(targets, 1)]) for i, (url, targets) in enumerate(sorted(edges.items()))]
    return spark.createDataFrame(rows, "url string, page_id long, targets array<struct<pos:int,target:string>>")


def fifo(seed, edges, cap):
    queue, seen, got = deque([seed]), {seed}, []
    while queue and (not cap or len(got) < cap):
        url = queue.popleft()
        if url in edges:
            got.append(url)
            for target in edges[url]:
                if target not in seen:
                    seen.add(target)
                    queue.append(target)
    return got


def crawled(spark, seeds, edges, cap):
    rows = crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), graph_of(spark, edges), cap).collect()
    out = {}
    for row in sorted(rows, key=lambda r: (r.site, r.fifo_rank)):
        out.setdefault(row.site, []).append(row.url)
    return out


@pytest.mark.parametrize("cap", [0, 7])
def test_random_graphs_match_a_queue(spark, cap):
    rng = random.Random(cap)
    names = [f"https://h{h}/p{i}" for h in range(3) for i in range(40)]
    edges = {n: [f"{n.rsplit('/', 1)[0]}/p{rng.randrange(60)}" for _ in range(rng.randrange(5))] for n in names if rng.random() < 0.85}
    seeds = ["https://h0/p0", "https://h1/p1", "https://h0/p5", "https://h2/p2"]
    expected = {s: got for s in seeds if (got := fifo(s, edges, cap))}
    assert crawled(spark, seeds, edges, cap) == expected


def test_cycle_two_parents_failed_page_and_invalid_seed(spark):
    edges = {"https://h/": ["https://h/a", "https://h/b", "https://h/gone"], "https://h/a": ["https://h/c", "https://h/"], "https://h/b": ["https://h/c", "https://h/d"],
             "https://h/c": [], "https://h/d": []}
    found = crawled(spark, ["https://h", "not a url"], edges, 0)
    assert found == {"https://h": ["https://h/", "https://h/a", "https://h/b", "https://h/c", "https://h/d"]}
    assert crawled(spark, ["https://h"], edges, 2) == {"https://h": ["https://h/", "https://h/a"]}
    assert crawled(spark, ["nothing"], edges, 2) == {}


def test_wide_levels_are_ranked_over_many_chunks(spark):
    """More parents than one chunk holds, each with children: ranks stay dense and in order."""
    edges = {"https://h/": [f"https://h/{i}" for i in range(2500)]}
    edges |= {f"https://h/{i}": [f"https://h/{i}/x"] for i in range(2500)}
    edges |= {f"https://h/{i}/x": [] for i in range(2500)}
    assert crawled(spark, ["https://h/"], edges, 0)["https://h/"] == fifo("https://h/", edges, 0)


def test_archive_to_graph(spark):
    pages = spark.createDataFrame(
        [(1, "https://h/?a", '<a href="/b">'), (2, "https://h/", "<p>later copy"), (3, "https://h/b/", '<a href="/f.pdf">'), (4, "https://h/e", ""), (5, "https://h/no", "<p>x")],
        "page_id long, url string, html string")
    robots = spark.createDataFrame([("https://h", 200, "User-agent: *\nDisallow: /no")], "origin string, fetch_status int, body string")
    fetchable = fetchable_pages(pages, robots_policies(robots))
    assert sorted((r.page_id, r.url) for r in fetchable.collect()) == [(1, "https://h/"), (3, "https://h/b")]
    graph, files = link_graph(parse_archive(fetchable))
    assert {r.url: [t.target for t in r.targets or []] for r in graph.collect()} == {"https://h/": ["https://h/b"], "https://h/b": []}
    assert [(r.page_id, r.file_url) for r in files.collect()] == [(3, "https://h/f.pdf")]


def test_robots(spark):
    bodies = [
        ("https://a", 200, "User-agent: *\nAllow: /en/1\nDisallow: /en/"), ("https://b", 200, "User-agent: *\nDisallow: /en/\nAllow: /en/1"),
        ("https://c", 200, "User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow:"), ("https://d", 403, None), ("https://e", 500, ""), ("https://f", 404, ""), ("https://g", None, None),
        ("https://q", 200, "User-agent: *\nDisallow: /a?x"),
    ]
    policies = robots_policies(spark.createDataFrame(bodies, "origin string, fetch_status int, body string"))
    cases = {"https://a/en/12": True, "https://a/en/2": False, "https://a/fr": True, "https://b/en/12": False, "https://c/x": True, "https://d/": False,
             "https://e/": False, "https://f/": True, "https://g/": True, "https://unknown/": True, "https://q/a?x=1": False, "https://q/a": True}
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.allowed for r in with_robots(urls, policies).collect()} == cases


def test_whole_run_and_export(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "https://h/", '<h1>Home</h1><a href="/About">a</a><a href="/about">b</a><a href="/r.pdf">r</a>'), (2, "https://h/About", "<p>one"), (3, "https://h/about", "<p>two")],
        "page_id long, url string, html string")
    run = run_sites(spark.createDataFrame([("https://h",), ("https://none",)], "url string"), pages, output_dir="o")
    assert [(r.file_url, r.local_path) for r in run.files.collect()] == [("https://h/r.pdf", "o/h/files/r.pdf")]
    stats = {r.site: (r.pages_scraped, r.pages_converted, r.files_downloaded) for r in run.stats.collect()}
    assert stats == {"https://h": (3, 3, 1), "https://none": (0, 0, 0), None: (3, 3, 1)}
    kept, lost = settle_paths(run.markdown)
    assert [r.url for r in lost.collect()] == ["https://h/About"]
    export_tree(document_parts(kept, run.sections()), str(tmp_path))
    assert (tmp_path / "o/h/about.md").read_text() == "two"
    assert (tmp_path / "o/h/index.md").read_text() == (
        "# Home\n\n[a](/About)[b](/about)[r](/r.pdf)\n\n## Downloaded Files\n\n- [r.pdf](files/r.pdf)\n")


def test_files_by_links_and_run_without_seeds(spark):
    pages = spark.createDataFrame([(1, "https://h/", '<p>x</p><a href="/a"></a>'), (2, "https://h/a", '<p>y</p><a href="/r.pdf"></a>')], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://h",)], "url string")
    for match, owners in (("text", ["https://h/"]), ("links", ["https://h/a"])):
        run = run_sites(seeds, pages, output_dir="o", match=match)
        assert [r.page_url for r in run.sections().collect()] == owners
    bare = run_sites(seeds, pages, output_dir="o", download_files=False)
    assert bare.files.isEmpty() and bare.stats.filter("is_total = 1").first().pages_converted == 2
    with pytest.raises(ValueError):
        run_sites(seeds.limit(0), pages)


def test_a_larger_cap_only_adds_pages(spark):
    edges = {f"https://h/{i}": [f"https://h/{(i * 3 + j) % 50}" for j in range(3)] for i in range(50)}
    found = [crawled(spark, ["https://h/0"], edges, cap)["https://h/0"] for cap in (1, 5, 20)]
    assert [len(f) for f in found] == [1, 5, 20] and found[0] == found[1][:1] and found[1] == found[2][:5]


def test_many_seeds_of_one_host_share_file_urls(spark):
    pages = spark.createDataFrame([(i, f"https://h/{i}", f'<p>z<a href="/{i + 1}"></a><a href="/r.pdf"></a>') for i in range(4)], "page_id long, url string, html string")
    run = run_sites(spark.createDataFrame([(f"https://h/{i}",) for i in range(4)], "url string"), pages, output_dir="o")
    assert sorted(r.filename for r in run.files.collect()) == ["r.pdf", "r_1.pdf", "r_2.pdf", "r_3.pdf"]
    assert {r.site: r.pages_scraped for r in run.stats.filter("is_total = 0").collect()} == {f"https://h/{i}": 4 - i for i in range(4)}


def test_a_level_shuffles_only_its_own_rows(spark, monkeypatch):
    """Between the graph, or the pages of all levels, and the join that reads them stands no exchange."""
    from webcorpus.plans import crawl as module

    plans, plain = [], module.next_queue

    def recorded(reached, graph, depth, max_pages):
        queue = plain(reached, graph, depth, max_pages)
        plans.append(queue.join(graph.select("url", "page_id"), "url")._jdf.queryExecution().executedPlan().toString())
        return queue

    monkeypatch.setattr(module, "next_queue", recorded)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = {f"https://h/{i}": [f"https://h/{2 * i + 1}", f"https://h/{2 * i + 2}"] for i in range(20)}
        assert crawled(spark, ["https://h/0"], edges, 0)["https://h/0"] == fifo("https://h/0", edges, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plans[2].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = 0
    for i, line in enumerate(lines):
        if "FileScan" in line and ("crawl_graph" in line or "PartitionFilters: []" in line):
            at, above = depth[i], []
            for j in range(i, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    above.append(lines[j])
                    if "Join" in lines[j]:
                        break
            assert "Join" in above[-1] and not any("Exchange" in x for x in above)
            scans += 1
    assert scans == 3


def test_a_capped_run_parses_the_pages_it_reaches_only(spark, monkeypatch):
    from webcorpus.plans import crawl as module

    parsed, plain = spark.sparkContext.accumulator(0), module.parse_archive

    def counted(fetchable):
        def count(batches):
            for batch in batches:
                parsed.add(batch.num_rows)
                yield batch

        return plain(fetchable.mapInArrow(count, fetchable.schema))

    monkeypatch.setattr(module, "parse_archive", counted)
    rows = [(h * 100 + i, f"https://h{h}/{i}", f'<p>p{i}<a href="/{2 * i + 1}"></a><a href="/{2 * i + 2}"></a><a href="/f{i}.pdf"></a>') for h in range(3) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://h0/0",), ("https://h1/3",), ("https://h0/1",)], "url string")
    run = run_sites(seeds, pages, output_dir="o", max_pages_per_site=7)
    crawled = run.crawl.collect()
    edges = {f"https://h{h}/{i}": [f"https://h{h}/{2 * i + 1}", f"https://h{h}/{2 * i + 2}"] for h in range(3) for i in range(60)}
    for seed in ("https://h0/0", "https://h1/3", "https://h0/1"):
        assert [r.url for r in sorted(crawled, key=lambda r: r.fifo_rank) if r.site == seed] == fifo(seed, edges, 7)
    assert parsed.value == len({r.page_id for r in crawled}) < 21
    assert {r.site: (r.pages_converted, r.files_downloaded) for r in run.stats.collect()} == {s: (7, 7) for s in ("https://h0/0", "https://h1/3", "https://h0/1")} | {None: (21, 21)}
