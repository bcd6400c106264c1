"""Document files: names on disk, and the pages each file belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import with_once
from ..functions.paths import base_name, file_name, files_dir, markdown_dir, raw_extension, relative_path
from ..functions.urls import url_netloc
from ..session import materialize
from .numbering import digest_chunk, running_total
from .skew import lookup_join

_CHUNK = 65536


def distinct_files(links: DataFrame) -> DataFrame:
    """Every file of a site once, whichever pages link to it."""
    return links.filter("kind = 'file'").select("site", F.col("norm").alias("file_url")).distinct()


def _split_name(name: Column) -> tuple[Column, Column]:
    ext = raw_extension(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def name_files(files: DataFrame, output_dir: str) -> DataFrame:
    """Give each (site, file_url, content_type) its directory and a unique file name.

    Files asking for one name are taken in the order of the MD5 of their URL and
    site. The
    first keeps the name; the n-th takes ``base_k.ext`` with the n-th ``k`` that
    no other file of the directory asks for. Numbers are handed out by running
    totals, so one name wanted by any share of all files is no hot spot.
    """
    key = ["dir", "wanted"]
    wanted = materialize(
        with_once(
            files,
            dir=files_dir(F.col("file_url"), output_dir),
            wanted=file_name(F.col("file_url"), F.col("content_type")),
        ),
        "file-urls",
    )
    own = F.concat_ws(" ", "file_url", "site")  # also even when many sites share one URL
    numbered = materialize(
        running_total(wanted, key, digest_chunk(own), [F.md5(own), "file_url", "site"], "n"), "file-names"
    )
    base, ext = _split_name(F.col("wanted"))
    first = numbered.filter("n = 1").withColumn("filename", F.col("wanted"))
    later = numbered.filter("n > 1").withColumn("j", F.col("n") - 1)

    # Names asked for by others that look like base_k.ext of a name with clashes.
    stem = F.regexp_extract(base, "(?s)^(.*)_([1-9][0-9]{0,17})$", 1)
    taken = (
        first.select(
            "dir",
            F.concat(stem, ext).alias("wanted"),
            F.regexp_extract(base, "_([1-9][0-9]{0,17})$", 1).alias("digits"),
        )
        .filter("digits <> ''")
        .select(*key, F.col("digits").cast("long").alias("t"))
        .join(later.select(*key).distinct(), key, "left_semi")
    )
    if taken.isEmpty():
        later = later.withColumn("k", F.col("j"))
    else:
        # The i-th taken number t leaves t - i free numbers below it, so number j
        # moves up by the count of taken numbers with t - i < j.
        ranked = running_total(taken, key, F.floor(F.col("t") / _CHUNK), ["t"], "i")
        steps = later.select(*key, "file_url", "site", F.col("j").alias("v"), F.lit(0).alias("step")).unionByName(
            ranked.select(*key, (F.col("t") - F.col("i")).alias("v"), F.lit(1).alias("step")), allowMissingColumns=True
        )
        moved = running_total(steps, key, F.floor(F.col("v") / _CHUNK), ["v", "step"], "up", F.col("step"))
        later = later.join(
            moved.filter("step = 0").select("site", "file_url", (F.col("v") + F.col("up")).alias("k")), ["site", "file_url"]
        )
    later = later.withColumn("filename", F.concat(base, F.lit("_"), F.col("k").cast("string"), ext))
    columns = [*files.columns, "dir", "filename"]
    return (
        first.select(*columns)
        .unionByName(later.select(*columns))
        .withColumn("local_path", F.concat_ws("/", "dir", "filename"))
    )


# A URL found inside a text is looked up by what follows its "://": the text
# gives the prefixes of that rest that are as long as a URL of the site is, by
# hash, and an equi-join finds the URLs among them.
_RUN = "[A-Za-z0-9+.-]"
_PLAIN = "[^\\s\"'<>]"


def _anchors(text: Column, rest: str) -> Column:
    """scheme://rest at each "://" of the text, the scheme as long as it goes."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?<!{_RUN})(?=({_RUN}+://{rest}*))"), F.lit(1))


def _scheme(anchor: Column) -> Column:
    return F.substring_index(anchor, "://", 1)


def _rest(anchor: Column) -> Column:
    return F.substring(anchor, F.length(_scheme(anchor)) + 4, F.length(anchor))


def _lookup(probes: DataFrame, targets: DataFrame, spread_by: str) -> DataFrame:
    """Rows of ``probes`` and ``targets`` (both with site and rest) where the target's rest begins the probe's.

    A probe has one key for each length that a target of its site has, however
    long, so keys grow with the number of lengths and not of characters.
    """
    sizes = targets.groupBy("site").agg(F.collect_set(F.length("rest")).alias("_sizes"))
    keyed = probes.join(sizes, "site").withColumn("_size", F.explode(F.filter("_sizes", lambda n: n <= F.length("rest"))))
    keyed = keyed.withColumn("_key", F.xxhash64(F.substring(F.col("rest"), F.lit(1), F.col("_size")))).drop("_sizes", "_size")
    whole = targets.withColumnRenamed("rest", "_rest").withColumn("_key", F.xxhash64("_rest"))
    found = lookup_join(keyed, whole, ["site", "_key"], [spread_by], "inner")
    return found.filter(F.col("rest").startswith(F.col("_rest"))).drop("_key", "_rest")


def with_anchors(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``anchors``: where the HTML names an absolute URL of the page's own host, up to the next blank, quote or bracket."""
    hosted = with_once(pages, _host=url_netloc(F.col(url)))
    own = F.filter(_anchors(F.col("html"), _PLAIN), lambda anchor: _rest(anchor).startswith(F.col("_host")))
    return hosted.withColumn("anchors", F.array_distinct(own)).drop("_host")


def _files_in_html(tokens: DataFrame, html: DataFrame, files: DataFrame) -> DataFrame:
    targets = with_once(files.select("site", "file_url"), rest=_rest(F.col("file_url")))
    plain = F.col("rest").rlike(f"^{_PLAIN}*$")

    # A file URL without blanks, quotes or angle brackets is a prefix of a token.
    probes = tokens.select("site", "token").distinct().withColumn("rest", _rest(F.col("token")))
    # Short prefixes are shared by all tokens of a site, hence the salted join.
    hits = materialize(
        _lookup(probes, targets.filter(plain), "token")
        .filter(_scheme(F.col("token")).endswith(_scheme(F.col("file_url"))))
        .select("site", "token", "file_url")
        .distinct(),
        "hits",
    )
    found = lookup_join(tokens.select("site", "page_id", "token"), hits, ["site", "token"], ["page_id"], "inner")

    # Any other file URL starts with a whole token of the page; it is looked up
    # by that start and checked against the HTML.
    odd = targets.filter(~plain).withColumn("rest", F.regexp_extract("rest", f"^{_PLAIN}*", 0))
    starts = materialize(
        tokens.select("site", "page_id", _rest(F.col("token")).alias("rest"))
        .distinct()
        .join(odd, ["site", "rest"])
        .select("site", "page_id", "file_url"),
        "starts",
    )
    found = found.select("site", "page_id", "file_url")
    if starts.isEmpty():
        return found
    checked = starts.join(html.select("page_id", "html"), "page_id").filter(F.contains("html", "file_url"))
    return found.unionByName(checked.drop("html"))


def _pages_in_file_urls(pages: DataFrame, files: DataFrame) -> DataFrame:
    anchors = files.select("site", "file_url", F.explode(_anchors(F.col("file_url"), ".")).alias("anchor"))
    probes = anchors.select("site", "file_url", _scheme(F.col("anchor")).alias("scheme_run"), _rest(F.col("anchor")).alias("rest"))
    targets = pages.select("site", "page_id", "page_url", _rest(F.col("page_url")).alias("rest"))
    return (
        _lookup(probes, targets, "file_url")
        .filter(F.contains("file_url", "page_url"))
        .filter(F.col("scheme_run").endswith(_scheme(F.col("page_url"))))
        .select("site", "page_id", "file_url")
    )


def page_files(pages: DataFrame, files: DataFrame, html: DataFrame) -> DataFrame:
    """Pairs (site, page_id, file_url): the file's URL stands in the page's HTML, or the page's URL in the file's.

    ``pages``: site, page_id, page_url (normalised), anchors (see
    ``with_anchors``). ``files``: site, file_url; both of the site's own domain.
    Exact substring semantics without comparing every page of a site to every
    file. ``html`` (page_id, html) is looked at only for pages with the start of
    an unusual file URL, one with blanks, quotes or brackets.
    """
    hosts = with_once(pages.select("site", "page_id", "page_url", "anchors"), host=url_netloc(F.col("page_url")))
    tokens = materialize(hosts.select("site", "page_id", "host", F.explode("anchors").alias("token")), "tokens")
    owners = pages.select("site", "page_id", "page_url")
    return _files_in_html(tokens, html, files).unionByName(_pages_in_file_urls(owners, files)).distinct()


def file_sections(pairs: DataFrame, pages: DataFrame, files: DataFrame, output_dir: str, part_size: int = 1000) -> DataFrame:
    """The Markdown list of each page's files, in parts of ``part_size`` lines.

    Concatenating a page's parts in order gives its whole section. Lines are
    ordered by the MD5 of the file URL. A site's root page may own every file
    of the site; parts keep that page from becoming one row and one task.
    """
    key = ["site", "page_id"]
    named = lookup_join(pairs, files.select("site", "file_url", "local_path"), ["site", "file_url"], ["page_id"], "inner")
    places = with_once(pages.select(*key, "page_url"), md_dir=markdown_dir(F.col("page_url"), output_dir))
    placed = lookup_join(named, materialize(places, "places"), key, ["file_url"], "inner")
    line = F.concat(
        F.lit("- ["), base_name(F.col("local_path")), F.lit("]("), relative_path(F.col("local_path"), F.col("md_dir")), F.lit(")\n")
    )
    lines = materialize(with_once(placed, line=line).select(*key, "page_url", "file_url", "line"), "lines")
    numbered = running_total(lines, key, digest_chunk(F.col("file_url")), [F.md5("file_url"), "file_url"], "n")
    parts = (
        numbered.withColumn("part", F.floor((F.col("n") - 1) / part_size))
        .groupBy(*key, "page_url", "part")
        .agg(
            F.count("*").alias("n_files"),
            F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_lines"),
        )
    )
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "")
    head = F.when(F.col("part") == 0, "\n\n## Downloaded Files\n\n").otherwise("")
    return parts.select(*key, "page_url", "part", "n_files", F.concat(head, text).alias("section"))
