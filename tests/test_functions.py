"""Column functions against tables of edge cases."""

from urllib.parse import quote, unquote, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from webcorpus.functions import paths, urls

NORMALIZED = {
    "HTTP://Ex.org:80/A;p=1/B;q/": ("http://Ex.org:80/A;p=1/B;q", True),
    "https://h.org/a;x": ("https://h.org/a", True),
    "https://h.org": ("https://h.org/", True),
    "https://h.org//": ("https://h.org/", True),
    "http://h.org/;p": ("http://h.org/", True),
    "http://h.org/a?b=/c/#d": ("http://h.org/a", True),
    "http://u:p@H.org:8080/x;": ("http://u:p@H.org:8080/x", True),
    "nothing": ("://nothing", False),
    "//h.org/x": ("://h.org/x", False),
    " \thttp://h.org/a\nb": ("http://h.org/ab", True),
    "http://h.org/a b": ("http://h.org/a b", True),
    "http://[::1]:8/x/": ("http://[::1]:8/x", True),
    "http://[bad/x": (None, False),
    "": (":///", False),
}


def test_normalize_and_validate(evaluate):
    inputs = [(u,) for u in NORMALIZED]
    assert evaluate(urls.normalize_url, inputs) == [n for n, _ in NORMALIZED.values()]
    assert evaluate(urls.is_valid_url, inputs) == [v for _, v in NORMALIZED.values()]


def test_null_url_is_invalid(evaluate):
    assert evaluate(urls.is_valid_url, [(None,)]) == [False]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"https?://[a-zA-Z0-9.:]{1,8}[/;a-z?#=&% ]{0,12}", fullmatch=True), min_size=20, max_size=20))
def test_normalize_agrees_with_the_standard_parser_and_is_idempotent(evaluate, samples):
    expected = []
    for u in samples:
        p = urlparse(u)
        expected.append(f"{p.scheme}://{p.netloc}{p.path.rstrip('/') or '/'}")
    once = evaluate(urls.normalize_url, [(u,) for u in samples])
    assert once == expected
    # A path segment may carry parameters after parameters; only stable results are normal forms.
    stable = [n for n in once if ";" not in n]
    if stable:
        assert evaluate(urls.normalize_url, [(n,) for n in stable]) == stable


def test_same_domain(evaluate):
    pairs = [("http://h.org/a", "https://h.org/b"), ("http://h.org", "http://www.h.org"), ("http://h.org", "http://H.org"), ("http://h.org", "http://h.org:443")]
    assert evaluate(urls.is_same_domain, pairs) == [True, False, False, False]


DOWNLOADS = {
    "https://h/a.PDF": True, "https://h/a.pdf?x=1": True, "https://h/other-local-documents": True, "https://document.h/": True,
    "https://h/download/report": False, "https://h/download/doctor": True, "https://h/get?file=a.csv": True,
    "https://h/profile/me": False, "https://h/img/a.png": False, "https://h/a.pdfx": False, "https://h/a.json/": False,
}


def test_downloadable(evaluate):
    assert evaluate(urls.is_downloadable, [(u,) for u in DOWNLOADS]) == list(DOWNLOADS.values())


def test_default_scheme(evaluate):
    assert evaluate(urls.with_default_scheme, [("h.org",), ("http://h",), ("https://h",), ("ftp://h",)]) == [
        "https://h.org", "http://h", "https://h", "https://ftp://h"]


def test_robots_key_agrees_with_the_standard_library(evaluate):
    samples = ["https://h/a b?x=1&y=é#f", "https://h", "https://h/%7Euser/%2Fx", "https://h/a+b", "https://h/a?", "https://h/ü/"]

    def expected(url):
        p = urlparse(unquote(url))
        return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"

    assert evaluate(urls.robots_key, [(s,) for s in samples]) == [expected(s) for s in samples]


LAYOUT = {
    "https://h": ("o/h", "index.md"), "https://h/about": ("o/h", "about.md"), "https://h/about/team": ("o/h/about", "team.md"),
    "https://h/en/176.html": ("o/h/en", "176-html.md"), "https://h/A B/c": ("o/h/a-b", "c.md"), "https://h/a%20b": ("o/h", "a-20b.md"),
    "https://h/Über/Straße": ("o/h/uber", "strasse.md"), "https://h/1,000": ("o/h", "1000.md"), "https://h/a//b/": ("o/h/a", "b.md"),
}


def test_layout(evaluate):
    inputs = [(u,) for u in LAYOUT]
    assert evaluate(lambda u: paths.markdown_dir(u, "o"), inputs) == [d for d, _ in LAYOUT.values()]
    assert evaluate(paths.markdown_name, inputs) == [n for _, n in LAYOUT.values()]


def test_other_scripts_stay_distinct(evaluate):
    made = evaluate(paths.slug, [("привет",), ("пока",), ("日本",)])
    assert len(set(made)) == 3 and all(m.isascii() and m for m in made)


def test_file_names(evaluate):
    inputs = [("https://h/f/bad:name*.pdf", None), ("https://h/get/report", "application/pdf; charset=x"), ("https://h/", "x/y"),
              ("https://h/get/a.pdf/", "TEXT/PLAIN"), ("https://h/v1.2/", None)]
    assert evaluate(paths.file_name, inputs) == ["bad_name_.pdf", "report.pdf", "file", "a.pdf.txt", "v1.2"]


def test_extension(evaluate):
    table = {"d/a.tar.gz": ".gz", ".hidden": "", "x": "", "..a": "", "a.": ".", "A.PDF": ".pdf", "d.d/x": ""}
    assert evaluate(paths.extension, [(p,) for p in table]) == list(table.values())
    assert evaluate(paths.extension_bucket, [("x",)]) == ["no_extension"]


def test_relative_path(evaluate):
    import os

    pairs = [("o/h/files/a.pdf", "o/h"), ("o/h/files/a.pdf", "o/h/en/x"), ("o/h/files/a", "o/h/files/b"), ("o/h/files/a", "o/h/files/a"),
             ("o/h", "o/h/x/y")]
    assert evaluate(paths.relative_path, pairs) == [os.path.relpath(p, s) for p, s in pairs]


@pytest.mark.parametrize("seconds,text", [("0", "00:00"), ("59.9", "00:59"), ("3599", "59:59"), ("3600", "01:00:00"), ("360000", "100:00:00")])
def test_duration(evaluate, seconds, text):
    assert evaluate(lambda c: paths.duration_text(c.cast("double")), [(seconds,)]) == [text]
