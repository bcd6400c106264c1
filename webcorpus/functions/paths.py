"""Path and text column functions: output layout, file names, extensions, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import (
    CONTENT_TYPE_EXTENSIONS,
    DELIVERABLE_LABELS,
    DELIVERABLE_MIME,
    FORBIDDEN_NAME_CHARS,
    IMAGE_LABELS,
    LATIN_DIGRAPHS,
    latin_fold,
)
from .urls import url_netloc, url_path

_FOLD_FROM, _FOLD_TO = latin_fold()


def slug(part: Column) -> Column:
    """Lower-case ASCII words joined by dashes.

    Exact for ASCII and for Latin letters with marks, composed or not, for
    typographic punctuation and the common named entities. A letter of any other
    script becomes the hex of its UTF-8 bytes: stable and unique, though not
    the romanisation a transliteration library would give.
    """
    text = F.regexp_replace(part, "&(?:amp|lt|gt|quot|nbsp);", "-")
    text = F.regexp_replace(text, "[\\u0300-\\u036F\\u2018-\\u201B]", "")  # combining marks; quotes within words
    text = F.regexp_replace(text, "[\\u2000-\\u206F]", "-")
    text = F.translate(text, _FOLD_FROM, _FOLD_TO)
    for letter, plain in LATIN_DIGRAPHS.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    foreign = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike("^[^\\x00-\\x7F]"), F.hex(F.encode(c, "UTF-8"))).otherwise(c),
        ),
        "",
    )
    text = F.when(text.rlike("[^\\x00-\\x7F]"), foreign).otherwise(text)
    text = F.regexp_replace(F.lower(text), "(?<=[0-9]),(?=[0-9])", "")
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def _segments(url: Column) -> Column:
    return F.split(F.btrim(url_path(url), F.lit("/")), "/")


def markdown_dir(url: Column, output_dir: str) -> Column:
    """Directory of a page's Markdown: the URL's own hierarchy, slugged."""
    parts = _segments(url)
    parents = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), slug), lambda s: s != "")
    return F.array_join(F.concat(F.array(F.lit(output_dir), url_netloc(url)), parents), "/")


def markdown_name(url: Column) -> Column:
    """File name of a page's Markdown; the site's root is index.md."""
    last = F.element_at(_segments(url), -1)
    return F.when(F.btrim(url_path(url), F.lit("/")) == "", "index.md").otherwise(
        F.concat(slug(last), F.lit(".md"))
    )


def files_dir(url: Column, output_dir: str) -> Column:
    return F.concat_ws("/", F.lit(output_dir), url_netloc(url), F.lit("files"))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small constant table, NULL if the key is not in it."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def file_name(url: Column, content_type: Column) -> Column:
    """Name a downloaded file asks for, before clashes are settled."""
    path = url_path(url)
    base = F.regexp_extract(path, "[^/]*$", 0)
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    stem = F.when(last == "", "file").otherwise(last)
    ext = F.coalesce(
        lookup(CONTENT_TYPE_EXTENSIONS, F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))),
        F.lit(""),
    )
    guessed = F.when(stem.endswith(ext), stem).otherwise(F.concat(stem, ext))
    return F.regexp_replace(F.when(base.contains("."), base).otherwise(guessed), FORBIDDEN_NAME_CHARS, "_")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def raw_extension(path: Column) -> Column:
    """From the last dot of the base name, as written; leading dots start no extension."""
    return F.regexp_extract(base_name(path), "(?s)^[.]*[^.].*?([.][^.]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def extension_bucket(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", "no_extension").otherwise(ext)


def mime_type(ext: Column) -> Column:
    return lookup(DELIVERABLE_MIME, ext)


def extension_label(ext: Column) -> Column:
    return lookup(DELIVERABLE_LABELS | IMAGE_LABELS, ext)


def relative_path(path: Column, start: Column) -> Column:
    """``path`` as seen from directory ``start``; both relative to one root."""
    there, here = F.split(path, "/"), F.split(start, "/")
    shared = F.aggregate(
        F.zip_with(there, here, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda acc, same: F.struct(
            (acc["n"] + F.when(acc["same"] & same, 1).otherwise(0)).alias("n"), (acc["same"] & same).alias("same")
        ),
        lambda acc: acc["n"],
    )
    steps = F.concat(
        F.array_repeat(F.lit(".."), F.size(here) - shared), F.slice(there, shared + 1, F.size(there))
    )
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def duration_text(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; fractions are cut."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))
