"""URL column functions. All are native expressions, so filters on them stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import DOCUMENT_EXTENSIONS, PARAM_SCHEMES, URL_RE

_LEADING_JUNK = "".join(map(chr, range(0x21)))
_EXTENSIONS = "|".join(ext[1:] for ext in DOCUMENT_EXTENSIONS)


def clean_url(url: Column) -> Column:
    """Drop leading control characters and blanks, and tabs and newlines anywhere."""
    return F.translate(F.ltrim(url, F.lit(_LEADING_JUNK)), "\t\r\n", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(clean_url(url), URL_RE, group)


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_netloc(url: Column) -> Column:
    """Authority with its case, port and user info as written."""
    return _part(url, 2)


def url_path(url: Column) -> Column:
    """Path without the last segment's ;parameters."""
    path = _part(url, 3)
    return F.when(url_scheme(url).isin(*PARAM_SCHEMES), F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)


def url_request(url: Column) -> Column:
    """Everything after the authority: path, ?query and #fragment, empty ones left out."""
    query, fragment = _part(url, 4), _part(url, 5)
    return F.concat(
        _part(url, 3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def url_origin(url: Column) -> Column:
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def _parses(netloc: Column) -> Column:
    # Brackets are legal only around one IPv6 (or vN.) literal.
    return ~netloc.rlike("[\\[\\]]") | netloc.rlike(
        "^(?:[^\\[\\]]*@)?\\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\\[\\]]*)?|[vV][0-9A-Fa-f]+[.][^\\[\\]]+)\\](?::[^\\[\\]]*)?$"
    )


def is_valid_url(url: Column) -> Column:
    """True iff the URL parses and has both a scheme and an authority."""
    netloc = url_netloc(url)
    return F.coalesce((url_scheme(url) != "") & (netloc != "") & _parses(netloc), F.lit(False))


def normalize_url(url: Column) -> Column:
    """scheme://netloc/path without trailing slashes, query, fragment or parameters.

    The host's case is kept. NULL for an authority that does not parse.
    """
    netloc = url_netloc(url)
    path = F.rtrim(url_path(url), F.lit("/"))
    return F.when(
        _parses(netloc),
        F.concat(url_scheme(url), F.lit("://"), netloc, F.when(path == "", "/").otherwise(path)),
    )


def is_same_domain(url: Column, base: Column) -> Column:
    return url_netloc(url) == url_netloc(base)


def is_downloadable(url: Column) -> Column:
    """True for document files: by path extension, or by telling words in the whole URL."""
    text = F.lower(url)
    return (
        F.lower(url_path(url)).rlike(f"[.](?:{_EXTENSIONS})$")
        | text.contains("document")
        | (text.rlike("download|file") & text.rlike(f"[.](?:{_EXTENSIONS})|pdf|doc|excel"))
    )


def with_default_scheme(url: Column) -> Column:
    """The URL to probe: https:// is put before anything without http:// or https://."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def robots_key(url: Column) -> Column:
    """What robots rules are matched against: the request, percent-decoded and re-encoded."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    request = url_request(F.when(url.contains("%"), decoded).otherwise(url))
    quoted = F.array_join(
        F.transform(
            F.split(request, ""),
            lambda c: F.when(c.rlike("^[A-Za-z0-9_.~/-]?$"), c).otherwise(
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    key = F.when(request.rlike("^[A-Za-z0-9_.~/-]*$"), request).otherwise(quoted)
    return F.when(key == "", "/").otherwise(key)
