"""For each query, SQL that must give the same rows. ``{name}`` is a test table or one derived from them."""

from __future__ import annotations

from ..functions.fixed import (
    CONTENT_TYPE_EXTENSIONS,
    DELIVERABLE_LABELS,
    DELIVERABLE_MIME,
    DOCUMENT_EXTENSIONS,
    IMAGE_LABELS,
    LATIN_DIGRAPHS,
    URL_RE,
    latin_fold,
)
from .derived import with_tables

_EXT = "|".join(e[1:] for e in DOCUMENT_EXTENSIONS)


def _part(url, n):
    return f"regexp_extract({url}, '{URL_RE}', {n})"


def _path(url):
    return f"regexp_replace({_part(url, 3)}, ';[^/]*$', '')"


def _norm(url):
    path = f"rtrim({_path(url)}, '/')"
    return f"lower({_part(url, 1)}) || '://' || {_part(url, 2)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END"


def _is_file(url):
    return (
        f"(regexp_matches(lower({_path(url)}), '[.](?:{_EXT})$') OR contains(lower({url}), 'document') OR "
        f"(regexp_matches(lower({url}), 'download|file') AND regexp_matches(lower({url}), '[.](?:{_EXT})|pdf|doc|excel')))"
    )


def _case(column, table):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _slug(text):
    for letter, plain in LATIN_DIGRAPHS.items():
        text = f"replace({text}, '{letter}', '{plain}')"
    source, target = latin_fold()
    text = f"translate({text}, '{source}', '{target}')"
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


def _dir(url):
    segments = f"string_split(trim({_path(url)}, '/'), '/')"
    parents = f"[{_slug('s')} FOR s IN {segments}[:-2] IF {_slug('s')} <> '']"
    return f"array_to_string(list_concat(['corpus', {_part(url, 2)}], {parents}), '/')"


def _name(url):
    last = f"string_split(trim({_path(url)}, '/'), '/')[-1]"
    return f"CASE WHEN trim({_path(url)}, '/') = '' THEN 'index.md' ELSE {_slug(last)} || '.md' END"


_BASE_NAME = "regexp_extract(file_path, '[^/]*$', 0)"
_EXTENSION = f"lower(regexp_extract({_BASE_NAME}, '(?s)^[.]*[^.].*?([.][^.]*)$', 1))"
_LABELS = DELIVERABLE_LABELS | IMAGE_LABELS
_IMAGES = ", ".join(f"'{e}'" for e in IMAGE_LABELS)
_SENDABLE = ", ".join(f"'{e}'" for e in DELIVERABLE_MIME)

_CLASSIFIED = f"""
SELECT file_path, ext, CASE WHEN ext NOT IN ({_IMAGES}) AND ext IN ({_SENDABLE}) THEN 'eligible' ELSE 'skipped' END AS status,
       CASE WHEN ext IN ({_IMAGES}) THEN 'image file' WHEN ext NOT IN ({_SENDABLE}) THEN 'unsupported file type' END AS reason,
       {_case('ext', DELIVERABLE_MIME)} AS mime
FROM (SELECT file_path, {_EXTENSION} AS ext FROM {{inventory}}) e"""

_LINKS = """
SELECT page_id, base_url, generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS raw
FROM (SELECT page_id, scheme || '://' || host || path AS base_url, scheme || '://' || host AS origin,
             regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM {parts}) h"""

_RESOLVED = f"""
SELECT page_id, base_url, pos, resolved, {_norm('resolved')} AS norm
FROM (SELECT *, regexp_extract(base_url, '^[^/]*//[^/]*') || raw AS resolved FROM ({_LINKS}) l) r"""

_FILES = f"SELECT DISTINCT site, file_url, content_type FROM {{file_urls}} WHERE {_is_file('file_url')}"

_WANTED = f"""
SELECT site, file_url, 'corpus/' || {_part('file_url', 2)} || '/files' AS dir,
       regexp_replace(CASE WHEN contains(base, '.') THEN base WHEN ends_with(stem, ext) THEN stem ELSE stem || ext END,
                      '[<>:"/\\\\|?*]', '_', 'g') AS wanted
FROM (SELECT *, regexp_extract({_path('file_url')}, '[^/]*$', 0) AS base,
             coalesce(nullif(regexp_extract({_path('file_url')}, '([^/]+)/*$', 1), ''), 'file') AS stem,
             coalesce({_case("lower(string_split(content_type, ';')[1])", CONTENT_TYPE_EXTENSIONS)}, '') AS ext
      FROM ({_FILES}) f) g"""

# Number n of a wanted name; later ones take the free numbers in order.
_NAMED = f"""
wanted AS ({_WANTED}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dir, wanted ORDER BY md5(file_url || ' ' || site), file_url, site) AS n,
                    regexp_extract(wanted, '(?s)^[.]*[^.].*?([.][^.]*)$', 1) AS ext FROM wanted),
split AS (SELECT *, left(wanted, length(wanted) - length(ext)) AS base FROM numbered),
free AS (SELECT c.dir, c.wanted, c.k, row_number() OVER (PARTITION BY c.dir, c.wanted ORDER BY c.k) AS j
         FROM (SELECT dir, wanted, base, ext, unnest(generate_series(1, most + total)) AS k
               FROM (SELECT dir, wanted, any_value(base) AS base, any_value(ext) AS ext, max(n) AS most,
                            (SELECT count(*) FROM split) AS total FROM split GROUP BY dir, wanted HAVING max(n) > 1) m) c
         WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.n = 1 AND s.dir = c.dir AND s.wanted = c.base || '_' || c.k || c.ext)),
named AS (SELECT s.site, s.file_url, s.dir,
                 CASE WHEN s.n = 1 THEN s.wanted ELSE s.base || '_' || f.k || s.ext END AS filename
          FROM split s LEFT JOIN free f ON s.dir = f.dir AND s.wanted = f.wanted AND f.j = s.n - 1)"""

_PAIRS = """
pairs AS (SELECT m.page_id, m.page_url, n.file_url, n.filename,
                 repeat('../', len(string_split(trim(regexp_extract(m.page_url, '^[^/]*//[^/]*(.*)$', 1), '/'), '/')) - 1)
                   || 'files/' || n.filename AS rel_path
          FROM {mentions} m JOIN named n ON m.site = n.site
          WHERE contains(m.html, n.file_url) OR contains(n.file_url, m.page_url))"""

_REACHED = """
WITH RECURSIVE reached AS (
  SELECT host, k, 0 AS depth FROM {nodes} WHERE k = 1
  UNION ALL
  SELECT r.host, n.k, r.depth + 1 FROM reached r JOIN {nodes} n ON n.host = r.host AND n.k // 2 = r.k WHERE r.k % 7 <> 0),
fetched AS (SELECT r.host, r.k, r.depth, n.page_id, row_number() OVER (PARTITION BY r.host ORDER BY r.k) AS fifo_rank
            FROM reached r JOIN {nodes} n ON n.host = r.host AND n.k = r.k WHERE r.k % 7 <> 0)
"""
_CRAWLED = _REACHED + """
SELECT 'https://' || host || '/t/1' AS site, 'https://' || host || '/t/' || k AS url, CAST(depth AS INTEGER) AS depth,
       CAST(fifo_rank AS BIGINT) AS fifo_rank, page_id FROM fetched"""

_ATTEMPTS = """
SELECT run_id, ts, file_path, CASE WHEN http_status = 200 THEN 'success' ELSE 'failed' END AS status,
       CASE WHEN http_status IS NULL THEN error WHEN http_status <> 200 THEN 'API Error: ' || http_status END AS reason,
       CASE WHEN http_status <> 200 THEN response END AS response, size AS file_size,
       CASE WHEN http_status = 200 THEN ended - started END AS upload_duration FROM {responses}"""

_EVENT_KIND = """
SELECT event_id, ts, message, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped'
         WHEN 'click' THEN 'skipped' ELSE 'other' END AS kind,
       CASE event_type WHEN 'view' THEN 'image file' WHEN 'click' THEN 'unsupported file type' END AS reason,
       CASE event_type WHEN 'purchase' THEN 'u/' || user_id || '.md' WHEN 'error' THEN 'u/' || user_id || '.md'
         WHEN 'view' THEN 'u/' || user_id || '.png' WHEN 'click' THEN 'u/' || user_id || '.bin' END AS file_path
FROM {events} JOIN {event_log} USING (event_id, ts)"""

_EVENT_LOG = f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(CAST(floor(microsecond(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS ts,
       'INFO' AS level, kind, reason, file_path FROM ({_EVENT_KIND}) k"""

_DELIVERED = """
success AS (SELECT file_path, min(CASE run_id WHEN 'r1' THEN 0 ELSE 1 END * 10000000000 + doc_id) AS place,
                   arg_min(ended - started, run_id) AS upload_duration FROM {responses} WHERE http_status = 200 GROUP BY file_path),
skipped AS (SELECT i.file_path, i.doc_id AS place FROM {inventory} i
            WHERE i.doc_id NOT IN (SELECT doc_id FROM {first_run})),
failed AS (SELECT file_path, CASE run_id WHEN 'r1' THEN 0 ELSE 1 END * 10000000000 + doc_id AS place FROM {responses}
           WHERE http_status IS NULL OR http_status <> 200),
details AS (SELECT source, line_no, file_path, coalesce(reason, 'Unknown reason') AS reason, coalesce(response, '') AS response,
                   file_size FROM {failures}),
reasons AS (SELECT reason, count(*) AS files FROM details GROUP BY reason),"""

_HISTOGRAM = f"""
exts AS (SELECT CASE ext WHEN '' THEN 'no_extension' ELSE ext END AS ext, count(*) AS files
         FROM (SELECT {_EXTENSION} AS ext FROM {{present}}) e GROUP BY 1)"""


def _markdown():
    """Markdown of the test pages' one layout, by successive replacement."""
    steps = [
        ("(?s)^.*?<body>", ""), ("(?s)<!--.*?-->", ""),
        ('<li><a href="([^"]*)">([^<]*)</a></li>', r"* [\2](\1)" + "¶"), ("<nav><ul>|</ul></nav>", "§"),
        (r"<p><b>([^<]*?)\s*<br>", r"§**\1**§"), ("<h1>", "§# "), ("</?(p|h1|div|article|footer|body|html)( [^>]*)?>", "§"),
    ]
    text = "html"
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    text = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    text = f"regexp_replace({text}, '[ §¶]*§[ §¶]*', chr(10) || chr(10), 'g')"
    text = f"regexp_replace({text}, '¶', chr(10), 'g')"
    return f"trim({_decoded(text)}, ' ' || chr(10))"


def _decoded(text):
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


_SQL = {
    "url_normalize": f"""
SELECT page_id, lower({_part('url', 1)}) AS scheme, {_part('url', 2)} AS netloc, {_path('url')} AS path, {_norm('url')} AS norm
FROM {{pages}}""",
    "url_validate": f"""
SELECT origin, id, url, {_part('url', 1)} <> '' AND {_part('url', 2)} <> '' AS valid
FROM (SELECT 'page' AS origin, page_id AS id, url FROM {{pages}} UNION ALL SELECT 'document', doc_id, source FROM {{documents}}) u""",
    "url_canonical": f"""
SELECT norm, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {_norm('url')} AS norm FROM {{pages}}) p GROUP BY norm""",
    "url_download": f"SELECT page_id, file_url, {_is_file('file_url')} AS is_file FROM {{file_urls}}",
    "link_extract": f"SELECT page_id, 'a' AS source, pos, raw FROM ({_LINKS}) l",
    "link_resolve": f"""
SELECT page_id, pos, resolved, norm, CASE WHEN {_is_file('norm')} THEN 'file' ELSE 'page' END AS kind FROM ({_RESOLVED}) r""",
    "link_frontier": f"""
SELECT site, url, page_id, pos FROM (
  SELECT {_part('norm', 2)} AS site, norm AS url, page_id, pos,
         row_number() OVER (PARTITION BY norm ORDER BY page_id, pos) AS n
  FROM ({_RESOLVED}) r WHERE NOT {_is_file('norm')}) f
WHERE n = 1 AND url NOT IN (SELECT {_norm('url')} FROM {{pages}})""",
    "markdown_convert": f"""
SELECT page_id, trim(regexp_replace({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title,
       {_markdown()} AS markdown FROM {{pages}}""",
    "robots_filter": """
SELECT p.page_id, p.url, CASE WHEN r.policy = 'down' THEN false ELSE coalesce(arg_min(x.allow, x.pos), true) END AS allowed
FROM {parts} p JOIN {robots} r ON r.origin = p.scheme || '://' || p.host
LEFT JOIN (VALUES ('deny', 1, false, '/'), ('mixed', 1, true, '/en/1'), ('mixed', 2, false, '/en/')) x(policy, pos, allow, prefix)
  ON x.policy = r.policy AND starts_with(p.path, x.prefix)
GROUP BY p.page_id, p.url, r.policy""",
    "crawl_bfs": _CRAWLED + " WHERE fifo_rank <= 10",
    "crawl_uncapped": _CRAWLED,
    "site_stats": _REACHED + """,
kept AS (SELECT * FROM fetched WHERE fifo_rank <= 10 AND host NOT LIKE '%spam-farm%'),
timed AS (SELECT k.host, w.started, w.ended FROM kept k JOIN {nodes} n ON n.host = k.host AND n.k = k.k JOIN {web_fetches} w ON w.page_id = n.page_id),
busy AS (SELECT host, sum(greatest(ended - greatest(started, coalesce(reached, started)), 0)) AS busy, min(started) AS first, max(ended) AS last FROM
         (SELECT *, max(ended) OVER (PARTITION BY host ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM timed) t GROUP BY host),
sites AS (SELECT h.host, count(DISTINCT k.k) AS pages_scraped,
                 count(DISTINCT CASE WHEN k.k % 5 <> 1 THEN k.k % 5 END) AS files_downloaded
          FROM (SELECT DISTINCT host FROM {nodes}) h LEFT JOIN kept k ON h.host = k.host GROUP BY h.host)
SELECT 'https://' || host || '/t/1' AS site, 0 AS is_total, 1 AS websites_processed, CAST(sum(pages_scraped) AS BIGINT) AS pages_scraped,
       CAST(sum(pages_scraped) AS BIGINT) AS pages_converted, CAST(sum(files_downloaded) AS BIGINT) AS files_downloaded,
       coalesce(any_value(last - first), 0) AS duration_seconds, coalesce(any_value(busy), 0) AS busy_seconds
FROM sites LEFT JOIN busy USING (host) GROUP BY host
UNION ALL
SELECT NULL, 1, count(*), CAST(sum(pages_scraped) AS BIGINT), CAST(sum(pages_scraped) AS BIGINT), CAST(sum(files_downloaded) AS BIGINT),
       max(last) - min(first), sum(busy) FROM sites LEFT JOIN busy USING (host)""",
    "page_paths": f"SELECT page_id, {_dir('url')} AS dir, {_name('url')} AS filename FROM {{pages}}",
    "link_paths": f"""
SELECT norm AS url, {_dir('norm')} AS dir, {_name('norm')} AS filename FROM (SELECT DISTINCT norm FROM ({_RESOLVED}) r) l""",
    "path_collisions": f"""
SELECT page_id, dir, filename, row_number() OVER (PARTITION BY dir, filename ORDER BY page_id DESC) = 1 AS kept
FROM (SELECT page_id, {_dir('url')} AS dir, {_name('url')} AS filename FROM {{pages}}) p""",
    "file_names": f"""
WITH {_NAMED} SELECT site, file_url, dir, filename, dir || '/' || filename AS local_path FROM named""",
    "page_files": f"""
WITH {_NAMED}, {_PAIRS},
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5(file_url), file_url) AS n FROM pairs)
SELECT page_id, page_url, (n - 1) // 20 AS part, count(*) AS n_files,
       CASE WHEN (n - 1) // 20 = 0 THEN chr(10) || chr(10) || '## Downloaded Files' || chr(10) || chr(10) ELSE '' END
         || string_agg('- [' || filename || '](' || rel_path || ')' || chr(10), '' ORDER BY n) AS section
FROM placed GROUP BY page_id, page_url, (n - 1) // 20""",
    "page_file_links": f"WITH {_NAMED}, {_PAIRS} SELECT page_id, file_url, filename AS name, rel_path FROM pairs",
    "seed_scan": f"""
SELECT seed_id, trim(url) AS url, {_part('trim(url)', 1)} <> '' AND {_part('trim(url)', 2)} <> '' AS valid
FROM {{seed_lines}} WHERE trim(url) <> ''""",
    "seed_dedup": """
SELECT trim(url) AS url, min(seed_id) AS seed_id, count(*) AS copies FROM {seed_lines}
WHERE trim(url) <> '' AND trim(url) NOT LIKE '#%' GROUP BY 1""",
    "seed_liveness": """
SELECT seed_id, url FROM {candidates} c WHERE EXISTS (
  SELECT 1 FROM {probes} p WHERE p.url = CASE WHEN c.url LIKE 'http%://%' THEN c.url ELSE 'https://' || c.url END
    AND (p.head_status < 400 OR p.get_status < 400))""",
    "inventory_ext": f"""
SELECT ext, files, {_case('ext', _LABELS)} AS label FROM (
  SELECT CASE ext WHEN '' THEN 'no_extension' ELSE ext END AS ext, count(*) AS files
  FROM (SELECT {_EXTENSION} AS ext FROM {{inventory}}) e GROUP BY 1) h
UNION ALL SELECT '(total)', count(*), NULL FROM {{inventory}}""",
    "upload_classify": f"SELECT *, {_case('ext', _LABELS)} AS label FROM ({_CLASSIFIED}) c",
    "upload_select": "SELECT * FROM {inventory} WHERE file_path NOT IN (SELECT file_path FROM {ledger})",
    "upload_attempts": f"SELECT * EXCLUDE (ts) FROM ({_ATTEMPTS}) a",
    "attempts_round_trip": f"SELECT * EXCLUDE (ts) FROM ({_ATTEMPTS}) a",
    "log_round_trip": "SELECT row_number() OVER (ORDER BY source, line_no, value) - 1 AS line_no, value FROM {run_log}",
    "failures_round_trip": "SELECT file_path, reason, response, file_size, count(*) AS n FROM {failures} GROUP BY file_path, reason, response, file_size",
    "runs_round_trip": f"""
SELECT job_id, strftime(arg_min(ts, event_id), '%Y-%m-%d') AS start_time, arg_max(status, event_id) AS status FROM {{run_events}} GROUP BY job_id""",
    "tree_round_trip": f"""
SELECT dir || '/' || filename AS file_path, strlen(url || chr(10) || html) AS size, md5(url || chr(10) || html) AS content
FROM (SELECT *, {_dir('url')} AS dir, {_name('url')} AS filename FROM {{pages}} WHERE html <> '') p
QUALIFY row_number() OVER (PARTITION BY dir, filename ORDER BY page_id DESC) = 1""",
    "inventory_diff": """
SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'removed' ELSE 'resized' END AS change
FROM {inventory} a FULL JOIN (SELECT file_path, size + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS size FROM {present}
                              UNION ALL SELECT file_path, 1 FROM {ledger} WHERE file_path LIKE 'corpus/gone/%') b ON a.file_path = b.file_path
WHERE a.size IS DISTINCT FROM b.size""",
    "seeds_round_trip": """
SELECT url FROM {candidates} c WHERE EXISTS (
  SELECT 1 FROM {probes} p WHERE p.url = CASE WHEN c.url LIKE 'http%://%' THEN c.url ELSE 'https://' || c.url END
    AND (p.head_status < 400 OR p.get_status < 400))""",
    "ledger_round_trip": """
SELECT file_path, NULL AS first_day FROM {ledger} UNION ALL
SELECT file_path, strftime(min(ts), '%Y-%m-%d') FROM {responses}
WHERE http_status = 200 AND file_path NOT IN (SELECT file_path FROM {ledger}) GROUP BY file_path""",
    "upload_outcomes": f"""
SELECT run_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
       count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total
FROM (SELECT run_id, status FROM ({_ATTEMPTS}) a UNION ALL SELECT 'r1', status FROM ({_CLASSIFIED}) c WHERE status = 'skipped') u
GROUP BY run_id""",
    "ledger_merge": """
SELECT file_path, NULL AS first_day FROM {ledger} UNION ALL
SELECT file_path, strftime(min(ts), '%Y-%m-%d') FROM {responses}
WHERE http_status = 200 AND file_path NOT IN (SELECT file_path FROM {ledger}) GROUP BY file_path""",
    "ledger_validate": "SELECT file_path FROM {ledger} WHERE file_path NOT IN (SELECT file_path FROM {present})",
    "retry_candidates": f"""
SELECT a.file_path, run_id AS failed_in, a.reason AS failed_for, CASE WHEN p.file_path IS NULL THEN 'failed' ELSE 'eligible' END AS status,
       CASE WHEN p.file_path IS NULL THEN 'File no longer exists' END AS reason,
       CASE WHEN p.file_path IS NOT NULL THEN c.mime END AS mime
FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC) AS n FROM ({_ATTEMPTS}) t) a
LEFT JOIN {{present}} p ON a.file_path = p.file_path JOIN ({_CLASSIFIED}) c ON a.file_path = c.file_path
WHERE a.n = 1 AND a.status = 'failed'""",
    "log_parse": _EVENT_LOG,
    "log_success": f"""
SELECT file_path, min(event_id) AS first_line, count(*) AS lines FROM ({_EVENT_KIND}) k WHERE kind = 'success' GROUP BY file_path""",
    "log_tail": f"SELECT event_id, message FROM ({_EVENT_KIND}) k ORDER BY date_trunc('millisecond', ts) DESC, event_id DESC LIMIT 10",
    "run_log_parse": f"""
SELECT CASE run_id WHEN 'r1' THEN 0 ELSE 1 END AS source, r.doc_id AS line_no, CASE http_status WHEN 200 THEN 'success' ELSE 'failed' END AS kind,
       NULL AS reason, r.file_path, r.size AS file_size, CASE http_status WHEN 200 THEN ended - started END AS upload_duration
FROM {{responses}} r
UNION ALL
SELECT 0, i.doc_id, c.status, c.reason, c.file_path, NULL, NULL FROM ({_CLASSIFIED}) c JOIN {{inventory}} i ON i.file_path = c.file_path
WHERE c.status = 'skipped'""",
    "failure_reasons": "SELECT coalesce(reason, 'Unknown reason') AS reason, count(*) AS files FROM {failures} GROUP BY 1",
    "upload_rate": f"""
SELECT *, round(100.0 * succeeded / nullif(succeeded + failed, 0), 2)::DOUBLE AS rate
FROM (SELECT count(DISTINCT CASE status WHEN 'success' THEN file_path END) AS succeeded,
             count(*) FILTER (status = 'failed') AS failed FROM ({_ATTEMPTS}) a) c""",
    "upload_report": f"""
WITH {_DELIVERED} unused AS (SELECT 1)
SELECT 1 AS section, CAST(place // 10000000000 AS INTEGER) AS source, CAST(place % 10000000000 AS BIGINT) AS line_no, s.file_path AS "File Path", 'Success' AS "Status",
       '' AS "Reason", '' AS "Response", coalesce(p.size, 0) AS "File Size (bytes)", upload_duration AS "Upload Duration (s)"
FROM success s LEFT JOIN {{present}} p ON s.file_path = p.file_path
UNION ALL
SELECT 2, 0, place, s.file_path, 'Skipped', 'Unsupported or image file', '', coalesce(p.size, 0), NULL
FROM skipped s LEFT JOIN {{present}} p ON s.file_path = p.file_path
UNION ALL
SELECT 3, source, line_no, file_path, 'Failed', reason, response, file_size, NULL FROM details""",
    "upload_summary": f"""
WITH {_DELIVERED} {_HISTOGRAM},
n AS (SELECT (SELECT count(*) FROM success) AS s, (SELECT count(*) FROM failed) AS f, (SELECT count(*) FROM skipped) AS k)
SELECT section, ord, line FROM (VALUES (1, '1', '=== UPLOAD STATISTICS SUMMARY ==='), (1, '2', 'Generated: 2025-01-01 00:00:00'), (1, '3', ''),
  (2, '1', '=== FILES TO PROCESS ==='), (2, '3', ''), (3, '1', '=== FILE EXTENSIONS ==='), (5, '', ''), (5, '1', '=== UPLOAD RESULTS ==='),
  (5, '6', ''), (6, '2', ''), (7, '1', '=== FAILURE REASONS ==='), (9, '', ''), (9, '0', '=== NEXT STEPS ==='),
  (9, '1', 'To retry failed uploads, run the retry job.'), (9, '2', ''),
  (9, '3', 'Detailed results are available in the following files:'), (9, '4', '- CSV Report: r.csv'), (9, '5', '- JSON Stats: s.json'),
  (9, '6', '- Full Logs: a.txt and b.txt')) v(section, ord, line)
UNION ALL SELECT 2, '2', 'Total files in corpus directory: ' || count(*) FROM {{present}}
UNION ALL SELECT 4, ext, ext || ': ' || files || ' files' FROM exts
UNION ALL SELECT 5, '2', 'Successfully uploaded: ' || s FROM n
UNION ALL SELECT 5, '3', 'Failed uploads: ' || f FROM n
UNION ALL SELECT 5, '4', 'Skipped files: ' || k FROM n
UNION ALL SELECT 5, '5', 'Total files processed: ' || (s + f + k) FROM n
UNION ALL SELECT 6, '1', 'Success rate for uploadable files: ' || printf('%.2f', 100.0 * s / (s + f)) || '%' FROM n
UNION ALL SELECT 8, reason, reason || ': ' || files || ' files' FROM reasons""",
    "upload_stats": f"""
WITH {_DELIVERED} {_HISTOGRAM},
elements AS (
  SELECT 11 AS section, ext AS ord, '"' || ext || '": ' || files AS line FROM exts
  UNION ALL SELECT 16, lpad(CAST(place // 10000000000 AS VARCHAR), 20, '0') || '/' || lpad(CAST(place % 10000000000 AS VARCHAR), 20, '0'), '"' || file_path || '"' FROM success
  UNION ALL SELECT 18, lpad(CAST(place // 10000000000 AS VARCHAR), 20, '0') || '/' || lpad(CAST(place % 10000000000 AS VARCHAR), 20, '0'), '"' || file_path || '"' FROM failed
  UNION ALL SELECT 20, lpad('0', 20, '0') || '/' || lpad(CAST(place AS VARCHAR), 20, '0'), '"' || file_path || '"' FROM skipped
  UNION ALL SELECT 22, reason, '"' || reason || '": ' || files FROM reasons
  UNION ALL SELECT 24, lpad(CAST(source AS VARCHAR), 20, '0') || '/' || lpad(CAST(line_no AS VARCHAR), 20, '0'),
    printf('{{"file_path":"%s","reason":"%s","response":"%s","file_size":%d}}', file_path, reason, response, file_size) FROM details)
SELECT section, ord, CASE WHEN row_number() OVER (PARTITION BY section ORDER BY ord) = 1 THEN '' ELSE ',' END || line AS line FROM elements
UNION ALL SELECT 13, '', '}}, "total_files": ' || count(*) || '}},' FROM {{present}}
UNION ALL SELECT section, '', line FROM (VALUES (10, '{{"file_counts": {{"extension_counts": {{'),
  (14, '"supported_extensions": {{{", ".join(f'"{k}": "{v}"' for k, v in DELIVERABLE_LABELS.items())}}}, "skip_extensions": {{{", ".join(f'"{k}": "{v}"' for k, v in IMAGE_LABELS.items())}}},'),
  (15, '"successful_files": ['), (17, '], "failed_files": ['), (19, '], "skipped_files": ['),
  (21, '], "failure_analysis": {{"reason_counts": {{'), (23, '}}, "detailed_failures": ['),
  (25, ']}}, "timestamp": "2025-01-01 00:00:00"}}')) v(section, line)""",
    "runs_list": """
SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, max(status) FILTER (n = 1) AS status, count(*) AS events
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM {run_events}) e GROUP BY job_id""",
    "duration_format": """
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
                      ELSE printf('%02d:%02d', s // 60, s % 60) END AS duration
FROM (SELECT event_id, CAST(trunc(value * 60) AS BIGINT) AS s FROM {events}) e""",
    "stream_log": _EVENT_LOG,
    "stream_counts": f"SELECT kind, count(DISTINCT file_path) AS files FROM ({_EVENT_KIND}) k WHERE kind <> 'other' GROUP BY kind",
    "stream_ledger": f"""
SELECT file_path, count(*) AS n FROM (
  SELECT file_path FROM {{ledger}} UNION ALL
  SELECT file_path FROM ({_CLASSIFIED}) c WHERE status = 'eligible' AND file_path NOT IN (SELECT file_path FROM {{ledger}})) l GROUP BY file_path""",
    "stream_select": f"""
SELECT file_path, ext, mime FROM ({_CLASSIFIED}) c WHERE status = 'eligible' AND file_path NOT IN (SELECT file_path FROM {{ledger}})""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in _SQL.items()}
