"""Input tables derived from the test tables.

The test tables hold pages, documents, labels and events, but no file URLs,
robots files, inventories, ledgers, responses or logs. Those are derived from
whole tables here, by SQL that Spark and an ANSI SQL engine read alike, so
that a query and its check start from the same rows. ``{name}`` refers to a
test table or to another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import URL_RE

DERIVED = {
    # Pages with the parts of their URL.
    "parts": f"""
SELECT page_id, url, html, lower(regexp_extract(url, '{URL_RE}', 1)) AS scheme,
       regexp_extract(url, '{URL_RE}', 2) AS host,
       CASE WHEN trim(TRAILING '/' FROM x) = '' THEN '/' ELSE trim(TRAILING '/' FROM x) END AS path
FROM (SELECT *, regexp_replace(regexp_extract(url, '{URL_RE}', 3), ';[^/]*$', '') AS x FROM {{pages}}) t""",
    # Lines of a seed list: blanks around URLs, comments, empty lines, repeats, words that are no URL.
    "seed_lines": """
SELECT page_id AS seed_id, CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN '#' || url WHEN 2 THEN ' '
       WHEN 3 THEN scheme || '://' || host || '/' ELSE url END AS url FROM {parts}
UNION ALL SELECT 1000000000 + doc_id, source FROM {documents}""",
    # Candidate seeds, some without scheme, and what a probe of each answered.
    "candidates": """
SELECT page_id AS seed_id, CASE WHEN page_id % 3 = 0 AND scheme = 'https' THEN substr(url, 9) ELSE url END AS url
FROM {parts}""",
    "probes": """
SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 404 WHEN 4 THEN 301 END AS head_status,
       CASE page_id % 5 WHEN 1 THEN 200 WHEN 2 THEN 404 END AS get_status FROM {pages}""",
    # A file URL per page, not all of them documents.
    "file_urls": """
SELECT page_id, host AS site, scheme || '://' || host || CASE page_id % 8
         WHEN 0 THEN '/files/' || page_id || '/report.pdf'
         WHEN 1 THEN '/files/' || page_id || '/report_' || (page_id % 32) || '.pdf'
         WHEN 2 THEN '/download/annual' || page_id || '.XLSX'  WHEN 3 THEN '/document/' || page_id
         WHEN 4 THEN '/img/logo' || page_id || '.png'          WHEN 5 THEN '/files/bad:name*' || page_id || '.pdf'
         WHEN 6 THEN '/data/' || page_id || '.json?file=1'     ELSE path || '/annex' || page_id || '.pdf' END AS file_url,
       CASE page_id % 3 WHEN 0 THEN 'application/pdf; charset=x' WHEN 1 THEN 'TEXT/PLAIN' END AS content_type
FROM {parts}""",
    # Pages that name their file's URL in their text.
    "mentions": """
SELECT p.page_id, p.host AS site, p.scheme || '://' || p.host || p.path AS page_url,
       '<p>see ' || f.file_url || ', please</p>' || p.html AS html
FROM {parts} p JOIN {file_urls} f ON p.page_id = f.page_id""",
    # robots.txt of every origin.
    "robots": """
SELECT origin, CASE policy WHEN 'none' THEN 404 WHEN 'down' THEN 503 ELSE 200 END AS fetch_status,
       CASE policy WHEN 'deny' THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10)
                   WHEN 'mixed' THEN 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: * # all'
                     || chr(10) || 'Allow: /en/1' || chr(10) || 'Disallow: /en/' || chr(10) END AS body, policy
FROM (SELECT DISTINCT scheme || '://' || host AS origin,
        CASE WHEN host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' THEN 'deny' WHEN host LIKE '%casino%' THEN 'down'
             WHEN host LIKE 'blog.%' THEN 'none' ELSE 'mixed' END AS policy FROM {parts}) o""",
    # A link tree per host over its pages: page k links to 2k and 2k+1, back to
    # its parent and to a file; every seventh page failed to load. Some URLs
    # have a first copy without content.
    "nodes": """
SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k,
       count(*) OVER (PARTITION BY host) AS n FROM {parts}""",
    "web": """
SELECT page_id, 'https://' || host || '/t/' || k AS url, CASE WHEN k % 7 = 0 THEN '' ELSE
       CASE WHEN 2 * k <= n THEN '<a href="/t/' || (2 * k) || '/?from=' || k || '">left</a>' ELSE '' END ||
       CASE WHEN 2 * k + 1 <= n THEN '<a href="' || (2 * k + 1) || '#top">right</a>' ELSE '' END ||
       '<a href="../t/' || CAST(floor(k / 2) AS BIGINT) || '">up</a><a href="/get/paper' || (k % 5) || '.pdf?v=' || k ||
       '">paper</a>' || html END AS html FROM (SELECT n.*, p.html FROM {nodes} n JOIN {pages} p ON n.page_id = p.page_id) w
UNION ALL SELECT -1 - page_id, 'https://' || host || '/t/' || k || '/', CASE WHEN k % 2 = 0 THEN '' END FROM {nodes} WHERE k % 5 = 1""",
    # When each page was fetched, in seconds.
    "web_fetches": """
SELECT page_id, CAST(page_id * 7 % 5000 AS DOUBLE) AS started, page_id * 7 % 5000 + (page_id % 9 + 1) / CAST(4 AS DOUBLE) AS ended FROM {web}""",
    "web_seeds": "SELECT 'https://' || host || '/t/1' AS url FROM {nodes} WHERE k = 1",
    "web_robots": """
SELECT DISTINCT 'https://' || host AS origin, 200 AS fetch_status, 'User-agent: *' || chr(10) ||
       CASE WHEN host LIKE '%spam-farm%' THEN 'Disallow: /t' ELSE 'Disallow: /get/paper1' END AS body FROM {nodes}""",
    # Files on disk, before and after some have gone, and the ledger of those delivered.
    "inventory": """
SELECT doc_id, 'corpus/' || source || '/' || CASE doc_id % 10 WHEN 8 THEN '.hidden' ELSE '' END || doc_id ||
       CASE doc_id % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.png' WHEN 4 THEN '.JPG'
         WHEN 5 THEN '.csv' WHEN 6 THEN '' WHEN 7 THEN '.txt' WHEN 8 THEN '' ELSE '.tar.gz' END AS file_path,
       n_chars AS size FROM {documents}""",
    "present": """
SELECT i.file_path, i.size FROM {inventory} i LEFT JOIN {labels} l ON i.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0""",
    "ledger": """
SELECT i.file_path FROM {inventory} i JOIN {labels} l ON i.doc_id = l.doc_id WHERE l.quality = 1
UNION ALL SELECT 'corpus/gone/' || n_nationkey || '.md' FROM {nation}""",
    # Answers of a first run over all sendable files and of a retry of what failed.
    "first_run": """
SELECT 'r1' AS run_id, TIMESTAMP '2025-01-01 00:00:00' AS ts, doc_id, file_path,
       CASE doc_id % 11 WHEN 0 THEN 500 WHEN 1 THEN 413 WHEN 2 THEN NULL ELSE 200 END AS http_status,
       CASE doc_id % 11 WHEN 2 THEN NULL ELSE 'answer ' || doc_id % 11 END AS response,
       CASE WHEN doc_id % 11 = 2 THEN 'timeout' END AS error, size,
       CAST(doc_id % 97 AS DOUBLE) AS started, CAST(doc_id % 97 + doc_id % 40 / CAST(4 AS DOUBLE) AS DOUBLE) AS ended
FROM {inventory} WHERE file_path LIKE '%.md' OR file_path LIKE '%.pdf' OR file_path LIKE '%.docx' OR file_path LIKE '%.txt'""",
    "responses": """
SELECT * FROM {first_run}
UNION ALL
SELECT 'r2', TIMESTAMP '2025-01-02 00:00:00', doc_id, file_path, CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 500 END,
       'again', CAST(NULL AS STRING), size, started, ended
FROM {first_run} WHERE http_status IS NULL OR http_status <> 200""",
    # The log lines and failure records those runs leave.
    "run_log": """
SELECT CASE run_id WHEN 'r1' THEN 0 ELSE 1 END AS source, doc_id AS line_no,
       '2025-01-01 00:00:00,000 - INFO - ' || CASE WHEN http_status = 200
         THEN 'Successfully uploaded ' || file_path || ' (' || size || ' bytes) in ' || (ended - started) || 's'
         WHEN http_status IS NULL THEN 'Error uploading ' || file_path || ' (' || size || ' bytes): ' || error
         ELSE 'Failed to upload ' || file_path || ' (' || size || ' bytes). Status: ' || http_status || ', Response: ' || response
       END AS value FROM {responses}
UNION ALL
SELECT 0, doc_id, '2025-01-01 00:00:00,000 - INFO - ' || CASE WHEN lower(file_path) LIKE '%.png' OR lower(file_path) LIKE '%.jpg'
         THEN 'Skipping image file: ' ELSE 'Unsupported file type: ' END || file_path
FROM {inventory} i WHERE NOT EXISTS (SELECT 1 FROM {first_run} r WHERE r.doc_id = i.doc_id)""",
    "failures": """
SELECT CASE run_id WHEN 'r1' THEN 0 ELSE 1 END AS source, doc_id AS line_no, file_path,
       CASE WHEN http_status IS NULL THEN CASE WHEN doc_id % 4 = 0 THEN NULL ELSE error END
            ELSE 'API Error: ' || http_status END AS reason, response, size AS file_size
FROM {responses} WHERE http_status IS NULL OR http_status <> 200""",
    # A log of every event; the last arm is a count at the end of a run, not a path.
    "event_log": """
SELECT event_id, ts, CASE event_type
         WHEN 'purchase' THEN 'Successfully uploaded u/' || user_id || '.md'
         WHEN 'error' THEN 'Failed to upload u/' || user_id || '.md. Status: 500, Response: x'
         WHEN 'view' THEN 'Skipping image file: u/' || user_id || '.png'
         WHEN 'click' THEN 'Unsupported file type: u/' || user_id || '.bin'
         ELSE 'Successfully uploaded: ' || user_id END AS message FROM {events}""",
    "run_events": """
SELECT 'job' || user_id AS job_id, ts, event_id,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'stopped' ELSE 'running' END AS status FROM {events}""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one derived from them."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {ref: table(spark, sf_dir, ref) for ref in set(_REFERENCE.findall(DERIVED[name]))}
    return spark.sql(DERIVED[name], **inputs)


def with_tables(sql: str) -> str:
    """``sql`` for an ANSI SQL engine, the derived tables it names as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for ref in _REFERENCE.findall(text):
            if ref in DERIVED and ref not in needed:
                need(DERIVED[ref])
                needed.append(ref)

    need(sql)
    plain = lambda text: _REFERENCE.sub(r"\1", text).strip()
    ctes = [f"{name} AS (\n{plain(DERIVED[name])}\n)" for name in needed]
    body = plain(sql)
    for keyword in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(keyword):
            ctes.append(body[len(keyword):])
            return keyword + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
