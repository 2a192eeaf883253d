"""SQL for DuckDB that the corpus queries must agree with, where SQL can say the same."""

SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurrences AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p,
                  1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
           FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table),
occurrences AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
written AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS digits FROM occurrences WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT),
                              lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h FROM written, bits),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
without AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT w.word, w.n, x.word, x.n FROM words w JOIN without x ON x.rest = w.word
         UNION SELECT x.word, x.n, w.word, w.n FROM words w JOIN without x ON x.rest = w.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.root WHERE e.form IS NULL
"""

URL_FILTERS = r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS written FROM rests),
parts AS (SELECT page_id, translate(written, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(written) + 1), '^[^?#]*') AS path FROM hosts),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(verdict, host, path)),
fits AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

# --- records of op9, in SQL that Spark and DuckDB both read ---------------------------------------------

RECORDS_A_PAGE = 8
#: A page as it is crawled. A third of all pages stand under one url, in several spellings; one in fifty has none.
CRAWL_FIELDS = (
    "page_id",
    """CASE WHEN page_id % 3 = 0 THEN concat('https://www.Front.example.org/news/?utm_source=', CAST(page_id % 9 AS STRING), '#top')
       WHEN page_id % 50 = 1 THEN NULL ELSE url END AS url""",
    "md5(coalesce(html, '')) AS tag",
    "md5(concat('second ', coalesce(html, ''))) AS second_tag",
    "length(coalesce(html, '')) AS size",
    "1700000000 + page_id * 60 AS crawled",
)
#: n: 0 response, 1 revisit soon after, 2 revisit with another tag, 3 revisit a day later, 4 second response with a new tag,
#: 5 revisit before the response, 6 failed response, 7 metadata.
RECORD_EXISTS = "CASE n WHEN 2 THEN page_id % 5 = 0 WHEN 4 THEN page_id % 6 = 1 WHEN 5 THEN page_id % 7 = 0 WHEN 6 THEN page_id % 8 = 2 WHEN 7 THEN page_id % 11 = 0 ELSE true END"
_AT = "crawled + CASE n WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 172800 WHEN 3 THEN 86400 WHEN 4 THEN 43200 WHEN 5 THEN -3600 WHEN 6 THEN 35 ELSE 1 END"
_LINE = "concat(chr(13), chr(10), '{}: ', {})"
_DATE, _TYPE = _LINE.format("Date", f"CAST({_AT} AS STRING)"), _LINE.format("Content-Type", "'text/html'")
_SIZE, _AGE = _LINE.format("Content-Length", "CAST(size AS STRING)"), _LINE.format("Cache-Control", "concat('max-age=', CAST(60 * (n + 1) AS STRING))")
_CHANGED = _LINE.format("Last-Modified", "CAST(crawled - 60 AS STRING)")
_TAG, _SECOND, _OTHER = (_LINE.format("ETag", f"""concat('"', {tag}, '"')""") for tag in ("tag", "second_tag", "'other'"))
_WEAK = _LINE.format("etag", """concat('W/"', tag, '"')""")
RECORD_FIELDS = (
    "page_id * 8 + n AS record_id",
    "url AS target_uri",
    f"{_AT} AS warc_date",
    "CASE WHEN n IN (0, 4, 6) THEN 'response' WHEN n = 7 THEN 'metadata' ELSE 'revisit' END AS warc_type",
    f"""CASE WHEN n = 0 THEN concat('HTTP/1.1 200 OK', {_DATE}, {_TAG}, {_CHANGED}, {_TYPE}, {_SIZE}, {_AGE}, chr(13), chr(10))
       WHEN n = 1 THEN concat('HTTP/1.1 304 Not Modified', {_DATE}, CASE page_id % 4 WHEN 0 THEN {_WEAK} WHEN 1 THEN {_CHANGED} ELSE '' END, {_AGE})
       WHEN n = 2 THEN concat('HTTP/1.1 304 Not Modified', {_OTHER}, {_DATE}) WHEN n = 3 THEN concat('HTTP/1.1 304 Not Modified', {_TAG}, {_SIZE})
       WHEN n = 4 THEN concat('HTTP/1.1 200 OK', {_SECOND}, {_DATE}, {_TYPE}) WHEN n = 5 THEN 'HTTP/1.1 304 Not Modified'
       WHEN n = 6 THEN concat('HTTP/1.1 503 Service Unavailable', {_DATE}) END AS http_head""",
    "CASE WHEN n = 4 THEN concat('md5:', second_tag) WHEN n < 6 THEN concat('md5:', tag) END AS payload_digest",
)

WARC_REVISITS = rf"""
WITH crawls AS (SELECT {', '.join(CRAWL_FIELDS)} FROM pages),
records AS (SELECT {', '.join(RECORD_FIELDS)} FROM (SELECT *, unnest(range({RECORDS_A_PAGE})) AS n FROM crawls) WHERE {RECORD_EXISTS}),
rests AS (SELECT *, CASE WHEN regexp_matches(target_uri, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(target_uri, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) END AS rest FROM records),
named AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[.]|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/$', '') AS place,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)[?](.*)$', 1), '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&') AS query FROM rests),
parsed AS (SELECT record_id, warc_date, warc_type, payload_digest, CASE WHEN query <> '' THEN place || '?' || query ELSE place END AS canonical_url,
             CAST(nullif(regexp_extract(http_head, '^HTTP/[0-9.]+ ([0-9]{{3}})', 1), '') AS INTEGER) AS status, warc_date::HUGEINT * 1000000000000 + record_id AS place_in_time,
             list_transform(list_filter(string_split(replace(coalesce(http_head, ''), chr(13) || chr(10), chr(10)), chr(10))[2:], lambda x: instr(x, ':') > 1),
               lambda x: {{name: lower(trim(split_part(x, ':', 1))), value: trim(x[instr(x, ':') + 1:])}}) AS headers FROM named),
facts AS (SELECT *, ltrim(list_filter(headers, lambda h: h.name = 'etag')[1].value, 'W/') AS etag, list_filter(headers, lambda h: h.name = 'last-modified')[1].value AS modified,
            list_filter(headers, lambda h: h.name IN ('age', 'cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary', 'warning')) AS sent FROM parsed),
stored AS (SELECT * FROM facts WHERE warc_type = 'response' AND status = 200 AND canonical_url IS NOT NULL),
joined AS (SELECT f.*, s.record_id AS stored_id, s.headers AS stored_headers, s.payload_digest AS stored_digest,
             CASE WHEN f.warc_type = 'response' THEN 'full' WHEN f.warc_type <> 'revisit' THEN 'other' WHEN f.canonical_url IS NULL THEN 'no_url' WHEN s.record_id IS NULL THEN 'no_response'
               WHEN CASE WHEN f.etag IS NOT NULL THEN f.etag IS NOT DISTINCT FROM s.etag WHEN f.modified IS NOT NULL THEN f.modified IS NOT DISTINCT FROM s.modified
                    ELSE f.payload_digest = s.payload_digest END THEN 'resolved' ELSE 'mismatch' END AS resolution
           FROM facts f ASOF LEFT JOIN stored s ON f.canonical_url = s.canonical_url AND f.place_in_time > s.place_in_time),
merged AS (SELECT *, CASE WHEN resolution = 'resolved' THEN list_concat(list_filter(stored_headers, lambda h: NOT list_contains(list_transform(sent, lambda s: s.name), h.name)), sent)
             ELSE headers END AS shown FROM joined)
SELECT record_id, canonical_url, warc_type, resolution, CASE resolution WHEN 'full' THEN record_id WHEN 'resolved' THEN stored_id END AS source_record_id,
  CASE WHEN resolution = 'resolved' THEN 200 ELSE status END AS status, CASE WHEN resolution = 'resolved' THEN stored_digest ELSE payload_digest END AS payload_digest,
  array_to_string(list_sort(list_transform(shown, lambda h: h.name || ': ' || h.value)), chr(10)) AS headers FROM merged
"""
