"""Lead-shaped views over the given tables, in SQL that Spark and DuckDB both run.

All of them grow with the given tables. Copies, blanks, bad values and one company name that a
fifth of all leads share are put in on purpose.
"""

from __future__ import annotations

import re


BASE_TABLES = ("region", "nation", "customer", "orders", "lineitem", "documents", "pages")

_TEXT = "VARCHAR(20)"

VIEWS: dict[str, str] = {}

VIEWS["page_hosts"] = """
SELECT page_id, url, html, regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', '') AS host FROM pages"""

VIEWS["leads_raw"] = f"""
SELECT c.c_custkey AS row_index,
  CASE WHEN c.c_custkey % 53 = 0 THEN '  '
       WHEN c.c_custkey % 5 = 1 THEN 'Southern Cape Properties'
       WHEN c.c_custkey % 3 = 0 THEN concat('  GROUP ', CAST(CAST(floor(c.c_custkey / 16) AS BIGINT) AS {_TEXT}), '   Realty ')
       ELSE concat('Group ', CAST(CAST(floor(c.c_custkey / 16) AS BIGINT) AS {_TEXT}), ' Realty') END AS company_name,
  CASE WHEN c.c_custkey % 2 = 0 THEN concat('Agent  ', CAST(c.c_custkey AS {_TEXT})) END AS agent_name,
  CASE c.c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('HTTPS://www.', p.host, '//') WHEN 2 THEN 'bad site'
       WHEN 3 THEN 'nodots' ELSE p.url END AS website,
  CASE c.c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not-an-email' WHEN 2 THEN concat('burn', CAST(c.c_custkey AS {_TEXT}), '@mailinator.com')
       WHEN 3 THEN concat(' Info@', p.host) ELSE concat('Agent', CAST(c.c_custkey AS {_TEXT}), '@Example.com') END AS email,
  CASE c.c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '12' WHEN 2 THEN concat('082 555 0', lpad(CAST(c.c_custkey % 1000 AS {_TEXT}), 3, '0'))
       WHEN 3 THEN concat('+27 82 555 0', lpad(CAST(c.c_custkey % 1000 AS {_TEXT}), 3, '0')) WHEN 4 THEN '+999 1234 5678'
       WHEN 5 THEN '0044 20 7183 8750' WHEN 6 THEN '+27 (0)21 555 1234 ext 12' WHEN 7 THEN '1234567'
       WHEN 8 THEN '' WHEN 9 THEN CASE CAST(floor(c.c_custkey / 11) AS BIGINT) % 15 WHEN 0 THEN '+33 1 42 22 22 22' WHEN 1 THEN '+49 (0)151 2345 6789'
         WHEN 2 THEN '+55 11 91234-5678' WHEN 3 THEN '+351 21 123 4567' WHEN 4 THEN '+31 (0)20 624 1111' WHEN 5 THEN '+234 803 123 4567'
         WHEN 6 THEN '+44 21 1234 5678' WHEN 7 THEN '+1 911 555 2671' WHEN 8 THEN '+1 290 555 2671' WHEN 9 THEN '+1 (212) 155-2671'
         WHEN 10 THEN '+55 20 3234-5678' WHEN 11 THEN '+61 1 2345 6789' WHEN 12 THEN '00 27 59 123 4567' WHEN 13 THEN '+7 500 123 45 67' ELSE '+852 1234 5678' END
       ELSE '+1 (415) 555-2671' END AS phone,
  CASE c.c_custkey % 8 WHEN 0 THEN NULL WHEN 4 THEN 'SA' ELSE n.n_name END AS location,
  CASE WHEN c.c_custkey % 9 = 0 THEN 'input,google_maps' WHEN c.c_custkey % 9 = 1 THEN '' ELSE 'input' END AS source
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN page_hosts p ON p.page_id = c.c_custkey % (SELECT count(*) FROM pages)"""

VIEWS["site_pages"] = f"""
SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status_code,
  (page_id * 137) % 12000 AS elapsed_ms,
  replace(html, '</body>', concat(
    CASE WHEN page_id % 2 = 0 THEN concat('<p>Write Desk', CAST(page_id AS {_TEXT}), '@agency.example.com now</p>') ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN '<a href="mailto:info@agency.example.com?subject=hi">mail</a><a class=x href=''tel:+27 82 555 0199''>call</a>' ELSE '' END,
    CASE WHEN page_id % 20 = 10 THEN '<script>var open = "<!--";</script>' ELSE '' END,
    CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{{"email":"burn@mailinator.com","contactPoint":[{{"telephone":"+27 44 001 0004"}},7]}}</script>' ELSE '' END,
    CASE WHEN page_id % 20 = 10 THEN '<!-- <script type="application/ld+json">{{"email":"gone@comment.example.com"}}</script> -->' ELSE '' END,
    CASE WHEN page_id % 10 = 5 THEN '<script type="application/ld+json">[{{"telephone":"021 555 0000","contactPoint":{{"email":"ld@agency.example.com"}}}},null]</script><script type="application/ld+json">{{broken</script>' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<script src="https://widget.intercom.io/w/a"></script>' ELSE '' END,
    CASE WHEN page_id % 6 = 0 THEN '<footer>Last updated: Jan 2024</footer>' ELSE '' END,
    CASE WHEN page_id % 9 = 0 THEN '<p>desk&#64;entity.example.com or (021) 555 0101</p><!-- hidden@comment.example.com -->' ELSE '' END,
    CASE WHEN page_id % 7 < 3 THEN '<a href="/contact-us">c</a><a href="/about">a</a><a href="/contact-us">t</a><a href="/team">t</a><a href="/agents">g</a>' ELSE '' END,
    '</body>')) AS html
FROM pages
UNION ALL
SELECT page_id + 1000000000, concat('https://', host, '/contact-us'), CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END, 500,
  concat('<html><body><p>Desk', CAST(page_id AS {_TEXT}), '@contact.example.org or 021 555 0', lpad(CAST(page_id % 1000 AS {_TEXT}), 3, '0'),
    CASE WHEN page_id % 3 = 0 THEN ' updated daily' ELSE '' END, '</p></body></html>')
FROM page_hosts
UNION ALL
SELECT page_id + 2000000000, concat('https://www.group', CAST(page_id AS {_TEXT}), '.example.com/'), CASE WHEN page_id % 4 = 0 THEN 500 ELSE 200 END, 3000,
  replace(html, '</body>', concat('<p>hello@group', CAST(page_id AS {_TEXT}), '.example.com</p></body>'))
FROM pages"""

VIEWS["search_results"] = f"""
SELECT concat('Group ', CAST(CAST(floor(c_custkey / 16) AS BIGINT) AS {_TEXT}), ' Realty') AS company_name,
  CAST(c_custkey % 16 + 1 AS INT) AS rank,
  CASE WHEN c_custkey % 16 = 0 THEN 'https://www.facebook.com/page'
       WHEN c_custkey % 7 = 0 THEN concat('https://www.group', CAST(CAST(floor(c_custkey / 16) AS BIGINT) AS {_TEXT}), '.example.com/')
       WHEN c_custkey % 7 = 1 THEN 'http://gr.example.org' WHEN c_custkey % 7 = 2 THEN '' ELSE concat('news', CAST(c_custkey % 16 AS {_TEXT}), '.example.net/a') END AS link
FROM customer
UNION ALL
SELECT 'Southern Cape Properties', n_nationkey + 1,
  CASE n_nationkey WHEN 0 THEN 'https://www.linkedin.com/x' WHEN 1 THEN 'https://netflix.com/cape' WHEN 2 THEN 'scprop.example.org/home' ELSE concat('http://n', CAST(n_nationkey AS {_TEXT}), '.example.org') END
FROM nation"""

VIEWS["geocodes"] = """
SELECT n_name AS raw_location, CASE WHEN n_nationkey % 3 <> 0 THEN 1 ELSE 3 END AS rank, concat(n_name, ', South Africa') AS formatted_address FROM nation
UNION ALL SELECT n_name, 2, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE concat('Old ', n_name) END FROM nation"""

VIEWS["place_customers"] = f"""
SELECT c.c_custkey, n.n_nationkey, n.n_name,
  CASE WHEN c.c_custkey % 5 = 1 THEN 'Southern Cape Properties' ELSE concat('Group ', CAST(CAST(floor(c.c_custkey / 16) AS BIGINT) AS {_TEXT}), ' Realty') END AS company,
  CASE WHEN n.n_nationkey % 3 <> 0 THEN concat(n.n_name, ', South Africa') ELSE concat('Old ', n.n_name) END AS geo
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey"""

VIEWS["place_search"] = f"""
SELECT concat(g.company, ' ', g.geo) AS query, CASE WHEN g.n_nationkey = 7 THEN 9 ELSE CAST(g.c_custkey % 7 + 1 AS INT) END AS rank, concat('place-', CAST(g.c_custkey AS {_TEXT}), '-b') AS place_id,
  CASE g.c_custkey % 4 WHEN 0 THEN g.company WHEN 1 THEN concat('The ', g.company) WHEN 2 THEN 'Blue Door Estates' ELSE concat(g.company, ' Pty') END AS name,
  CASE WHEN g.c_custkey % 2 = 0 THEN concat('1 Main Rd, ', g.geo) ELSE concat('2 Side Rd, ', g.n_name) END AS formatted_address
FROM place_customers g
UNION ALL
SELECT g.company, CAST(g.c_custkey % 16 + 1 AS INT), CASE WHEN g.c_custkey % 31 = 0 THEN '' ELSE concat('place-', CAST(g.c_custkey AS {_TEXT}), '-a') END,
  CASE g.c_custkey % 4 WHEN 0 THEN 'Blue Door Estates' WHEN 1 THEN concat('The ', g.company) WHEN 2 THEN g.company ELSE concat(g.company, ' Pty') END,
  concat('3 High St, ', g.n_name)
FROM place_customers g"""

VIEWS["places"] = f"""
SELECT concat(CASE WHEN g.c_custkey % 10 = 9 THEN 'gone-' ELSE 'place-' END, CAST(g.c_custkey AS {_TEXT}), '-b') AS place_id, g.company AS name,
  CASE WHEN g.c_custkey % 9 <> 0 THEN concat('1 Main Rd, ', g.geo) ELSE ' ' END AS formatted_address,
  CASE WHEN g.c_custkey % 4 <> 0 THEN concat('https://www.place', CAST(g.c_custkey AS {_TEXT}), '.example.com/') END AS website_uri,
  CASE WHEN g.c_custkey % 6 <> 0 THEN '044 001 0004' ELSE '' END AS national_phone,
  CASE WHEN g.c_custkey % 5 = 0 THEN '+27 44 001 0004' END AS international_phone
FROM place_customers g
UNION ALL
SELECT concat('place-', CAST(g.c_custkey AS {_TEXT}), '-a'), g.company, concat('3 High St, ', g.n_name),
  concat('https://www.place', CAST(g.c_custkey AS {_TEXT}), '.example.com/'), '044 001 0005', NULL
FROM place_customers g"""

VIEWS["runs"] = f"""
SELECT concat('job-', CAST(o_orderkey AS {_TEXT})) AS job_id,
  CASE WHEN o_orderkey % 23 = 0 THEN 'terminated' WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'completed' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'csv' WHEN o_orderkey % 3 = 1 THEN 'json' ELSE 'listing' END AS input_format,
  CAST(o_orderkey % 701 AS BIGINT) AS total_rows, o_custkey AS custkey
FROM orders"""

VIEWS["run_batches"] = f"""
SELECT concat('job-', CAST(l_orderkey AS {_TEXT})) AS job_id, l_linenumber AS batch_index,
  (l_linenumber - 1) * 100 AS start_row, (l_linenumber - 1) * 100 + CAST(l_quantity AS INT) AS end_row,
  CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_linestatus = 'O' THEN 'completed' WHEN l_linenumber % 2 = 0 THEN 'pending' ELSE 'processing' END AS status,
  CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN CAST(l_quantity AS INT) ELSE 0 END AS processed_rows,
  l_shipdate AS written_at, l_partkey AS seq1, l_suppkey AS seq2
FROM lineitem"""

VIEWS["raw_records"] = f"""
SELECT c_custkey AS row_id,
  CASE c_custkey % 8
    WHEN 0 THEN concat('{{"Company":" ', c_name, ' ","contact_email":"a', CAST(c_custkey AS {_TEXT}), '@example.com","tel":"+27 82 555 0199"}}')
    WHEN 1 THEN concat('{{"company_name":"","company":"', c_name, '"}}')
    WHEN 2 THEN concat('{{"agency":"', c_name, '","phone":123,"mobile":"082 555 0199","lead_source":"', c_mktsegment, '"}}')
    WHEN 3 THEN concat('{{"BUSINESS":"', c_name, '","town":"T', CAST(c_nationkey AS {_TEXT}), '","city":" "}}')
    WHEN 4 THEN concat('{{" company ":"', c_name, '","email":null,"mail":"x@example.com","website":"bad site"}}')
    WHEN 5 THEN '[1,2]'
    WHEN 6 THEN concat('{{"listingcontext":"', c_name, '","url":"https://e', CAST(c_custkey AS {_TEXT}), '.example.com","province":"P","lead_score":"77"}}')
    ELSE concat('{{"agency_name":"', c_name, '","agent_name":"Ann","agent_phone":"0825550199","agent_email":"","email":"b', CAST(c_custkey AS {_TEXT}), '@example.com","source_site":"portal","location":"Here"}}') END AS record
FROM customer"""


def needed(sql: str, available: dict[str, str]) -> list[str]:
    """Names of `available` that `sql` uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for name in words & (available.keys() - found):
            found.add(name)
            todo.append(available[name])
    return [n for n in available if n in found]


def with_prefix(sql: str, available: dict[str, str]) -> str:
    names = [n for n in needed(sql, available)]
    return ("WITH " + ",\n".join(f"{n} AS ({available[n].strip()})" for n in names) + "\n" if names else "") + sql


#: Read as few large splits although each row makes much work: their rows are dealt to tasks by key first.
DEALT = {"customer": "c_custkey"}
_ANALYSED: dict[tuple[str, str, str], object] = {}


def view(spark, sf_dir: str, name: str):
    """One view (or given table) as a lazy Spark DataFrame; its analysed plan is kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ANALYSED:
        sql = with_prefix(f"SELECT * FROM {name}", VIEWS)
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", sql):
                df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                df = df.repartition(DEALT[table]) if table in DEALT else df
                df.createOrReplaceTempView(table)
        _ANALYSED[key] = spark.sql(sql)
    return _ANALYSED[key]
