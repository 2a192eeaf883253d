"""What each registered query must return, written independently as DuckDB SQL over the same tables."""

from __future__ import annotations

from leadloom import constants as K
from workload.views import VIEWS, with_prefix

CTES: dict[str, str] = dict(VIEWS)
ORACLES: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def filled(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def squash(x: str) -> str:
    return f"regexp_replace({strip(x)}, '\\s+', ' ', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def site_key(x: str) -> str:
    return f"nullif(rtrim(ltrim(regexp_replace(lower({strip(x)}), '^https?://', ''), 'w.'), '/'), '')"


def url_key(x: str) -> str:
    return f"nullif(rtrim(regexp_replace({site_key(x)}, '#.*$', ''), '/'), '')"


def scheme(x: str) -> str:
    return f"CASE WHEN {filled(x)} IS NULL THEN NULL WHEN regexp_matches({strip(x)}, '^https?://') THEN {strip(x)} ELSE 'https://' || {strip(x)} END"


def some(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


# --- mapping -------------------------------------------------------------------------------------

_MAPPED = ", ".join(f"{filled(c)} AS {c}" for c in ("company_name", "agent_name", "website", "email", "phone", "location"))
CTES["mapped"] = f"SELECT row_index AS row_id, {_MAPPED}, coalesce({filled('source')}, 'input') AS source FROM leads_raw"

_REASON = """CASE WHEN company_name IS NULL THEN 'missing_required_identity'
  WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'invalid_email'
  WHEN phone IS NOT NULL AND length(regexp_replace(phone, '\\D', '', 'g')) < 7 THEN 'invalid_phone'
  WHEN website IS NOT NULL AND (contains(website, ' ') OR (NOT (starts_with(website, 'http://') OR starts_with(website, 'https://')) AND NOT contains(website, '.')))
    THEN 'invalid_website' END"""
CTES["checked"] = f"SELECT *, {_REASON} AS reject_reason FROM mapped"
CTES["norm"] = f"""SELECT row_id, {squash('company_name')} AS company_name, {squash('agent_name')} AS agent_name, {squash('location')} AS location,
  {site_key('website')} AS website, lower(email) AS email,
  CASE WHEN {digits('phone')} = '' THEN NULL WHEN starts_with(phone, '+') THEN '+' || {digits('phone')} ELSE {digits('phone')} END AS phone, source
FROM checked WHERE reject_reason IS NULL"""
CTES["keyed"] = """SELECT *, CASE WHEN website IS NOT NULL THEN 'website:' || rtrim(ltrim(regexp_replace(website, '^https?://', ''), 'w.'), '/')
  WHEN company_name IS NOT NULL THEN 'company:' || lower(company_name)
  WHEN coalesce(email, phone) IS NOT NULL THEN 'contact:' || coalesce(email, phone) ELSE 'unknown' END AS k FROM norm"""
CTES["clean"] = "SELECT * EXCLUDE (k, rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn FROM keyed) WHERE rn = 1"

ORACLES["rejected_rows"] = "SELECT row_id AS row_index, reject_reason AS reason FROM checked WHERE reject_reason IS NOT NULL"
ORACLES["reject_reasons"] = """SELECT reject_reason AS reason, count(*) AS rejected FROM checked WHERE reject_reason IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1"""
ORACLES["relaxed_mapping"] = "SELECT row_id, company_name, website, email, phone FROM mapped WHERE company_name IS NOT NULL"
ORACLES["normalize_contacts"] = "SELECT row_id, company_name, agent_name, website, email, phone, location FROM norm"
ORACLES["dedup_leads"] = "SELECT row_id, company_name, website, email, phone FROM clean"
ORACLES["dedup_leads_batch"] = """SELECT row_id, company_name, website, email FROM
(SELECT *, row_number() OVER (PARTITION BY row_id // 100, k ORDER BY row_id) AS rn FROM keyed) WHERE rn = 1"""

# records: keys are unnested, matched against the ranked alias list, and pivoted back
_ALIASES = ", ".join(
    f"({lit(f)}, {lit(a)}, {i})"
    for f in K.CANONICAL_FIELDS
    for i, a in enumerate(dict.fromkeys([f, *K.HEADER_ALIASES.get(f, ())]))
)
CTES["alias_rank"] = f"SELECT * FROM (VALUES {_ALIASES}) AS t(field, alias, pos)"


def _records_sql(source: str) -> str:
    fields = ("company_name", "agent_name", "website", "email", "phone", "location", "source", "lead_score")
    cols = ", ".join(
        f"max(CASE WHEN field = '{f}' THEN val END) AS {f}" if f != "source"
        else "coalesce(max(CASE WHEN field = 'source' THEN val END), 'input') AS source" for f in fields
    )
    return f"""
rec AS ({source}),
kv AS (SELECT row_id, lower(trim(k)) AS k, k AS raw_key, json_extract(j, '$."' || k || '"') AS v FROM (SELECT row_id, j, unnest(json_keys(j)) AS k FROM rec WHERE json_type(j) = 'OBJECT')),
ranked AS (SELECT row_id, field, CASE WHEN json_type(v) = 'VARCHAR' THEN {filled("json_extract_string(v, '$')")} END AS val,
  row_number() OVER (PARTITION BY row_id, field ORDER BY pos, raw_key DESC) AS rn FROM kv JOIN alias_rank ON alias = k),
wide AS (SELECT rec.row_id, any_value(json_type(j)) AS kind, {cols} FROM rec LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON r.row_id = rec.row_id GROUP BY rec.row_id),
out AS (SELECT *, CASE WHEN kind <> 'OBJECT' THEN 'invalid_record_type' ELSE {_REASON} END AS reject_reason FROM wide)
"""


def _records_oracle(source: str, columns: str) -> str:
    body = _records_sql(source)
    base = with_prefix("SELECT * FROM alias_rank, raw_records", CTES).split("SELECT * FROM alias_rank, raw_records")[0]
    return base.rstrip() + ",\n" + body.strip() + f"\nSELECT {columns} FROM out"


_LISTING = """SELECT row_id, CASE WHEN json_type(record::JSON) <> 'OBJECT' THEN record::JSON ELSE json_object(
  'company_name', record::JSON->'$.agency_name', 'agent_name', record::JSON->'$.agent_name', 'phone', record::JSON->'$.agent_phone',
  'email', CASE WHEN coalesce(record::JSON->>'$.agent_email', '') <> '' THEN record::JSON->'$.agent_email' ELSE record::JSON->'$.email' END,
  'source', CASE WHEN coalesce(record::JSON->>'$.source_site', '') <> '' THEN record::JSON->'$.source_site' ELSE record::JSON->'$.source' END) END AS j FROM raw_records"""

# --- contacts --------------------------------------------------------------------------------------

_PLANS = ", ".join(f"({lit(r)}, {lit(c)}, {lit(t)}, {lit(i)}, {lit(s)})" for r, c, t, i, s in K.PHONE_PLANS)
CTES["regions"] = f"SELECT * FROM (VALUES {_PLANS}) AS t(region, code, trunk, idd, ranges)"
CTES["plan_parts"] = "SELECT code, unnest(string_split(ranges, ' ')) AS part FROM regions"
CTES["plan_spans"] = """SELECT code, unnest(string_split(CASE WHEN contains(part, '/') THEN split_part(part, '/', 1) ELSE '' END, ',')) AS area,
  split_part(regexp_replace(part, '^.*/', ''), ':', 1) AS span, split_part(part, ':', 2) AS lengths FROM plan_parts"""
CTES["plan_rows"] = """SELECT code, split_part(area, '-', 1) AS area_low, split_part(area, '-', CASE WHEN contains(area, '-') THEN 2 ELSE 1 END) AS area_high,
  split_part(span, '-', 1) AS low, split_part(span, '-', CASE WHEN contains(span, '-') THEN 2 ELSE 1 END) AS high,
  split_part(lengths, '-', 1)::INT AS least, split_part(lengths, '-', CASE WHEN contains(lengths, '-') THEN 2 ELSE 1 END)::INT AS most FROM plan_spans"""


def _phones(name: str, source: str) -> None:
    """CTE `name`(raw, value, valid, reason) over the distinct numbers of `source`(raw)."""
    CTES[f"{name}_parts"] = f"""
SELECT raw, num, regexp_replace(num, '[^0-9]', '', 'g') AS d, regexp_replace(raw, '[^0-9]', '', 'g') AS all_digits
FROM (SELECT raw, regexp_replace(regexp_extract(raw, '(?s)[+0-9].*$'), '(?i)[\\s,;]*(ext(ension)?\\.?|x|#)[\\s:.]*[0-9]{{1,7}}#?$', '') AS num
  FROM (SELECT DISTINCT {strip("coalesce(raw, '')")} AS raw FROM ({source})))"""
    CTES[f"{name}_dial"] = f"""
SELECT *, CASE WHEN starts_with(num, '+') THEN d WHEN starts_with(d, '00') THEN substr(d, 3) END AS intl,
  regexp_full_match(num, '[+]*[-\\s0-9().\\[\\]/~*]*') AND (length(d) >= 3 OR regexp_full_match(num, '[0-9]{{2}}')) AND length(d) <= 17 AS readable
FROM {name}_parts"""
    # one try per plan and reading; the first that fits counts
    CTES[f"{name}_tries"] = f"""
SELECT t.raw, t.code, t.nsn, t.ord FROM (
  SELECT raw, r.code, CASE WHEN starts_with(substr(intl, length(r.code) + 1), r.trunk) THEN substr(intl, length(r.code) + length(r.trunk) + 1) END AS nsn, 1 AS ord
    FROM {name}_dial JOIN regions r ON starts_with(intl, r.code)
  UNION ALL SELECT raw, r.code, substr(intl, length(r.code) + 1), 2 FROM {name}_dial JOIN regions r ON starts_with(intl, r.code)
  UNION ALL SELECT raw, r.code, CASE WHEN starts_with(d, r.trunk) THEN substr(d, length(r.trunk) + 1) END, 1 FROM {name}_dial JOIN regions r ON r.region = 'ZA' AND intl IS NULL
  UNION ALL SELECT raw, r.code, d, 2 FROM {name}_dial JOIN regions r ON r.region = 'ZA' AND intl IS NULL
  UNION ALL SELECT raw, r.code, CASE WHEN starts_with(d, r.code || r.trunk) THEN substr(d, length(r.code) + 2) WHEN starts_with(d, r.code) THEN substr(d, length(r.code) + 1) END, 3
    FROM {name}_dial JOIN regions r ON r.region = 'ZA' AND intl IS NULL)
t
SEMI JOIN plan_rows p ON p.code = t.code AND length(t.nsn) BETWEEN p.least AND p.most AND substr(t.nsn, 1, length(p.area_low)) BETWEEN p.area_low AND p.area_high
  AND substr(t.nsn, length(p.area_low) + 1, length(p.low)) >= p.low AND substr(t.nsn, length(p.area_low) + 1, length(p.high)) <= p.high
  AND NOT (length(p.area_low) = 3 AND substr(t.nsn, 2, 2) = '11')"""
    CTES[name] = f"""
SELECT p.raw, CASE WHEN p.raw = '' THEN NULL WHEN ok AND hit IS NOT NULL THEN '+' || hit WHEN ok THEN NULL
    WHEN length(all_digits) >= 7 THEN CASE WHEN starts_with(p.raw, '+') THEN '+' ELSE '' END || all_digits END AS value,
  CASE WHEN p.raw = '' THEN false WHEN ok THEN hit IS NOT NULL ELSE length(all_digits) >= 7 END AS valid,
  CASE WHEN p.raw = '' THEN 'empty_phone' WHEN ok AND hit IS NOT NULL THEN 'valid_e164' WHEN ok THEN 'invalid_number'
    WHEN length(all_digits) >= 7 THEN 'fallback_normalized' ELSE 'invalid_digits' END AS reason
FROM (SELECT *, readable AND (intl IS NULL OR EXISTS (SELECT 1 FROM regions r WHERE starts_with(intl, r.code))) AS ok FROM {name}_dial) p
LEFT JOIN (SELECT raw, arg_min(code || nsn, ord) AS hit FROM {name}_tries GROUP BY raw) h ON h.raw = p.raw"""


def _emails(name: str, source: str) -> None:
    """CTE `name`(raw, ...) over the distinct addresses of `source`(raw)."""
    shaped = "regexp_full_match(a, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"
    gone = f"({shaped} AND regexp_extract(a, '@(.*)$', 1) IN ({', '.join(map(lit, K.DISPOSABLE_DOMAINS))}))"
    role = f"({shaped} AND regexp_extract(a, '^([^@]*)@', 1) IN ({', '.join(map(lit, K.ROLE_PREFIXES))}))"
    CTES[name] = f"""
SELECT raw, CASE WHEN {shaped} AND NOT {gone} THEN a END AS value, {shaped} AND NOT {gone} AS valid,
  CASE WHEN a = '' THEN 'empty_email' WHEN NOT {shaped} THEN 'invalid_format' WHEN {gone} THEN 'disposable_domain' ELSE 'valid_email' END AS reason,
  {gone} AS is_disposable, CASE WHEN NOT {shaped} OR {gone} THEN 'low' WHEN {role} THEN 'medium' ELSE 'high' END AS quality, {role} AS is_role_based
FROM (SELECT DISTINCT coalesce(raw, '') AS raw, lower({strip("coalesce(raw, '')")}) AS a FROM ({source}))"""


_phones("phone_in", "SELECT phone AS raw FROM mapped")
_emails("email_in", "SELECT email AS raw FROM mapped")
# written by hand, not from the numbering plans
CTES["phones_by_hand"] = """SELECT * FROM (VALUES
  ('12', NULL, 'invalid_number'), ('+999 1234 5678', '+99912345678', 'fallback_normalized'), ('0044 20 7183 8750', '+442071838750', 'valid_e164'),
  ('+27 (0)21 555 1234 ext 12', '+27215551234', 'valid_e164'), ('1234567', NULL, 'invalid_number'), ('+1 (415) 555-2671', '+14155552671', 'valid_e164'),
  ('', NULL, 'empty_phone'), ('+33 1 42 22 22 22', '+33142222222', 'valid_e164'), ('+49 (0)151 2345 6789', '+4915123456789', 'valid_e164'),
  ('+55 11 91234-5678', '+5511912345678', 'valid_e164'), ('+351 21 123 4567', '+351211234567', 'valid_e164'), ('+31 (0)20 624 1111', '+31206241111', 'valid_e164'),
  ('+234 803 123 4567', '+2348031234567', 'valid_e164'), ('+44 21 1234 5678', NULL, 'invalid_number'), ('+1 911 555 2671', NULL, 'invalid_number'),
  ('+1 290 555 2671', NULL, 'invalid_number'), ('+1 (212) 155-2671', NULL, 'invalid_number'), ('+55 20 3234-5678', NULL, 'invalid_number'),
  ('+61 1 2345 6789', NULL, 'invalid_number'), ('00 27 59 123 4567', NULL, 'invalid_number'), ('+7 500 123 45 67', NULL, 'invalid_number'),
  ('+852 1234 5678', NULL, 'invalid_number')) AS t(raw, value, reason)"""
ORACLES["verify_phone"] = """SELECT m.row_id, CASE WHEN h.raw IS NULL THEN '+2782555' || right(m.phone, 4) ELSE h.value END AS value,
  coalesce(h.reason, 'valid_e164') IN ('valid_e164', 'fallback_normalized') AS valid, coalesce(h.reason, 'valid_e164') AS reason
FROM mapped m LEFT JOIN phones_by_hand h ON h.raw = coalesce(m.phone, '')"""
ORACLES["verify_email"] = """SELECT m.row_id, e.value, e.valid, e.reason, e.is_disposable, e.quality, e.is_role_based
FROM mapped m JOIN email_in e ON e.raw = coalesce(m.email, '')"""

_QUALITY = "CASE WHEN e.valid AND p.valid THEN 'verified' WHEN e.valid OR p.valid THEN 'likely' ELSE 'low' END"
_phones("phone_clean", "SELECT phone AS raw FROM clean")
_emails("email_clean", "SELECT email AS raw FROM clean")
CTES["graded"] = f"""SELECT c.*, {_QUALITY} AS contact_quality, e.valid AS email_ok, p.valid AS phone_ok, e.reason AS email_reason, p.reason AS phone_reason
FROM clean c JOIN email_clean e ON e.raw = coalesce(c.email, '') JOIN phone_clean p ON p.raw = coalesce(c.phone, '')"""
ORACLES["contact_quality"] = "SELECT row_id, contact_quality, email_reason, phone_reason FROM graded"

# --- scores ------------------------------------------------------------------------------------------


def score(w: dict[str, float], base: int) -> str:
    g = {**K.SCORE_WEIGHTS, **w}
    hi, mid, low = (int(g[f"website_speed_{t}_threshold"]) for t in ("high", "mid", "low"))
    return f"""CAST(round_even(greatest(0.0, least(100.0, CAST({base} AS DOUBLE)
  + CASE contact_quality WHEN 'verified' THEN {g['contact_quality_verified']} WHEN 'likely' THEN {g['contact_quality_likely']} WHEN 'low' THEN {g['contact_quality_low']} ELSE 0 END
  + CASE WHEN contact_quality = 'likely' AND email_ok AND phone_ok THEN {g['both_channels_bonus']} ELSE 0 END
  + CASE WHEN {some('website')} THEN {g['has_website']} ELSE 0 END
  + CASE WHEN has_chatbot THEN {g['chatbot_penalty']} ELSE 0 END
  + CASE WHEN last_updated_signal = 'detected' THEN {g['last_updated_bonus']} ELSE {g['last_updated_unknown_penalty']} END
  + CASE WHEN website_speed_score IS NULL THEN {g['website_speed_unknown_penalty']} WHEN website_speed_score >= {hi} THEN {g['website_speed_high_bonus']}
      WHEN website_speed_score >= {mid} THEN {g['website_speed_mid_bonus']} WHEN website_speed_score < {low} THEN {g['website_speed_low_penalty']} ELSE 0 END
  + CASE WHEN contains(lower(coalesce(source, '')), 'google_maps') THEN {g['google_maps_source_bonus']} ELSE 0 END
  + CASE WHEN {some('location')} THEN {g['has_location_bonus']} ELSE 0 END
  + CASE WHEN {some('agent_name')} THEN {g['has_agent_name_bonus']} ELSE 0 END)), 0) AS INT)"""


REASON_TEXT = f"""concat_ws('; ', 'Contact quality ' || contact_quality,
  CASE WHEN contact_quality = 'likely' AND email_ok AND phone_ok THEN 'Both email and phone valid' END,
  CASE WHEN {some('website')} THEN 'Website on record' END,
  CASE WHEN has_chatbot IS NULL THEN 'Chatbot status unknown (no site crawl)' WHEN has_chatbot THEN 'Chatbot or live-widget signal on site' ELSE 'No chatbot-style widgets detected' END,
  CASE WHEN last_updated_signal = 'detected' THEN 'Freshness wording on page' ELSE 'No freshness signal in crawl' END,
  CASE WHEN website_speed_score IS NULL THEN CASE WHEN {some('website')} THEN 'Website speed not measured' END
    WHEN website_speed_score >= 80 THEN 'Fast website response' WHEN website_speed_score >= 55 THEN 'Moderate website response time'
    WHEN website_speed_score < 35 THEN 'Slow website response' ELSE 'Website response time acceptable' END,
  CASE WHEN contains(lower(coalesce(source, '')), 'google_maps') THEN 'Google Maps enrichment' END,
  CASE WHEN {some('location')} THEN 'Location on record' END, CASE WHEN {some('agent_name')} THEN 'Agent name on record' END)"""

CTES["offline"] = f"""SELECT *, {score({}, K.BASE_SCORE)} AS lead_score, {REASON_TEXT} AS lead_reason
FROM (SELECT *, CAST(NULL AS BOOLEAN) AS has_chatbot, CAST(NULL AS VARCHAR) AS last_updated_signal, CAST(NULL AS INT) AS website_speed_score FROM graded)"""
ORACLES["offline_score"] = "SELECT row_id, company_name, contact_quality, lead_score, lead_reason FROM offline"
ORACLES["lead_history"] = "SELECT row_id, field, chosen_source, chosen_value, decision_reason FROM decided"
ORACLES["scoring_off"] = "SELECT row_id, company_name, contact_quality, CAST(NULL AS INT) AS lead_score, CAST(NULL AS VARCHAR) AS lead_reason FROM offline"
ORACLES["exported_run"] = """SELECT company_name, nullif(email, '') AS email, lead_score, 'leads_csv' AS output FROM offline UNION ALL SELECT company_name, email, lead_score, 'leads_json' FROM offline
UNION ALL SELECT CAST(row_id AS VARCHAR), reject_reason, NULL, 'rejected_rows' FROM checked WHERE reject_reason IS NOT NULL"""
ORACLES["incremental_leads"] = "SELECT row_id, company_name, website, email, contact_quality, lead_score FROM offline"
ORACLES["incremental_tables"] = ORACLES["incremental_resume"] = ORACLES["incremental_leads"]
ORACLES["lead_search"] = """SELECT row_id, company_name, location FROM offline WHERE contains(lower(concat_ws(' ', nullif(company_name, ''), nullif(agent_name, ''),
  nullif(location, ''), nullif(email, ''), nullif(website, ''), nullif(phone, ''), nullif(lead_reason, ''), nullif(source, ''))), 'cape prop')"""
ORACLES["lead_page"] = "SELECT row_id, company_name, lead_score FROM offline ORDER BY lead_score DESC, row_id LIMIT 25 OFFSET 50"
ORACLES["lead_page_after"] = ORACLES["lead_page"]


def kpi(table: str) -> str:
    return f"""SELECT count(*) AS leads, coalesce({half_up('sum(lead_score) / count(*)')}, 0) AS avg_score,
  coalesce({half_up("count(*) FILTER (WHERE contact_quality = 'verified') / count(*) * 100")}, 0) AS verified_rate FROM {table}"""


ORACLES["analytics_kpi"] = kpi("offline")
_BUCKETS = ", ".join(f"({lit(label)}, {lo}, {hi})" for label, lo, hi in K.SCORE_BUCKETS)
ORACLES["score_histogram"] = f"""SELECT bucket, lo, hi, count(o.row_id) AS leads FROM (VALUES {_BUCKETS}) AS b(bucket, lo, hi)
LEFT JOIN offline o ON o.lead_score BETWEEN b.lo AND b.hi GROUP BY bucket, lo, hi"""
ORACLES["missing_fields"] = " UNION ALL ".join(
    f"SELECT '{f}' AS field, " + half_up(f"count(*) FILTER (WHERE {f} IS NULL OR {f}::VARCHAR = '') / count(*) * 100") + " AS pct, "
    f"count(*) FILTER (WHERE {f} IS NULL OR {f}::VARCHAR = '') AS missing FROM offline"
    for f in K.PROFILE_FIELDS
)

# --- pages -------------------------------------------------------------------------------------------

CTES["fetched"] = f"""SELECT page_id, {scheme('url')} AS url, status_code, elapsed_ms, status_code < 400 AS ok,
  CASE WHEN status_code >= 400 THEN 'http_' || status_code END AS error, CASE WHEN status_code < 400 THEN html ELSE '' END AS html FROM site_pages"""
ORACLES["page_fetch_status"] = "SELECT page_id, url, status_code, ok, error, elapsed_ms, length(html) AS html_chars FROM fetched"


def markup(x: str) -> str:
    whichever_opens_first = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
    return f"regexp_replace({x}, {lit(whichever_opens_first)}, ' ', 'g')"


def entities(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#64;", "@"), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


def page_text(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '(?is)<template\\b[^>]*>.*?</template\\s*>', ' ', 'g'), '<[!/?A-Za-z][^>]*>', ' ', 'g')"
    return squash(f"replace({entities(x)}, chr(160), ' ')")


_EMAIL, _PHONE = lit(K.EMAIL_IN_TEXT), lit(r"\+?\d[\d\-\s()]{6,}\d")
_HREF = lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
CTES["markups"] = f"SELECT page_id, url, {markup('html')} AS m FROM fetched"
CTES["anchors"] = f"""SELECT page_id, url, pos, {strip(entities('''regexp_replace(h, '^["'']|["'']$', '', 'g')'''))} AS href
FROM (SELECT page_id, url, unnest(hs) AS h, generate_subscripts(hs, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(m, {_HREF}, 1) AS hs FROM markups))"""
CTES["found"] = f"""
SELECT page_id, 'email' AS kind, unnest(regexp_extract_all({page_text('m')}, {_EMAIL})) AS v FROM markups
UNION SELECT page_id, 'phone', unnest(regexp_extract_all({page_text('m')}, {_PHONE})) FROM markups
UNION SELECT page_id, 'email', {strip("regexp_extract(href, '^mailto:([^?]*)', 1)")} FROM anchors WHERE starts_with(href, 'mailto:')
UNION SELECT page_id, 'phone', {strip("substr(href, 5)")} FROM anchors WHERE starts_with(href, 'tel:')"""


def _listed(table: str, kind: str, page: str) -> str:
    return f"coalesce((SELECT list(DISTINCT v ORDER BY v) FROM {table} f WHERE f.page_id = {page} AND f.kind = '{kind}' AND v <> ''), [])"


CTES["found_lists"] = """SELECT page_id, coalesce(list(DISTINCT v ORDER BY v) FILTER (WHERE kind = 'email'), []) AS emails,
  coalesce(list(DISTINCT v ORDER BY v) FILTER (WHERE kind = 'phone'), []) AS phones FROM found WHERE v <> '' GROUP BY page_id"""
ORACLES["page_contacts"] = """SELECT f.page_id, coalesce(array_to_string(emails, '|'), '') AS emails, coalesce(array_to_string(phones, '|'), '') AS phones
FROM fetched f LEFT JOIN found_lists l ON l.page_id = f.page_id"""
CTES["doc_texts"] = f"SELECT doc_id, {page_text(markup('text'))} AS t FROM documents"
ORACLES["text_contacts"] = f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {_EMAIL}))), '|') AS emails,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, {_PHONE}))), '|') AS phones FROM doc_texts"""

CTES["ld_roots"] = """SELECT page_id, b::JSON AS j FROM (SELECT page_id,
  unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|(<script\\b[^>]*>.*?</script\\s*>)', ' \\1', 'g'), '(?is)<script\\b[^>]*type\\s*=\\s*["'']?application/ld\\+json["'']?[^>]*>(.*?)</script\\s*>', 1)) AS b FROM fetched) WHERE json_valid(b)"""
CTES["ld_items"] = """SELECT page_id, j FROM ld_roots WHERE json_type(j) = 'OBJECT'
UNION ALL SELECT page_id, unnest(json_extract(j, '$[*]')) FROM ld_roots WHERE json_type(j) = 'ARRAY'"""
CTES["ld_points"] = """SELECT page_id, json_extract(j, '$.contactPoint') AS j FROM ld_items WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.contactPoint') = 'OBJECT'
UNION ALL SELECT page_id, unnest(json_extract(j, '$.contactPoint[*]')) FROM ld_items WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.contactPoint') = 'ARRAY'
UNION ALL SELECT page_id, j FROM ld_items"""
CTES["ld_found"] = f"""SELECT page_id, 'email' AS kind, {strip("json_extract_string(j, '$.email')")} AS v FROM ld_points WHERE json_type(j) = 'OBJECT'
UNION SELECT page_id, 'phone', {strip("json_extract_string(j, '$.telephone')")} FROM ld_points WHERE json_type(j) = 'OBJECT'"""
CTES["ld_lists"] = CTES["found_lists"].replace("FROM found", "FROM ld_found")
ORACLES["page_jsonld_contacts"] = ORACLES["page_contacts"].replace("found_lists", "ld_lists")

CTES["link_targets"] = """SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href
  WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target
FROM anchors WHERE regexp_matches(lower(href), 'contact|about|team|agents')"""
CTES["links_of"] = """SELECT page_id, pos, target, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nr FROM
(SELECT page_id, target, min(pos) AS pos FROM link_targets WHERE regexp_matches(target, '(?i)^https?:') GROUP BY page_id, target)"""
ORACLES["contact_links"] = """SELECT f.page_id, coalesce(l.links, '') AS links FROM fetched f
LEFT JOIN (SELECT page_id, string_agg(target, '|' ORDER BY nr) AS links FROM links_of GROUP BY page_id) l ON l.page_id = f.page_id"""

_CHAT = " OR ".join(f"contains(lower(html), {lit(w)})" for w in (*K.CHAT_KEYWORDS, *K.CHAT_VENDOR_MARKERS))
_FRESH = " OR ".join(f"regexp_matches(html, {lit('(?i)' + p)})" for p in K.FRESHNESS_PATTERNS)
CTES["flags"] = f"""SELECT page_id, ({_CHAT}) AS chat, ({_FRESH}) AS worded, contains(lower(html), 'updated') AS updated, length(html) AS chars FROM fetched"""
ORACLES["chatbot_signal"] = "SELECT page_id, chat AS has_chatbot FROM flags"
ORACLES["freshness_signal"] = "SELECT page_id, worded OR (updated AND chars > 200) AS fresh FROM flags"


def speed(ms: str) -> str:
    steps = " ".join(f"WHEN {ms} < {b} THEN {s}" for b, s in K.SPEED_LADDER)
    return f"CAST(CASE WHEN {ms} < 0 OR {ms} IS NULL THEN NULL {steps} ELSE greatest(5, 25 - least(20, ({ms} - 6000) // 500)) END AS INT)"


ORACLES["speed_score"] = f"SELECT page_id, elapsed_ms, {speed('elapsed_ms')} AS speed_score FROM fetched"

CTES["site_of"] = f"""SELECT company_key, arg_min(link, rank) AS discovered FROM (
  SELECT lower({squash('company_name')}) AS company_key, company_name, rank, {scheme('link')} AS link FROM search_results)
WHERE link IS NOT NULL AND regexp_extract(lower(link), '://([^/?#]*)', 1) <> ''
  AND NOT regexp_matches(regexp_extract(lower(link), '://([^/?#]*)', 1), 'facebook\\.com|instagram\\.com|linkedin\\.com|x\\.com|twitter\\.com')
  AND plausible(company_name, regexp_extract(lower(link), '://([^/?#]*)', 1)) GROUP BY company_key"""
_WORDS = "list_filter(regexp_split_to_array(lower(company_name), '[^a-z0-9]+'), lambda w: length(w) > 2)"
_HOST = "regexp_extract(lower(link), '://([^/?#]*)', 1)"
_COMPACT = f"regexp_replace({_HOST}, '[^a-z0-9]', '', 'g')"
_OTHER = f"list_filter({_WORDS}, lambda w: w NOT IN ('property', 'properties'))"


def _first_letters(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: w[1]), '')"


CTES["site_of"] = CTES["site_of"].replace(
    f"plausible(company_name, {_HOST})",
    f"(len({_WORDS}) = 0 OR len(list_filter({_WORDS}, lambda w: contains({_HOST}, w))) > 0 "
    f"OR (len({_WORDS}) >= 2 AND contains({_COMPACT}, {_first_letters(_WORDS)})) "
    f"OR (len({_OTHER}) > 0 AND len({_OTHER}) < len({_WORDS}) AND contains({_COMPACT}, {_first_letters(_OTHER)} || 'prop')))",
)
ORACLES["website_discovery"] = "SELECT c.row_id, c.company_name, s.discovered FROM clean c LEFT JOIN site_of s ON s.company_key = lower(c.company_name)"

CTES["page_best"] = f"""SELECT * EXCLUDE rn FROM (SELECT *, {url_key('url')} AS pk, row_number() OVER (PARTITION BY {url_key('url')} ORDER BY NOT ok, url, elapsed_ms, length(html), emails) AS rn FROM fetched LEFT JOIN found_lists USING (page_id)) WHERE rn = 1"""
CTES["tries"] = """SELECT row_id, 1 AS nr, coalesce(website, discovered) AS u FROM clean LEFT JOIN site_of ON company_key = lower(company_name)
UNION ALL SELECT row_id, 2, discovered FROM clean JOIN site_of ON company_key = lower(company_name) WHERE website IS NOT NULL AND discovered <> website"""
CTES["answers"] = f"""SELECT t.row_id, t.nr, t.u, coalesce(b.ok, false) AS ok, b.page_id, b.elapsed_ms, CASE WHEN NOT coalesce(b.ok, false) THEN coalesce(b.error, 'not_in_snapshot') END AS error
FROM tries t LEFT JOIN page_best b ON b.pk = {url_key('t.u')} WHERE t.u IS NOT NULL"""
CTES["homes"] = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY NOT ok, CASE WHEN ok THEN nr ELSE -nr END) AS rn FROM answers) WHERE rn = 1"""
CTES["lead_pages"] = f"""SELECT row_id, 0 AS nr, page_id FROM homes WHERE ok
UNION ALL SELECT h.row_id, l.nr, b.page_id FROM homes h JOIN links_of l ON l.page_id = h.page_id JOIN page_best b ON b.pk = {url_key('l.target')} AND b.ok WHERE h.ok"""
CTES["lead_values"] = """SELECT p.row_id, v.kind, v.v, p.nr, v.src FROM lead_pages p JOIN (
  SELECT page_id, kind, v, 1 AS src FROM found WHERE v <> '' UNION ALL SELECT page_id, kind, v, 0 FROM ld_found WHERE v <> '') v ON v.page_id = p.page_id"""
CTES["lead_order"] = "SELECT *, row_number() OVER (PARTITION BY row_id, kind ORDER BY nr, src, v) AS ord FROM lead_values"
_emails("email_page", "SELECT v AS raw FROM lead_values WHERE kind = 'email'")
_phones("phone_page", "SELECT v AS raw FROM lead_values WHERE kind = 'phone'")
CTES["email_seen"] = """SELECT o.row_id, o.ord, e.* FROM lead_order o JOIN email_page e ON e.raw = o.v WHERE o.kind = 'email'"""
CTES["email_hit"] = "SELECT row_id, min(ord) FILTER (WHERE valid) AS hit FROM email_seen GROUP BY row_id"
CTES["email_picks"] = """SELECT s.row_id, max(value) FILTER (WHERE ord = hit) AS value, max(reason) FILTER (WHERE ord = hit) AS reason, max(quality) FILTER (WHERE ord = hit) AS quality,
  count(*) FILTER (WHERE is_disposable AND ord <= coalesce(hit, ord)) AS disposable FROM email_seen s JOIN email_hit h ON h.row_id = s.row_id GROUP BY s.row_id"""
CTES["phone_picks"] = f"""SELECT o.row_id, arg_min(p.value, o.ord) FILTER (WHERE p.valid) AS value, arg_min(p.reason, o.ord) FILTER (WHERE p.valid) AS reason,
  count(*) FILTER (WHERE p.valid) AS valid_count, count(*) AS total FROM lead_order o JOIN phone_page p ON p.raw = {strip('o.v')} WHERE o.kind = 'phone' GROUP BY o.row_id"""
CTES["page_sums"] = """SELECT p.row_id, bool_or(f.chat) AS has_chatbot, bool_or(f.worded) OR (bool_or(f.updated) AND sum(f.chars) + count(*) - 1 > 200) AS fresh,
  count(*) - 1 AS extra, count(*) FILTER (WHERE p.page_id IN (SELECT page_id FROM ld_found WHERE v <> '')) AS schema_pages
FROM lead_pages p JOIN flags f ON f.page_id = p.page_id GROUP BY p.row_id"""
CTES["sites"] = f"""SELECT h.row_id, e.value AS email, p.value AS phone, s.has_chatbot, s.fresh, {speed('h.elapsed_ms')} AS speed_score, s.schema_pages AS schema_contacts_used,
  coalesce(e.disposable, 0) AS email_disposable_rejected, s.extra AS multi_page_fetch_success, coalesce(p.valid_count, 0) AS phone_valid_count,
  coalesce(p.total, 0) AS phone_total_candidates, coalesce(e.reason, 'none') AS email_validation_reason, coalesce(p.reason, 'none') AS phone_validation_reason, coalesce(e.quality, 'low') AS email_quality
FROM homes h JOIN page_sums s ON s.row_id = h.row_id LEFT JOIN email_picks e ON e.row_id = h.row_id LEFT JOIN phone_picks p ON p.row_id = h.row_id WHERE h.ok"""
ORACLES["lead_page_contacts"] = "SELECT s.*, h.u AS website FROM sites s JOIN homes h ON h.row_id = s.row_id"
CTES["paged"] = """SELECT c.row_id, c.company_name, c.agent_name, c.location, c.source, coalesce(h.u, c.website) AS website, coalesce(c.email, s.email) AS email, coalesce(c.phone, s.phone) AS phone,
  s.has_chatbot, CASE WHEN s.fresh THEN 'detected' WHEN s.row_id IS NOT NULL THEN 'unknown' END AS last_updated_signal, s.speed_score AS website_speed_score,
  h.error AS enrichment_error, s.email AS page_email, s.phone AS page_phone, s.row_id IS NOT NULL AS loaded, s.* EXCLUDE (row_id, email, phone, has_chatbot, fresh, speed_score),
  c.website AS base_website, c.email AS base_email, c.phone AS base_phone
FROM clean c LEFT JOIN homes h ON h.row_id = c.row_id LEFT JOIN sites s ON s.row_id = c.row_id"""
ORACLES["page_enriched"] = "SELECT row_id, website, email, phone, has_chatbot, last_updated_signal, website_speed_score, enrichment_error FROM paged"

# --- places ------------------------------------------------------------------------------------------

CTES["geo"] = f"SELECT raw_location, {filled('arg_min(formatted_address, rank)')} AS normalized_location FROM geocodes GROUP BY raw_location"
ORACLES["location_normalized"] = """SELECT c.row_id, c.location, g.normalized_location FROM clean c LEFT JOIN geo g ON g.raw_location = c.location AND length(c.location) >= 3"""


def _places(name: str, leads: str) -> None:
    """CTEs for leads of one stage: <name>_asked(company, nl), <name>_best, <name> (lead with its place)."""
    CTES[f"{name}_in"] = f"SELECT l.*, g.normalized_location AS nl FROM {leads} l LEFT JOIN geo g ON g.raw_location = l.location AND length(l.location) >= 3"
    CTES[f"{name}_asked"] = f"SELECT DISTINCT company_name AS company, nl FROM {name}_in WHERE company_name IS NOT NULL"
    sim = "(1.0 - levenshtein(lower(a.company), lower(s.name)) / greatest(length(a.company), length(s.name)))"
    adjust = "CASE WHEN a.nl IS NULL OR length(a.nl) < 3 THEN 0 WHEN contains(lower(s.formatted_address), lower(a.nl)) THEN 0.15::DOUBLE ELSE -0.05::DOUBLE END"
    CTES[f"{name}_scored"] = f"""SELECT a.company, a.nl, t.tier, s.rank, s.place_id, s.name, CASE WHEN {sim} >= 0.5 THEN {sim} + {adjust} END AS score
FROM {name}_asked a JOIN (SELECT 1 AS tier UNION ALL SELECT 2) t ON t.tier = 1 OR a.nl IS NOT NULL
JOIN place_search s ON lower(s.query) = lower(CASE WHEN t.tier = 1 THEN concat_ws(' ', a.company, a.nl) ELSE a.company END)"""
    CTES[f"{name}_best"] = f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY company, nl ORDER BY tier, coalesce(score, -10) DESC, rank, place_id DESC) AS rn FROM {name}_scored)
WHERE rn = 1 AND score IS NOT NULL AND trim(place_id) <> ''"""
    CTES[name] = f"""SELECT l.*, b.place_id, nullif(trim(p.website_uri), '') AS g_website, coalesce(nullif(trim(p.international_phone), ''), nullif(trim(p.national_phone), '')) AS g_phone,
  nullif(trim(p.formatted_address), '') AS g_address, p.place_id IS NOT NULL AS hit
FROM {name}_in l LEFT JOIN {name}_best b ON b.company = l.company_name AND b.nl IS NOT DISTINCT FROM l.nl LEFT JOIN places p ON p.place_id = b.place_id"""
    CTES[f"{name}_out"] = f"""SELECT * EXCLUDE (website, phone, location, source, g_website, g_phone, g_address), coalesce(website, g_website) AS website, coalesce(phone, g_phone) AS phone,
  CASE WHEN hit AND g_address IS NOT NULL THEN coalesce(nl, g_address) ELSE location END AS location, location AS before_location,
  CASE WHEN NOT hit OR contains(source, 'google_maps') THEN source ELSE source || ',google_maps' END AS source,
  g_website AS place_website, g_phone AS place_phone, CASE WHEN hit THEN coalesce(g_address, nl) END AS place_location FROM {name}"""


_places("near", "clean")
_places("placed", "paged")
ORACLES["place_match_lev"] = "SELECT company, nl AS normalized_location, place_id, name AS place_name, tier, round(score, 6) AS match_score FROM near_best"
ORACLES["place_enriched"] = "SELECT row_id, website, phone, location, source, place_website, place_phone, place_location FROM near_out"
ORACLES["unmatched_leads"] = "SELECT row_id, company_name, location FROM near WHERE NOT hit"

# --- resolution --------------------------------------------------------------------------------------

# long form: one row per lead and field, then one per candidate
CTES["stages_long"] = """
SELECT row_id, 'website' AS field, base_website AS base, paged_website AS site, website AS cur, place_website AS dir, NULL AS why, enrichment_error FROM staged
UNION ALL SELECT row_id, 'email', base_email, coalesce(page_email, paged_email), email, NULL, email_validation_reason, enrichment_error FROM staged
UNION ALL SELECT row_id, 'phone', base_phone, coalesce(page_phone, paged_phone), phone, place_phone, phone_validation_reason, enrichment_error FROM staged
UNION ALL SELECT row_id, 'location', before_location, before_location, location, place_location, NULL, enrichment_error FROM staged"""
CTES["staged"] = """SELECT o.*, p.website AS paged_website, p.email AS paged_email, p.phone AS paged_phone FROM placed_out o JOIN paged p ON p.row_id = o.row_id"""
# definition order matters to the prefix: staged before its long form
CTES["stages_long"] = CTES.pop("stages_long")
CTES["candidates"] = """
SELECT row_id, field, cur, 1 AS pos, 'input' AS source, base AS value, true AS validated, 0.35::DOUBLE AS confidence, 'from_input' AS validation_reason FROM stages_long WHERE base IS NOT NULL
UNION ALL SELECT row_id, field, cur, 2, 'website_enrichment', site, enrichment_error IS NULL, CASE WHEN enrichment_error IS NOT NULL THEN 0.2 WHEN field = 'email' THEN 0.82 ELSE 0.75 END::DOUBLE,
  CASE WHEN enrichment_error IS NULL THEN coalesce(why, 'website_fetch_ok') ELSE 'website_fetch_failed' END FROM stages_long WHERE site IS NOT NULL AND site IS DISTINCT FROM base
UNION ALL SELECT row_id, field, cur, 3, 'google_maps', coalesce(dir, cur), true, CASE WHEN field = 'phone' THEN 0.9 ELSE 0.75 END::DOUBLE, 'google_maps_ok'
  FROM stages_long WHERE dir IS NOT NULL OR (cur IS NOT NULL AND cur IS DISTINCT FROM site)"""
ORACLES["field_candidates"] = "SELECT row_id, field, source, value, validated, confidence, validation_reason FROM candidates"
CTES["pooled"] = """SELECT *, confidence = max(confidence) OVER (PARTITION BY row_id, field) AS top FROM
(SELECT *, bool_or(validated) OVER (PARTITION BY row_id, field) AS any_valid FROM candidates) WHERE validated OR NOT any_valid"""
CTES["tops"] = """SELECT *, count(*) OVER (PARTITION BY row_id, field) AS n, field = 'website' AND source = 'google_maps' AND validated AS by_map, value IS NOT DISTINCT FROM cur AS is_cur
FROM pooled WHERE top"""
CTES["chosen"] = """SELECT row_id, field, source, value, n > 1 AS tie, CASE WHEN n = 1 THEN 'highest_confidence' WHEN by_map THEN 'prefer_google_maps_if_verified'
  WHEN is_cur THEN 'keep_current_on_tie' ELSE 'tie_first_candidate' END AS why FROM
(SELECT *, row_number() OVER (PARTITION BY row_id, field ORDER BY CASE WHEN n > 1 AND by_map THEN 0 WHEN n > 1 AND is_cur THEN 1 ELSE 2 END, pos) AS rn FROM tops) WHERE rn = 1"""
CTES["decided"] = """SELECT l.row_id, l.field, l.base, coalesce(c.source, 'current') AS chosen_source, CASE WHEN c.row_id IS NULL THEN l.cur ELSE c.value END AS chosen_value,
  coalesce(c.tie, false) AS tie_break_applied, coalesce(c.why, 'no_candidates') AS tie_break_reason,
  CASE WHEN c.row_id IS NULL THEN NULL WHEN c.tie THEN 'tie_break:' || c.why ELSE 'highest_validated_confidence' END AS decision_reason,
  greatest((SELECT count(*) FROM candidates k WHERE k.row_id = l.row_id AND k.field = l.field) - 1, 0) AS alternatives
FROM stages_long l LEFT JOIN chosen c ON c.row_id = l.row_id AND c.field = l.field"""
ORACLES["field_resolution"] = "SELECT row_id, field, chosen_source, chosen_value, tie_break_applied, tie_break_reason, decision_reason, alternatives FROM decided"
CTES["resolved"] = """SELECT s.* REPLACE (d.website AS website, d.email AS email, d.phone AS phone, d.location AS location), s.location AS staged_location FROM staged s JOIN (
  SELECT row_id, max(chosen_value) FILTER (WHERE field = 'website') AS website, max(chosen_value) FILTER (WHERE field = 'email') AS email,
    max(chosen_value) FILTER (WHERE field = 'phone') AS phone, max(chosen_value) FILTER (WHERE field = 'location') AS location FROM decided GROUP BY row_id) d ON d.row_id = s.row_id"""
_emails("email_final", "SELECT email AS raw FROM resolved")
_phones("phone_final", "SELECT phone AS raw FROM resolved")
CTES["final_graded"] = f"""SELECT r.*, {_QUALITY} AS contact_quality, e.valid AS email_ok, p.valid AS phone_ok FROM resolved r
JOIN email_final e ON e.raw = coalesce(r.email, '') JOIN phone_final p ON p.raw = {strip("coalesce(r.phone, '')")}"""
CTES["final"] = f"SELECT *, {score({}, K.BASE_SCORE)} AS lead_score, {REASON_TEXT} AS lead_reason FROM final_graded"
ORACLES["lead_score"] = "SELECT row_id, lead_score, lead_reason, lead_score AS confidence_score, contact_quality FROM final"
ORACLES["incremental_jsonl"] = ORACLES["incremental_csv"] = "SELECT company_name, website, email, phone, location, contact_quality, lead_score, lead_reason FROM final"
ORACLES["export_canonical"] = """SELECT company_name, agent_name, website, email, phone, location, source, lead_score AS confidence_score, has_chatbot, website_speed_score,
  last_updated_signal, contact_quality, lead_score, lead_reason FROM final"""
ORACLES["lead_filter"] = """SELECT row_id, company_name, lead_score FROM final WHERE lead_score >= 60 AND contact_quality = 'verified' AND NOT has_chatbot AND last_updated_signal = 'unknown'
ORDER BY lead_score DESC, row_id"""
_PROFILES = {
    "default": ({}, 45),
    "contacts_first": ({"contact_quality_verified": 40.5, "has_website": 5.0}, 30),
    "strict": ({"contact_quality_low": -40.0, "website_speed_high_threshold": 95.5}, 20),
}
ORACLES["profile_scores"] = " UNION ALL ".join(
    f"SELECT row_id, '{name}' AS profile, {score(w, base)} AS lead_score, "
    + REASON_TEXT.replace(">= 80", f">= {int(w.get('website_speed_high_threshold', 80))}") + " AS lead_reason FROM final_graded"
    for name, (w, base) in _PROFILES.items()
)
ORACLES["signal_splits"] = """SELECT 'quality' AS signal, contact_quality AS name, count(*) AS leads FROM final GROUP BY 2
UNION ALL SELECT 'chatbot', CASE WHEN has_chatbot THEN 'has chatbot' WHEN NOT has_chatbot THEN 'no chatbot' ELSE 'unknown' END, count(*) FROM final GROUP BY 2
UNION ALL SELECT 'freshness', coalesce(last_updated_signal, 'unknown'), count(*) FROM final GROUP BY 2"""
ORACLES["source_mix"] = """SELECT CASE WHEN source = 'google_maps' THEN 'google_maps' WHEN contains(source, 'google_maps') THEN 'mixed' ELSE 'input' END AS source_kind, count(*) AS leads FROM final GROUP BY 1"""
ORACLES["run_diagnostics"] = f"""SELECT count(enrichment_error) AS page_errors, 0 AS place_errors,
  {half_up("count(*) FILTER (WHERE contains(source, 'google_maps')) / count(*) * 100")} AS place_match_rate FROM final"""
ORACLES["run_summary"] = """SELECT (SELECT count(*) FROM checked) AS input_rows, (SELECT count(*) FROM norm) AS mapped_valid_rows,
  (SELECT count(*) FROM checked WHERE reject_reason IS NOT NULL) AS rejected_rows, count(*) AS deduped_rows, count(*) AS enriched_rows, count(*) AS google_maps_attempted,
  count(*) FILTER (WHERE contains(source, 'google_maps')) AS google_maps_matched, 0 AS google_maps_failed,
  count(*) FILTER (WHERE staged_location <> '' AND staged_location IS DISTINCT FROM before_location) AS google_maps_location_normalized,
  (SELECT count(*) FROM decided WHERE tie_break_applied) AS conflicts_resolved, (SELECT count(*) FROM decided WHERE chosen_value IS DISTINCT FROM base) AS replacements_performed,
  (SELECT count(*) FROM candidates WHERE NOT validated) AS invalid_candidates, coalesce(sum(schema_contacts_used), 0) AS schema_contacts_used,
  coalesce(sum(email_disposable_rejected), 0) AS email_disposable_rejected, coalesce(sum(multi_page_fetch_success), 0) AS multi_page_fetch_success,
  round(sum(phone_valid_count) / sum(phone_total_candidates), 4) AS phone_e164_valid_rate, count(*) AS scored_rows FROM final"""

# --- runs and batches ----------------------------------------------------------------------------------

ORACLES["runs_page"] = """SELECT job_id, status, created_on, input_format FROM (
  SELECT job_id, status, strftime(created_at, '%Y-%m-%d') AS created_on, input_format FROM runs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 40)
UNION ALL SELECT 'total', '', '', CAST(count(*) AS VARCHAR) FROM runs WHERE status = 'completed'"""
ORACLES["runs_search"] = """SELECT job_id, status, total_rows FROM runs WHERE input_format = 'csv'
AND contains(lower(concat_ws(' ', job_id, status, '{"total_rows":' || total_rows || '}')), '"total_rows":7')"""
ORACLES["lead_upsert"] = """SELECT job_id, batch_index, end_row, status, processed_rows FROM (SELECT *, row_number() OVER (PARTITION BY job_id, batch_index
  ORDER BY written_at DESC, seq1 DESC, seq2 DESC, end_row DESC, status DESC) AS rn FROM run_batches) WHERE rn = 1"""
ORACLES["batch_plan"] = """SELECT job_id, i AS batch_index, i * 100 AS start_row, least(total_rows, i * 100 + 100) AS end_row, 'pending' AS status
FROM (SELECT job_id, total_rows, unnest(range(0, (total_rows + 99) // 100)) AS i FROM runs)"""


def _progress(status: str) -> str:
    return f"""SELECT job_id, count(*) AS batches_total, count(*) FILTER (WHERE {status} IN ('processing', 'completed', 'failed', 'terminated')) AS batches_started,
  count(*) FILTER (WHERE {status} = 'completed') AS batches_completed, count(*) FILTER (WHERE {status} = 'failed') AS failed_batches,
  CAST(sum(end_row - start_row) AS BIGINT) AS rows_total, CAST(sum(processed_rows) AS BIGINT) AS rows_processed FROM run_batches GROUP BY job_id"""


ORACLES["batch_progress"] = _progress("status")
ORACLES["batch_resume"] = _progress("CASE WHEN status = 'completed' THEN status ELSE 'pending' END")
ORACLES["run_rollup"] = """SELECT job_id, CAST(sum(end_row - start_row) AS BIGINT) AS phones_total, CAST(sum(processed_rows) AS BIGINT) AS phones_valid,
  CASE WHEN sum(end_row - start_row) > 0 THEN round(sum(processed_rows) / sum(end_row - start_row), 4) ELSE 0 END AS phone_e164_valid_rate FROM run_batches GROUP BY job_id"""


def _recent(n: int) -> str:
    return f"""SELECT r.job_id, o.* FROM offline o JOIN (SELECT job_id, custkey FROM runs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT {n}) r ON r.custkey = o.row_id"""


CTES["recent50"] = _recent(50)
CTES["recent100"] = _recent(100)
ORACLES["recent_runs_leads"] = "SELECT job_id, row_id, lead_score FROM recent50"
ORACLES["recent_runs_kpi"] = kpi("recent100")
CTES["yearly"] = """SELECT r.input_format || '-' || year(r.created_at) AS job_id, CAST(o.row_id AS BIGINT) AS row_index, o.company_name, o.contact_quality, o.lead_score,
  r.job_id AS written_by, r.status, r.created_at FROM offline o JOIN runs r ON r.custkey = o.row_id"""
_NEWEST = "row_number() OVER (PARTITION BY job_id, row_index ORDER BY {}created_at DESC, written_by DESC) = 1"
CTES["yearly_newest"] = f"SELECT * FROM yearly QUALIFY {_NEWEST.format('')}"
ORACLES["lead_table_merge"] = f"SELECT * FROM yearly QUALIFY {_NEWEST.format("CASE status WHEN 'completed' THEN 1 WHEN 'processing' THEN 3 ELSE 2 END DESC, ")}"
ORACLES["run_lookup"] = "SELECT row_index, company_name, lead_score, written_by FROM yearly_newest WHERE job_id = 'csv-1996'"
ORACLES["recent_runs_table"] = """SELECT job_id, row_index, lead_score, written_by FROM yearly_newest SEMI JOIN (SELECT job_id FROM yearly GROUP BY job_id
  HAVING min(status) = 'completed' ORDER BY max(created_at) DESC, job_id DESC LIMIT 5) USING (job_id)"""

ORACLES = {name: with_prefix(sql, CTES) for name, sql in ORACLES.items()}
ORACLES["alias_mapping"] = _records_oracle(
    "SELECT row_id, record::JSON AS j FROM raw_records",
    "row_id, company_name, agent_name, website, email, phone, location, source, lead_score, reject_reason",
)
ORACLES["listing_mapping"] = _records_oracle(
    _LISTING, "row_id, company_name, agent_name, email, phone, location, source, reject_reason"
)
