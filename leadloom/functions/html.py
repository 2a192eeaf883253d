"""Contacts, links and signals of one web page.

Everything is a native string or array function over the html, so a page never leaves the JVM and
never needs a shuffle. Steps that are used more than once are meant to be selected as columns of
their own first (see operators.pages), so that each is computed once per page.
"""

from __future__ import annotations

from collections.abc import Sequence

from leadloom import constants as K
from leadloom.functions.text import NO_STRINGS, let, q, squash, strip

# whichever opens first wins, as in a parser: one pass over the page
CODE = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>)"
TEMPLATE_OR_TAG = r"(?is)<(?:template\b[^>]*>.*?</template\s*>|[!/?a-z][^>]*>)"
HREF = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
JSONLD = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
# fixed values: named entities decoded in text; "amp" goes last
NAMED_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "))


def find_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def without_code(html: str) -> str:
    """Html without comments, scripts and styles: what is left holds the real anchors and text."""
    return f"regexp_replace({html}, {q(CODE)}, ' ')"


def visible_text(markup: str) -> str:
    """Text of html that went through `without_code`."""
    bare = f"regexp_replace({markup}, {q(TEMPLATE_OR_TAG)}, ' ')"
    return squash(f"replace({decode_entities(bare)}, '\u00a0', ' ')")


def decode_entities(x: str) -> str:
    named = "de"
    for name, char in NAMED_ENTITIES:
        named = f"replace({named}, '&{name};', {q(char)})"
    numeric = let("dn", named, f"if(contains(dn, '&#'), {_decode_numeric('dn')}, dn)")
    other = "&(?:#|" + "|".join(name for name, _ in NAMED_ENTITIES) + ")"  # most pages hold no other than "&amp;"
    return let("de", x, f"replace(if(de RLIKE {q(other)}, {numeric}, de), '&amp;', '&')")


def _decode_numeric(x: str) -> str:
    """Decimal and hexadecimal character references; anything else after '&#' stays as it was."""
    body = r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"
    code = "if(startswith(nb, 'x'), CAST(conv(substring(nb, 2), 16, 10) AS INT), try_cast(nb AS INT))"
    real = "nb <> '' AND nc BETWEEN 1 AND 1114111 AND NOT nc BETWEEN 55296 AND 57343"
    char = "decode(unhex(lpad(hex(nc), 8, '0')), 'UTF-32')"
    part = let(
        "nb", f"regexp_extract(np, {q(body)}, 1)",
        let("nc", code, f"if({real}, {char} || substring(np, length(nb) + 2), '&#' || np)"),
    )
    return let(
        "ns", f"split({x}, '&#')",
        f"ns[0] || array_join(transform(slice(ns, 2, greatest(size(ns) - 1, 0)), np -> {part}), '')",
    )


def hrefs(markup: str) -> str:
    """Targets of all anchors, in document order, unquoted and trimmed."""
    bare = "regexp_replace(hr, '^[\"\\']|[\"\\']$', '')"
    return f"transform({find_all(markup, HREF, 1)}, hr -> {strip(decode_entities(bare))})"


def text_emails(text: str) -> str:
    return f"if(contains({text}, '@'), {find_all(text, K.EMAIL_IN_TEXT)}, {NO_STRINGS})"


def text_phones(text: str) -> str:
    return find_all(text, K.PHONE_IN_TEXT)


def link_emails(links: str) -> str:
    address = strip("regexp_extract(substring(lm, 8), '^[^?]*', 0)")
    return f"filter(transform(filter({links}, lm -> startswith(lm, 'mailto:')), lm -> {address}), lm -> lm <> '')"


def link_phones(links: str) -> str:
    number = strip("substring(lt, 5)")
    return f"filter(transform(filter({links}, lt -> startswith(lt, 'tel:')), lt -> {number}), lt -> lt <> '')"


def value_set(*arrays: str) -> str:
    """Distinct values of several arrays, sorted by code point."""
    return f"array_sort(array_distinct(concat({', '.join(arrays)})))"


# --- JSON-LD -------------------------------------------------------------------------------


def _as_items(v: str) -> str:
    """A variant that is an array as its elements, anything else as one element."""
    return f"if(schema_of_variant({v}) LIKE 'ARRAY<%', try_variant_get({v}, '$', 'array<variant>'), array({v}))"


def _objects(items: str) -> str:
    return f"filter({items}, ob -> coalesce(schema_of_variant(ob) LIKE 'OBJECT<%', false))"


def without_comments(html: str) -> str:
    """Html without comments; what looks like one inside a script is the script's own text."""
    either = r"(?is)<!--.*?-->|(<script\b[^>]*>.*?</script\s*>)"
    return f"regexp_replace({html}, {q(either)}, ' $1')"


def jsonld_objects(html: str) -> str:
    """Objects of all valid JSON-LD blocks, each followed by its contact points."""
    blocks = f"if(contains(lower({html}), 'ld+json'), {find_all(without_comments(html), JSONLD, 1)}, {NO_STRINGS})"
    parsed = f"filter(transform({blocks}, jb -> try_parse_json({strip('jb')})), jp -> jp IS NOT NULL)"
    roots = f"flatten(transform({parsed}, jp -> {_as_items('jp')}))"
    points = let(
        "cp", "try_variant_get(jo, '$.contactPoint', 'variant')",
        f"if(cp IS NULL, CAST(array() AS ARRAY<VARIANT>), {_objects(_as_items('cp'))})",
    )
    return f"flatten(transform({_objects(roots)}, jo -> concat(array(jo), {points})))"


def jsonld_values(objects: str, name: str) -> str:
    """Sorted distinct non-blank scalars under `name`; 0 and false count as absent."""
    kind = f"schema_of_variant(try_variant_get(jv, '$.{name}', 'variant'))"
    text = strip(f"try_variant_get(jv, '$.{name}', 'string')")
    scalar = (
        f"CASE WHEN {kind} LIKE 'ARRAY<%' OR {kind} LIKE 'OBJECT<%' THEN NULL "
        f"WHEN {kind} <> 'STRING' AND {text} IN ('0', '0.0', 'false') THEN NULL ELSE {text} END"
    )
    return value_set(f"filter(transform({objects}, jv -> {scalar}), js -> js IS NOT NULL AND js <> '')")


# --- links ---------------------------------------------------------------------------------


def resolve_url(base: str, href: str) -> str:
    """Absolute form of `href` found on page `base`; both are names, not expressions."""
    path = f"regexp_extract({base}, '^https?://[^/?#]*([^?#]*)', 1)"
    origin = f"regexp_extract({base}, '^(https?://[^/?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/')"
    merged = let("um", f"if(startswith({href}, '/'), {href}, {folder} || {href})", _without_dots("um"))
    return (
        f"CASE WHEN {href} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {href} "
        f"WHEN startswith({href}, '//') THEN regexp_extract({base}, '^(https?:)', 1) || {href} "
        f"WHEN startswith({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href} "
        f"WHEN startswith({href}, '?') THEN {origin} || {path} || {href} "
        f"ELSE {origin} || {merged} END"
    )


def _without_dots(url: str) -> str:
    """Apply '.' and '..' segments of the path part."""
    step = (
        "CASE WHEN sg = '..' THEN slice(ac, 1, greatest(size(ac) - 1, 1)) WHEN sg = '.' THEN ac "
        "ELSE array_append(ac, sg) END"
    )
    kept = f"array_join(aggregate(split(up, '/'), {NO_STRINGS}, (ac, sg) -> {step}), '/')"
    applied = f"{kept} || if(up RLIKE {q(r'/\.\.?$')}, '/', '') || substring({url}, length(up) + 1)"
    return let(
        "up", f"regexp_extract({url}, '^[^?#]*', 0)", f"if(up RLIKE {q(r'(^|/)\.\.?(/|$)')}, {applied}, {url})"
    )


def contact_links(base: str, links: str, most: int | None = None) -> str:
    """Distinct absolute http(s) links that look like contact pages, in document order; with `most` the first so many."""
    wanted = f"filter({links}, cl -> lower(cl) RLIKE {q('|'.join(K.CONTACT_LINK_WORDS))})"
    absolute = f"filter(transform({wanted}, cl -> {resolve_url(base, 'cl')}), cu -> cu RLIKE '(?i)^https?:')"
    return f"array_distinct({absolute})" if most is None else f"slice(array_distinct({absolute}), 1, {most})"


# --- page signals --------------------------------------------------------------------------


def chat_signal(html_lower: str, keywords: Sequence[str] = K.CHAT_KEYWORDS) -> str:
    """True if a keyword or a chat vendor's marker occurs. Markers that contain another are implied by it."""
    wanted = sorted({w.lower() for w in (*keywords, *K.CHAT_VENDOR_MARKERS)})
    minimal = [w for w in wanted if not any(o != w and o in w for o in wanted)]
    return "(" + " OR ".join(f"contains({html_lower}, {q(w)})" for w in minimal) + ")"


def fresh_wording(html_lower: str) -> str:
    """The patterns are tried only on pages that hold one of the words they all need."""
    possible = " OR ".join(f"contains({html_lower}, {q(w)})" for w in K.FRESHNESS_WORDS)
    return f"(({possible}) AND {html_lower} RLIKE {q('|'.join(f'({p})' for p in K.FRESHNESS_PATTERNS))})"


def fresh_signal(wording: str, updated: str, length: str) -> str:
    return f"({wording} OR ({updated} AND {length} > {K.FRESHNESS_MIN_CHARS}))"


def speed_score(ms: str) -> str:
    """0-100 from a response time; unknown or negative times have none."""
    ladder = " ".join(f"WHEN {ms} < {bound} THEN {score}" for bound, score in K.SPEED_LADDER)
    slow = f"greatest(5, 25 - least(20, floor(({ms} - 6000) / 500)))"
    return f"CAST(CASE WHEN {ms} IS NULL OR {ms} < 0 THEN NULL {ladder} ELSE {slow} END AS INT)"
