"""Does a web host plausibly belong to a company?"""

from __future__ import annotations

from leadloom import constants as K
from leadloom.functions.text import in_list, let, q, struct

# fixed values: words shortened to "prop" in host names
PROPERTY_WORDS = ("property", "properties")


def host_of(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def blocked_host(host: str, match: str = "contains") -> str:
    if match == "contains":
        return "(" + " OR ".join(f"contains({host}, {q(b)})" for b in K.BLOCKED_HOSTS) + ")"
    if match == "suffix":
        names = "|".join(b.replace(".", "\\.") for b in K.BLOCKED_HOSTS)
        return f"({host} RLIKE {q(rf'(^|\.)({names})(:[0-9]+)?$')})"
    raise ValueError(f"unknown host match: {match}")


def plausible_site(company: str, url: str, host_match: str = "contains") -> str:
    """Host shares a name word, the initials, or initials + "prop" with the company."""
    parts = struct(
        words=f"filter(split(lower({company}), '[^a-z0-9]+'), wd -> length(wd) > 2)",
        host=host_of(url),
        compact=f"regexp_replace({host_of(url)}, '[^a-z0-9]', '')",
    )
    others = f"filter(ps.words, wd -> wd NOT IN {in_list(PROPERTY_WORDS)})"
    shared = (
        "size(ps.words) = 0 OR exists(ps.words, wd -> contains(ps.host, wd)) "
        f"OR (size(ps.words) >= 2 AND contains(ps.compact, {_initials('ps.words')})) "
        f"OR (size({others}) BETWEEN 1 AND size(ps.words) - 1 "
        f"AND contains(ps.compact, {_initials(others)} || 'prop'))"
    )
    return let("ps", parts, f"ps.host <> '' AND NOT {blocked_host('ps.host', host_match)} AND ({shared})")


def _initials(words: str) -> str:
    return f"array_join(transform({words}, wi -> substring(wi, 1, 1)), '')"
