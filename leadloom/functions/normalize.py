"""Comparable keys for websites, e-mails, phones and company names."""

from __future__ import annotations

from leadloom.functions.text import digits, let, q, squash, strip


def website_key(x: str, www: str = "chars") -> str:
    v = f"regexp_replace(lower({strip(x)}), '^https?://', '')"
    if www == "prefix":
        v = f"regexp_replace({v}, {q(r'^www\.')}, '')"
    elif www == "chars":
        v = f"trim(LEADING 'w.' FROM {v})"
    else:
        raise ValueError(f"unknown www option: {www}")
    return f"nullif(trim(TRAILING '/' FROM {v}), '')"


def email_key(x: str) -> str:
    return f"nullif(lower({strip(x)}), '')"


def phone_key(x: str) -> str:
    return let(
        "ph", strip(x), f"if(startswith(ph, '+'), '+', '') || nullif({digits('ph')}, '')"
    )


def company_key(x: str) -> str:
    return f"nullif(lower({squash(x)}), '')"


def page_key(url: str) -> str:
    """Key under which a page of the crawl snapshot is looked up: no scheme, www, fragment or end slash."""
    return f"nullif(trim(TRAILING '/' FROM regexp_replace({website_key(url)}, '#.*$', '')), '')"


def request_key(*parts: str) -> str:
    """Key of a text query: its parts joined by a blank, lower-cased."""
    return f"nullif(lower({squash('concat_ws(' + q(' ') + ', ' + ', '.join(parts) + ')')}), '')"


def with_scheme(url: str) -> str:
    return let("wu", f"nullif({strip(url)}, '')", "if(wu RLIKE '^https?://', wu, 'https://' || wu)")
