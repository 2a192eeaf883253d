"""Page stage: what a lead's website says about it.

Html is read once, turned into a narrow row of signals per page, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import html as H
from leadloom.functions.contacts import PhoneRules, check_email, check_phone
from leadloom.functions.hosts import plausible_site
from leadloom.functions.normalize import company_key, page_key, with_scheme
from leadloom.functions.text import NO_TEXT, has_text, let, struct
from leadloom.operators.dedup import first_per_key
from leadloom.operators.lookup import HOT_KEY_SALTS, lookup_left
from leadloom.operators.normalize import replace_columns
from leadloom.operators.stages import in_plan
from leadloom.settings import PageOptions

NOT_IN_SNAPSHOT = "not_in_snapshot"
_RAW = ("url", "status_code", "elapsed_ms", "html")


def fetch_status(pages: DataFrame) -> DataFrame:
    """Status of each page as a fetch would have reported it; html only where the fetch was good."""
    kept = [c for c in pages.columns if c not in _RAW]
    return pages.selectExpr(
        *kept,
        f"{with_scheme('url')} AS url",
        "status_code",
        "elapsed_ms",
        "coalesce(status_code < 400, false) AS ok",
        "if(coalesce(status_code < 400, false), NULL, coalesce(concat('http_', status_code), 'no_status')) AS error",
        "if(coalesce(status_code < 400, false), html, '') AS html",
    )


def page_signals(pages: DataFrame, opts: PageOptions = PageOptions()) -> DataFrame:
    """One narrow row per page: contacts, contact links and signals. A map-only job over the crawl.

    The steps are separate projections so that cleaned markup and text are computed once per page.
    """
    kept = [c for c in pages.columns if c not in _RAW]
    facts = [*kept, "url", "status_code", "ok", "error", "elapsed_ms"]
    cleaned = fetch_status(pages).selectExpr(
        *facts, "CAST(length(html) AS BIGINT) AS html_chars", "lower(html) AS _lower",
        f"{H.without_code('html')} AS _markup", f"{H.jsonld_objects('html')} AS _objects",
    )
    read = cleaned.selectExpr(
        *facts, "html_chars", "_objects",
        f"{H.visible_text('_markup')} AS _text",
        f"{H.hrefs('_markup')} AS _links",
        f"{H.chat_signal('_lower', opts.chat_keywords)} AS has_chatbot",
        f"{H.fresh_wording('_lower')} AS fresh_wording",
        "contains(_lower, 'updated') AS says_updated",
    )
    return read.selectExpr(
        *facts, "html_chars", f"{page_key('url')} AS page_key",
        f"{H.value_set(H.text_emails('_text'), H.link_emails('_links'))} AS emails",
        f"{H.value_set(H.text_phones('_text'), H.link_phones('_links'))} AS phones",
        f"{H.jsonld_values('_objects', 'email')} AS schema_emails",
        f"{H.jsonld_values('_objects', 'telephone')} AS schema_phones",
        f"{H.contact_links('url', '_links', opts.max_contact_pages)} AS contact_links",
        "has_chatbot", "fresh_wording", "says_updated",
        f"{H.fresh_signal('fresh_wording', 'says_updated', 'html_chars')} AS fresh",
        f"{H.speed_score('elapsed_ms')} AS speed_score",
    )


_LOOKUP_FIELDS = ("ok", "error", "elapsed_ms", "html_chars", "emails", "phones", "schema_emails", "schema_phones",
                  "contact_links", "has_chatbot", "fresh_wording", "says_updated")


def page_lookup(signals: DataFrame) -> DataFrame:
    """(page_key, page): one page per key; of several copies a good one, then the first by URL.

    Copies under one URL are told apart by what was found on them, so the choice never depends on
    the order in which they are read.
    """
    keyed = signals.where("page_key IS NOT NULL").select("page_key", "url", *_LOOKUP_FIELDS)
    rest = ", ".join(f for f in _LOOKUP_FIELDS if f not in ("ok", "error"))
    best = first_per_key(keyed, ["page_key"], f"struct(NOT ok, url, {rest})")
    return best.select("page_key", F.struct(*_LOOKUP_FIELDS).alias("page"))


def plausible_links(search_results: DataFrame, opts: PageOptions = PageOptions()) -> DataFrame:
    """company_key, company_name, rank and link of the search answers that may be a company's own site."""
    taken = search_results if opts.max_search_links is None else search_results.where(f"rank <= {opts.max_search_links}")
    links = taken.selectExpr(
        "company_name", f"{company_key('company_name')} AS company_key", "rank", f"{with_scheme('link')} AS link"
    )
    plausible = plausible_site("company_name", "link", opts.blocked_host_match)
    return links.where(f"company_key IS NOT NULL AND link IS NOT NULL AND {plausible}")


def discovered_sites(search_results: DataFrame, opts: PageOptions = PageOptions()) -> DataFrame:
    """(company_key, discovered): first plausible link of each company's search."""
    first = F.expr("min_by(link, struct(rank, link))").alias("discovered")
    return plausible_links(search_results, opts).groupBy("company_key").agg(first)


def one_link(search_results: DataFrame, opts: PageOptions = PageOptions()) -> DataFrame:
    """The search answer that counts of each company, in the shape of the table."""
    first = F.expr("min_by(struct(company_name, rank, link), struct(rank, link, company_name))").alias("_f")
    return plausible_links(search_results, opts).groupBy("company_key").agg(first).select("_f.*")


def discover_websites(leads: DataFrame, search_results: DataFrame, opts: PageOptions = PageOptions()) -> DataFrame:
    """Leads with the site a web search would have found for their company, as `discovered`."""
    keyed = leads.selectExpr("*", f"{company_key('company_name')} AS company_key")
    sites = discovered_sites(search_results, opts)
    return lookup_left(keyed, sites, "company_key", salts=HOT_KEY_SALTS).drop("company_key")


def discovery_candidates(
    leads: DataFrame, search_results: DataFrame | None, opts: PageOptions = PageOptions()
) -> DataFrame:
    """Leads with `discovered`, which is null without search results or with discovery off."""
    if opts.discover and search_results is not None:
        return discover_websites(leads, search_results, opts)
    return leads.selectExpr("*", f"{NO_TEXT} AS discovered")


def fetch_homepages(leads: DataFrame, lookup: DataFrame, discover: bool = True) -> DataFrame:
    """Leads with `website` as finally used, `page` (null if none) and `enrichment_error`.

    Up to two fetches per lead, primary and fallback, are looked up in one join and folded back by row.
    """
    own = has_text("website")
    first = f"if({own}, website, discovered)"
    second = f"if({own} AND NOT discovered <=> website, discovered, NULL)"
    tries = (
        leads.selectExpr(
            "row_id",
            f"explode(filter(array(named_struct('nr', 1, 'url', {first}), named_struct('nr', 2, 'url', {second})), "
            "ft -> ft.url IS NOT NULL)) AS try",
        )
        .selectExpr("row_id", "try.nr AS nr", "try.url AS url", f"{page_key('try.url')} AS page_key")
    )
    answered = lookup_left(tries, lookup, "page_key").selectExpr(
        "row_id", "named_struct('nr', nr, 'url', url, 'ok', coalesce(page.ok, false), 'page', page) AS t"
    )
    # the first good fetch decides; without one, the last fetch made
    chosen = answered.groupBy("row_id").agg(
        F.expr("min_by(t, struct(if(t.ok, 0, 1), if(t.ok, t.nr, -t.nr)))").alias("t")
    )
    # a site that cannot be fetched is dropped only where no other one is looked for
    site = "coalesce(t.url, website)" if discover else "if(t.ok, t.url, NULL)"
    return replace_columns(
        leads.join(chosen, "row_id", "left"),
        {
            "website": site,
            "page": "if(t.ok, t.page, NULL)",
            "enrichment_error": f"if(NOT t.ok, coalesce(t.page.error, '{NOT_IN_SNAPSHOT}'), NULL)",
        },
    ).drop("t", "discovered")


_EXTRA_FIELDS = ("html_chars", "emails", "phones", "schema_emails", "schema_phones", "has_chatbot",
                 "fresh_wording", "says_updated")


def gather_pages(homes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add `pages`: the homepage followed by up to three contact pages that loaded; null without a homepage.

    At most four narrow structs are collected per lead.
    """
    narrow = "named_struct(" + ", ".join(f"'{f}', page.{f}" for f in _EXTRA_FIELDS) + ")"
    links = homes.selectExpr("row_id", "posexplode(page.contact_links) AS (nr, url)").selectExpr(
        "row_id", "nr", f"{page_key('url')} AS page_key"
    )
    good = lookup.where("page.ok").selectExpr("page_key", f"{narrow} AS page")
    loaded = (
        links.join(good, "page_key")
        .groupBy("row_id")
        .agg(F.expr("array_sort(collect_list(struct(nr, page)))").alias("_extra"))
    )
    extra = f"coalesce(transform(_extra, ex -> ex.page), slice(array({narrow}), 1, 0))"
    return homes.join(loaded, "row_id", "left").selectExpr(
        *[f"`{c}`" for c in homes.columns], f"if(page IS NOT NULL, concat(array({narrow}), {extra}), NULL) AS pages"
    )


def _pick_email(pages: str) -> str:
    """First valid address; disposable ones are counted only up to the pick."""
    checked = f"transform(flatten(transform({pages}, pg -> concat(pg.schema_emails, pg.emails))), ea -> {check_email('ea')})"
    facts = struct(all="ck", first="try_element_at(filter(ck, ce -> ce.valid), 1)",
                   at="array_position(transform(ck, ce -> ce.valid), true)")
    pick = struct(
        value="pk.first.value",
        reason="coalesce(pk.first.reason, 'none')",
        quality="coalesce(pk.first.quality, 'low')",
        disposable="size(filter(if(pk.at > 0, slice(pk.all, 1, CAST(pk.at AS INT)), pk.all), ce -> ce.is_disposable))",
    )
    return let("ck", checked, let("pk", facts, pick))


def _pick_phone(pages: str, region: str | PhoneRules) -> str:
    checked = f"transform(flatten(transform({pages}, pg -> concat(pg.schema_phones, pg.phones))), pa0 -> {check_phone('pa0', region)})"
    facts = struct(total="size(ck)", valid="filter(ck, cp -> cp.valid)")
    pick = struct(
        value="try_element_at(pk.valid, 1).value",
        reason="coalesce(try_element_at(pk.valid, 1).reason, 'none')",
        valid_count="size(pk.valid)",
        total="pk.total",
    )
    return let("ck", checked, let("pk", facts, pick))


def with_site(gathered: DataFrame, phone_region: str | PhoneRules = K.DEFAULT_PHONE_REGION) -> DataFrame:
    """Add `site`: picks, counts and signals over all pages of a lead; null without a homepage."""
    kept = [c for c in gathered.columns if c not in ("page", "pages")]
    picked = gathered.selectExpr(
        *kept, "page.elapsed_ms AS _ms", "pages",
        f"{_pick_email('pages')} AS _email",
        f"{_pick_phone('pages', phone_region)} AS _phone",
        # length of all pages joined by newlines
        "aggregate(pages, CAST(-1 AS BIGINT), (n, pg) -> n + pg.html_chars + 1) AS _chars",
    )
    wording, updated = "exists(pages, pg -> pg.fresh_wording)", "exists(pages, pg -> pg.says_updated)"
    stats = struct(
        schema_contacts_used="size(filter(pages, pg -> size(pg.schema_emails) + size(pg.schema_phones) > 0))",
        email_disposable_rejected="_email.disposable",
        multi_page_fetch_success="size(pages) - 1",
        phone_valid_count="_phone.valid_count",
        phone_total_candidates="_phone.total",
        email_validation_reason="_email.reason",
        phone_validation_reason="_phone.reason",
        email_quality="_email.quality",
        fetch_elapsed_ms="CAST(_ms AS BIGINT)",
    )
    site = struct(
        email="_email.value",
        phone="_phone.value",
        has_chatbot="exists(pages, pg -> pg.has_chatbot)",
        fresh=H.fresh_signal(wording, updated, "_chars"),
        speed_score=H.speed_score("_ms"),
        stats=stats,
    )
    return picked.selectExpr(*kept, f"if(pages IS NOT NULL, {site}, NULL) AS site")


STATS_TYPE = (
    "struct<schema_contacts_used:int,email_disposable_rejected:int,multi_page_fetch_success:int,"
    "phone_valid_count:int,phone_total_candidates:int,email_validation_reason:string,"
    "phone_validation_reason:string,email_quality:string,fetch_elapsed_ms:bigint>"
)


def skip_pages(leads: DataFrame) -> DataFrame:
    """Columns of the page stage for a run that leaves it out."""
    return leads.selectExpr(
        "*", f"{NO_TEXT} AS enrichment_error", f"{NO_TEXT} AS page_email", f"{NO_TEXT} AS page_phone",
        f"CAST(NULL AS {STATS_TYPE}) AS page_stats",
    )


def enrich_from_pages(
    leads: DataFrame,
    lookup: DataFrame,
    search_results: DataFrame | None = None,
    opts: PageOptions = PageOptions(),
    phone_region: str | PhoneRules = K.DEFAULT_PHONE_REGION,
    keep: Callable[[DataFrame, str], DataFrame] = in_plan,
) -> DataFrame:
    """Fill contacts and signals of each lead from its homepage and contact pages (see `page_lookup`).

    With `keep=stage_table` the leads with their discovered sites and the homepages, which are both read twice, are written once.
    """
    if not opts.enabled:
        return skip_pages(leads)
    asked = discovery_candidates(leads, search_results, opts)
    if opts.discover and search_results is not None:
        asked = keep(asked, "discovered")
    homes = keep(fetch_homepages(asked, lookup, opts.discover), "homes")
    return replace_columns(
        with_site(gather_pages(homes, lookup), phone_region),
        {
            "email": "coalesce(nullif(email, ''), site.email)",
            "phone": "coalesce(nullif(phone, ''), site.phone)",
            "has_chatbot": "if(site IS NOT NULL, site.has_chatbot, has_chatbot)",
            "last_updated_signal": "CASE WHEN site.fresh THEN 'detected' WHEN site IS NOT NULL THEN 'unknown' "
            "ELSE last_updated_signal END",
            "website_speed_score": "coalesce(site.speed_score, website_speed_score)",
            "page_email": "site.email",
            "page_phone": "site.phone",
            "page_stats": "site.stats",
        },
    ).drop("site")
