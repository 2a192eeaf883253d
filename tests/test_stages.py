"""Page stage, place stage, resolution and scoring on small fixtures."""

from difflib import SequenceMatcher

import pytest

from leadloom.functions.similarity import name_similarity
from leadloom.operators.pages import enrich_from_pages, page_lookup, page_signals
from leadloom.operators.places import MISSING_SOURCE, enrich_from_places
from leadloom.operators.resolve import decision
from leadloom.operators.score import score_leads
from leadloom.operators.stages import stage_table
from leadloom.operators.verify import verify_leads
from leadloom.plans.lead_run import run_leads
from leadloom.settings import PageOptions, PlaceOptions, ResolveOptions, RunOptions, ScoreOptions
from leadloom.sources.tables import Snapshots
from tests.helpers import PAGE_SCHEMA, leads


def enrich(spark, lead, pages, search=(), opts=PageOptions(), keep=None):
    lookup = page_lookup(page_signals(spark.createDataFrame(pages, PAGE_SCHEMA), opts))
    results = spark.createDataFrame(list(search), "company_name string, rank int, link string")
    kwargs = {"keep": keep} if keep else {}
    return enrich_from_pages(leads(spark, lead), lookup, results, opts, **kwargs).first()


def test_no_site_and_no_discovery_passes_through(spark):
    row = enrich(spark, {"company_name": "A"}, [("https://x.com", 200, 10, "x")], opts=PageOptions(discover=False))
    assert row["website"] is None and row["enrichment_error"] is None and row["has_chatbot"] is None


def test_discovered_site_is_used(spark):
    search = [("Acme  Homes", 1, "https://facebook.com/acme"), ("Acme Homes", 2, "acmehomes.com"), ("Acme Homes", 9, "https://acme.org")]
    row = enrich(spark, {"company_name": "Acme Homes"}, [("http://www.acmehomes.com/", 200, 300, "me@acme.com")], search)
    assert (row["website"], row["email"], row["website_speed_score"]) == ("https://acmehomes.com", "me@acme.com", 100)


@pytest.mark.parametrize("discover,website", [(True, "dead.com"), (False, None)])
def test_dead_site(spark, discover, website):
    row = enrich(spark, {"company_name": "A", "website": "dead.com"}, [("https://dead.com", 500, 10, "")], opts=PageOptions(discover=discover))
    assert (row["website"], row["enrichment_error"]) == (website, "http_500")


def test_fallback_site_after_a_dead_one(spark):
    pages = [("https://dead.com", 500, 10, ""), ("https://acme.org", 200, 10, "a@acme.org")]
    row = enrich(spark, {"company_name": "Acme", "website": "dead.com"}, pages, [("Acme", 1, "https://acme.org/")])
    assert (row["website"], row["enrichment_error"], row["email"]) == ("https://acme.org/", None, "a@acme.org")
    row = enrich(spark, {"company_name": "Acme", "website": "dead.com"}, pages[:1], [("Acme", 1, "https://acme.org/")])
    assert (row["website"], row["enrichment_error"]) == ("https://acme.org/", "not_in_snapshot")


def test_contact_pages_counts_and_picks(spark):
    home = '<a href="/contact">c</a><a href="/about">a</a><a href="/team">gone</a><a href="/agents">4th</a> +27 82 555 0100'
    pages = [
        ("https://acme.com/", 200, 10, home),
        ("https://acme.com/contact", 200, 10, 'b@mailinator.com c@acme.com <script type="application/ld+json">{"email":"d@yopmail.com"}</script>'),
        ("https://acme.com/about", 200, 10, "a@acme.com z@mailinator.com 12-34-56-78"), ("https://acme.com/agents", 200, 10, "x@acme.com"),
    ]
    for keep in (None, stage_table):
        for limit, gathered in ((3, 2), (None, 3)):
            row = enrich(spark, {"company_name": "Acme", "website": "acme.com"}, pages, opts=PageOptions(max_contact_pages=limit), keep=keep)
            stats = row["page_stats"]
            assert (row["email"], row["phone"]) == ("c@acme.com", "+27825550100")
            assert (stats["email_disposable_rejected"], stats["schema_contacts_used"], stats["multi_page_fetch_success"]) == (2, 1, gathered)
        assert (stats["phone_total_candidates"], stats["phone_valid_count"]) == (2, 1)


def test_fresh_length_counts_all_pages(spark):
    pages = [("https://a.com", 200, 1, "updated <a href=/contact>c</a>" + "x" * 80), ("https://a.com/contact", 200, 1, "y" * 100)]
    assert enrich(spark, {"website": "a.com"}, pages)["last_updated_signal"] == "detected"
    assert enrich(spark, {"website": "a.com"}, pages[:1])["last_updated_signal"] == "unknown"


PLACES = "place_id string, name string, formatted_address string, website_uri string, national_phone string, international_phone string"


def snapshots(spark, search, places=(("p1", "n", "77 Knysna Road, George", "https://www.scprop.co.za/", "044 001 0004", None),), geo=()):
    return Snapshots(
        geocodes=spark.createDataFrame(list(geo), "raw_location string, rank int, formatted_address string"),
        place_search=spark.createDataFrame(search, "query string, rank int, place_id string, name string, formatted_address string"),
        places=spark.createDataFrame(list(places), PLACES),
    )


def test_name_only_place(spark):
    s = snapshots(spark, [("Southern Cape Properties", 1, "p1", "Southern Cape Properties", "77 Knysna Road, George")])
    row = enrich_from_places(leads(spark, {"company_name": "Southern Cape Properties", "location": "bad"}), s).first()
    assert (row["website"], row["phone"], row["source"]) == ("https://www.scprop.co.za/", "044 001 0004", "input,google_maps")
    assert row["location"] == "77 Knysna Road, George"


def test_place_tiers_threshold_and_location(spark):
    geo = [("George", 2, "no"), ("George", 1, "George, South Africa")]
    near = ("acme homes george, south africa", 2, "p1", "Acme Homes Ltd", "1 Rd, George, South Africa")
    far = ("acme homes george, south africa", 1, "p2", "Acme Homes Ltd", "1 Rd, Elsewhere")
    low = ("acme homes george, south africa", 3, "p1", "Random Company Name", "x")
    name_only = ("Acme Homes", 1, "p1", "Acme Homes", "x")
    lead = leads(spark, {"company_name": "Acme Homes", "location": "George"})
    match = lambda rows, **o: enrich_from_places(lead, snapshots(spark, rows, geo=geo), PlaceOptions(**o)).first()
    assert match([far, near])["place_website"] is not None  # the nearer one wins over the earlier one
    assert match([far])["place_website"] is None  # no details for p2
    assert match([name_only])["location"] == "George, South Africa"
    assert match([low, name_only])["place_website"] is None  # an answer of tier 1 rules tier 2 out
    assert match([near], min_name_match=0.95)["place_website"] is None


def test_missing_place_tables_are_an_error_not_a_failure(spark):
    row = enrich_from_places(leads(spark, {"company_name": "A"}), Snapshots()).first()
    assert row["google_maps_error"] == MISSING_SOURCE


def test_gestalt_similarity_against_brute_force(spark):
    names = ["Acme Homes", "acme homes", "Homes Acme", "", "X", "The Acme Homes Company of George", "Blue Door"]
    pairs = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", name_similarity("a", "b", 0.5).alias("s")).collect()
    for r in got:
        a, b = r["a"].lower(), r["b"].lower()
        want = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert (r["s"] >= 0.5) == (want >= 0.5) and (r["s"] < 0.5 or r["s"] == pytest.approx(want))


def test_place_match_ratio_against_brute_force(spark, sf):
    from workload import queries as Q
    from workload.views import view

    located = {(r["company_name"], r["normalized_location"]) for r in Q.located(spark, sf).collect()}
    answers: dict[str, list] = {}
    for r in view(spark, sf, "place_search").collect():
        answers.setdefault(r["query"].lower(), []).append(r)
    want = set()
    for company, loc in located:
        found = answers.get(f"{company} {loc}".lower(), []) if loc else []
        scored = []
        for r in found or answers.get(company.lower(), []):
            s = SequenceMatcher(None, company.lower(), r["name"].lower()).ratio()
            if s >= 0.5:
                bonus = 0 if not loc else 0.15 if loc.lower() in r["formatted_address"].lower() else -0.05
                scored.append((s + bonus, -r["rank"], r["place_id"]))
        if scored and max(scored)[2]:
            want.add((company, loc, max(scored)[2]))
    got = {(r["company"], r["normalized_location"], r["place_id"]) for r in Q.QUERIES["place_match_ratio"](spark, sf).collect()}
    assert got == want and got


CAND = "array<struct<field:string,source:string,value:string,validated:boolean,confidence:double,validation_reason:string,timestamp:timestamp>>"


def decide(spark, field, current, *cands):
    rows = [(field, s, v, ok, c, "", None) for s, v, ok, c in cands]
    df = spark.createDataFrame([(field, current, rows)], f"field string, current string, list {CAND}")
    return df.selectExpr("named_struct('field', field, 'current', current, 'list', list) AS c").selectExpr(f"{decision('c')} AS d").first()["d"]


def test_website_tie_prefers_the_validated_place(spark):
    d = decide(spark, "website", "a.com", ("website_enrichment", "a.com", True, 0.75), ("google_maps", "b.com", True, 0.75))
    assert (d["chosen_value"], d["tie_break_reason"]) == ("b.com", "prefer_google_maps_if_verified")
    assert d["alternatives"][0]["losing_reason"] == "not_selected_after_tie_break"


def test_other_ties(spark):
    d = decide(spark, "phone", "2", ("input", "1", True, 0.5), ("google_maps", "2", True, 0.5))
    assert (d["chosen_value"], d["tie_break_reason"]) == ("2", "keep_current_on_tie")
    d = decide(spark, "phone", "3", ("input", "1", True, 0.5), ("google_maps", "2", True, 0.5))
    assert (d["chosen_value"], d["tie_break_reason"]) == ("1", "tie_first_candidate")
    d = decide(spark, "phone", "3", ("input", "1", True, 0.35), ("google_maps", "2", False, 0.9))
    assert (d["chosen_value"], d["decision_reason"]) == ("1", "highest_validated_confidence")
    d = decide(spark, "phone", None)
    assert (d["chosen_source"], d["chosen_value"], d["tie_break_reason"]) == ("current", None, "no_candidates")


def tagged(spark, **fields):
    from leadloom.operators.mapping import map_columns, tag_rejects

    schema = ", ".join(["row_id bigint", *[f"{k} string" for k in fields]])
    return tag_rejects(map_columns(spark.createDataFrame([(0, *fields.values())], schema)))


@pytest.mark.parametrize("strict,phone,email", [(False, "0825550100", "x@page.com"), (True, "+27825550111", "x@page.com")])
def test_provenance_option(spark, strict, phone, email):
    pages = spark.createDataFrame([("https://acme.com", 200, 10, "x@page.com +27 82 555 0111")], PAGE_SCHEMA)
    opts = RunOptions(places=PlaceOptions(enabled=False), resolve=ResolveOptions(strict_provenance=strict))
    t = tagged(spark, company_name="Acme", website="https://acme.com", email="own@acme.com", phone="082 555 0100")
    row = run_leads(t, Snapshots(site_pages=pages), opts).leads.first()
    assert (row["phone"], row["email"]) == (phone, email)


def test_place_phone_beats_input_phone(spark):
    s = snapshots(spark, [("Acme Homes", 1, "p1", "Acme Homes", "x")])
    run = run_leads(tagged(spark, company="Acme Homes", phone="0825550100"), s, RunOptions(pages=PageOptions(enabled=False)))
    row = run.leads.first()
    history = row["enrichment_history"]
    assert row["phone"] == "044 001 0004" and row["contact_quality"] == "likely"
    assert history["decisions"]["phone"]["chosen_source"] == "google_maps"
    assert history["verification"]["phone"]["normalized"] == "+27440010004"
    counts = run.summary.first().asDict()
    assert (counts["input_rows"], counts["google_maps_matched"], counts["scored_rows"], counts["phone_e164_valid_rate"]) == (1, 1, 1, 0.0)


def scored(spark, opts=ScoreOptions(), **lead):
    extra = {k: lead.pop(k) for k in ("has_chatbot", "website_speed_score") if k in lead}
    df = verify_leads(leads(spark, {"source": "", **lead}))
    for k, v in extra.items():
        df = df.withColumn(k, df[k] if v is None else __import__("pyspark").sql.functions.lit(v))
    return score_leads(df, opts).first()


BOTH = {"email": "a@example.com", "phone": "+27825550199"}


@pytest.mark.parametrize(
    "lead,score",
    [
        ({**BOTH, "website": "a.com", "has_chatbot": False, "last_updated_signal": "detected"}, 85),
        ({**BOTH, "website": "a.com", "has_chatbot": True, "last_updated_signal": "detected"}, 75),
        ({**BOTH, "website": "a.com", "has_chatbot": False, "last_updated_signal": "detected", "website_speed_score": 90}, 89),
        ({**BOTH, "website": "a.com", "has_chatbot": False, "last_updated_signal": "detected", "website_speed_score": 20}, 80),
        ({**BOTH, "website": "a.com", "has_chatbot": False, "last_updated_signal": "detected", "website_speed_score": 40}, 85),
        ({}, 30),
        ({"email": "a@example.com", "location": "L", "agent_name": "A", "source": "Google_Maps"}, 65),
    ],
)
def test_scores(spark, lead, score):
    row = scored(spark, **lead)
    assert (row["lead_score"], row["confidence_score"]) == (score, score)


def test_score_rounds_half_to_even_and_clamps(spark):
    assert scored(spark, ScoreOptions(weights={"contact_quality_low": -14.5}))["lead_score"] == 30
    assert scored(spark, ScoreOptions(weights={"contact_quality_low": 500}))["lead_score"] == 100
    assert scored(spark, ScoreOptions(base_score=0))["lead_score"] == 0


def test_scoring_off_keeps_mapped_values(spark):
    t = tagged(spark, company_name="A", lead_score="77", lead_reason="given")
    opts = RunOptions(pages=PageOptions(enabled=False), places=PlaceOptions(enabled=False), score=ScoreOptions(enabled=False))
    row = run_leads(t, opts=opts).leads.first()
    assert (row["lead_score"], row["lead_reason"], row["contact_quality"]) == (77, "given", "low")


def test_lookup_with_hot_and_missing_keys(spark):
    from leadloom.operators.lookup import lookup_left

    keys = ["hot"] * 60 + [None] * 30 + ["a", "b", "absent"]
    left = spark.createDataFrame(list(enumerate(keys)), "row_id bigint, k string")
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("unasked", 4)], "k string, v int")
    want = {i: {"hot": 1, "a": 2, "b": 3}.get(k) for i, k in enumerate(keys)}
    for salts in (1, 16):
        out = lookup_left(left, table, "k", salts=salts)
        assert out.columns == ["row_id", "k", "v"]
        assert {r["row_id"]: r["v"] for r in out.collect()} == want


def test_hot_company_and_copied_pages(spark):
    """A third of all leads under one name and location, and many copies of one page, still give one row per lead."""
    geo = [("George", 1, "George, South Africa")]
    s = snapshots(spark, [("acme homes george, south africa", 1, "p1", "Acme Homes", "George, South Africa")], geo=geo)
    many = [{"company_name": "Acme Homes", "location": "George", "website": f"s{i}.com"} for i in range(100)]
    others = [{"company_name": f"Other {i}", "website": f"o{i}.com"} for i in range(200)]
    out = enrich_from_places(leads(spark, *many, *others), s)
    assert out.count() == 300 and out.where("place_website IS NOT NULL").count() == 100
    copies = [("https://www.s1.com/", 200, 10, f"mail{i}@s1.com") for i in range(50)] + [("http://s1.com", 500, 1, "")]
    lookup = page_lookup(page_signals(spark.createDataFrame(copies, PAGE_SCHEMA)))
    assert lookup.count() == 1
    first = enrich_from_pages(leads(spark, *many), lookup.repartition(7), None).where("website = 's1.com'").first()
    assert first["email"] == "mail0@s1.com"
