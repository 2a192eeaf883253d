import html as pyhtml
from urllib.parse import urljoin

import pytest

from leadloom import constants as K
from leadloom.functions import html as H
from leadloom.functions.hosts import plausible_site
from leadloom.operators.pages import page_signals
from leadloom.settings import PageOptions
from tests.helpers import PAGE_SCHEMA, one

PAGE = """<html><!-- no@comment.com --><script type="application/ld+json">{"email":"burn@mailinator.com","telephone":0,
"contactPoint":[{"telephone":"+27 44 001 0004"},3]}</script><script type='application/ld+json'>[{"email":"z@z.com",
"contactPoint":{"email":"q@q.com"}}, 5, {"email":null}]</script><script type="application/ld+json">broken{</script>
<p>mail <b>me&#64;x.com</b> or i&#x6e;fo@y.org &amp;c</p><style>s@s.com</style><template>t@t.com</template>
<a class="x" href="mailto:info@agency.com?subject=hi">m</a><a href='tel:+27 82 555 0199'>t</a><a href=/contact-us>c</a>
<a href="../about.html">a</a><a data-href="no" href="team?x=1">t</a><a href="//o.com/agents">g</a> call +27 (82) 555-0123"""


def signals(spark, html, url="https://site.com/a/b/c.html", status=200, ms=100, opts=PageOptions()):
    return page_signals(spark.createDataFrame([(url, status, ms, html)], PAGE_SCHEMA), opts).first()


def test_page_contacts(spark):
    s = signals(spark, PAGE)
    assert s["emails"] == ["info@agency.com", "info@y.org", "me@x.com"]
    assert s["phones"] == ["+27 (82) 555-0123", "+27 82 555 0199"]
    assert s["schema_emails"] == ["burn@mailinator.com", "q@q.com", "z@z.com"]
    assert s["schema_phones"] == ["+27 44 001 0004"]


def test_contact_links_first_three_distinct(spark):
    three = ["https://site.com/contact-us", "https://site.com/a/about.html", "https://site.com/a/b/team?x=1"]
    assert signals(spark, PAGE, opts=PageOptions(max_contact_pages=3))["contact_links"] == three
    assert signals(spark, PAGE)["contact_links"] == [*three, "https://o.com/agents"]


def test_failed_page_has_no_content(spark):
    s = signals(spark, PAGE, status=503)
    assert (s["ok"], s["error"], s["emails"], s["fresh"]) == (False, "http_503", [], False)


@pytest.mark.parametrize("href", ["/x/y", "x", "x/y?z=1", "../up", "../../../up/", "./same", "#frag", "?q=2", "//h.org/p",
                                  "http://e.org/a/../b", "a/./b", "..", "mailto:x@y.z", "/a/b/../c"])
@pytest.mark.parametrize("base", ["https://site.com", "https://site.com/a/b/c.html", "http://site.com/a/b/?q=1#f"])
def test_resolve_url_like_the_standard(spark, base, href):
    assert one(spark, H.resolve_url("b", "h"), b=base, h=href) == urljoin(base, href)


@pytest.mark.parametrize("text", ["a&#64;b", "x &lt;&gt;&quot;&apos; y", "&amp;#64;", "&#x1F600;!", "&#;&#x;&", "no", "&#169;&#233;"])
def test_entities(spark, text):
    expected = text if text == "&#;&#x;&" else pyhtml.unescape(text)
    assert one(spark, H.decode_entities("t"), t=text) == expected


@pytest.mark.parametrize("marker", K.CHAT_VENDOR_MARKERS)
def test_chat_vendors(spark, marker):
    assert one(spark, H.chat_signal("lower(h)", ()), h=f"<script src='{marker.upper()}'>") is True


def test_chat_absent(spark):
    assert one(spark, H.chat_signal("h"), h="<p>hello</p>") is False


@pytest.mark.parametrize(
    "html,fresh",
    [("", False), ("last   Revised 2020", True), ("Updated : x", True), ("<time class=a datetime='x'>", True),
     ("OG:updated_time", True), ("just updated", False), ("just updated" + "x" * 200, True), ("edited", False)],
)
def test_freshness(spark, html, fresh):
    assert signals(spark, html)["fresh"] is fresh


def test_speed_ladder(spark):
    cases = {0: 100, 399: 100, 400: 88, 900: 72, 1800: 55, 3500: 35, 5000: 35, 6000: 25, 9000: 19, 90000: 5}
    for ms, score in cases.items():
        assert one(spark, H.speed_score("CAST(m AS BIGINT)"), m=str(ms)) == score
    assert one(spark, H.speed_score("CAST(m AS BIGINT)"), m="-1") is None


@pytest.mark.parametrize(
    "url,plain,suffix",
    [("https://scprop.co.za", True, True), ("https://southern.org", True, True), ("https://facebook.com/southern", False, False),
     ("https://southern-netflix.com", False, True), ("http://zzz.com", False, False), ("not a url", False, False)],
)
def test_plausible_site(spark, url, plain, suffix):
    assert one(spark, plausible_site("c", "u"), c="Southern Cape Properties", u=url) is plain
    assert one(spark, plausible_site("c", "u", "suffix"), c="Southern Cape Properties", u=url) is suffix


def test_jsonld_in_a_comment_is_not_read(spark):
    html = '<!-- <script type="application/ld+json">{"email":"hid@x.example"}</script> --><script type="application/ld+json">{"email":"in@x.example"}</script>'
    found = one(spark, f"to_json({H.jsonld_objects('html')})", html=html)
    assert "in@x.example" in found and "hid@x.example" not in found


def test_a_comment_mark_inside_a_script_opens_no_comment(spark):
    block = '<script type="application/ld+json">{"email":"%s"}</script>'
    html = f"<script>var a = '<!--';</script>{block % 'a@b.com'}<!-- {block % 'gone@b.com'} -->{block % 'c@b.com'}"
    found = one(spark, f"to_json({H.jsonld_objects('html')})", html=html)
    assert "a@b.com" in found and "c@b.com" in found and "gone@b.com" not in found
