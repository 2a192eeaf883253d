"""Explainable lead score: a sum of weights and the list of reasons behind it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from leadloom import constants as K
from leadloom.functions.text import has_text, q, strip
from leadloom.operators.normalize import replace_columns
from leadloom.settings import ScoreOptions

_QUALITY = f"lower({strip('coalesce(contact_quality, \'\')')})"
_FRESH = f"lower({strip('coalesce(last_updated_signal, \'\')')})"
_ON_MAP = "contains(lower(coalesce(source, '')), 'google_maps')"
_BOTH = f"({_QUALITY} = 'likely' AND verification.email.valid AND verification.phone.valid)"
_SPEED = "greatest(0, least(100, website_speed_score))"
_TIMED = "website_speed_score IS NOT NULL"


def _when(*branches: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches) + " END"


def _terms(weight: Callable[[str], str]) -> list[tuple[str, str]]:
    """(points, reason) per dimension, in the order reasons are listed; null points count as 0."""

    def threshold(name: str) -> str:
        return f"CAST({weight(name)} AS INT)"

    fast = f"{_SPEED} >= {threshold('website_speed_high_threshold')}"
    fair = f"{_SPEED} >= {threshold('website_speed_mid_threshold')}"
    slow = f"{_SPEED} < {threshold('website_speed_low_threshold')}"
    website, location, agent = has_text("website"), has_text("location"), has_text("agent_name")
    return [
        (
            _when(*[(f"{_QUALITY} = '{v}'", weight(f"contact_quality_{v}")) for v in ("verified", "likely", "low")]),
            f"if({_QUALITY} IN ('verified', 'likely', 'low'), 'Contact quality ' || {_QUALITY}, 'Contact quality unknown')",
        ),
        (_when((_BOTH, weight("both_channels_bonus"))), _when((_BOTH, "'Both email and phone valid'"))),
        (_when((website, weight("has_website"))), _when((website, "'Website on record'"))),
        (
            _when(("has_chatbot", weight("chatbot_penalty"))),
            _when(
                ("has_chatbot IS NULL", "'Chatbot status unknown (no site crawl)'"),
                ("has_chatbot", "'Chatbot or live-widget signal on site'"),
                ("true", "'No chatbot-style widgets detected'"),
            ),
        ),
        (
            _when((f"{_FRESH} = 'detected'", weight("last_updated_bonus")), ("true", weight("last_updated_unknown_penalty"))),
            _when(
                (f"{_FRESH} = 'detected'", "'Freshness wording on page'"),
                (f"{_FRESH} IN ('unknown', '')", "'No freshness signal in crawl'"),
            ),
        ),
        (
            _when(
                (f"NOT ({_TIMED})", weight("website_speed_unknown_penalty")),
                (fast, weight("website_speed_high_bonus")),
                (fair, weight("website_speed_mid_bonus")),
                (slow, weight("website_speed_low_penalty")),
            ),
            _when(
                (f"NOT ({_TIMED}) AND {website}", "'Website speed not measured'"),
                (f"NOT ({_TIMED})", "NULL"),
                (fast, "'Fast website response'"),
                (fair, "'Moderate website response time'"),
                (slow, "'Slow website response'"),
                ("true", "'Website response time acceptable'"),
            ),
        ),
        (_when((_ON_MAP, weight("google_maps_source_bonus"))), _when((_ON_MAP, "'Google Maps enrichment'"))),
        (_when((location, weight("has_location_bonus"))), _when((location, "'Location on record'"))),
        (_when((agent, weight("has_agent_name_bonus"))), _when((agent, "'Agent name on record'"))),
    ]


def score_expr(weight: Callable[[str], str], base: str) -> str:
    """Clamped sum, rounded half to even."""
    total = " + ".join([f"CAST({base} AS DOUBLE)", *[f"coalesce({points}, 0D)" for points, _ in _terms(weight)]])
    return f"CAST(bround(greatest(0D, least(100D, {total})), 0) AS INT)"


def reason_expr(weight: Callable[[str], str]) -> str:
    return "concat_ws('; ', " + ", ".join(reason for _, reason in _terms(weight)) + ")"


def _scores(weight: Callable[[str], str], base: str) -> dict[str, str]:
    return {"lead_score": score_expr(weight, base), "lead_reason": reason_expr(weight)}


def with_confidence(scored: DataFrame) -> DataFrame:
    return replace_columns(scored, {"confidence_score": "greatest(0, least(100, lead_score))"})


def score_leads(leads: DataFrame, opts: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Set lead_score, lead_reason and confidence_score of verified leads."""
    if not opts.enabled:
        return leads
    return with_confidence(replace_columns(leads, _scores(lambda name: f"{opts.weight(name)!r}D", str(opts.base_score))))


def score_under_profiles(leads: DataFrame, profiles: Mapping[str, ScoreOptions]) -> DataFrame:
    """One row per lead and profile, from one pass over the leads."""
    rows = [
        f"named_struct('profile', {q(name)}, 'base', {opts.base_score}, "
        + ", ".join(f"'{w}', {opts.weight(w)!r}D" for w in K.SCORE_WEIGHTS)
        + ")"
        for name, opts in profiles.items()
    ]
    each = leads.selectExpr("*", f"explode(array({', '.join(rows)})) AS _p")
    scored = replace_columns(each, {"profile": "_p.profile", **_scores(lambda name: f"_p.{name}", "_p.base")})
    return with_confidence(scored).drop("_p")
