"""Grading of one e-mail address or phone number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

from leadloom import constants as K
from leadloom.functions.text import NO_TEXT, digits, in_list, let, q, strip, struct


def check_email(x: str) -> str:
    """STRUCT<value, valid, reason, is_disposable, quality, is_role_based> of an address."""
    facts = struct(
        v="em",
        shaped=f"em RLIKE {q(K.STRICT_EMAIL)}",
        disposable=f"em RLIKE {q(K.STRICT_EMAIL)} AND split_part(em, '@', 2) IN {in_list(K.DISPOSABLE_DOMAINS)}",
        role=f"em RLIKE {q(K.STRICT_EMAIL)} AND split_part(em, '@', 1) IN {in_list(K.ROLE_PREFIXES)}",
    )
    verdict = struct(
        value="if(ef.shaped AND NOT ef.disposable, ef.v, NULL)",
        valid="ef.shaped AND NOT ef.disposable",
        reason="CASE WHEN ef.v = '' THEN 'empty_email' WHEN NOT ef.shaped THEN 'invalid_format' "
        "WHEN ef.disposable THEN 'disposable_domain' ELSE 'valid_email' END",
        is_disposable="ef.disposable",
        quality="CASE WHEN NOT ef.shaped OR ef.disposable THEN 'low' WHEN ef.role THEN 'medium' ELSE 'high' END",
        is_role_based="ef.role",
    )
    return let("em", f"lower({strip(f'coalesce({x}, {q(str())})')})", let("ef", facts, verdict))


@dataclass(frozen=True)
class PhoneRules:
    """The numbering plans that apply and the region in which numbers without a calling code are dialled.

    A plan is (region, calling code, trunk prefix, international prefix, ranges), see `constants.PHONE_RANGES`.
    """

    region: str = K.DEFAULT_PHONE_REGION
    plans: Sequence[tuple[str, str, str, str, str]] = K.PHONE_PLANS

    def home(self) -> tuple[str, str, str, str, str]:
        found = next((p for p in self.plans if p[0] == self.region), None)
        if found is None:
            raise ValueError(f"no numbering plan for region: {self.region}")
        return found

    def ranges(self) -> list[tuple[str, str, int]]:
        """(first digits, last digits, lengths as a set of bits) of whole numbers with calling code, in order; they do not overlap."""
        rows = sorted((code + low, code + high, lengths << len(code)) for _, code, _, _, text in self.plans for low, high, lengths in _ranges(text))
        for (_, high, _), (low, _, _) in zip(rows, rows[1:], strict=False):
            if low[: len(high)] <= high:
                raise ValueError(f"ranges of numbers overlap at {low}")
        return rows


def _ranges(text: str) -> Iterator[tuple[str, str, int]]:
    for part in text.split():
        areas, _, rest = part.rpartition("/")
        span, _, lengths = rest.partition(":")
        least, _, most = lengths.partition("-")
        bits = sum(1 << n for n in range(int(least), int(most or least) + 1))
        low, _, high = span.partition("-")
        for area in areas.split(",") if areas else ("",):
            first, _, last = area.partition("-")
            for n in range(int(first or 0), int(last or first or 0) + 1):
                # numbers whose area is N11 are services, not lines
                if not area or len(first) != 3 or n % 100 != 11:
                    yield f"{n if area else ''}{low}", f"{n if area else ''}{high or low}", bits


@lru_cache(maxsize=16)
def _assigned(rules: PhoneRules) -> str:
    """SQL: whether the digits `t`, calling code first, are a number of some range, by binary search in the sorted ranges."""
    rows = rules.ranges()
    lows, highs, bits = (f"split('{','.join(map(str, column))}', ',')" for column in zip(*rows, strict=True))
    steps = ", ".join(str(1 << k) for k in reversed(range(len(rows).bit_length())))
    at = f"aggregate(array({steps}), 0, (at, step) -> if(try_element_at({lows}, at + step) <= t, at + step, at))"
    found = struct(high=f"try_element_at({highs}, pi)", bits=f"CAST(try_element_at({bits}, pi) AS INT)")
    inside = "coalesce(substring(t, 1, length(pj.high)) <= pj.high AND (shiftright(pj.bits, length(t)) & 1) = 1, false)"
    return let("pi", at, let("pj", f"if(pi > 0, {found}, NULL)", inside))


def check_phone(x: str, rules: str | PhoneRules = K.DEFAULT_PHONE_REGION) -> str:
    """STRUCT<value, valid, reason> of a phone number, in E.164 form where a numbering plan has it assigned.

    `rules` is a region under the plans known, or plans of the caller's. Calling codes are prefix-free, so at most one plan can apply.
    A number no plan can read is kept as digits when it has enough of them.
    """
    rules = rules if isinstance(rules, PhoneRules) else PhoneRules(rules)
    _, code, trunk, idd, _ = rules.home()

    # from the first '+' or digit on, without an extension
    start = f"regexp_extract(pr, {q(r'(?s)[+0-9].*$')}, 0)"
    dialled = f"regexp_replace({start}, {q(r'(?i)[\s,;]*(ext(ension)?\.?|x|#)[\s:.]*[0-9]{1,7}#?$')}, '')"
    readable = (
        f"pa.num RLIKE {q(r'^[+]*[-\s0-9().\[\]/~*]*$')} "
        f"AND (length(pa.d) >= 3 OR pa.num RLIKE '^[0-9][0-9]$') AND length(pa.d) <= {K.MAX_NATIONAL_DIGITS}"
    )
    by_idd = f"(NOT startswith(pa.num, '+') AND startswith(pa.d, '{idd}'))"
    abroad = f"(startswith(pa.num, '+') OR {by_idd})"
    intl = f"if({by_idd}, substring(pa.d, {len(idd) + 1}), pa.d)"
    # digits with calling code, in the order in which they are tried
    tries = (
        f"if(pb.abroad, array({_drop_trunk('pb.intl', rules)}, pb.intl), "
        f"array(if(startswith(pb.d, '{trunk}'), '{code}' || substring(pb.d, {len(trunk) + 1}), NULL), "
        f"'{code}' || pb.d, if(startswith(pb.d, '{code}'), {_drop_trunk('pb.d', rules)}, NULL)))"
    )
    hit = f"try_element_at(filter({tries}, t -> {_assigned(rules)}), 1)"
    known = " OR ".join(f"substring(pb.intl, 1, {n}) IN {in_list(sorted(p[1] for p in rules.plans if len(p[1]) == n))}" for n in sorted({len(p[1]) for p in rules.plans}))
    as_digits = f"if(startswith(pc.raw, '+'), '+', '') || {digits('pc.raw')}"
    verdict = (
        f"CASE WHEN pc.raw = '' THEN {_verdict(NO_TEXT, False, 'empty_phone')} "
        f"WHEN pc.readable AND pc.hit IS NOT NULL THEN {_verdict(f'{q("+")} || pc.hit', True, 'valid_e164')} "
        f"WHEN pc.readable THEN {_verdict(NO_TEXT, False, 'invalid_number')} "
        f"WHEN length({digits('pc.raw')}) >= {K.MIN_PHONE_DIGITS} THEN {_verdict(as_digits, True, 'fallback_normalized')} "
        f"ELSE {_verdict(NO_TEXT, False, 'invalid_digits')} END"
    )
    return let(
        "pr", strip(f"coalesce({x}, '')"),
        let("pn", dialled,
            let("pa", struct(num="pn", d=digits("pn")),
                let("pb", struct(d="pa.d", intl=intl, abroad=abroad, readable=readable),
                    let("pc", struct(raw="pr", hit=hit, readable=f"pb.readable AND (NOT pb.abroad OR {known})"),
                        verdict)))),
    )


def _drop_trunk(d: str, rules: PhoneRules) -> str:
    """Digits with calling code, without a trunk prefix dialled after it."""
    by_trunk: dict[str, list[str]] = {}
    for _, code, trunk, _, _ in rules.plans:
        by_trunk.setdefault(trunk, []).append(code)
    pattern = "|".join(f"({'|'.join(codes)}){trunk}" for trunk, codes in by_trunk.items())
    groups = "".join(f"${i + 1}" for i in range(len(by_trunk)))
    return f"regexp_replace({d}, {q(f'^(?:{pattern})')}, {q(groups)})"


def _verdict(value: str, valid: bool, reason: str) -> str:
    return struct(value=value, valid=str(valid).lower(), reason=q(reason))
