"""String helpers. All functions of this package take and give SQL expression text, so that a whole
rule becomes one expression of one projection (`F.expr`), however many steps it has."""

from __future__ import annotations

WHITESPACE = " \t\n\r\x0b\x0c"
NO_TEXT = "CAST(NULL AS STRING)"
NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim(BOTH {q(WHITESPACE)} FROM {x})"


def blank_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def squash(x: str) -> str:
    """Strip and collapse inner whitespace runs to one blank."""
    return f"regexp_replace({strip(x)}, {q(r'\s+')}, ' ')"


def has_text(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def let(name: str, value: str, body: str) -> str:
    """Bind `value` to `name` once and use it several times in `body`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{q(k)}, {v}" for k, v in fields.items()) + ")"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5D) AS BIGINT)"
