"""Pieces of DuckDB SQL shared by several oracles."""

from __future__ import annotations

from dialogmeter.functions.text import WHITESPACE
from dialogmeter.functions.tokens import UNESCAPE

# The full mteval-13a rules and one run of characters that are not white space.
SPLIT_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
TOKEN = (
    r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(expr: str) -> str:
    return f"trim(replace({expr}, chr(34), ''), {SPACES})"


def last_line(expr: str) -> str:
    return f"string_split({expr}, chr(10))[-1]"


def token_count(expr: str) -> str:
    out = f"rtrim({expr}, {SPACES})"
    out = f"replace(replace(replace({out}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for old, new in UNESCAPE:
        out = f"replace({out}, {literal(old)}, {literal(new)})"
    out = f"' ' || {out} || ' '"
    for pattern, replacement in SPLIT_RULES:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(replacement.replace('$', chr(92)))}, 'g')"
    return f"len(regexp_extract_all({out}, {literal(TOKEN)}))"


def penalty(c: str, r: str) -> str:
    return f"case when {c} >= {r} then 1.0::double when {c} = 0 then 0.0::double else exp(1 - {r}::double / {c}) end"


def fits(source: str, x: str, y: str, by: list[str]) -> str:
    """CTEs ending in ``fit``: regression per group, the p-value by Simpson's rule.

    With t = sqrt(n-2) tan(theta), the tail probability is the share of the integral of
    cos(theta)^(n-3) that lies beyond theta = asin(|r|).
    """
    keys = "".join(f"{b}, " for b in by)
    group = f"group by {', '.join(by)}" if by else ""
    return f"""
moments as (
  select {keys} regr_count({y}, {x}) as n, regr_slope({y}, {x}) as slope, regr_intercept({y}, {x}) as intercept,
    case when regr_syy({y}, {x}) = 0 then 0.0 else corr({y}, {x}) end as r,
    regr_sxx({y}, {x}) as sxx, regr_syy({y}, {x}) as syy, row_number() over () as id
  from {source} {group}),
bounds as (
  select *, asin(least(abs(r), 1.0)) as lo, least(pi()/2, 14/sqrt(n)) as hi
  from moments where n >= 3 and sxx > 0),
steps as (
  select id, n, i, case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end as w, lo, hi
  from bounds cross join (select unnest(range(0, 4001)) as i)),
areas as (
  select id,
    max(greatest(hi - lo, 0)) * sum(w * pow(greatest(cos(lo + greatest(hi - lo, 0) * i / 4000), 0), n - 3)) as tail,
    max(hi) * sum(w * pow(greatest(cos(hi * i / 4000), 0), n - 3)) as total
  from steps group by id),
fit as (
  select {keys} n, case when sxx > 0 then slope end as slope, case when sxx > 0 then intercept end as intercept,
    case when sxx > 0 then r end as r, case when sxx > 0 then r*r end as r2, tail/total as p,
    case when sxx > 0 and n > 2 then sqrt(greatest(1 - r*r, 0) * syy / sxx / (n - 2)) end as stderr
  from moments left join areas using (id))
"""


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


FIT_COLUMNS = ["slope", "intercept", "r", "r2", "p", "stderr"]


def short_decimal(column: str, digits: int = 6) -> str:
    """A rounded number as plain decimal text without trailing zeros, one digit after the point at least."""
    text = f"rtrim(printf('%.{digits}f', round({column}, {digits})), '0')"
    return f"coalesce(case when {text} like '%.' then {text} || '0' else {text} end, 'nan')"
