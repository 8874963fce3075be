"""Mask strategies as Column functions.

Every strategy maps a string Column to a string Column; NULL stays NULL and
an unknown strategy name redacts.  ``apply_strategy`` picks the strategy per
row from a strategy column with one ``CASE`` chain, so a whole table is
masked in a single projection.  ``SQL`` holds the DuckDB twin of each
strategy for the oracle statements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def _red() -> Column:
    return F.lit(REDACTED)


def last4(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 4, c).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(4))))


def first2last2(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 4, c).otherwise(F.concat(F.left(c, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2))))


def hash_value(c: Column, salt: str = "", algo: str = "sha1") -> Column:
    src = F.concat(F.lit(salt), c) if salt else c
    h = F.sha1(src) if algo == "sha1" else F.sha2(src, 256)
    return F.upper(F.substring(h, 1, 16))


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), _red())


def mask_email(c: Column) -> Column:
    at = F.instr(c, "@")
    local = F.substring_index(c, "@", 1)
    domain = F.substr(c, at + 1)
    parts = F.filter(F.split(domain, r"\."), lambda p: p != "")
    masked_domain = F.when(
        F.size(parts) >= 2, F.concat(F.left(F.element_at(parts, 1), F.lit(1)), F.lit("***."), F.element_at(parts, -1))
    ).otherwise(F.concat(F.left(domain, F.lit(1)), F.lit("***")))
    ok = (at > 0) & (F.length(domain) > 0)
    return F.when(ok, F.concat(F.left(local, F.lit(1)), F.lit("***@"), masked_domain)).otherwise(_red())


def mask_phone(c: Column) -> Column:
    s = F.regexp_replace(c, r"[\s\-()]+", "")
    return F.when(F.length(s) < 10, _red()).otherwise(F.concat(F.left(s, F.lit(5)), F.lit("***"), F.right(s, F.lit(4))))


def mask_national_id(c: Column) -> Column:
    return F.when(F.length(c) != 11, _red()).otherwise(F.concat(F.lit("****"), F.substring(c, 5, 5), F.lit("**")))


def mask_iban(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s", "")
    n = F.length(s)
    return F.when(n < 8, _red()).otherwise(F.concat(F.left(s, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(s, F.lit(4))))


def mask_ip(c: Column) -> Column:
    o = F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    return F.when(F.size(o) == 4, F.concat(F.element_at(o, 1), F.lit("."), F.element_at(o, 2), F.lit(".*.*"))).otherwise(c)


def mask_dob(c: Column) -> Column:
    day = F.regexp_extract(c, r"-(\d+)$", 1)
    return F.concat(F.lit("****-**-"), F.when(day == "", F.lit("**")).otherwise(day))


def imei_tac(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 8, c).otherwise(F.concat(F.left(c, F.lit(8)), F.repeat(F.lit("*"), n - 8)))


def tokenize(c: Column, key: str = "gatewise") -> Column:
    """M13 token: stable per distinct value (128 bits of a keyed SHA-256)."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(key), c), 256), 1, 32))


def full(c: Column) -> Column:
    return c


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "last4": last4,
    "first2last2": first2last2,
    "hash": hash_value,
    "redact": redact,
    "mask:email": mask_email,
    "mask:phone": mask_phone,
    "mask:national_id": mask_national_id,
    "mask:iban": mask_iban,
    "mask:ip": mask_ip,
    "mask:dob": mask_dob,
    "full": full,
    "imei": imei_tac,
    "tokenize": tokenize,
}


def register_strategy(name: str, fn: Callable[[Column], Column]) -> None:
    """User extension: a strategy is any Column -> Column function."""
    STRATEGIES[name] = fn


def apply_strategy(value: Column, strategy: Column | str) -> Column:
    """Per-row strategy choice; NULL stays NULL, unknown redacts."""
    if isinstance(strategy, str):
        fn = STRATEGIES.get(strategy, redact)
        return F.when(value.isNotNull(), fn(value))
    chain = None
    for name, fn in STRATEGIES.items():
        chain = F.when(strategy == name, fn(value)) if chain is None else chain.when(strategy == name, fn(value))
    return F.when(value.isNotNull(), chain.otherwise(_red()))


# ----------------------------------------------------------------- DuckDB twins


def _sql(name: str, v: str) -> str:
    r = f"'{REDACTED}'"
    return {
        "last4": f"case when length({v}) <= 4 then {v} else repeat('*', length({v})-4) || right({v}, 4) end",
        "first2last2": f"case when length({v}) <= 4 then {v} else left({v},2) || repeat('*', length({v})-4) || right({v},2) end",
        "hash": f"upper(substr(sha1({v}), 1, 16))",
        "redact": r,
        "mask:email": (
            f"case when strpos({v}, '@') > 0 and length(substr({v}, strpos({v}, '@')+1)) > 0 then "
            f"left({v}, 1) || '***@' || case when len(list_filter(string_split(substr({v}, strpos({v}, '@')+1), '.'), lambda p: p <> '')) >= 2 "
            f"then left(list_filter(string_split(substr({v}, strpos({v}, '@')+1), '.'), lambda p: p <> '')[1], 1) || '***.' || "
            f"list_filter(string_split(substr({v}, strpos({v}, '@')+1), '.'), lambda p: p <> '')[-1] "
            f"else left(substr({v}, strpos({v}, '@')+1), 1) || '***' end else {r} end"
        ),
        "mask:phone": (
            f"case when length(regexp_replace({v}, '[\\s\\-()]+', '', 'g')) < 10 then {r} else "
            f"left(regexp_replace({v}, '[\\s\\-()]+', '', 'g'), 5) || '***' || right(regexp_replace({v}, '[\\s\\-()]+', '', 'g'), 4) end"
        ),
        "mask:national_id": f"case when length({v}) <> 11 then {r} else '****' || substr({v}, 5, 5) || '**' end",
        "mask:iban": (
            f"case when length(regexp_replace({v}, '\\s', '', 'g')) < 8 then {r} else left(regexp_replace({v}, '\\s', '', 'g'), 4) || "
            f"repeat('*', length(regexp_replace({v}, '\\s', '', 'g'))-8) || right(regexp_replace({v}, '\\s', '', 'g'), 4) end"
        ),
        "mask:ip": (
            f"case when len(regexp_extract_all({v}, '(\\d+)', 1)) = 4 then regexp_extract_all({v}, '(\\d+)', 1)[1] || '.' || "
            f"regexp_extract_all({v}, '(\\d+)', 1)[2] || '.*.*' else {v} end"
        ),
        "mask:dob": f"'****-**-' || case when regexp_extract({v}, '-(\\d+)$', 1) = '' then '**' else regexp_extract({v}, '-(\\d+)$', 1) end",
        "full": v,
        "imei": f"case when length({v}) <= 8 then {v} else left({v}, 8) || repeat('*', length({v})-8) end",
        "tokenize": f"'tok_' || substr(sha256('gatewise' || {v}), 1, 32)",
    }[name]


def sql_apply(v: str, strategy: str, literal: bool = False) -> str:
    if literal:
        inner = _sql(strategy, v) if strategy in STRATEGIES else f"'{REDACTED}'"
    else:
        inner = "case " + " ".join(f"when {strategy} = '{n}' then {_sql(n, v)}" for n in STRATEGIES) + f" else '{REDACTED}' end"
    return f"case when {v} is null then null else {inner} end"
