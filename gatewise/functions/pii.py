"""Personal-data patterns, validators and scan expressions.

A scan is one Column expression: per family ``regexp_extract_all`` (group 1),
``filter`` by the family validator and the value whitelist, ``transform`` to
a match struct, then ``concat`` in family order.  Everything stays inside
Catalyst/codegen; no Python runs per row.

Word boundaries: the reference matches bytewise with ASCII word characters.
Java's ``\\b`` is not ASCII-only, so ``\\b`` is rewritten to an exact ASCII
boundary (word-char before XOR word-char after).  DuckDB's RE2 ``\\b`` is
already ASCII and is kept as is in the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[0-9A-Za-z_]"
ASCII_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


NOT_WORD_BEFORE = f"(?<!{_W})"
NOT_WORD_AFTER = f"(?!{_W})"


def java_regex(rx: str, word_start: bool = False, word_end: bool = False) -> str:
    """Rewrite ``\\b`` for Java with ASCII word characters.

    When the match always starts (ends) with a word character, a leading
    (trailing) boundary is exactly "no word character before (after)", a
    single cheap lookaround; otherwise the full boundary test is used.
    """
    if word_start and rx.startswith(r"\b"):
        rx = NOT_WORD_BEFORE + rx[2:]
    if word_end and rx.endswith(r"\b"):
        rx = rx[:-2] + NOT_WORD_AFTER
    return rx.replace(r"\b", ASCII_BOUNDARY)


def _digit(v: Column, i: int) -> Column:
    return F.substring(v, i, 1).cast("int")


def luhn(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return (F.length(digits) >= 12) & F.call_function("luhn_check", digits)


def tc_kimlik_valid(v: Column) -> Column:
    d = [None] + [_digit(v, i) for i in range(1, 12)]
    odd = d[1] + d[3] + d[5] + d[7] + d[9]
    even = d[2] + d[4] + d[6] + d[8]
    total10 = d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + d[10]
    return (
        (F.length(v) == 11)
        & (F.substring(v, 1, 1) != "0")
        & (F.pmod(odd * 7 - even, F.lit(10)) == d[10])
        & (F.pmod(total10, F.lit(10)) == d[11])
    )


def msisdn_valid(v: Column) -> Column:
    n = F.length(F.regexp_replace(v, r"\D", ""))
    return (n >= 10) & (n <= 13)


def iban_valid(v: Column) -> Column:
    return F.length(F.regexp_replace(v, r"\s", "")) == 26


def imei_valid(v: Column) -> Column:
    return luhn(F.substring(v, 1, 14))


def ip_valid(v: Column) -> Column:
    octets_ok = F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255)
    return octets_ok & ~v.isin("0.0.0.0", "127.0.0.1")


# ----------------------------------------------------------------- DuckDB twins


def sql_luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    body = (
        f"list_sum(list_transform(range(1, length({d})+1), lambda i: case when (length({d}) - i) % 2 = 1 "
        f"then cast(substr({d}, i, 1) as int)*2 - case when cast(substr({d}, i, 1) as int)*2 > 9 then 9 else 0 end "
        f"else cast(substr({d}, i, 1) as int) end))"
    )
    return f"(length({d}) >= 12 and {body} % 10 = 0)"


def sql_tc(v: str) -> str:
    d = {i: f"cast(substr({v},{i},1) as int)" for i in range(1, 12)}
    odd = "+".join(d[i] for i in (1, 3, 5, 7, 9))
    even = "+".join(d[i] for i in (2, 4, 6, 8))
    tot = "+".join(d[i] for i in range(1, 11))
    return (
        f"(length({v}) = 11 and substr({v},1,1) <> '0' and ((({odd})*7 - ({even})) % 10 + 10) % 10 = {d[10]} "
        f"and (({tot}) % 10) = {d[11]})"
    )


def sql_msisdn(v: str) -> str:
    n = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    return f"({n} between 10 and 13)"


def sql_iban(v: str) -> str:
    return f"(length(regexp_replace({v}, '\\s', '', 'g')) = 26)"


def sql_imei(v: str) -> str:
    return sql_luhn(f"substr({v},1,14)")


def sql_ip(v: str) -> str:
    return f"(len(list_filter(string_split({v}, '.'), lambda x: cast(x as int) > 255)) = 0 and {v} not in ('0.0.0.0', '127.0.0.1'))"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    field_type: str
    classification: str
    placeholder: str
    validator: Callable[[Column], Column] | None = None
    sql_validator: Callable[[str], str] | None = None
    guard: str | None = None  # substring every match contains (cheap pre-check)
    guard_rx: str | None = None  # short regex every text with a match contains
    word_start: bool = True  # every match begins with an ASCII word character
    word_end: bool = True  # every match ends with an ASCII word character

    @property
    def java(self) -> str:
        return java_regex(self.regex, self.word_start, self.word_end)


# The eight pattern families (regex, field type, level, placeholder).
PATTERNS: dict[str, Pattern] = {
    "pan": Pattern("pan", r"\b([3-6]\d{12,18})\b", "pan", "L4", "[REDACTED_PAN]", luhn, sql_luhn, guard_rx=r"\d{11}"),
    "msisdn": Pattern("msisdn", r"(\+?90\s?5\d{2}\s?\d{3}\s?\d{2}\s?\d{2})", "phone", "L3", "[REDACTED_PHONE]", msisdn_valid, sql_msisdn, "90"),
    "tc_kimlik": Pattern("tc_kimlik", r"\b(\d{11})\b", "national_id", "L3", "[REDACTED_NATIONAL_ID]", tc_kimlik_valid, sql_tc, guard_rx=r"\d{11}"),
    "email": Pattern("email", r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b", "email", "L3", "[REDACTED_EMAIL]", None, None, "@", word_start=False),
    "iban_tr": Pattern("iban_tr", r"\b(TR\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2})\b", "iban", "L3", "[REDACTED_IBAN]", iban_valid, sql_iban, "TR"),
    "imei": Pattern("imei", r"\b(\d{15})\b", "imei", "L3", "[REDACTED_IMEI]", imei_valid, sql_imei, guard_rx=r"\d{11}"),
    "ip_address": Pattern("ip_address", r"\b((?:\d{1,3}\.){3}\d{1,3})\b", "ip", "L3", "[REDACTED_IP]", ip_valid, sql_ip, ".", guard_rx=r"\d\.\d"),
    "dob": Pattern("dob", r"\b((19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]))\b", "dob", "L3", "[REDACTED_DOB]", None, None, "-", guard_rx=r"\d-[01]\d-[0-3]\d"),
}
# Fixed order when no family list is given (decision D10) and alias of D1.
DEFAULT_ORDER = ["pan", "imei", "tc_kimlik", "iban_tr", "msisdn", "email", "ip_address", "dob"]
ALIASES = {"iban": "iban_tr", "ip": "ip_address", "phone": "msisdn", "national_id": "tc_kimlik"}
# Default family list of JSON auto-detection.
AUTO_DETECT_DEFAULT = ["pan", "msisdn", "tc_kimlik", "email", "iban"]

MATCH_TYPE = "array<struct<pii_type:string,field_type:string,value:string,classification:string,placeholder:string>>"


def register_pattern(p: Pattern) -> None:
    """User extension: add or replace a family (validator as Column functions)."""
    PATTERNS[p.name] = p
    if p.name not in DEFAULT_ORDER:
        DEFAULT_ORDER.append(p.name)


def resolve(names: Sequence[str] | None) -> list[Pattern]:
    """Chosen families in the given order; unknown names are dropped."""
    names = DEFAULT_ORDER if names is None else names
    out = []
    for n in names:
        n = ALIASES.get(n, n) if n not in PATTERNS else n
        if n in PATTERNS:
            out.append(PATTERNS[n])
    return out


def _family_matches(text: Column, p: Pattern, whitelist: Sequence[str] | None) -> Column:
    arr = F.regexp_extract_all(text, F.lit(p.java), 1)
    cond = None
    if p.guard:
        cond = F.instr(text, p.guard) > 0
    if p.guard_rx:
        g = text.rlike(p.guard_rx)
        cond = g if cond is None else cond & g
    if cond is not None:
        arr = F.when(cond, arr).otherwise(F.array().cast("array<string>"))
    if p.validator is not None:
        arr = F.filter(arr, p.validator)
    if whitelist:
        wl = F.array(*[F.lit(w) for w in whitelist])
        arr = F.filter(arr, lambda v: ~F.array_contains(wl, v))
    return F.transform(
        arr,
        lambda v: F.struct(
            F.lit(p.name).alias("pii_type"),
            F.lit(p.field_type).alias("field_type"),
            v.alias("value"),
            F.lit(p.classification).alias("classification"),
            F.lit(p.placeholder).alias("placeholder"),
        ),
    )


def scan(text: Column, patterns: Sequence[str] | None = None, whitelist: Sequence[str] | None = None) -> Column:
    """P1 as a Column: array of match structs in family order, then position."""
    t = F.coalesce(text, F.lit(""))
    parts = [_family_matches(t, p, whitelist) for p in resolve(patterns)]
    if not parts:
        return F.array().cast(MATCH_TYPE)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def mask_text(text: Column, matches: Column) -> Column:
    """Replace every occurrence of each found value by its placeholder."""
    return F.aggregate(matches, text, lambda acc, m: F.replace(acc, m["value"], m["placeholder"]))


def first_family(text: Column, patterns: Sequence[str] | None = None) -> Column:
    """First family (in the given order) with a valid match, as a struct or NULL.

    Early exit per field: ``coalesce`` of per-family first matches, no explode.
    """
    firsts = [F.try_element_at(_family_matches(F.coalesce(text, F.lit("")), p, None), F.lit(1)) for p in resolve(patterns)]
    return F.coalesce(*firsts) if firsts else F.lit(None).cast(MATCH_TYPE[len("array<") : -1])


# ----------------------------------------------------------------- DuckDB scan text


def sql_scan(text: str, patterns: Sequence[str] | None = None, whitelist: Sequence[str] | None = None) -> str:
    parts = []
    for p in resolve(patterns):
        rx = p.regex.replace("'", "''")
        arr = f"regexp_extract_all(coalesce({text}, ''), '{rx}', 1)"
        conds = []
        if p.sql_validator:
            conds.append(p.sql_validator("v"))
        if whitelist:
            conds.append("v not in (" + ",".join(f"'{w}'" for w in whitelist) + ")")
        if conds:
            arr = f"list_filter({arr}, lambda v: {' and '.join(conds)})"
        arr = (
            f"list_transform({arr}, lambda v: {{'pii_type': '{p.name}', 'field_type': '{p.field_type}', 'value': v, "
            f"'classification': '{p.classification}', 'placeholder': '{p.placeholder}'}})"
        )
        parts.append(arr)
    out = parts[0]
    for a in parts[1:]:
        out = f"list_concat({out}, {a})"
    return out


def sql_mask_text(text: str, matches: str) -> str:
    return f"list_reduce({matches}, lambda acc, mm: replace(acc, mm.value, mm.placeholder), {text})"
