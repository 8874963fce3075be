"""JSON body masking (J2-J13) over the table of JSON values of ``jsontree``.

Two legs from one table: masked-field facts (which path, which strategy,
which rule/source -- never the original value) and rewritten bodies, joined
back on the body id.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.functions import pii as PF
from gatewise.functions import strategies as S
from gatewise.functions.jsontext import key_step, splice
from gatewise.operators.jsontree import json_nodes
from gatewise.operators.masking import DEFAULT_POLICIES

# Auto-detect strategy "mask" by field type.
MASK_BY_TYPE = {
    "pan": "last4",
    "phone": "mask:phone",
    "email": "mask:email",
    "national_id": "mask:national_id",
    "iban": "mask:iban",
    "imei": "last4",
    "ip": "mask:ip",
    "dob": "mask:dob",
}
MIN_NER_LEN = 3
NER_MIN_CONFIDENCE = 0.7


_ANY_STEP = r'(?:\.(?:"(?:[^"\\]|\\.)*"|[A-Za-z0-9_]+)|\[\d+\])'


def jsonpath_regex(path: str, below: bool = False) -> str:
    """A simple JSONPath as a regex over canonical paths of values and containers.

    ``$.a.b``, ``$..field`` (any depth), ``$.a[*].b``, ``$.a[*]``, ``$[*].b`` on
    a root array, and implicit iteration when a middle step is an array.  With
    ``below`` it matches the paths inside a hit instead of the hit.
    """
    if path.startswith("$.."):
        out = rf"^\${_ANY_STEP}*" + re.escape(key_step(path[3:]))
    else:
        steps = [s for s in re.sub(r"^\$\.?", "", path).split(".") if s]
        out = r"^\$"
        for i, step in enumerate(steps):
            name, wild = (step[:-3], True) if step.endswith("[*]") else (step, False)
            out += re.escape(key_step(name)) if name else ""
            if wild:
                out += r"\[\d+\]"
            elif i < len(steps) - 1:
                out += r"(?:\[\d+\])?"
    return out + (_ANY_STEP + "+$" if below else "$")


def _strategy_for(role: Column, field_type: str, default: str, policies) -> Column:
    """R1 for a fixed field type as a CASE over the policy roles."""
    policies = DEFAULT_POLICIES if policies is None else policies
    expr = None
    for r, (d, o) in policies.items():
        s = o.get(field_type, d or default)
        expr = F.when(role == r.lower(), F.lit(s)) if expr is None else expr.when(role == r.lower(), F.lit(s))
    return F.lit("redact") if expr is None else expr.otherwise(F.lit("redact"))


def _role(role_col: str) -> Column:
    return F.lower(F.coalesce(F.col(role_col), F.lit("")))


def inside_masked(rules: Sequence[dict], role_col: str = "role", policies=None) -> Column:
    """Whether a value lies inside a container that one of the rules replaces."""
    hits = [
        F.col("path").rlike(jsonpath_regex(r["path"], below=True)) & (_strategy_for(_role(role_col), r.get("field_type", "unknown"), r["strategy"], policies) != "full")
        for r in rules
    ]
    return F.array_contains(F.array(F.lit(False), *hits), True)


def explicit_masking(nodes: DataFrame, rules: Sequence[dict], role_col: str = "role", policies=None) -> DataFrame:
    """Rules one after another, each on what the earlier ones left.

    The strategy follows from the role (the rule's own is the default); a rule
    that resolves to ``full`` is skipped and leaves earlier masks in place.  A
    replaced container hides what it held from later rules and is always
    redacted.  JSON nulls are not masked.  One fact per rule and value:
    (keys, path, rule_id, field_type, strategy, source, step, new_value); the
    highest ``step`` of a path is its final value.  No rules give no facts.
    """
    role = _role(role_col)
    hit_type = "struct<step:int,rule_id:string,field_type:string,strategy:string>"
    hits = []
    for i, r in enumerate(rules):
        ft = r.get("field_type", "unknown")
        strategy = _strategy_for(role, ft, r["strategy"], policies)
        hit = F.struct(F.lit(i).alias("step"), F.lit(r.get("id", f"rule-{i}")).alias("rule_id"), F.lit(ft).alias("field_type"), strategy.alias("strategy"))
        cond = F.col("path").rlike(jsonpath_regex(r["path"])) & (strategy != "full") & ~inside_masked(rules[:i], role_col, policies)
        hits.append(F.when(cond, hit.cast(hit_type)))
    found = F.filter(F.array(*hits).cast(f"array<{hit_type}>"), lambda h: h.isNotNull())
    rows = nodes.where(F.col("value").isNotNull()).withColumn("_hits", found).where(F.size("_hits") > 0)
    container = F.col("value_type").isin("object", "array")
    out_type = "array<struct<step:int,rule_id:string,field_type:string,strategy:string,new_value:string>>"

    def apply(acc: Column, h: Column) -> Column:
        new = F.when(container, F.lit(S.REDACTED)).otherwise(S.apply_strategy(acc["now"], h["strategy"]))
        fact = F.struct(h["step"].alias("step"), h["rule_id"].alias("rule_id"), h["field_type"].alias("field_type"), h["strategy"].alias("strategy"), new.alias("new_value"))
        return F.struct(new.alias("now"), F.concat(acc["facts"], F.array(fact).cast(out_type)).alias("facts"))

    start = F.struct(F.col("value").alias("now"), F.array().cast(out_type).alias("facts"))
    facts = F.aggregate("_hits", start, apply, lambda acc: acc["facts"])
    return rows.select(*nodes.columns, F.inline(facts)).withColumn("source", F.lit("explicit_rule"))


def auto_masking(
    nodes: DataFrame,
    already: DataFrame,
    patterns: Sequence[str] = tuple(PF.AUTO_DETECT_DEFAULT),
    whitelist_paths: Sequence[str] = (),
    role_col: str = "role",
    policies=None,
    rules: Sequence[dict] = (),
) -> DataFrame:
    """Strings not masked before (nor inside a container that ``rules``
    replace) and not whitelisted; the first family with a valid match decides
    the field type; the whole value is masked with the role's strategy
    (``mask`` -> type default).  ``rule_id`` is ``auto:`` and the family."""
    cand = nodes.where((F.col("value_type") == "string") & ~inside_masked(rules, role_col, policies)).join(already.select("body_id", "path"), ["body_id", "path"], "left_anti")
    if whitelist_paths:
        cand = cand.where(~F.col("path").isin(*whitelist_paths))
    first = PF.first_family(F.col("value"), list(patterns))
    d = cand.withColumn("_m", first).where(F.col("_m").isNotNull())
    role = F.lower(F.coalesce(F.col(role_col), F.lit("")))
    strat = None
    for ft in sorted({PF.resolve([p])[0].field_type for p in patterns if PF.resolve([p])}):
        s = _strategy_for(role, ft, "mask", policies)
        s = F.when(s == "mask", F.lit(MASK_BY_TYPE.get(ft, "redact"))).otherwise(s)
        strat = F.when(F.col("_m.field_type") == ft, s) if strat is None else strat.when(F.col("_m.field_type") == ft, s)
    strat = F.lit(None).cast("string") if strat is None else strat
    d = d.withColumn("strategy", strat).withColumn("field_type", F.col("_m.field_type")).withColumn("pii_type", F.col("_m.pii_type"))
    d = d.where(F.col("strategy") != "full")
    return d.withColumn("new_value", S.apply_strategy(F.col("value"), F.col("strategy"))).withColumn("rule_id", F.concat(F.lit("auto:"), "pii_type")).withColumn(
        "source", F.lit("auto_detect")
    ).drop("_m")


def ner_candidates(nodes: DataFrame, masked: DataFrame, max_content: int = 128 * 1024, rules: Sequence[dict] = (), role_col: str = "role", policies=None) -> DataFrame:
    """Strings of length >= 3 not masked yet, with their offsets in the
    per-body detection buffer (parts joined by one delimiter byte).  Bodies
    whose buffer exceeds ``max_content`` have ``within_cap`` false."""
    free = (F.col("value_type") == "string") & (F.length("value") >= MIN_NER_LEN) & ~inside_masked(rules, role_col, policies)
    c = nodes.where(free).join(masked.select("body_id", "path"), ["body_id", "path"], "left_anti")
    w = Window.partitionBy("body_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("part_start", F.coalesce(F.sum(F.length("value") + 1).over(w), F.lit(0)))
    c = c.withColumn("part_end", F.col("part_start") + F.length("value"))
    total = F.max("part_end").over(Window.partitionBy("body_id"))
    return c.withColumn("within_cap", total <= max_content)


def assign_entities(candidates: DataFrame, entities: DataFrame, min_conf: float = NER_MIN_CONFIDENCE) -> DataFrame:
    """An entity belongs to the part whose [start, end) contains it.
    As-of on offsets inside a body (union + last part start <= entity start),
    then containment; straddling, empty or low-confidence spans drop out.
    No pair of part and entity is ever formed."""
    parts = candidates.select("body_id", F.col("part_start").alias("pos"), F.lit(0).alias("_k"), "path", "part_start", "part_end",
                              F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("double").alias("confidence"))
    ents = entities.where((F.col("end") > F.col("start")) & (F.col("confidence") >= min_conf)).select(
        "body_id", F.col("start").alias("pos"), F.lit(1).alias("_k"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("part_start"),
        F.lit(None).cast("bigint").alias("part_end"), "start", "end", "entity_type", "confidence")
    u = parts.unionByName(ents)
    w = Window.partitionBy("body_id").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_p", F.last(F.when(F.col("_k") == 0, F.struct("path", "part_start", "part_end")), ignorenulls=True).over(w))
    e = u.where(F.col("_k") == 1).where(F.col("_p").isNotNull() & (F.col("start") >= F.col("_p.part_start")) & (F.col("end") <= F.col("_p.part_end")))
    return e.select("body_id", F.col("_p.path").alias("path"), "start", "end", "entity_type", "confidence")


def ner_masking(assigned: DataFrame, leaves: DataFrame, entity_strategy: dict[str, str] | None = None, role_col: str = "role", policies=None) -> DataFrame:
    """One mask per field (highest-confidence entity), strategy from the
    entity default with role override by entity type."""
    es = entity_strategy or {"PERSON": "redact", "LOCATION": "redact", "ORGANIZATION": "redact", "MISC": "redact"}
    w = Window.partitionBy("body_id", "path").orderBy(F.col("confidence").desc(), "start")
    one = assigned.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    j = one.join(leaves.select("body_id", "path", "value", role_col), ["body_id", "path"])
    kind, strat = F.col("entity_type"), None
    own = F.create_map(*[x for k, v in es.items() for x in (F.lit(k), F.lit(v))])[kind] if es else F.lit(None).cast("string")
    for r, (default, overrides) in (DEFAULT_POLICIES if policies is None else policies).items():
        by_type = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))])[kind] if overrides else F.lit(None).cast("string")
        s = F.coalesce(by_type, F.lit(default or None).cast("string"), own, F.lit("redact"))
        strat = F.when(_role(role_col) == r.lower(), s) if strat is None else strat.when(_role(role_col) == r.lower(), s)
    j = j.withColumn("strategy", F.lit("redact") if strat is None else strat.otherwise(F.lit("redact"))).where(F.col("strategy") != "full")
    return j.withColumn("field_type", kind).withColumn("new_value", S.apply_strategy(F.col("value"), F.col("strategy"))).withColumn(
        "rule_id", F.concat(F.lit("ner:"), kind)).withColumn("source", F.lit("ner_sidecar"))


def ner_fail_closed(candidates: DataFrame, detected_bodies: DataFrame, fail_mode: str = "closed") -> DataFrame:
    """Bodies without detection output: closed -> redact every candidate."""
    miss = candidates.join(detected_bodies.select("body_id").distinct(), "body_id", "left_anti")
    if fail_mode != "closed":
        return miss.limit(0)
    return miss.withColumn("strategy", F.lit("redact")).withColumn("field_type", F.lit("unknown")).withColumn("new_value", F.lit(S.REDACTED)).withColumn(
        "rule_id", F.lit("ner_fail_closed")).withColumn("source", F.lit("ner_fail_closed"))


FACT_COLS = ["body_id", "path", "rule_id", "field_type", "strategy", "source", "step", "new_value"]


def masked_facts(*parts: DataFrame) -> DataFrame:
    """Union of all masked-field facts (no original value)."""
    out = None
    for p in parts:
        x = (p if "step" in p.columns else p.withColumn("step", F.lit(0))).select(*FACT_COLS)
        out = x if out is None else out.unionByName(x)
    return out.withColumn("mask_source", F.when(F.col("source").startswith("ner"), "ner_detect").otherwise(F.col("source")))


def masking_counters(facts: DataFrame, bodies: DataFrame, consumer_col: str = "role") -> DataFrame:
    """J10 counters: applied{field_type, strategy, consumer}."""
    return facts.join(bodies.select("body_id", consumer_col), "body_id").groupBy("field_type", "strategy", consumer_col).agg(F.count(F.lit(1)).alias("applied"))


@F.pandas_udf(T.StringType())
def _splice_udf(bodies: pd.Series, updates: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else splice(b, {} if u is None else dict(u)) for b, u in zip(bodies, updates)], dtype=object)


def rewrite_bodies(bodies: DataFrame, facts: DataFrame, body_col: str = "body") -> DataFrame:
    """Put the masked values into the text of each body.

    Only the changed places are replaced; everything else, number spellings
    included, stays byte for byte.  Updates are one map per body (bounded by
    the body's own values) joined back on the body id, the last rule's value
    per path.  Bodies without updates pass through, except that bodies with
    repeated keys lose the members no rule has seen.
    """
    last = facts.groupBy("body_id", "path").agg(F.max_by("new_value", "step").alias("new_value"))
    upd = last.groupBy("body_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "new_value"))).alias("_u"))
    j = bodies.join(upd, "body_id", "left")
    as_is = F.col(body_col).isNull() | (F.col("_u").isNull() & F.try_parse_json(body_col).isNotNull())
    return j.withColumn("masked_body", F.when(as_is, F.col(body_col)).otherwise(_splice_udf(F.when(~as_is, F.col(body_col)), F.col("_u")))).drop("_u")


def merge_entities(*engines: DataFrame, min_conf: float = NER_MIN_CONFIDENCE) -> DataFrame:
    """Union of engines, confidence floor, duplicate spans removed (best
    confidence kept per body, start, end, type)."""
    u = engines[0]
    for e in engines[1:]:
        u = u.unionByName(e)
    u = u.where(F.col("confidence") >= min_conf)
    w = Window.partitionBy("body_id", "start", "end", "entity_type").orderBy(F.col("confidence").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def regex_missed(ner_facts: DataFrame, regex_facts: DataFrame) -> DataFrame:
    """Fields the entity engine masked that regex rules did not, by type."""
    return ner_facts.join(regex_facts.select("body_id", "path"), ["body_id", "path"], "left_anti").groupBy("field_type").agg(F.count(F.lit(1)).alias("missed_by_regex"))


def mask_bodies(
    bodies: DataFrame,
    rules: Sequence[dict],
    keys: Sequence[str] = ("body_id", "role"),
    body_col: str = "body",
    patterns: Sequence[str] = tuple(PF.AUTO_DETECT_DEFAULT),
    whitelist_paths: Sequence[str] = (),
    policies=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J1-J4 + J9 + J10 as one job graph: the bodies are walked once and the
    values materialized (they feed the explicit rules, the auto-detect
    anti-join and the NER candidates), then (values, facts, rewritten bodies)
    are returned."""
    from gatewise.operators.common import materialize

    nodes = materialize(json_nodes(bodies, list(keys), body_col))
    j3 = explicit_masking(nodes, rules, policies=policies)
    j4 = auto_masking(nodes, j3, patterns, whitelist_paths, policies=policies, rules=rules)
    facts = masked_facts(j3, j4)
    return nodes, facts, rewrite_bodies(bodies, facts, body_col)


def detect_entities(candidates: DataFrame, detector, schema: str = "body_id long, start int, end int, entity_type string, confidence double") -> DataFrame:
    """Run a user-supplied detector over candidate parts with
    ``mapInPandas`` (one model load per Python worker, Arrow batches).
    ``detector(pdf) -> pdf`` receives body_id, path, value, part_start."""
    return candidates.select("body_id", "path", "value", "part_start").mapInPandas(lambda it: (detector(p) for p in it), schema)
