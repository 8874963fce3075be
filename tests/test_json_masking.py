"""JSON masking: paths, ordered rules, containers, odd bodies, exact rewrite."""

import re

import pytest
from pyspark.sql import functions as F

from gatewise.functions import jsontext
from gatewise.functions import pii as PF
from gatewise.operators import jsonmask as J
from gatewise.operators import requests as R
from gatewise.operators.jsontree import json_leaves, json_nodes
from gatewise.sources import gw_bodies

SF = "/root/testdata/sf0.001"
RULES = [{"id": "r-email", "path": "$.user.email", "strategy": "mask:email", "field_type": "email"}]


def _deep(depth, inner):
    return '{"d":' * depth + inner + "}" * depth


@pytest.mark.parametrize(
    ("path", "hits", "misses"),
    [
        ("$.user.email", ["$.user.email"], ["$.user.emails", '$."user.email"', "$.user.email.x", "$.user.email[0]"]),
        ("$..pan", ["$.items[0].pan", "$.pan", '$."a.b".pan'], ["$.items[0].span", '$."x.pan"', "$.pan.x"]),
        ("$.items[*].pan", ["$.items[1].pan"], ["$.items.pan"]),
        ("$.items.pan", ["$.items[0].pan", "$.items.pan"], ["$.items[0][1].pan"]),
        ("$.items[*]", ["$.items[0]"], ["$.items", "$.items[0].x"]),
        ("$.items", ["$.items"], ["$.items[0]"]),
        ("$[*].x", ["$[3].x"], ["$.x"]),
        ("$..a.b", ['$."a.b"', '$.q[0]."a.b"'], ["$.a.b"]),
    ],
)
def test_jsonpath_regex(path, hits, misses):
    rx, below = re.compile(J.jsonpath_regex(path)), re.compile(J.jsonpath_regex(path, below=True))
    for h in hits:
        assert rx.match(h) and below.match(h + ".k") and below.match(h + "[0].k") and not below.match(h)
    for m in misses:
        assert not rx.match(m)


def test_scan_finds_places_and_refuses_what_is_no_json():
    text = ' {"a" : [1.10, {"b.c":"x\\"y"}], "e":{}, "n":null} '
    assert [(n.path, n.type, text[n.start : n.end]) for n in jsontext.scan(text)][1:] == [
        ("$.a", "array", '[1.10, {"b.c":"x\\"y"}]'),
        ("$.a[0]", "number", "1.10"),
        ("$.a[1]", "object", '{"b.c":"x\\"y"}'),
        ('$.a[1]."b.c"', "string", '"x\\"y"'),
        ("$.e", "object", "{}"),
        ("$.n", "null", "null"),
    ]
    for bad in ("", " ", "{", '{"a":}', '{"a":1,}', "[1 2]", "[,]", "{1:2}", '{"a" 1}', "[1]]", "nul", '"x', "[1,]"):
        assert jsontext.scan(bad) is None
    assert jsontext.splice("{bad", {"$": "x"}) == "{bad"
    deep = "[" * 20_000 + "]" * 20_000
    assert len(jsontext.scan(deep)) == 20_000


def test_both_walks_give_the_same_rows(spark):
    body = '{"a":[1,{"b.c":"x\\"y","q\\"":true}],"e":{},"f":[],"n":null,"k":{"l":{"m":2}}}'
    df = spark.createDataFrame([(1, body), (2, _deep(7, body)), (3, None), (4, ""), (5, "{bad"), (6, '"root"')], "id long, body string")
    got = {(r.id, r.path, r.value_type, r.value) for r in json_nodes(df, ["id"], "body").collect() if r.value_type not in ("object", "array") or r.value in ("{}", "[]")}
    want = {(i, p, t, v) for i, b in ((1, body), (2, _deep(7, body)), (6, '"root"')) for p, _, t, v in jsontext.live(b) if t not in ("object", "array") or v in ("{}", "[]")}
    assert got == want
    assert {(r.id, r.path) for r in json_leaves(df, ["id"], "body").collect()} == {w[:2] for w in want}


BODIES = {
    1: _deep(12, '"ann@mail.com"'),
    2: '"ann@mail.com"',
    3: '["ann@mail.com",1.10,1e2,1234567890123456789012345]',
    4: '{"a.b":"ann@mail.com","a":{"b":"kept"}}',
    5: '{"x":"ann@mail.com","x":"kept"}',
    6: '{"x":"kept","x":"ann@mail.com"}',
    7: '{"u":{"n":"x","mail":"ann@mail.com"},"t":[1, 2]}',
    8: '{"pan":null}',
    9: "{bad ann@mail.com",
    10: None,
    11: '{ "keep" : 1.10 }',
}


def _mask(spark, rules, role, bodies=None):
    df = spark.createDataFrame([(i, role, b) for i, b in (bodies or BODIES).items()], "body_id long, role string, body string")
    _, facts, out = J.mask_bodies(df, rules)
    return facts, {r.body_id: r.masked_body for r in out.collect()}


def test_odd_bodies_are_masked_and_kept_exactly(spark):
    rules = [{"id": "c", "path": "$.u", "strategy": "redact", "field_type": "c"}, {"path": "$.pan", "strategy": "last4", "field_type": "pan"}]
    facts, out = _mask(spark, rules, "support_agent")
    mail = '"a***@m***.com"'
    assert out == {
        1: _deep(12, mail),
        2: mail,
        3: f"[{mail},1.10,1e2,1234567890123456789012345]",
        4: f'{{"a.b":{mail},"a":{{"b":"kept"}}}}',
        5: '{"x":"kept"}',
        6: f'{{"x":{mail}}}',
        7: '{"u":"[REDACTED]","t":[1, 2]}',
        **{i: BODIES[i] for i in (8, 9, 10, 11)},
    }
    found = {(r.body_id, r.path, r.rule_id) for r in facts.collect()}
    assert (7, "$.u", "c") in found and not any(i in (8, 9, 10) for i, _, _ in found)
    assert {r for i, _, r in found if i == 2} == {"auto:email"}
    assert "value" not in facts.columns  # facts never carry the original value


def test_rules_apply_in_order_and_full_is_skipped(spark):
    bodies = {1: '{"u":{"e":"ann@mail.com"}}'}
    first = {"id": "a", "path": "$.u.e", "strategy": "redact", "field_type": "pan"}
    later = {"id": "b", "path": "$.u.e", "strategy": "redact", "field_type": "email"}  # full for operators
    facts, out = _mask(spark, [first, later], "operator", bodies)
    assert out[1] == '{"u":{"e":"********.com"}}' and [r.rule_id for r in facts.collect()] == ["a"]
    facts, out = _mask(spark, [first, later], "support_agent", bodies)
    assert out[1] == '{"u":{"e":"[REDACTED]"}}'  # the e-mail strategy on what last4 left
    assert sorted(r.rule_id for r in facts.collect()) == ["a", "b"]
    whole = {"id": "w", "path": "$.u", "strategy": "redact", "field_type": "w"}
    facts, out = _mask(spark, [whole, first], "support_agent", bodies)
    assert out[1] == '{"u":"[REDACTED]"}' and [r.rule_id for r in facts.collect()] == ["w"]
    facts, out = _mask(spark, [first, whole], "support_agent", bodies)
    assert out[1] == '{"u":"[REDACTED]"}' and sorted(r.rule_id for r in facts.collect()) == ["a", "w"]
    assert _mask(spark, [], "admin", bodies)[1] == bodies


def test_entity_strategy_follows_the_role(spark):
    a = spark.createDataFrame([(i, "$.n", 0, 3, "PERSON", 0.9) for i in range(1, 5)], "body_id long, path string, start int, end int, entity_type string, confidence double")
    roles = {1: "admin", 2: "auditor", 3: "nobody", 4: "external_partner"}
    v = spark.createDataFrame([(i, "$.n", "Ann", r) for i, r in roles.items()], "body_id long, path string, value string, role string")
    got = {r.body_id: (r.strategy, r.rule_id) for r in J.ner_masking(a, v).collect()}
    assert got == {2: ("hash", "ner:PERSON"), 3: ("redact", "ner:PERSON"), 4: ("redact", "ner:PERSON")}
    own = {"external_partner": ("redact", {"PERSON": "full"}), "auditor": ("", {})}
    got = {r.body_id: r.strategy for r in J.ner_masking(a, v, {"PERSON": "last4"}, policies=own).collect()}
    assert got == {1: "redact", 2: "last4", 3: "redact"}


def test_rewrite_invariants(spark):
    b = R.maskable_gate(gw_bodies(spark, SF)).where(F.col("maskable")).select("body_id", "role", "body")
    _, _, out = J.mask_bodies(b, RULES)
    rows = out.collect()
    for r in rows:
        if r.role == "admin":
            assert r.masked_body == r.body
    # the auto-detect families find nothing they could mask again, except in
    # roles whose policy keeps that field type in full
    res = out.where(~F.col("role").isin("admin", "operator")).select(F.size(PF.scan(F.col("masked_body"), ["pan", "email", "tc_kimlik"])).alias("n")).collect()
    assert all(x.n == 0 for x in res)
