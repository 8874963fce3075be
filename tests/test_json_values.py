"""One value form for both JSON walks, and the row-wise diff against a plain comparison."""

import json
import random
from decimal import Decimal

from gatewise.operators.canary import structural_diff
from gatewise.operators.jsondiff import diff_bodies
from gatewise.operators.jsontree import json_nodes

ODD = '{"n":1.10,"e":1e2,"z":1.0,"i":10000000000000000,"f":2.5e-1,"o":{"b":1, "a":2.50},"l":[ 1e1 ,{}],"q":"1.10"}'


def _deep(inner, levels=9):
    return '{"d":' * levels + inner + "}" * levels


def test_flat_deep_and_repeated_bodies_have_one_form(spark):
    repeated = ODD[:-1] + ',"n":7,"n":1.10}'
    df = spark.createDataFrame([(1, ODD), (2, _deep(ODD)), (3, repeated)], "id long, body string")
    got = {}
    for r in json_nodes(df, ["id"], "body").collect():
        at = "$" + r.path[1 + 2 * 9 :] if r.id == 2 else r.path
        if r.id != 2 or r.path.startswith("$" + ".d" * 9):
            got.setdefault(r.id, {})[at] = (r.value_type, r.value)
    assert got[1] == got[2] == got[3]
    want = {"$.n": "1.1", "$.e": "100", "$.z": "1", "$.i": "10000000000000000", "$.f": "0.25", "$.o": '{"a":2.5,"b":1}', "$.o.a": "2.5", "$.l[0]": "10", "$.l[1]": "{}", "$.q": "1.10"}
    assert {p: got[1][p][1] for p in want} == want


def _leaves(v, path="$"):
    if isinstance(v, dict) and v:
        return {p: x for k, w in v.items() for p, x in _leaves(w, f"{path}.{k}").items()}
    if isinstance(v, list) and v:
        return {p: x for i, w in enumerate(v) for p, x in _leaves(w, f"{path}[{i}]").items()}
    return {path: (type(v) is bool, isinstance(v, str), str(v) if isinstance(v, (dict, list)) else v)}


def _brute(a, b):
    x, y = ({} if t is None else _leaves(json.loads(t, parse_int=Decimal, parse_float=Decimal)) for t in (a, b))
    diff = sorted(p for p in x.keys() | y.keys() if p not in x or p not in y or x[p] != y[p])
    return len(x), len(y), len(x) - sum(p in x for p in diff), diff


def _value(rng, depth):
    k = rng.randrange(10 if depth else 6)
    if k < 6:
        return rng.choice(["1", "1.0", "1e0", "-0", "0", "null", "true", '"1"', '"a,[]{}:\\"x\\":1"', "[]", "{}", "2.50", "2.5"])
    if k < 8:
        return "[" + ",".join(_value(rng, depth - 1) for _ in range(rng.randrange(4))) + "]"
    keys = rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4))
    return "{" + ", ".join(f'"{k}":{_value(rng, depth - 1)}' for k in keys) + "}"


def test_diff_is_the_plain_comparison_of_leaves(spark):
    rng = random.Random(5)
    pairs = [(_value(rng, 3), _value(rng, 3)) for _ in range(250)]
    for _ in range(150):  # alike but for one place, shallow and deep
        inner = [_value(rng, 2) for _ in range(2)]
        n = rng.randrange(0, 9)
        pairs.append((_deep('{"x":%s,"y":[1,2]}' % inner[0], n), _deep('{"y":[1.0,2],"x":%s}' % inner[1], n)))
    pairs += [(None, "[1]"), (None, None), ("{}", "{}"), ("1", "1.0"), ('"' + "a\\n" * 100_000 + '"', '"b"'), ("[[[[[[[[[1]]]]]]]]]", '{"a":[[[[[[[[[[]]]]]]]]]]}')]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    got = {r.id: (r.n_a, r.n_b, r.n_same, r.diff_fields) for r in diff_bodies(df, "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == _brute(a, b), (a, b)


def test_diff_of_invalid_repeated_and_missing_bodies(spark):
    rows = [(1, "{bad", "[1]"), (2, '{"a":1,"a":2}', '{"a":2.0}'), (3, None, None), (4, "{bad", None), (5, '{"a":1,"a":2}', '{"a":1}')]
    got = {r.request_id: (r.similarity, r.diff_fields) for r in structural_diff(spark.createDataFrame(rows, "request_id long, body_p string, body_s string")).collect()}
    assert got == {1: (0.0, ["$[0]"]), 2: (1.0, []), 3: (1.0, []), 4: (1.0, []), 5: (0.0, ["$.a"])}
    empty = spark.createDataFrame([], "request_id long, body_p string, body_s string")
    assert structural_diff(empty).collect() == []
