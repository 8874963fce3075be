"""Leaf-level differences of two JSON bodies that stand in one row.

Both bodies are walked together inside the row, so nothing is exploded,
shuffled or joined.  The fingerprint of a container is its canonical text
(VARIANT keeps keys sorted): containers with equal text are settled with one
leaf count, and only members whose texts differ are looked into.

``DIFF_LEVELS`` levels are planned.  Rows that still differ below them, and bodies
that VARIANT refuses (repeated keys), are compared by a text scan in Arrow
batches with the same result; all other rows hand nulls to it.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.functions.jsontext import live
from gatewise.operators.jsontree import bare_text, key_step, number_text

DIFF_LEVELS = 3
_PAIRS = "array<struct<path:string,a:variant,b:variant>>"
_COUNTS = "n_a long, n_b long, n_same long, diff_fields array<string>"


def _pair(path: Column, a: Column, b: Column) -> Column:
    return F.struct(path.alias("path"), a.alias("a"), b.alias("b"))


def _kind(text: Column) -> Column:
    """object or array for containers that hold something, else leaf; null for nothing."""
    head = F.substring(text, 1, 1)
    return F.when(text.isNull(), F.lit(None)).when(text.isin("{}", "[]"), "leaf").when(head == "{", "object").when(head == "[", "array").otherwise("leaf")


def leaf_count(text: Column) -> Column:
    """Scalars and empty containers of a compact JSON text."""
    return F.regexp_count(F.regexp_replace(bare_text(text, "s$1"), "s:", ""), F.lit(r"[^\[\]{},]+|\[\]|\{\}")).cast("bigint")


def _texted(n: Column) -> Column:
    return F.struct(n["path"].alias("path"), n["a"].alias("a"), n["b"].alias("b"), F.to_json(n["a"]).alias("ta"), F.to_json(n["b"]).alias("tb"))


def _judged(n: Column) -> Column:
    """Kinds and equality; numbers are compared by value."""
    ta, tb = number_text(n["ta"]), number_text(n["tb"])
    keep = [n[c].alias(c) for c in ("path", "a", "b", "ta", "tb")]
    return F.struct(*keep, _kind(n["ta"]).alias("ka"), _kind(n["tb"]).alias("kb"), F.coalesce((n["ta"] == n["tb"]) | (ta == tb), F.lit(False)).alias("same"))


def _open(n: Column) -> Column:
    return ~n["same"] & (F.coalesce(n["ka"] != "leaf", F.lit(False)) | F.coalesce(n["kb"] != "leaf", F.lit(False)))


def _settled(n: Column) -> Column:
    """Leaves that are equal, or the one leaf of either side that is not."""
    equal = F.when(n["same"], leaf_count(n["ta"])).otherwise(0)
    alone = [(~n["same"] & n[t].isNotNull()).cast("bigint").alias(c) for c, t in (("a", "ta"), ("b", "tb"))]
    return F.struct(n["path"].alias("path"), equal.alias("n_same"), *alone)


def _opened(n: Column) -> Column:
    """Members and items of a pair; those of sides of different kinds stay apart."""
    apart = F.coalesce(n["ka"] != n["kb"], F.lit(False))
    kind = F.when(apart, "apart").otherwise(F.coalesce(n["ka"], n["kb"]))
    members = [F.when(kind == "object", F.try_variant_get(n[c], "$", "map<string,variant>")).alias("m" + c) for c in "ab"]
    items = [F.when(kind == "array", F.try_variant_get(n[c], "$", "array<variant>")).alias("i" + c) for c in "ab"]
    return F.struct(n["path"].alias("path"), n["a"].alias("a"), n["b"].alias("b"), kind.alias("kind"), *members, *items)


def _children(n: Column) -> Column:
    nothing, none = F.lit(None).cast("variant"), F.array().cast("array<string>")
    keys = F.array_union(*[F.coalesce(F.map_keys(n[m]), none) for m in ("ma", "mb")])
    count = F.greatest(*[F.coalesce(F.array_size(n[i]), F.lit(0)) for i in ("ia", "ib")])
    below = F.transform(keys, lambda k: _pair(F.concat(n["path"], key_step(k)), F.try_element_at(n["ma"], k), F.try_element_at(n["mb"], k)))
    along = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: _pair(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), F.get(n["ia"], i), F.get(n["ib"], i)),
    )
    two = F.array(_pair(n["path"], n["a"], nothing), _pair(n["path"], nothing, n["b"]))
    return F.when(n["kind"] == "object", below.cast(_PAIRS)).when(n["kind"] == "array", along.cast(_PAIRS)).otherwise(two.cast(_PAIRS))


def _leaves(text: str | None) -> dict[str, tuple]:
    found = {}
    for path, _, kind, value in live(text) if text is not None else ():
        if kind in ("object", "array"):
            if value[1:-1].strip():
                continue
            value = kind
        found[path] = (kind, Decimal(value) if kind == "number" else value)
    return found


def _diff_text(a: str | None, b: str | None) -> tuple[int, int, int, list[str]]:
    x, y = _leaves(a), _leaves(b)
    other = sorted(p for p in x.keys() | y.keys() if p not in x or p not in y or x[p] != y[p])
    return len(x), len(y), sum(p in y and y[p] == v for p, v in x.items()), other


def _scanned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(0, 0, 0, []) if x is None and y is None else _diff_text(x, y) for x, y in zip(a, b)]
    return pd.DataFrame(rows, columns=["n_a", "n_b", "n_same", "diff_fields"])


def diff_bodies(df: DataFrame, body_a: str, body_b: str) -> DataFrame:
    """``df`` with n_a, n_b (leaves), n_same (equal at the same path) and diff_fields (sorted paths that are not).

    Numbers are equal by value (1, 1.0 and 1e0).  Null and invalid bodies have
    no leaves; of repeated keys the last one counts.
    """
    d = df.withColumns({"_a": F.try_parse_json(body_a), "_b": F.try_parse_json(body_b)})
    refused = (F.col(body_a).isNotNull() & F.col("_a").isNull()) | (F.col(body_b).isNotNull() & F.col("_b").isNull())
    root = F.array(_pair(F.lit("$"), F.col("_a"), F.col("_b"))).cast(_PAIRS)
    d = d.withColumns({"_refused": refused, "_open": F.when(refused, F.array().cast(_PAIRS)).otherwise(root)})
    # one set of expressions serves every level
    judged = F.transform(F.transform("_open", _texted), _judged)
    done = F.transform(F.filter("_all", lambda n: ~_open(n)), _settled)
    left = F.transform(F.filter("_all", _open), _opened)
    below = F.flatten(F.transform("_left", _children))
    for level in range(DIFF_LEVELS + 1):
        d = d.withColumn("_all", judged).withColumns({f"_done{level}": done, "_left": left})
        if level < DIFF_LEVELS:
            d = d.withColumn("_open", below)
    d = d.withColumns({"_scan": F.col("_refused") | (F.size("_left") > 0), "_done": F.concat(*[f"_done{i}" for i in range(DIFF_LEVELS + 1)])})
    text = F.pandas_udf(_scanned, _COUNTS)(F.when(F.col("_scan"), F.col(body_a)), F.when(F.col("_scan"), F.col(body_b)))

    def total(name: str) -> Column:
        return F.aggregate("_done", F.lit(0).cast("bigint"), lambda s, n: s + n[name])

    same = total("n_same")
    unlike = F.filter("_done", lambda n: n["a"] + n["b"] > 0)
    planned = {"n_a": same + total("a"), "n_b": same + total("b"), "n_same": same, "diff_fields": F.array_sort(F.transform(unlike, lambda n: n["path"]))}
    d = d.withColumn("_text", text)
    return d.select(*df.columns, *[F.when(F.col("_scan"), F.col("_text")[c]).otherwise(v).alias(c) for c, v in planned.items()])
