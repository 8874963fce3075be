"""JSON values of a body column (J1), shared by masking and shadow diffs.

Bodies are parsed once into VARIANT.  Each level explodes the containers of
the previous level (objects by key, arrays by position), so the walk is plain
DataFrame work without Python.  Paths use one canonical form, ``$.a[0].b``
(0-based), with keys that are no plain names quoted: ``$."a.b"``.

``LEVELS`` levels are planned.  Bodies that nest deeper, and bodies that
VARIANT refuses for a repeated key, are walked by a text scan in Arrow batches
instead and give the same rows, so no depth is cut off.

Values have one form in both walks.  Numbers are written by value: no
trailing zeros, and whole numbers below 1e15 without exponent or point (``1.10``
is ``1.1``, ``1e2`` is ``100``).  Containers are compact with sorted keys, the
last of repeated keys kept; those that VARIANT cannot hold (over 1000 levels)
stay as written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.functions.jsontext import live
from gatewise.operators.common import spread

LEVELS = 6
_NODE = "struct<path:string,parent_type:string,open:boolean,v:variant>"


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.isin("NULL", "VOID"), "null")
        .otherwise("number")
    )


def bare_text(body: Column, literal: str = "") -> Column:
    """JSON text with ``literal`` for every string ($1 is the colon behind a key).

    Escapes go first, so that no pattern repeats a group: the JVM would need
    stack for every character of a long string.
    """
    return F.regexp_replace(F.regexp_replace(body, r"\\.", "e"), '"[^"]*+"(:?)', literal)


def nesting_depth(body: Column) -> Column:
    """Depth of open brackets outside string literals."""
    bare = bare_text(body)
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[{}\]]"), F.lit(0)), lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(
        steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"]
    )


def number_text(shown: Column) -> Column:
    """A number as VARIANT prints it, whole numbers below 1e15 as integers."""
    d = shown.try_cast("double")
    whole = shown.rlike("[.eE]") & (F.abs(d) < 1e15) & (d == F.floor(d))
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(shown)


def key_step(key: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat(F.lit("."), F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(quoted))


def json_nodes(df: DataFrame, keys: Sequence[str], body_col: str) -> DataFrame:
    """Rows (keys..., path, parent_type, value_type, value) of every JSON value.

    Containers are rows too, with their JSON text as ``value``; scalars are
    rendered as text (strings unquoted, JSON null -> NULL).  Null and invalid
    bodies give no rows; of repeated keys the last one counts.
    """
    keys = list(keys)
    rows = spread(df).select(*keys, F.col(body_col).alias("_body")).where(F.col("_body").isNotNull())
    planned = F.try_parse_json("_body").isNotNull() & (nesting_depth(F.col("_body")) <= LEVELS)
    cur = rows.where(planned).select(*keys, F.lit("$").alias("path"), F.lit("root").alias("parent_type"), F.lit(True).alias("open"), F.try_parse_json("_body").alias("v"))
    for _ in range(LEVELS):
        kind = _kind(F.col("v"))
        members = F.transform(
            F.map_entries(F.try_variant_get(F.col("v"), "$", "map<string,variant>")),
            lambda e: F.struct(F.concat(F.col("path"), key_step(e["key"])).alias("path"), F.lit("object").alias("parent_type"), F.lit(True).alias("open"), e["value"].alias("v")),
        )
        items = F.transform(
            F.try_variant_get(F.col("v"), "$", "array<variant>"),
            lambda x, i: F.struct(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit("array").alias("parent_type"), F.lit(True).alias("open"), x.alias("v")),
        )
        me = F.array(F.struct("path", "parent_type", F.lit(False).alias("open"), "v")).cast(f"array<{_NODE}>")
        grown = (
            F.when(F.col("open") & (kind == "object"), F.concat(me, members.cast(f"array<{_NODE}>")))
            .when(F.col("open") & (kind == "array"), F.concat(me, items.cast(f"array<{_NODE}>")))
            .otherwise(me)
        )
        cur = cur.select(*keys, F.inline(grown))
    kind = _kind(F.col("v"))

    def rendered(kind: Column, v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        return F.when(kind.isin("object", "array"), F.to_json(v)).when(kind == "number", number_text(text)).otherwise(text)

    value = rendered(kind, F.col("v"))
    out = cur.select(*keys, "path", "parent_type", kind.alias("value_type"), value.alias("value"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "path", "parent_type", "value_type", "value"]
        for f in frames:
            for at in range(0, len(f), 64):
                part = f.iloc[at : at + 64]
                found = [(*row[:-1], *node) for row in part.itertuples(index=False, name=None) for node in live(row[-1])]
                yield pd.DataFrame(found, columns=columns, dtype=object)

    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(c, T.StringType()) for c in ("path", "parent_type", "value_type", "value"))])
    walked = rows.where(~planned).select(*keys, "_body").mapInPandas(walk, schema)
    again = F.when(F.col("value_type").isin("object", "array", "number"), rendered(F.col("value_type"), F.try_parse_json("value")))
    return out.unionByName(walked.withColumn("value", F.coalesce(again, F.col("value"))))


def json_leaves(df: DataFrame, keys: Sequence[str], body_col: str) -> DataFrame:
    """Scalars and empty containers of ``json_nodes``, with ``is_string``."""
    n = json_nodes(df, keys, body_col)
    leaf = ~F.col("value_type").isin("object", "array") | F.col("value").isin("{}", "[]")
    return n.where(leaf).withColumn("is_string", F.col("value_type") == "string")


# DuckDB twin: json_tree gives the same canonical paths.
def sql_nodes(source: str, keys: Sequence[str], body_col: str) -> str:
    ks = ", ".join(f"s.{k}" for k in keys)
    return f"""select {ks}, t.fullkey as path,
 case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as value_type,
 case when t.type = 'NULL' then null when t.type = 'DOUBLE' and abs((t.value ->> '$')::double) < 1e15 and (t.value ->> '$')::double = floor((t.value ->> '$')::double)
  then ((t.value ->> '$')::double)::bigint::varchar else t.value ->> '$' end as value
 from {source} s, json_tree(s.{body_col}) t where json_valid(s.{body_col})"""


def sql_leaves(source: str, keys: Sequence[str], body_col: str) -> str:
    return f"select * from ({sql_nodes(source, keys, body_col)}) where value_type not in ('object', 'array') or value in ('{{}}', '[]')"
