"""Role policy resolution and table masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.functions import strategies as S
from gatewise.operators.common import bounded_broadcast

FIELD_TYPES = ["pan", "phone", "email", "national_id", "iban", "imei", "ip", "dob"]

# Default role matrix (role -> default strategy, overrides by field type).
DEFAULT_POLICIES: dict[str, tuple[str, dict[str, str]]] = {
    "admin": ("full", {}),
    "operator": ("full", {"pan": "last4", "phone": "last4", "national_id": "last4", "iban": "last4"}),
    "support_agent": (
        "redact",
        {
            "pan": "last4",
            "phone": "mask:phone",
            "email": "mask:email",
            "national_id": "mask:national_id",
            "iban": "mask:iban",
            "imei": "redact",
            "ip": "mask:ip",
            "dob": "mask:dob",
        },
    ),
    "external_partner": ("redact", {}),
    "auditor": ("hash", {}),
}


def policy_frames(spark: SparkSession, policies=None) -> tuple[DataFrame, DataFrame]:
    """(roles(role, default_strategy), overrides(role, field_type, strategy))."""
    policies = DEFAULT_POLICIES if policies is None else policies
    roles = spark.createDataFrame([(r.lower(), d) for r, (d, _) in policies.items()], "role string, default_strategy string")
    ov = spark.createDataFrame(
        [(r.lower(), f, s) for r, (_, o) in policies.items() for f, s in o.items()] or [("", "", "")],
        "role string, field_type string, strategy string",
    ).where(F.col("role") != "")
    return roles, ov


def resolve_strategy(
    df: DataFrame,
    role_col: str,
    field_type_col: str,
    policies=None,
    default: str | None = None,
    out_col: str = "strategy",
    no_policies: bool = False,
) -> DataFrame:
    """Override for (role, field type), else the role default, else the
    rule default, else redact; unknown role -> redact; role lower-cased.

    Two left joins against broadcast policy tables (config-sized, checked).
    """
    if no_policies:
        return df.withColumn(out_col, F.lit(default or "redact"))
    return _resolve(df, role_col, F.col(field_type_col), policies, default, out_col)


def _resolve(df: DataFrame, role_col: str, ft: Column, policies, default: str | None, out_col: str) -> DataFrame:
    roles, ov = policy_frames(df.sparkSession, policies)
    roles = roles.select(F.col("role").alias("_pr"), F.col("default_strategy").alias("_pd"))
    ov = ov.select(F.col("role").alias("_or"), F.col("field_type").alias("_of"), F.col("strategy").alias("_os"))
    r = F.lower(F.coalesce(F.col(role_col), F.lit("")))
    j = (
        df.withColumn("_role", r)
        .withColumn("_ft", ft)
        .join(bounded_broadcast(roles), F.col("_role") == F.col("_pr"), "left")
        .join(bounded_broadcast(ov), (F.col("_role") == F.col("_or")) & (F.col("_ft") == F.col("_of")), "left")
    )
    strat = F.when(F.col("_pr").isNull(), F.lit("redact")).otherwise(
        F.coalesce(F.col("_os"), F.col("_pd"), F.lit(default) if default else F.lit(None), F.lit("redact"))
    )
    return j.withColumn(out_col, strat).drop("_role", "_ft", "_pr", "_pd", "_or", "_of", "_os")


def policy_lookup(role: Column, field_type: str, policies=None, default: str | None = None) -> Column:
    """R1 as a pure expression for a fixed field type (config maps, no join)."""
    policies = DEFAULT_POLICIES if policies is None else policies
    m = {r.lower(): o.get(field_type, d or default or "redact") for r, (d, o) in policies.items()}
    mp = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(mp[F.lower(F.coalesce(role, F.lit("")))], F.lit("redact"))


def consumer_role(requests: DataFrame, consumers: DataFrame, key: str = "consumer_id") -> DataFrame:
    """R2: role from consumer metadata; missing role -> unknown; no consumer -> anonymous."""
    c = bounded_broadcast(consumers.select(F.col(key).alias("_ck"), F.col("role").alias("_cr")))
    j = requests.join(c, F.col(key) == F.col("_ck"), "left")
    role = F.when(F.col(key).isNull(), "anonymous").otherwise(F.coalesce(F.col("_cr"), F.lit("unknown")))
    return j.withColumn("consumer_role", role).drop("_ck", "_cr")


def masked_projection(df: DataFrame, role_col: str, columns: dict[str, str], policies=None) -> DataFrame:
    """Mask each listed column (column -> field type) by the row's role.

    The policy is configuration, so each column becomes one CASE over the
    roles holding only the strategies those roles use (unknown role ->
    redact): a single projection that stays inside whole-stage codegen.
    """
    policies = DEFAULT_POLICIES if policies is None else policies
    role = F.lower(F.coalesce(F.col(role_col), F.lit("")))
    cols = []
    for c in df.columns:
        if c not in columns:
            cols.append(F.col(c))
            continue
        ft, v = columns[c], F.col(c)
        expr = None
        for r, (d, o) in policies.items():
            fn = S.STRATEGIES.get(o.get(ft, d), S.redact)
            expr = F.when(role == r.lower(), fn(v)) if expr is None else expr.when(role == r.lower(), fn(v))
        expr = S.redact(v) if expr is None else expr.otherwise(S.redact(v))
        cols.append(F.when(v.isNotNull(), expr).alias(c))
    return df.select(*cols)


def tokenize(df: DataFrame, col: str, key: str, out_col: str = "token") -> tuple[DataFrame, DataFrame]:
    """Stable token per distinct value plus the mapping table
    (token, AES-GCM encrypted value).  ``key`` must be 16, 24 or 32 bytes."""
    tok = S.tokenize(F.col(col), key)
    out = df.withColumn(out_col, tok)
    mapping = (
        df.select(F.col(col).alias("_v"))
        .where(F.col("_v").isNotNull())
        .distinct()
        .select(S.tokenize(F.col("_v"), key).alias("token"), F.aes_encrypt(F.col("_v"), F.lit(key)).alias("secret"))
    )
    return out, mapping


def detokenize(df: DataFrame, token_col: str, mapping: DataFrame, key: str, out_col: str = "value") -> DataFrame:
    """Join tokens back to the mapping and decrypt."""
    j = df.join(mapping.withColumnRenamed("token", "_tok"), F.col(token_col) == F.col("_tok"), "left")
    return j.withColumn(out_col, F.try_aes_decrypt(F.col("secret"), F.lit(key)).cast("string")).drop("_tok", "secret")
