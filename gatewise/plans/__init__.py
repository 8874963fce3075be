from gatewise.plans.catalog import REGISTRY, register, queries, oracle_sql  # noqa: F401
