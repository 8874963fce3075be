"""Reusable DuckDB fragments for oracle statements."""

from __future__ import annotations

from gatewise.functions.pricing import DEFAULT_PRICING


def pricing_values(table: dict[str, tuple[str, str]] | None = None) -> str:
    table = DEFAULT_PRICING if table is None else table
    rows = ",\n ".join(
        f"('{m}', cast('{i}' as decimal(12,8)), cast('{o}' as decimal(12,8)))" for m, (i, o) in table.items() if m != "_default"
    )
    return f"select * from (values {rows}) as t(model, input_per_1k, output_per_1k)"


def cost_sql(tin: str, tout: str, pin: str, pout: str) -> str:
    return (
        f"cast(round((cast({tin} as decimal(20,0))*{pin} + cast({tout} as decimal(20,0))*{pout})*0.001, 6) as decimal(22,6))"
    )


def priced_requests(default=("0.01", "0.03"), source: str = "gw_requests") -> str:
    pin = f"coalesce(p.input_per_1k, cast('{default[0]}' as decimal(12,8)))"
    pout = f"coalesce(p.output_per_1k, cast('{default[1]}' as decimal(12,8)))"
    return (
        f"select r.*, {cost_sql('r.tokens_input', 'r.tokens_output', pin, pout)} as cost_usd, p.model is not null as price_known "
        f"from {source} r left join pricing p on r.model = p.model"
    )


USAGE = """select *, case when status >= 200 and status < 300 and tokens_input + tokens_output > 0 then tokens_input + tokens_output else 0 end as usage_tokens,
 case when status >= 200 and status < 300 and tokens_input + tokens_output > 0 then cost_usd else cast(0 as decimal(22,6)) end as usage_cost,
 cast(ts as date) as day, cast(date_trunc('month', ts) as date) as month from priced"""
