from gatewise.sources.tables import (  # noqa: F401
    TABLES,
    read_table,
    gw_requests,
    gw_canary,
    gw_billing,
    gw_customers,
    gw_bodies,
    gw_prompts,
    gw_shadow,
    gw_payloads,
    gw_request_bodies,
    gw_stream_chunks,
)
