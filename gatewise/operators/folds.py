"""Sequential rules over one key's rows, as plain functions on a pandas frame.

``shadow_disable_fold`` states C12 row by row; the batch operator walks chunk
maps instead (``walks``) and is tested against it.  ``stage_fold`` is run on a
route's evaluation ticks (one per 10 s).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

def _secs(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


# ------------------------------------------------------------------ C12 shadow auto-disable


def shadow_disable_fold(pdf: pd.DataFrame, threshold: int = 3, window_s: float = 300.0, disable_s: float = 300.0) -> pd.DataFrame:
    """Failures within ``window_s`` of the previous failure accumulate, a
    success resets; at ``threshold`` shadowing is disabled for ``disable_s``
    and events inside a disabled period are skipped."""
    pdf = pdf.sort_values(["ts", "id"], kind="mergesort")
    t = _secs(pdf["ts"])
    ok = pdf["success"].to_numpy(dtype=bool)
    fails, last_fail, until = 0, None, None
    skipped = np.zeros(len(pdf), dtype=bool)
    tripped = np.zeros(len(pdf), dtype=bool)
    nfail = np.zeros(len(pdf), dtype=np.int64)
    for i in range(len(pdf)):
        if until is not None and t[i] < until:
            skipped[i] = True
            nfail[i] = fails
            continue
        if ok[i]:
            fails = 0
        else:
            fails = (fails if last_fail is not None and t[i] - last_fail <= window_s else 0) + 1
            last_fail = t[i]
            if fails >= threshold:
                until = t[i] + disable_s
                tripped[i] = True
                fails = 0
        nfail[i] = fails
    return pd.DataFrame({"id": pdf["id"].to_numpy(), "skipped": skipped, "tripped": tripped, "fail_count": nfail})


# ------------------------------------------------------------------ C7 stage replay

# Default rollout schedule (traffic %, hold seconds).
DEFAULT_SCHEDULE = [(5, 300), (10, 300), (25, 600), (50, 600), (100, 0)]


def stage_fold(
    pdf: pd.DataFrame,
    schedule: Sequence[tuple[int, int]] = DEFAULT_SCHEDULE,
    sustained_s: float = 60.0,
    breach_ttl_s: float = 300.0,
    min_requests: int = 10,
    auto_rollback: bool = True,
    auto_resume: bool = False,
    auto_retry: bool = False,
    retry_cooldown_s: float = 600.0,
    max_retries: int = 3,
) -> pd.DataFrame:
    """Replay the rollout state machine over one route's evaluation ticks.

    Input columns: ts, id, verdict (ok / breach / insufficient /
    baseline_unhealthy), canary_total, latency_ok, manual (NULL or
    promote / rollback / pause / resume).
    """
    pdf = pdf.sort_values(["ts", "id"], kind="mergesort")
    t = _secs(pdf["ts"])
    verdict = pdf["verdict"].to_numpy()
    ctot = pdf["canary_total"].fillna(0).to_numpy()
    lat_ok = pdf["latency_ok"].fillna(True).to_numpy(dtype=bool)
    manual = pdf["manual"].to_numpy() if "manual" in pdf else np.array([None] * len(pdf))
    stage, state = 0, "STAGE_1"
    started = t[0] if len(t) else 0.0
    breach_start, retries, rolled_at = None, 0, None
    out_state, out_pct, out_stage, out_event = [], [], [], []
    for i in range(len(pdf)):
        ev = None
        m = manual[i]
        if m == "promote" and state not in ("PROMOTED",):
            state, ev = "PROMOTED", "promoted_manual"
        elif m == "rollback" and state not in ("ROLLED_BACK",):
            state, ev, rolled_at, breach_start = "ROLLED_BACK", "rolled_back_manual", t[i], None
        elif m == "pause" and state.startswith("STAGE"):
            state, ev = "PAUSED", "paused_manual"
        elif m == "resume" and state == "PAUSED":
            state, ev, started, breach_start = f"STAGE_{stage + 1}", "resumed", t[i], None
        elif state in ("PROMOTED",):
            pass
        elif state == "ROLLED_BACK":
            if auto_retry and rolled_at is not None and t[i] - rolled_at >= retry_cooldown_s and retries < max_retries:
                retries += 1
                stage, state, started, ev = 0, "STAGE_1", t[i], "retry"
        elif verdict[i] == "baseline_unhealthy":
            ev = "baseline_unhealthy"
        elif verdict[i] == "breach":
            if breach_start is not None and t[i] - breach_start > breach_ttl_s:
                breach_start = None
            if breach_start is None:
                breach_start = t[i]
                if state.startswith("STAGE"):
                    state, ev = "PAUSED", "paused_breach"
            elif t[i] - breach_start >= sustained_s and auto_rollback:
                state, ev, rolled_at, breach_start = "ROLLED_BACK", "rolled_back", t[i], None
        else:
            breach_start = None
            if state == "PAUSED" and auto_resume:
                state, started, ev = f"STAGE_{stage + 1}", t[i], "resumed_auto"
            elif state.startswith("STAGE"):
                hold = schedule[stage][1]
                if t[i] - started >= hold and verdict[i] == "ok" and ctot[i] >= min_requests and lat_ok[i]:
                    if stage + 1 < len(schedule) and schedule[stage + 1][0] < 100:
                        stage += 1
                        state, started, ev = f"STAGE_{stage + 1}", t[i], "advanced"
                    else:
                        stage = len(schedule) - 1
                        state, ev = "PROMOTED", "promoted"
        pct = 0 if state == "ROLLED_BACK" else (100 if state == "PROMOTED" else schedule[stage][0])
        out_state.append(state)
        out_pct.append(pct)
        out_stage.append(stage + 1)
        out_event.append(ev)
    return pd.DataFrame({"id": pdf["id"].to_numpy(), "state": out_state, "traffic_pct": out_pct, "stage": out_stage, "event": out_event})
