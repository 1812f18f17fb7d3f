"""The health of sources as a fold of their runs, operators' commands and freshness checks, in order.

An event has source_id, at (seconds), seq (order among equal times), kind and what its kind needs:

* ``run``: ok, and for a success eligible (rows) and changed, for a failure category, status,
  retryable and retry_after (seconds);
* ``command``: action (pause, resume, set-tier, quarantine, acknowledge, resolve, recover, replay) and
  argument (the tier, or the reason);
* ``check``: nothing; a published source without success for 90 minutes gets a high incident.

In a batch the events of a source are sorted and pass through its task one by one; the task holds a
source's state only. As a stream the state is kept by Spark between batches, and events up to the last
one seen are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "source_id string, at long, seq long, kind string, ok boolean, eligible long, changed boolean, category string, status int, retryable boolean, retry_after long, action string, argument string"
HEALTH = (
    "state string, source_status string, poll_tier string, poll_tier_mode string, config_version long, failures long, category string, last_attempt_at long, last_success_at long, last_changed_at long, "
    "backoff_until long, incident string, severity string, opened_at long, updated_at long, acknowledged_at long, resolved_at long, quarantined_at long, reason string, recent array<string>"
)
FIELDS = [f.split()[0] for f in HEALTH.split(", ")]
TRANSITION = f"source_id string, at long, seq long, accepted boolean, {HEALTH}"
#: Runs that are remembered, failures from which an incident is open and high, and minutes to a stale source.
RECENT, OPEN_AT, HIGH_AT, STALE_MINUTES = 25, 2, 3, 90


def quarantines(category, status, failures: int) -> bool:
    if category in ("json", "identity") or category == "http" and status in (401, 403, 404):
        return True
    return category in ("quality", "link", "empty") and failures >= 2


def _run(old: dict, e: dict) -> dict:
    at = e["at"]
    kept = {k: old.get(k) for k in ("poll_tier_mode", "last_success_at", "last_changed_at")}
    new = kept | {"source_status": old.get("source_status") or "active", "config_version": old["config_version"] if old.get("config_version") is not None else 1, "last_attempt_at": at}
    mark = "ok" if e["ok"] else e["category"]
    new["recent"] = [f"{at}:{mark}", *(old.get("recent") or [])][:RECENT]
    incident = old.get("incident")
    if e["ok"]:
        tier = "active" if (e["eligible"] or 0) > 0 else "quiet"
        mode = old.get("poll_tier_mode") or "automatic"
        new |= {"state": "healthy", "failures": 0, "poll_tier_mode": mode, "poll_tier": old.get("poll_tier") or tier if mode == "operator" else tier, "last_success_at": at, "incident": "resolved"}
        if e["changed"]:
            new["last_changed_at"] = at
        if incident and incident != "resolved":
            new |= {"severity": old.get("severity"), "opened_at": old.get("opened_at"), "updated_at": at, "resolved_at": at}
        return new
    failures = (old.get("failures") or 0) + 1
    out = quarantines(e["category"], e["status"], failures)
    new |= {"state": "quarantined" if out else "degraded", "failures": failures, "category": e["category"], "poll_tier": old.get("poll_tier") or "active"}
    if e["retryable"]:
        new["backoff_until"] = at + min(1800, max(e["retry_after"] or 0, min(1800, 60 * 2 ** min(failures - 1, 10))))
    if out or failures >= OPEN_AT:
        new |= {"incident": "acknowledged" if incident == "acknowledged" else "open", "severity": "high" if out or failures >= HIGH_AT else "warning", "opened_at": old.get("opened_at") or at, "updated_at": at, "acknowledged_at": old.get("acknowledged_at")}
    else:
        new["incident"] = incident or "resolved"
    if out:
        new |= {"quarantined_at": at, "reason": e["category"]}
    return new


def _command(old: dict, e: dict) -> dict | None:
    """The state after a command, or None where it is refused."""
    at, action, argument = e["at"], e["action"], (e["argument"] or "").strip()
    base = old or {"state": "never-succeeded", "last_attempt_at": at, "failures": 0}
    new = base | {"config_version": (base.get("config_version") or 0) + 1}
    if action == "pause":
        return new | {"source_status": "paused"}
    if action == "resume":
        return new | {"source_status": "active", "backoff_until": None}
    if action == "set-tier":
        return new | {"poll_tier": argument, "poll_tier_mode": "operator"} if argument in ("active", "quiet") else None
    if action == "quarantine":
        if not 0 < len(argument) <= 500:
            return None
        return new | {"state": "quarantined", "source_status": "paused", "reason": argument, "quarantined_at": at, "incident": "open", "severity": "high", "opened_at": base.get("opened_at") or at, "updated_at": at}
    if action == "acknowledge":
        return new | {"incident": "acknowledged", "acknowledged_at": at, "updated_at": at} if base.get("incident") not in (None, "resolved") else None
    if action == "resolve":
        return new | {"incident": "resolved", "resolved_at": at, "updated_at": at}
    if action == "recover":
        return new | {"source_status": "paused", "incident": "acknowledged", "acknowledged_at": at, "updated_at": at} if base["state"] == "quarantined" else None
    return base if action == "replay" else None


def _check(old: dict, e: dict) -> dict | None:
    at = e["at"]
    if not old or old.get("source_status") == "paused" or old.get("last_success_at") is None or at - old["last_success_at"] < 60 * STALE_MINUTES:
        return None
    state = "acknowledged" if old.get("incident") == "acknowledged" else "open"
    # Again within a minute of the last change nothing is new.
    if old.get("incident") == state and old.get("severity") == "high" and old.get("updated_at") is not None and old["updated_at"] // 60 == at // 60:
        return None
    return old | {"incident": state, "severity": "high", "opened_at": old.get("opened_at") or at, "updated_at": at}


def step(old: dict, e: dict) -> dict | None:
    """The state of a source after an event; None where the event is refused or changes nothing."""
    return {"run": _run, "command": _command, "check": _check}[e["kind"]](old, e)


def _plain(frame: pd.DataFrame) -> Iterator[dict]:
    names = list(frame.columns)
    for row in frame.astype(object).itertuples(index=False, name=None):
        yield {n: None if v is None or v is pd.NaT or v != v else v for n, v in zip(names, row)}


def _row(e: dict, state: dict, accepted: bool) -> tuple:
    return (e["source_id"], e["at"], e["seq"], accepted, *(state.get(f) for f in FIELDS))


def _typed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_id", "at", "seq", "accepted", *FIELDS]).astype(object)


def transitions(events: DataFrame) -> DataFrame:
    """A row for every event: whether it was accepted, and its source's state after it."""

    def run(frames):
        source, state = None, {}
        for frame in frames:
            rows = []
            for e in _plain(frame):
                if e["source_id"] != source:
                    source, state = e["source_id"], {}
                after = step(state, e)
                state = state if after is None else after
                rows.append(_row(e, state, after is not None))
            yield _typed(rows)

    names = [f.split()[0] for f in EVENT.split(", ")]
    return events.select(names).repartition("source_id").sortWithinPartitions("source_id", "at", "seq").mapInPandas(run, TRANSITION)


def final_states(changes: DataFrame) -> DataFrame:
    """The state of every source after its last event, by a partial maximum."""
    rest = F.struct(*(c for c in changes.columns if c != "source_id"))
    return changes.groupBy("source_id").agg(F.max_by(rest, F.struct("at", "seq")).alias("x")).select("source_id", "x.*").drop("accepted", "seq")


class _Health(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("health", "last_at long, last_seq long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, seq, state = -1, -1, {}
        if self.held.exists():
            at, seq, text = self.held.get()
            state = json.loads(text)
        out = []
        for e in _plain(pd.concat(list(rows)).sort_values(["at", "seq"])):
            if (e["at"], e["seq"]) <= (at, seq):
                continue
            after = step(state, e)
            state, at, seq = state if after is None else after, e["at"], e["seq"]
            out.append(_row(e, state, after is not None))
        self.held.update((at, seq, json.dumps(state)))
        if out:
            yield _typed(out)

    def close(self) -> None:
        pass


def follow_health(events: DataFrame) -> DataFrame:
    """The transitions of a stream of events; needs a state store with column families, such as RocksDB."""
    return events.groupBy("source_id").transformWithStateInPandas(_Health(), TRANSITION, "Append", "None")
