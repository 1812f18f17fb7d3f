"""The fold of health: expected values are those of the rules, written out by hand."""

import json

from gleaner.operators import incidents

NAMES = [f.split()[0] for f in incidents.EVENT.split(", ")]


def event(at, kind, source="s", **more):
    return {n: None for n in NAMES} | {"source_id": source, "at": at, "seq": more.pop("seq", 0), "kind": kind} | more


def ok(at, eligible=2, **more):
    return event(at, "run", ok=True, eligible=eligible, changed=True, **more)


def failed(at, category="transport", **more):
    return event(at, "run", ok=False, category=category, **more)


def command(at, action, argument=None, **more):
    return event(at, "command", action=action, argument=argument, **more)


def fold(*events):
    state = {}
    for e in events:
        after = incidents.step(state, e)
        state = state if after is None else after
    return state


def test_a_transport_failure_degrades_and_keeps_the_last_success():
    s = fold(ok(1), failed(602, retryable=True))
    assert (s["state"], s["last_success_at"], s["failures"], s["category"], s["backoff_until"], s["incident"]) == ("degraded", 1, 1, "transport", 662, "resolved")


def test_what_quarantines():
    assert fold(failed(1, "json"))["state"] == "quarantined"
    assert fold(failed(1, "http", status=404))["state"] == "quarantined"
    assert fold(failed(1, "transport", status=404))["state"] == "degraded"
    first, second = fold(failed(1, "link")), fold(failed(1, "link"), failed(2, "link"))
    assert first["state"] == "degraded" and second["state"] == "quarantined" and len(second["recent"]) == 2
    assert fold(failed(1, "json"), ok(2, 1))["state"] == "healthy"


def test_incidents_open_at_two_and_are_high_at_three():
    s = [fold(*(failed(k) for k in range(1, n + 1))) for n in (1, 2, 3)]
    assert [(x["incident"], x.get("severity"), x.get("opened_at")) for x in s] == [("resolved", None, None), ("open", "warning", 2), ("open", "high", 2)]
    acknowledged = fold(failed(1), failed(2), command(3, "acknowledge"), failed(4))
    assert (acknowledged["incident"], acknowledged["acknowledged_at"], acknowledged["config_version"]) == ("acknowledged", 3, 2)
    done = fold(failed(1), failed(2), ok(5))
    assert (done["incident"], done["opened_at"], done["resolved_at"], done["failures"]) == ("resolved", 2, 5, 0)


def test_tiers_and_versions():
    assert [fold(ok(1, 0), *x)["poll_tier"] for x in ((), (ok(2, 2),), (command(2, "set-tier", "quiet"), ok(3, 2)), (command(2, "set-tier", "fast"),))] == ["quiet", "active", "quiet", "quiet"]
    assert fold(ok(1), command(2, "pause"), command(3, "resume"))["config_version"] == 3
    assert fold(command(1, "pause"))["config_version"] == 1 and fold(command(1, "pause"))["state"] == "never-succeeded"


def test_refused_commands_change_nothing():
    s = fold(ok(1))
    for c in (command(2, "acknowledge"), command(2, "recover"), command(2, "quarantine", "  "), command(2, "quarantine", "x" * 501), command(2, "unknown")):
        assert incidents.step(s, c) is None
    assert fold(ok(1), command(2, "quarantine", "bad rows"), command(3, "recover"))["incident"] == "acknowledged"
    assert fold(failed(1, retryable=True), command(2, "resume"))["backoff_until"] is None


def test_stale_sources_get_one_high_incident_a_minute():
    s = fold(ok(0), event(5399, "check"))
    assert s["incident"] == "resolved"
    s = fold(ok(0), event(5400, "check"))
    assert (s["incident"], s["severity"], s["opened_at"]) == ("open", "high", 5400)
    assert incidents.step(s, event(5430, "check")) is None and incidents.step(s, event(5460, "check"))["updated_at"] == 5460
    assert fold(ok(0), command(1, "pause"), event(9999, "check"))["incident"] == "resolved"


def test_rings_hold_the_newest_runs():
    s = fold(*(ok(k) for k in range(40)))
    assert len(s["recent"]) == 25 and s["recent"][0] == "39:ok" and s["recent"][-1] == "15:ok"


EVENTS = [ok(1), failed(2), failed(3, seq=1), command(3, "acknowledge", seq=2), failed(4, "json"), ok(9, 0, source="t"), command(1, "pause", source="u"), failed(5)]


def test_batch_and_stream_give_the_same_transitions(spark, tmp_path):
    rows = [tuple(e[n] for n in NAMES) for e in EVENTS]
    batch = incidents.transitions(spark.createDataFrame(rows[::-1], incidents.EVENT))
    want = sorted(map(str, batch.collect()))
    assert len(want) == len(EVENTS)
    last = {r["source_id"]: r for r in incidents.final_states(batch).collect()}
    assert (last["s"]["state"], last["s"]["incident"], last["s"]["failures"], last["u"]["source_status"]) == ("degraded", "acknowledged", 4, "paused")

    feed = tmp_path / "in"
    feed.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate((rows[:4], rows[:2] + rows[4:])):
            (feed / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(NAMES, r))) for r in part))
            got = incidents.follow_health(spark.readStream.schema(incidents.EVENT).json(str(feed)))
            got.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(str, spark.read.schema(incidents.TRANSITION).parquet(str(tmp_path / "out")).collect())) == want
