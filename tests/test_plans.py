"""Plan guards: no registered batch query pairs rows without an equi-join key."""

from stewardlake.plans import registry

STREAMS = {"audit_stream_ingest", "audit_ingest_repeats", "audit_daily_counts", "audit_daily_windows", "request_state_stream",
           "expiry_sweep_stream"}


def test_no_nested_loop_or_cartesian_joins(spark):
    bad = []
    for key, build in sorted(registry.queries().items()):
        if key in STREAMS:
            continue
        plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
            bad.append(key)
    assert bad == []


def test_top_k_per_group_uses_group_limits(spark):
    for key in ["notifications", "recently_accessed", "match_questions", "gated_previews", "find_keywords"]:
        plan = registry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, key


def test_scans_read_only_needed_columns(spark):
    import re

    plan = registry.queries()["policy_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas == ["event_id:bigint,user_id:bigint,event_type:string"]
    plan = registry.queries()["table_has_pii"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["p_partkey:bigint"]
