"""Table schemas of a run log, as DDL strings."""

RUNS = "run_id STRING, workflow STRING, workflow_version STRING, root_branch STRING, created_at_ms BIGINT"
OVERRIDES = "STRUCT<model STRING, prompt_patches MAP<STRING,STRING>, signals MAP<STRING,STRING>, effects STRING, allow_live ARRAY<STRING>>"
BRANCHES = f"branch_id STRING, run_id STRING, parent_branch STRING, fork_seq BIGINT, overrides {OVERRIDES}, depth INT, label STRING, status STRING, output STRING, created_at_ms BIGINT"
EVENTS = "branch_id STRING, seq BIGINT, type STRING, step_id STRING, body STRING, prev_hash STRING, hash STRING, epoch BIGINT, at_ms BIGINT"
EFFECTS = "idem_key STRING, branch_id STRING, step_id STRING, class STRING, state STRING, external_ref STRING, attempts INT, updated_at TIMESTAMP"
TASKS = "branch_id STRING, queue STRING, visible_at_ms BIGINT, lease_owner STRING, lease_epoch BIGINT, lease_expires_at_ms BIGINT, attempts INT, progress_seq BIGINT"
SIGNALS = "branch_id STRING, name STRING, idx INT, payload STRING, created_at TIMESTAMP"
ANNOTATIONS = "at_ms BIGINT, kind STRING, signal STRING, pid BIGINT, reason STRING, idem_key STRING, adapter STRING, point STRING, after_ms BIGINT"
ORDERS = "order_id STRING, customer STRING, amount_cents BIGINT, payment_intent STRING, status STRING, item STRING"
TICKET = "ticket_id STRING, customer STRING, order_id STRING, body STRING"

TABLES = {"runs": RUNS, "branches": BRANCHES, "events": EVENTS, "effects": EFFECTS, "tasks": TASKS, "signals": SIGNALS}
#: The event types of a log and the statuses of a branch.
STEP_EVENTS = ["LlmRequested", "LlmCompleted", "LlmFailed", "EffectIntent", "EffectPrepared", "EffectCommitted", "EffectAborted", "EffectInDoubt", "EffectCompensated", "TimerSet", "TimerFired", "SignalReceived", "SignalTimedOut", "LiveEffectAllowed", "NowRecorded", "RandomRecorded", "SideValueRecorded"]
RUN_EVENTS = ["RunStarted", "RunCompleted", "RunFailed", "RunCancelled", "Forked", "VersionMarker"]
TERMINAL_EVENTS = ["RunCompleted", "RunFailed", "RunCancelled"]
FINISHED = ["completed", "failed", "cancelled"]


def create_tables(spark, database: str, buckets: int = 8) -> None:
    """Parquet tables; those that joins meet by branch are bucketed by it."""
    for name, ddl in TABLES.items():
        by = f" CLUSTERED BY (branch_id) INTO {buckets} BUCKETS" if "branch_id STRING" in ddl else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{by}")
