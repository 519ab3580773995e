"""The log operators on small hand-made logs: literals, mutations, a contract script, and batch against stream."""

import random

import pytest
from logweave.functions import canonical, scalars
from logweave.operators import audit, chain, diffing, effects, lease_machine, lineage, replaying, tasks, views
from logweave.sources import export, ingest, schema
from logweave.streaming import task_stream
from pyspark.sql import functions as F


def test_canonical_json_does_not_depend_on_key_order(spark):
    texts = ['{"b":1,"a":{"y":[1,2],"x":null}}', '{"a":{"x":null,"y":[1,2]},"b":1}', '{"n":1.50,"b":1e-7}', '{"k":1,"k":2}', "no json", None]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "body string").select(canonical.canonical_json("body")).collect()]
    assert rows == ['{"a":{"x":null,"y":[1,2]},"b":1}'] * 2 + ['{"b":1e-7,"n":1.5}', '{"k":2}', None, None]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.dollars_to_cents(F.lit("pay $1,250.50.")), scalars.dollars_to_cents(F.lit("$120")), scalars.dollars_to_cents(F.lit("none")), scalars.order_reference(F.lit("about order ORD-1042: late")),
        scalars.cost_micros(F.lit(1000), F.lit(10), F.lit(2_000_000), F.lit(8_000_000)), scalars.percent_change(F.lit(0), F.lit(5)), scalars.percent_change(F.lit(8), F.lit(9)), scalars.step_number(F.lit("a#b#3")), scalars.step_number(F.lit("a#x")), scalars.tokens(F.lit("äöü")),
    ).first()
    assert list(row) == [125050, 12000, None, "ORD-1042", 2080, 0.0, 12.5, 3, None, 2]


def log(n, branches=(1, 2)):
    return [(b, i, 1 + i // 4, 1000 * i, f'{{"n":{i}}}') for b in branches for i in range(n)]


def sealed(spark, rows):
    return chain.seal(spark.createDataFrame(rows, "branch_id long, seq long, epoch long, at_ms long, body string"))


def test_chain_is_sound_whatever_the_input_order_and_a_touched_body_is_found(spark):
    rows = log(9)
    good = sealed(spark, rows)
    random.Random(1).shuffle(rows)
    assert sorted(good.collect()) == sorted(sealed(spark, rows).collect())
    assert {r["error"] for r in chain.verdicts(good).collect()} == {None}
    touched = good.withColumn("body", F.when((F.col("branch_id") == 2) & (F.col("seq") == 4), F.lit('{"n":99}')).otherwise(F.col("body")))
    assert [(r["branch_id"], r["seq"], r["error"]) for r in chain.findings(touched).collect()] == [(2, 4, "tampered")]
    assert [(r["seq"], r["error"]) for r in chain.findings(good.filter("branch_id = 1 and seq <> 3")).collect()] == [(4, "gap")]


def test_fork_of_a_fork_below_its_parents_fork_stays_contiguous(spark):
    b = spark.createDataFrame([(1, None, None), (2, 1, 6), (3, 2, 4)], "branch_id long, parent_branch long, fork_seq long")
    e = spark.createDataFrame([(1, s) for s in range(10)] + [(2, s) for s in range(6, 9)] + [(3, s) for s in range(4, 7)], "branch_id long, seq long")
    seen = lineage.visible_events(lineage.closure(b), e).filter("branch_id = 3").orderBy("seq").collect()
    assert [(r["origin"], r["seq"]) for r in seen] == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 4), (3, 5), (3, 6)]


SCRIPT = [  # command, at, epoch, first_seq, events, until -> verdict
    ("claim", 0, 0, 0, 0, 0, "claimed"), ("claim", 10, 0, 0, 0, 0, "leased"), ("append", 20, 1, 0, 2, 0, "accepted"), ("append", 21, 1, 1, 1, 0, "conflict"),
    ("claim", 5000, 0, 0, 0, 0, "claimed"), ("append", 5001, 1, 2, 1, 0, "stale epoch"), ("heartbeat", 5002, 1, 0, 0, 0, "stale epoch"), ("append", 5003, 2, 2, 1, 0, "accepted"), ("append", 5003, 2, 9, 0, 0, "accepted"),
    ("suspend", 5004, 2, 0, 0, 9000, "suspended"), ("claim", 6000, 0, 0, 0, 0, "hidden"), ("wake", 6001, 0, 0, 0, 0, "woken"), ("claim", 6002, 0, 0, 0, 0, "claimed"), ("finish", 6003, 3, 0, 0, 0, "finished"),
    ("append", 6004, 3, 3, 1, 0, "stale epoch"), ("claim", 9999, 0, 0, 0, 0, "no task"),
]


def test_contract_script_in_batch_and_stream(spark, tmp_path):
    rows = [(b, n, *s[:-1]) for b in (1, 2) for n, s in enumerate(SCRIPT)]
    commands = spark.createDataFrame(rows, lease_machine.COMMANDS)
    batch = sorted(tuple(r) for r in lease_machine.batch_verdicts(commands, 2000).collect())
    assert [r[3] for r in batch] == [s[-1] for s in SCRIPT] * 2
    for k, part in enumerate((commands.filter("n < 6"), commands.filter("n >= 6"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if k else "overwrite")
    source = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    task_stream.verdict_stream(source, 2000).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("verdicts").collect()) == batch
    again = spark.readStream.schema(commands.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart adds nothing
        task_stream.append_accepted(task_stream.verdict_stream(again, 2000), f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(120)
    kept = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r["branch_id"], r["n"]) for r in kept.collect()) == [(r[0], r[1]) for r in batch if r[2] == "append" and r[3] == "accepted"]


def test_streams_answer_once_and_window_late_rows(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:01', 5L), ('a', timestamp'2024-01-01 00:00:02', 7L), ('b', timestamp'2024-01-01 00:02:00', 1L) as t(type, at, cost_micros)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("once", task_stream.answered_once(read(), "type", "at", "1 minute"), "append"), ("spend", task_stream.spend_by_window(read(), "at", "1 minute", "1 minute"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["cost_micros"] for r in spark.table("once").collect()) == [1, 5]
    assert sorted((r["type"], r["events"], r["cost_micros"]) for r in spark.table("spend").collect()) == [("a", 2, 12), ("b", 1, 1)]


def test_edit_scripts_are_shortest_and_turn_a_into_b():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(8))] for _ in range(2))
        script = diffing.edit_script(a, b)
        made = [a[x] if op == "equal" else b[y] for op, x, y in script if op != "delete"]
        assert made == b and [a[x] for op, x, _ in script if op != "insert"] == a
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if p == q else max(lcs[i][j + 1], lcs[i + 1][j])
        assert sum(op == "equal" for op, *_ in script) == lcs[-1][-1]


def test_trajectory_keeps_one_sided_keys(spark):
    a = spark.createDataFrame([(1, 0, "x#1"), (1, 1, "y#1"), (2, 0, "x#1")], "k long, seq long, step_id string")
    b = spark.createDataFrame([(1, 0, "y#1"), (1, 1, "x#1"), (3, 0, "z#1")], "k long, seq long, step_id string")
    got = sorted((r["k"], r["position"], r["op"], r["step_id"]) for r in diffing.trajectory(a, b, "k").collect())
    assert [x[2] for x in got if x[0] == 1].count("equal") == 1 and [x[2:] for x in got if x[0] != 1] == [("delete", "x#1"), ("insert", "z#1")]


def test_long_scripts_take_little_memory_and_counting_them_works(spark):
    import tracemalloc

    r = random.Random(8)
    for a, b in (([f"a{i}" for i in range(5000)], [f"b{i}" for i in range(5000)]), ([r.choice("abcdefgh") for _ in range(3000)], [r.choice("abcdefgh") for _ in range(3000)])):
        tracemalloc.start()
        script = diffing.edit_script(a, b)
        assert tracemalloc.get_traced_memory()[1] < 50e6
        tracemalloc.stop()
        assert [b[y] if op == "insert" else a[x] for op, x, y in script if op != "delete"] == b
    a = spark.createDataFrame([(1, 0, "x#1"), (2, 0, "x#1")], "k long, seq long, step_id string")
    assert diffing.trajectory(a, a.filter("k = 1"), "k").count() == 2


def test_refused_refunds_dont_count(spark):
    refunds = spark.createDataFrame([(1, n, c) for n, c in enumerate([60, 50, 40, 1])], "payment long, line long, cents long")
    found = audit.over_cap(spark.createDataFrame([(1, 100)], "payment long, cents long"), refunds, ["line"]).orderBy("line").collect()
    assert [(r["so_far"], r["over"]) for r in found] == [(60, False), (110, True), (100, False), (101, True)]


def test_appends_are_fenced_by_the_task_and_follow_the_accepted_head(spark):
    rows = [("append", 0, 0, "stale epoch"), ("claim", 0, 0, "claimed"), ("append", 1, 0, "accepted"), ("append", 1, 2, "conflict"), ("append", 5, 1, "stale epoch"), ("append", 1, 1, "accepted"), ("claim", 0, 0, "claimed"), ("append", 1, 2, "stale epoch"), ("append", 2, 2, "accepted")]
    log = spark.createDataFrame([(1, n, c == "claim", e, f) for n, (c, e, f, _) in enumerate(rows)], "branch_id long, seq long, claims boolean, epoch long, first_seq long")
    found = tasks.append_verdicts(log)
    assert [r["verdict"] for r in found.orderBy("seq").collect()] == [x[-1] for x in rows]
    assert tuple(tasks.fence_counters(found).first()) == (1, 3, 3, 1)


def test_parents_in_a_cycle_raise(spark):
    b = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "branch_id long, parent_branch long, fork_seq long")
    with pytest.raises(ValueError, match="cycle"):
        lineage.closure(b)


def test_details_by_type(spark):
    rows = [
        ("RunStarted", '{"workflow":"w","workflow_version":"2"}', "w@2"), ("LlmCompleted", '{"response":{"model":"m","content":"hi","tool_calls":[{"name":"f"},{"name":"g"}]}}', "m →f →g “hi”"),
        ("LlmCompleted", '{"response":{"model":"m","content":null,"tool_calls":[]}}', "m "), ("EffectIntent", '{"adapter":"a","tier":"B","idem_key":"run_0123456789abc","simulated":true}', "a tier B key run_012345678… (simulated)"),
        ("TimerSet", '{"fire_at_ms":7}', "fires at 7"), ("EffectAborted", '{"error":"' + "x" * 100 + '"}', "x" * 89 + "…"), ("Other", '{"k":1}', '{"k":1}'), ("Forked", '{"from_step":"s#1","overrides":{"model":"m"}}', 'from s#1 {"model":"m"}'),
    ]
    df = spark.createDataFrame(rows, "kind string, body string, line string")
    assert [r["got"] for r in df.select(views.detail(F.col("kind"), F.col("body")).alias("got")).collect()] == [x[2] for x in rows]


def test_a_replay_with_another_output_is_not_clean(spark):
    verdicts = spark.createDataFrame([(p, "s#1", "replayed") for p in (1, 2, 3)], "pair long, step_id string, verdict string")
    chains = spark.createDataFrame([(p, None) for p in (1, 2, 3)], "pair long, error string")
    outputs = spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, None, "y")], "pair long, recorded string, output string")
    found = replaying.report(verdicts, chains, outputs, "pair", "step_id").orderBy("pair").collect()
    assert [(r["output_matches"], r["clean"]) for r in found] == [(True, True), (False, False), (None, True)]


def test_branch_documents_come_back(spark, tmp_path):
    b = spark.createDataFrame([("r", "b1", None, None, 0, 5), ("r", "b2", "b1", 1, 1, 6)], "run_id string, branch_id string, parent_branch string, fork_seq long, depth int, created_at_ms long")
    e = spark.createDataFrame([("b1", 1, "X", "x#1", 1, 7, "{}"), ("b1", 0, "RunStarted", None, 0, 5, "{}")], "branch_id string, seq long, type string, step_id string, epoch long, at_ms long, body string")
    export.branch_documents(b, e, 9).select("document").withColumnRenamed("document", "value").write.text(f"{tmp_path}/out")
    branches, events = export.read_recordings(spark, f"{tmp_path}/out")
    assert sorted((r["run_id"], r["branch_id"], r["fork_seq"]) for r in branches.collect()) == [("r", "b1", None), ("r", "b2", 1)] and [r["seq"] for r in events.orderBy("seq").collect()] == [0, 1]


def test_recordings_come_back(spark, tmp_path):
    runs = spark.createDataFrame([("r", 5)], "run_id string, created_at_ms long")
    b = spark.createDataFrame([("r", "b1", None, None, 0, 5), ("r", "b2", "b1", 1, 1, 6)], "run_id string, branch_id string, parent_branch string, fork_seq long, depth int, created_at_ms long")
    e = spark.createDataFrame([("b1", 1, "X", "x#1", 1, 7, "{}"), ("b1", 0, "RunStarted", None, 0, 5, "{}")], "branch_id string, seq long, type string, step_id string, epoch long, at_ms long, body string")
    export.write_recordings(export.recordings(runs, b, e, 9), f"{tmp_path}/out")
    branches, events = export.read_recordings(spark, f"{tmp_path}/out")
    assert sorted(r["branch_id"] for r in branches.collect()) == ["b1", "b2"] and [r["seq"] for r in events.orderBy("seq").collect()] == [0, 1]
    with pytest.raises(Exception, match="unexpected schema"):
        export.read_recordings(spark, f"{tmp_path}/out", "other/v9")[0].collect()


def test_json_lines_strict_and_lenient(spark, tmp_path):
    (tmp_path / "notes.jsonl").write_text('{"at_ms":1,"kind":"kill"}\n\n{"at_ms":2,"kind":"wake"}\n')
    (tmp_path / "bad.jsonl").write_text('{"at_ms":1,"kind":"kill"}\nnot json\n')
    assert ingest.json_lines(spark, f"{tmp_path}/notes.jsonl", schema.ANNOTATIONS).count() == 2
    assert len(ingest.json_lines(spark, f"{tmp_path}/bad.jsonl", schema.ANNOTATIONS, strict=False).collect()) == 1
    assert ingest.json_lines(spark, f"{tmp_path}/missing.jsonl", schema.ANNOTATIONS, strict=False).count() == 0
    with pytest.raises(Exception):
        ingest.json_lines(spark, f"{tmp_path}/bad.jsonl", schema.ANNOTATIONS).collect()
    (tmp_path / "orders.json").write_text('[{"order_id":"o","amount_cents":1},{"order_id":"p","amount_cents":3}]')
    assert ingest.json_documents(spark, f"{tmp_path}/orders.json", schema.ORDERS).count() == 2


def test_json_lines_are_added(spark, tmp_path):
    notes = spark.createDataFrame([(1, "kill", None), (2, "wake", "a")], "at_ms long, kind string, reason string")
    for part in ("at_ms = 1", "at_ms = 2"):
        export.append_json_lines(notes.filter(part), f"{tmp_path}/notes")
    back = ingest.json_lines(spark, f"{tmp_path}/notes", schema.ANNOTATIONS).select("at_ms", "kind", "reason").orderBy("at_ms").collect()
    assert [tuple(r) for r in back] == [(1, "kill", None), (2, "wake", "a")]


def test_effects_and_tasks(spark):
    rows = spark.createDataFrame([("k", "a", "e1", 1), ("k", "b", None, 2)], "idem_key string, state string, external_ref string, seq long")
    assert [tuple(r) for r in effects.latest_state(rows, "idem_key", ["seq"]).collect()] == [("k", "b", "e1", 2)]
    claims = spark.createDataFrame([(1, i, h) for i, h in enumerate([0, 0, 0, 2, 2])], "branch_id long, seq long, head long")
    assert [r["attempt"] for r in tasks.attempts(claims, 2).orderBy("seq").collect()] == [1, 2, 3, 1, 2]
    events = spark.createDataFrame([(1, i, ep, 10 * i, "x") for i, ep in enumerate([0, 1, 0, 1, 2])], "branch_id long, seq long, epoch long, at_ms long, type string")
    assert [(r["first_seq"], r["last_seq"]) for r in views.segments(events, F.lit(True)).orderBy("segment").collect()] == [(1, 3), (4, 4)]


def test_folds_deal_more_rows_to_more_tasks_and_not_to_larger_ones(spark, monkeypatch):
    from logweave.operators import folding
    from pyspark.sql import functions as F

    monkeypatch.setattr(folding, "TASK_ROWS", 500)
    payments = spark.range(2000).select(F.col("id").alias("payment"), F.lit(100).cast("long").alias("cents"))
    refunds = spark.range(8000).select((F.col("id") % 2000).alias("payment"), F.expr("id div 2000").alias("line"), F.lit(40).cast("long").alias("cents"))
    found = audit.over_cap(payments, refunds, ["line"])
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]  # of 20 tasks; the session's setting is 4
    assert sum(sizes) == 8000 and max(sizes) < 1000
    assert {(r["line"], r["so_far"], r["over"]) for r in found.collect()} == {(0, 40, False), (1, 80, False), (2, 120, True), (3, 120, True)}
    log = refunds.select(F.col("payment").alias("branch_id"), F.col("line").alias("seq"), (F.col("line") == 0).alias("claims"), F.lit(1).cast("long").alias("epoch"), (F.col("line") - 1).alias("first_seq"))
    verdicts = tasks.append_verdicts(log)
    assert max(r["count"] for r in verdicts.groupBy(F.spark_partition_id()).count().collect()) < 1000
    assert verdicts.filter("verdict = 'accepted'").count() == 6000
