"""Fork trees: which events a branch sees without copying its ancestors' history."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut_lineage


def closure(branches: DataFrame) -> DataFrame:
    """branch_id, ancestor, distance, from_seq, upto: every branch with itself and all its ancestors.

    An ancestor's own events are visible from its own fork on and below upto, the smallest fork_seq on the path down to the
    branch (null for the branch itself). Parents that form a cycle raise an error. Taking the minimum keeps histories contiguous when a grandchild forks below its
    parent's fork. Paths double in each round, so a tree of depth d takes about log2(d) rounds, each one join.
    """
    reach = branches.select("branch_id", F.col("branch_id").alias("ancestor"), F.lit(0).alias("distance"), F.lit(None).cast("bigint").alias("upto"))
    jumps = branches.filter("parent_branch is not null").select(F.col("branch_id").alias("start"), F.col("parent_branch").alias("stop"), F.col("fork_seq").cast("bigint").alias("low"))
    step, most = 1, branches.count()
    while True:
        jumps = cut_lineage(jumps)
        if jumps.isEmpty():
            break
        if step > most:
            raise ValueError("the parents of branches form a cycle")
        further = reach.join(jumps, F.col("ancestor") == F.col("start")).select("branch_id", F.col("stop").alias("ancestor"), (F.col("distance") + step).alias("distance"), F.least("upto", "low").alias("upto"))
        reach = cut_lineage(reach.unionByName(further))  # else each round would compute all rounds before it again, twice
        second = jumps.toDF("start2", "stop2", "low2")
        jumps = jumps.join(second, F.col("stop") == F.col("start2")).select("start", F.col("stop2").alias("stop"), F.least("low", "low2").alias("low"))
        step *= 2
    own = branches.select(F.col("branch_id").alias("ancestor"), F.coalesce("fork_seq", F.lit(0)).cast("bigint").alias("from_seq"))
    return reach.join(own, "ancestor").select("branch_id", "ancestor", "distance", "from_seq", "upto")


def visible_events(closed: DataFrame, events: DataFrame) -> DataFrame:
    """events seen from each branch: their own branch_id becomes origin, branch_id is the one that looks. An equi join with a range as residual."""
    e = events.withColumnRenamed("branch_id", "origin")
    seen = (F.col("origin") == F.col("ancestor")) & (F.col("seq") >= F.col("from_seq")) & (F.col("upto").isNull() | (F.col("seq") < F.col("upto")))
    return closed.join(e, seen).drop("ancestor", "from_seq", "upto", "distance")


def override_schedule(closed: DataFrame, branches: DataFrame) -> DataFrame:
    """branch_id, model, allow_live: overrides of forks merged along the path, nearest last. branches: model, allow_live (array).

    Scalars: the last that isn't null. Lists: union in order of first appearance. Roots' overrides don't count.
    """
    own = branches.filter("parent_branch is not null").select(F.col("branch_id").alias("ancestor"), "model", "allow_live")
    steps = closed.join(own, "ancestor").groupBy("branch_id")
    merged = steps.agg(F.max_by("model", F.when(F.col("model").isNotNull(), -F.col("distance"))).alias("model"), F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "allow_live"))).alias("all"))
    union = F.aggregate("all", F.array().cast("array<string>"), lambda acc, x: F.array_union(acc, F.coalesce(x["allow_live"], F.array().cast("array<string>"))))
    return merged.select("branch_id", "model", union.alias("allow_live"))


def _merged(entries, field: str):
    """Of entries from the root down, a map in which later values win."""
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_zip_with(acc, F.coalesce(e[field], F.create_map().cast("map<string,string>")), lambda k, old, new: F.coalesce(new, old)))


def overrides_at(closed: DataFrame, branches: DataFrame, asked: DataFrame) -> DataFrame:
    """What is in force for a step of a branch at a seq (asked: branch_id, seq; a null seq is the tip): model, effects (mode), prompt_patches, signals, allow_live.

    Overrides hold from the seq at which their branch forked, roots' not at all. Along the path scalars are the last that isn't null, maps
    merge key by key with the nearest winning, lists join in order of first appearance. branches: branch_id, parent_branch, fork_seq and these fields.
    """
    fields = ["model", "effects", "prompt_patches", "signals", "allow_live"]
    own = branches.filter("parent_branch is not null").select(F.col("branch_id").alias("ancestor"), F.struct(*fields).alias("own"))
    steps = closed.join(own, "ancestor").groupBy("branch_id").agg(F.collect_list(F.struct((-F.col("distance")).alias("at"), "from_seq", "own")).alias("entries"))  # as many as the path is long
    found = asked.join(steps, "branch_id", "left")
    # Maps can't be sorted, so places are sorted and entries looked up.
    places = F.array_sort(F.transform(F.filter("entries", lambda e: F.col("seq").isNull() | (e["from_seq"] <= F.col("seq"))), lambda e: e["at"]))
    active = F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda at: F.get(F.filter("entries", lambda e: e["at"] == at), F.lit(0))["own"])
    found = found.withColumn("active", active)
    last = lambda field: F.aggregate("active", F.lit(None).cast("string"), lambda acc, e: F.coalesce(e[field], acc))
    union = F.aggregate("active", F.array().cast("array<string>"), lambda acc, e: F.array_union(acc, F.coalesce(e["allow_live"], F.array().cast("array<string>"))))
    return found.select("branch_id", "seq", last("model").alias("model"), F.coalesce(last("effects"), F.lit("live")).alias("effects"), _merged("active", "prompt_patches").alias("prompt_patches"), _merged("active", "signals").alias("signals"), union.alias("allow_live"))


def last_output(seen: DataFrame, completed, output) -> DataFrame:
    """The output of the last completion in each branch's history, ancestors' included; null without one. seen: as visible_events gives it."""
    at = F.when(completed, F.col("seq"))
    return seen.groupBy("branch_id").agg(F.max_by(output, at).alias("output"), F.max(at).alias("at_seq"))


def resolve(targets: DataFrame, runs: DataFrame, branches: DataFrame) -> DataFrame:
    """target, branch_id, error: branches that texts name. A text is a start of a run's id, with :label or without (its root branch), or a start of a
    branch's id. Whole ids are starts too. What names none or several is an error. runs: run_id, root_branch; branches: branch_id, run_id, label.

    Starts meet by equality: ids are dealt out at the lengths that targets have."""
    asked = targets.select("target", F.lower(F.split_part("target", F.lit(":"), F.lit(1))).alias("start"), F.when(F.contains("target", F.lit(":")), F.substring_index("target", ":", -1)).alias("wanted")).distinct()
    sizes = asked.select(F.length("start").alias("size")).distinct().agg(F.collect_set("size").alias("sizes"))  # as many as ids have characters
    starts = lambda ids, c: ids.crossJoin(F.broadcast(sizes)).select("*", F.explode("sizes").alias("size")).filter(F.length(c) >= F.col("size")).withColumn("start", F.expr(f"left({c}, size)")).drop("sizes", "size")
    of_run = asked.join(starts(runs.select("run_id", "root_branch"), "run_id"), "start")
    plain = of_run.filter("wanted is null or wanted = 'main'").select("target", F.col("root_branch").alias("branch_id"))
    labelled = of_run.filter("wanted <> 'main'").join(branches, "run_id").filter((F.col("label") == F.col("wanted")) | F.startswith("branch_id", F.col("wanted"))).groupBy("target", "run_id").agg(F.min("branch_id").alias("branch_id")).drop("run_id")
    met = of_run.select("target", "run_id").distinct()
    direct = asked.filter("wanted is null").join(starts(branches.select("branch_id", "run_id"), "branch_id"), "start").join(met, ["target", "run_id"], "left_anti").select("target", "branch_id")
    found = plain.union(labelled).union(direct).groupBy("target").agg(F.count("*").alias("n"), F.min("branch_id").alias("branch_id"))
    n = F.coalesce("n", F.lit(0))
    error = F.when(n == 0, "nothing matches").when(n > 1, F.concat(F.lit("ambiguous ("), n.cast("string"), F.lit(" matches)")))
    return asked.select("target").join(found, "target", "left").select("target", F.when(n == 1, F.col("branch_id")).alias("branch_id"), error.alias("error"))


def fork_points(branches: DataFrame, events: DataFrame) -> DataFrame:
    """branch_id, parent_branch, fork_seq, step_id at the fork in the parent, and the parent's hash just before. events: branch_id, seq, step_id, hash."""
    own = Window.partitionBy("branch_id").orderBy("seq")
    at = events.select(F.col("branch_id").alias("parent_branch"), F.col("seq").alias("fork_seq"), "step_id", F.lag("hash").over(own).alias("prev_hash"))
    return branches.filter("parent_branch is not null").select("branch_id", "parent_branch", F.col("fork_seq").cast("bigint").alias("fork_seq")).join(at, ["parent_branch", "fork_seq"], "left").select("branch_id", "parent_branch", "fork_seq", "step_id", "prev_hash")


def genesis_rows(branches: DataFrame, workflow: str, version: str, history_format: int = 1) -> DataFrame:
    """The first event of each root (seq 0, epoch 0, RunStarted) and of each fork (at its fork_seq, Forked)."""
    root = F.col("parent_branch").isNull()
    started = F.concat(F.lit(f'{{"history_format":{history_format},"type":"RunStarted","version":"{version}","workflow":"{workflow}"}}'))
    forked = F.concat(F.lit('{"from_branch":"'), F.col("parent_branch").cast("string"), F.lit('","type":"Forked"}'))
    return branches.select("branch_id", F.when(root, 0).otherwise(F.col("fork_seq")).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("epoch"), F.when(root, "RunStarted").otherwise("Forked").alias("type"), F.when(root, started).otherwise(forked).alias("body"))
