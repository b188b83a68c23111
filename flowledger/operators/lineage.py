"""Reachability over workflow lineage and call graphs, by frontier joins.

Every level is one join of the frontier with the edges; results of a level are
written to the session's checkpoint folder, so that plans don't grow.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SPAWNING

MOST_LEVELS = 1000
COMPACTED = 8
_own_dir: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in ``spark.checkpoint.dir``; a folder of our own only where there is none and all executors are threads of this process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not found and not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="flowledger-"))
        context.setCheckpointDir(found or _own_dir[0])
    return df.checkpoint()


def descendants(ws: DataFrame, roots: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(root, workflow_uuid, depth) of everything below each root, ``most_levels`` down; a root isn't below itself, cycles end at what was seen."""
    edges = ws.where(F.col("parent_workflow_id").isNotNull()).select(F.col("parent_workflow_id").alias("node"), "workflow_uuid")
    frontier = cut(roots.select(F.col("workflow_uuid").alias("root"), F.col("workflow_uuid").alias("node"), F.lit(0).alias("depth")))
    seen = frontier
    for depth in range(1, most_levels + 1):
        step = frontier.join(edges, "node").select("root", F.col("workflow_uuid").alias("node")).distinct()
        frontier = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % COMPACTED == 0:  # else every level reads a union of all before
            seen = cut(seen)
    return seen.where("depth > 0").select("root", F.col("node").alias("workflow_uuid"), "depth")


def unwind_steps(oo: DataFrame) -> DataFrame:
    """Steps to unwind with their position from the last: undo where there is a compensation, else the child it spawned."""
    own = oo.where(F.col("ex_compensation").isNotNull() | F.col("function_name").isin(SPAWNING))
    kind = F.when(F.col("ex_compensation").isNotNull(), "undo").otherwise("descendant")
    child = F.when(F.col("ex_compensation").isNull(), F.when(F.col("function_name") == "DBOS.getResult", F.col("child_workflow_id")).otherwise(F.col("output")))
    return own.select("workflow_uuid", "function_id", kind.alias("kind"), child.alias("descendant")).where((F.col("kind") == "undo") | F.col("descendant").isNotNull())


def unwind_plan(ws: DataFrame, oo: DataFrame, able: DataFrame) -> DataFrame:
    """What each step's unwinding does: undo; cancel_and_wait for a running descendant; unwind for a finished one that can be; else skip."""
    state = ws.select(F.col("workflow_uuid").alias("descendant"), "status").join(able.select(F.col("workflow_uuid").alias("descendant"), "unwindable"), "descendant", "left")
    live = F.col("status").isin("PENDING", "ENQUEUED", "DELAYED", "CANCELLING")
    action = F.when(F.col("kind") == "undo", "undo").when(live, "cancel_and_wait").when((F.col("status") == "SUCCESS") & F.col("unwindable"), "unwind").otherwise("skip")
    return unwind_steps(oo).join(state, "descendant", "left").select("workflow_uuid", "function_id", action.alias("action"))


#: What must not be called, by module, function, arity (None: any), scope and rule.
RULES = [
    *((m, f, None, scope, "spawn") for m in ("Kernel", ":erlang") for f in ("spawn", "spawn_link", "spawn_monitor") for scope in ("workflow", "step")),
    *(("Task", f, None, "workflow", "task") for f in ("async", "await", "async_stream", "start")),
    *(("Task", f, None, "step", "task") for f in ("async", "await", "async_stream", "start", "start_link")),
    (":rand", None, None, "workflow", "rand"),
    ("DateTime", "utc_now", None, "workflow", "utc_now"),
    ("NaiveDateTime", "utc_now", None, "workflow", "utc_now"),
    ("Date", "utc_today", None, "workflow", "utc_today"),
    *(("System", f, None, "workflow", "system_time") for f in ("system_time", "os_time", "monotonic_time", "unique_integer")),
    ("Process", "sleep", None, "workflow", "sleep"),
    ("Kernel", "send", 2, "workflow", "send"),
    (":erlang", "send", 2, "workflow", "send"),
    ("Kernel.SpecialForms", "receive", None, "workflow", "receive"),
    ("Kernel", "make_ref", 0, "workflow", "make_ref"),
    (":erlang", "make_ref", 0, "workflow", "make_ref"),
]


def match_rules(callees: DataFrame, scope: str, repo: str | None = None) -> DataFrame:
    """Of callees(module, function, arity) those that ``scope`` must not call: callee (``module.function/arity``) and rule.

    With ``repo``, any call of that module within a workflow breaks the rule ``repo``.
    """
    spark = callees.sparkSession
    more = [(repo, None, None, "workflow", "repo")] if repo else []
    rules = spark.createDataFrame([r for r in RULES + more if r[3] == scope], "r_module string, r_function string, r_arity int, scope string, rule string")
    any_or = lambda r, c: F.col(r).isNull() | (F.col(r) == F.col(c))
    hit = (F.col("module") == F.col("r_module")) & any_or("r_function", "function") & any_or("r_arity", "arity")
    name = F.concat("module", F.lit("."), "function", F.lit("/"), F.col("arity").cast("string"))
    return callees.join(F.broadcast(rules), hit).select(name.alias("callee"), "rule").distinct()


def reached(entries: DataFrame, calls: DataFrame, stop: DataFrame) -> DataFrame:
    """Every node that calls(caller, callee) lead to from the entries, which are included, without passing a stop on the way."""
    edges = calls.select(F.col("caller").alias("node"), "callee")
    frontier = cut(entries.select(F.col("entry").alias("node")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        found = cut(frontier.join(edges, "node").select(F.col("callee").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(found)
        frontier = found.join(stop, "node", "left_anti")
    return seen


def unscannable(modules: DataFrame, reached_modules: DataFrame) -> DataFrame:
    """Modules(module, file) without debug information that a workflow reaches, one row a module."""
    return modules.join(reached_modules.select("module").distinct(), "module", "left_semi").groupBy("module").agg(F.min("file").alias("file"))


def banned_calls(entries: DataFrame, calls: DataFrame, rules: DataFrame, stop: DataFrame) -> DataFrame:
    """Witness chains from entries to banned callees.

    entries(entry); calls(caller, callee, file, line, ordinal); rules(callee, rule);
    stop(node): nodes the search does not pass.  For each (entry, rule, callee) the
    chain that a breadth-first search in edge order finds first.
    """
    edges = calls.select(F.col("caller").alias("node"), "callee", "file", "line", "ordinal")
    frontier = cut(entries.select("entry", F.col("entry").alias("node"), F.array(F.col("entry")).alias("path"), F.array(F.lit(0)).cast("array<bigint>").alias("rank")))
    seen, found = frontier.select("entry", "node"), None
    while not frontier.isEmpty():
        step = frontier.join(edges, "node").select("entry", "callee", "file", "line", F.concat("path", F.array("callee")).alias("path"), F.concat("rank", F.array(F.col("ordinal").cast("bigint"))).alias("rank"))
        hits = cut(step.join(rules, "callee").select("entry", "rule", "callee", "file", "line", "path", "rank"))
        found = hits if found is None else found.unionByName(hits)
        new = step.join(stop.select(F.col("node").alias("callee")), "callee", "left_anti").groupBy("entry", F.col("callee").alias("node")).agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"))
        frontier = cut(new.join(seen, ["entry", "node"], "left_anti"))
        seen = seen.unionByName(frontier.select("entry", "node"))
    best = found.groupBy("entry", "rule", "callee").agg(F.min_by(F.struct("file", "line", "path"), F.struct(F.size("path"), "rank")).alias("b")) if found is not None else None
    return best.select("entry", "rule", "callee", "b.file", "b.line", "b.path").orderBy("file", "line", "entry", "rule") if best is not None else entries.limit(0)


def unused(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Suppressions, trusted modules and the like that nothing used."""
    return declared.join(used, key, "left_anti")


def merge_manifest(old: DataFrame, traced: DataFrame, known: DataFrame) -> DataFrame:
    """Edges by module: traced again, they replace the old ones; modules no longer known go."""
    kept = old.join(traced.select("module").distinct(), "module", "left_anti").join(known, "module", "left_semi")
    return kept.unionByName(traced)
