"""Agent logs: spans, usage, tasks, tool arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_spans(events: DataFrame, keys: list[str], kind: str, ts: str, start: str, end: str) -> DataFrame:
    """(keys, started, ended, duration_ms) from start and end events of a key; an open span has no end."""
    t = lambda k, f: f(F.when(F.col(kind) == k, F.col(ts)))
    d = events.where(F.col(kind).isin(start, end)).groupBy(*keys).agg(t(start, F.min).alias("started"), t(end, F.max).alias("ended")).where("started IS NOT NULL")
    return d.withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, started, ended)"))


def usage(raw: str) -> list[Column]:
    """input_tokens, output_tokens, total_tokens of the answer shapes of several providers."""
    g = lambda *paths: F.coalesce(*[F.get_json_object(raw, f"$.{p}").cast("long") for p in paths])
    i = g("usage.prompt_tokens", "usage.input_tokens", "usageMetadata.promptTokenCount")
    o = g("usage.completion_tokens", "usage.output_tokens", "usageMetadata.candidatesTokenCount")
    t = F.coalesce(g("usage.total_tokens", "usageMetadata.totalTokenCount"), i + o)
    return [i.alias("input_tokens"), o.alias("output_tokens"), t.alias("total_tokens")]


def tool_arguments(raw: str) -> list[Column]:
    """args (JSON object text) and error: empty is {} without error, anything but an object {} with one."""
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    ok = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    return [F.when(~blank & ok, F.col(raw)).otherwise("{}").alias("args"), F.when(~blank & ~F.coalesce(ok, F.lit(False)), "not a JSON object").alias("error")]


def task_status(events: DataFrame, task: str, status: str, ts: str) -> DataFrame:
    """(task, status): the last one wins; at a tie of time the one that sorts last."""
    return events.groupBy(task).agg(F.max_by(status, F.struct(ts, status)).alias("status"))


def to_blocks(messages: DataFrame, session: str, seq: str, role: str, content: str) -> DataFrame:
    """(session, system, turns): the system text apart, and turns as array<struct<role, text>> with neighbours of one role
    joined, as providers that want alternating turns take them."""
    from pyspark.sql import Window

    d = messages.select(F.col(session).alias("s"), F.col(seq).alias("n"), F.when(F.col(role) == "tool", "user").otherwise(F.col(role)).alias("r"), F.col(content).alias("c"))
    system = d.where("r = 'system'").groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "\n").alias("system"))
    w = Window.partitionBy("s").orderBy("n")
    t = d.where("r <> 'system'").withColumn("g", F.sum(F.coalesce((F.lag("r").over(w) != F.col("r")).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy("s", "g").agg(F.first("r").alias("r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "\n").alias("c"))
    t = t.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r", "c"))), lambda x: F.struct(x["r"].alias("role"), x["c"].alias("text"))).alias("turns"))
    return t.join(system, "s", "left").select(F.col("s").alias(session), "system", "turns")


def parsed_json(raw: str) -> list[Column]:
    """success, and the value in its variant form (null if the text is no JSON)."""
    v = F.try_parse_json(F.col(raw))
    return [v.isNotNull().alias("success"), F.to_json(v).alias("data")]


def clock(ts: str) -> list[Column]:
    """Date, time, weekday and epoch seconds of an instant, in the session's time zone."""
    t = F.col(ts)
    return [F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "HH:mm:ss").alias("time"), F.date_format(t, "EEEE").alias("weekday"), F.unix_timestamp(t).alias("epoch")]


#: States of a subtask.
PROGRESS = "task string, created_at string, updated_at string, subtasks array<struct<id:int,description:string,status:string,result_summary:string,started_at:string,completed_at:string>>"


def progress(raw: str) -> list[Column]:
    """task, next_pending (the first pending subtask's id) and complete (all are completed or skipped) of a progress file's JSON."""
    p = F.from_json(raw, PROGRESS)
    left = F.get(F.filter(p["subtasks"], lambda s: s["status"] == "pending"), F.lit(0))["id"]
    return [p["task"].alias("task"), left.alias("next_pending"), F.forall(p["subtasks"], lambda s: s["status"].isin("completed", "skipped")).alias("complete")]


def latest_numbered(names: DataFrame, name: str, *keys: str) -> DataFrame:
    """(*keys, name): of each key the name with the highest number at its end."""
    return names.groupBy(*keys).agg(F.max_by(name, F.regexp_extract(name, "([0-9]+)$", 1).cast("decimal(38,0)")).alias(name))


def to_messages(turns: DataFrame, conv: str, turn: str, role: str, text: str, shape: str) -> DataFrame:
    """(conv, body): a conversation as the JSON that a provider takes.

    ``roles``: all messages as {role, content}. ``parts``: messages as {role, parts: [{text}]} under contents, the assistant as model, and system texts, joined by
    line ends, apart (left out where there are none). Null texts are empty.
    """
    said = F.coalesce(text, F.lit(""))
    system = F.col(role) == "system"
    if shape == "roles":
        one = F.struct(F.col(turn).alias("t"), F.struct(F.col(role).alias("role"), said.alias("content")).alias("m"))
        g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("x"))
        return g.select(conv, F.to_json(F.transform("x", lambda v: v["m"])).alias("body"))
    if shape != "parts":
        raise ValueError(f"unknown shape: {shape}")
    part = F.array(F.struct(said.alias("text")))
    one = F.struct(F.col(turn).alias("t"), F.struct(F.when(F.col(role) == "assistant", "model").otherwise("user").alias("role"), part.alias("parts")).alias("m"))
    g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.when(~system, one))).alias("x"), F.array_sort(F.collect_list(F.when(system, F.struct(F.col(turn).alias("t"), said.alias("s"))))).alias("s"))
    apart = F.when(F.size("s") > 0, F.struct(F.array(F.struct(F.array_join(F.transform("s", lambda v: v["s"]), "\n").alias("text"))).alias("parts")))
    return g.select(conv, F.to_json(F.struct(F.transform("x", lambda v: v["m"]).alias("contents"), apart.alias("systemInstruction"))).alias("body"))
