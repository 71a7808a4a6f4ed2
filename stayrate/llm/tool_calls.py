"""Link tool calls with their results, order them, validate them and print canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ranking import distributed_rank
from stayrate.llm.native import stored
from stayrate.sources import scratch_path

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and value == int(value)
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema; type, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength and pattern count."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    found = [f"{path}: not allowed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                found += violations(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{name}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += violations(item, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            found.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{path}: pattern")
    elif _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        found.append(f"{path}: range")
    return found


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole numbers without a fraction."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, list):
            return [plain(y) for y in x]
        return {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    text.encode()  # lone surrogates cannot be written
    return text


def _checker(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, errors = [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
                try:
                    value = json.loads(text if text is not None else "")
                    plain.append(canonical(value))
                    broken = violations(value, schemas[name]) if name in schemas else ["unknown tool"]
                except (ValueError, RecursionError):
                    plain.append(None)
                    broken = ["not JSON"]
                errors.append(broken)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"arguments": pa.array(plain, pa.string()), "errors": pa.array(errors, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def topological_waves(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call, wave) of the calls (conv, call, at) that no cycle holds up; ``edges`` are (conv, call, dep).

    By wave, then by place (``at``, then identifier), is a topological order of a conversation. A
    wave takes every call that waits for nothing, and the calls of each conversation up to the
    first that depends on a later one: what those wait for comes before them in the wave. So
    conversations in which calls depend on earlier ones take one wave, however long they are, and
    others no more than they have levels. Each wave is added to one table.
    """
    key = ["conv", "call"]
    place, dep_place = F.struct("at", "call"), F.struct("dep_at", "dep")
    placed = calls.select("conv", F.col("call").alias("dep"), F.col("at").alias("dep_at"))
    edges = stored(edges.join(calls.select(*key, "at"), key).join(placed, ["conv", "dep"]), "edges")
    target = scratch_path(calls.sparkSession, "waves")
    todo, wave, schema = calls.select(*key, "at"), 0, "conv string, call string, wave long"
    while True:
        stops = edges.where(dep_place > place).groupBy("conv").agg(F.min(place).alias("stop"))
        waits = edges.select(*key).distinct().withColumn("waits", F.lit(True))
        judged = todo.join(stops, "conv", "left").join(waits, key, "left")
        goes = F.col("waits").isNull() | F.col("stop").isNull() | (place < F.col("stop"))
        judged.where(goes).select(*key, F.lit(wave).cast("long").alias("wave")).write.mode("append").parquet(target)
        settled = calls.sparkSession.read.schema(schema).parquet(target)
        now = settled.where(F.col("wave") == wave).select(*key)
        todo = stored(todo.join(now, key, "left_anti"), "todo")
        if not now.limit(1).count() or not todo.limit(1).count():
            return settled
        gone = now.withColumnRenamed("call", "dep")
        edges = stored(edges.join(now, key, "left_anti").join(gone, ["conv", "dep"], "left_anti"), "edges")
        wave += 1


def _others(rows: DataFrame, firsts: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of repeated identifiers without the first of each, equal rows as often as they occur."""
    key = ["conv", "call"]
    counted = rows.groupBy(*key, *fields).agg(F.count(F.lit(1)).alias("n"))
    first = firsts.select(*key, F.struct(*fields).alias("first"))
    left = F.col("n") - F.struct(*fields).eqNullSafe(F.col("first")).cast("long")
    others = counted.join(first, key).select(*key, *fields, left.alias("n")).where("n > 0")
    return others.withColumn("_copy", F.explode(F.expr("array_repeat(0, int(n))"))).drop("_copy", "n")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, per result without a call and per further row of an identifier.

    ``calls``: conv_id, call_id, name, arguments (JSON), depends_on (array of call ids of the
    conversation), at (place in the conversation); ``results``: conv_id, call_id, content, at.
    Identifiers hold within a conversation; of calls or results with one identifier the first
    by ``at`` (then by content) counts and the others are rows of their own (``duplicate``). Dependencies on unknown calls or on the call itself are
    left out. Returns conv_id, call_id, name, wave, position (from 0, a topological order of
    the conversation, which is that of the places wherever it can be: by wave, then by place), status (``answered``, ``unanswered``, ``orphan``
    for a result without a call, ``cycle`` for calls that cannot be ordered), valid, errors, and
    ``message``: canonical JSON of the call and its result. Calls and results without a conversation or
    identifier are linked with nothing and left unordered (``unlinked``). Null arguments are not
    JSON, null contents are null. Empty tables give an empty result; other columns are ignored.
    """
    rest = ["name", "arguments", "depends_on"]
    named = calls.select(F.col("conv_id").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call"), "at", *rest)
    with_id = F.col("conv").isNotNull() & F.col("call").isNotNull()
    fields = "conv string, call string, at long, name string, arguments string, depends_on array<string>, errors array<string>"
    checked = lambda rows: rows.mapInArrow(_checker(schemas), fields)
    first = checked(named.where(with_id)).groupBy("conv", "call").agg(
        F.min(F.struct("at", "name", "arguments", "depends_on", "errors")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    counted = stored(first.select("conv", "call", "c.*", "n"), "calls")
    known = counted.drop("n")
    answers = results.select(F.col("conv_id").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call"), "at", "content")
    found = answers.where(with_id).groupBy("conv", "call").agg(
        F.min(F.struct("at", "content")).alias("r"), F.count(F.lit(1)).alias("n")
    )

    wanted = known.select("conv", "call", F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep <> call")
    edges = wanted.join(known.select("conv", F.col("call").alias("dep")), ["conv", "dep"], "left_semi")
    waves = topological_waves(known, edges.select("conv", "call", "dep"))
    ordered = stored(known.select("conv", "call", "at").join(waves, ["conv", "call"]), "ordered")
    ranked = stored(distributed_rank(ordered, ["conv", "wave", "at", "call"]), "ranked")
    starts = ranked.groupBy("conv").agg(F.min("rank").alias("start"))
    places = ranked.join(starts, "conv").select("conv", "call", "wave", (F.col("rank") - F.col("start")).alias("position"))

    linked = known.withColumn("is_call", F.lit(True)).join(found.drop("n"), ["conv", "call"], "full").join(places, ["conv", "call"], "left")
    status = (
        F.when(F.col("is_call").isNull(), "orphan")
        .when(F.col("wave").isNull(), "cycle")
        .when(F.col("r").isNull(), "unanswered")
        .otherwise("answered")
    )
    unplaced = lambda rows, status: rows.select(
        "conv", "call",
        *(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c)
          for c, kind in (("name", "string"), ("arguments", "string"), ("errors", "array<string>"))),
        F.lit(None).cast("long").alias("wave"), F.lit(None).cast("long").alias("position"), F.lit(status).alias("status"),
        F.col("content") if "content" in rows.columns else F.lit(None).cast("string").alias("content"),
    )
    more_calls = checked(named.where(with_id).join(counted.where("n > 1").select("conv", "call"), ["conv", "call"]).select(*named.columns))
    more_answers = answers.where(with_id).join(found.where("n > 1").select("conv", "call"), ["conv", "call"])
    firsts = found.where("n > 1").select("conv", "call", "r.*")
    everything = (
        unplaced(checked(named.where(~with_id)), "unlinked")
        .unionByName(unplaced(answers.where(~with_id), "unlinked"))
        .unionByName(unplaced(_others(more_calls, counted.where("n > 1").drop("n"), ["at", *rest, "errors"]), "duplicate"))
        .unionByName(unplaced(_others(more_answers, firsts, ["at", "content"]), "duplicate"))
        .unionByName(
            linked.select(
                "conv", "call", "name", "arguments", "errors", "wave", "position", status.alias("status"),
                F.col("r.content").alias("content"),
            )
        )
    )
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1), F.lit(""))
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"call_id":'), value("call"),
        F.lit(',"name":'), value("name"), F.lit(',"result":'), value("content"), F.lit("}"),
    )
    return everything.select(
        F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "name", "wave", "position", "status",
        F.when(F.col("errors").isNotNull(), F.size("errors") == 0).alias("valid"), "errors", message.alias("message"),
    )


#: Tools that the turns of a conversation amount to.
TURN_TOOLS = {
    "set_up": {
        "type": "object",
        "required": ["instructions"],
        "properties": {"instructions": {"type": "string", "minLength": 1}},
        "additionalProperties": False,
    },
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    },
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of conversations (conv_id, turn, role, text) amount to.

    A user's turn calls ``reply`` and a system turn ``set_up``; an assistant's turn is the result
    of the call in the turn before. A call depends on those of the two turns before it.
    """
    nr = lambda back: F.concat(F.lit("call_"), (F.col("turn") - back).cast("string"))
    user = F.col("role") == "user"
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        nr(0).alias("call_id"),
        F.col("turn").alias("at"),
        F.when(user, "reply").otherwise("set_up").alias("name"),
        F.when(user, F.to_json(F.struct("turn", F.col("text").alias("prompt"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("instructions"))))
        .alias("arguments"),
        F.array_compact(F.array(nr(1), nr(2))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", nr(1).alias("call_id"), F.col("turn").alias("at"), F.col("text").alias("content")
    )
    return calls, results


def turns_without_part(turns: DataFrame) -> DataFrame:
    """A row of ``link_calls`` for every turn that is neither call nor result: its role is null or another.

    Its status is ``other_role`` and its name the role; the message is the turn as JSON.
    """
    other = turns.where(F.col("role").isNull() | ~F.col("role").isin("user", "system", "assistant"))
    null = lambda kind: F.lit(None).cast(kind)
    return other.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"),
        F.col("role").alias("name"),
        null("long").alias("wave"),
        null("long").alias("position"),
        F.lit("other_role").alias("status"),
        null("boolean").alias("valid"),
        null("array<string>").alias("errors"),
        F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"}).alias("message"),
    )
