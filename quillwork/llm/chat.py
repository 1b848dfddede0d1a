"""Tool-call linking for chat logs.

Calls and results are matched by their identifier with a hash join. Each identifier first gets one call and one result by a
minimum (combined before the shuffle), so the join's keys are unique and no repeated identifier gathers anywhere; the
other copies are kept and marked. Calls are put in topological order: a call may name the call whose result it uses, and its
level is its distance from a call that uses none, found by pointer doubling in as many rounds as the logarithm of the longest
chain. Arguments are checked against their tool's schema, and every row is serialised as canonical JSON: keys sorted, no
blanks, characters as they are.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from quillwork.llm.common import Stage, append_columns

DEEPEST = 200  # levels of nesting
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; whole doubles as whole numbers."""
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str) -> object:
    """The value of a JSON text. ValueError for what is no JSON, what no double holds (``1e400``, NaN), lone surrogates, and more than
    ``DEEPEST`` levels."""
    def number(digits: str) -> float:
        value = float(digits)
        if math.isinf(value):
            raise ValueError(digits)
        return value

    def refused(word: str) -> None:
        raise ValueError(word)

    try:
        value = json.loads(text, parse_float=number, parse_constant=refused)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(DEEPEST):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            canonical(value).encode()  # a UnicodeEncodeError is a ValueError
            return value
    raise ValueError("nested too deep")


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, const, minimum, maximum, minLength, maxLength, required, properties,
    additionalProperties (false), items, minItems and maxItems."""
    out = []
    want = schema.get("type")
    if want is not None:
        def fits(kind: str) -> bool:
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == value // 1)
            return isinstance(value, KINDS[kind])

        if not any(map(fits, [want] if isinstance(want, str) else want)):
            return [f"{at}:type"]
    same = lambda x: canonical(x) == canonical(value)
    if "enum" in schema and not any(map(same, schema["enum"])) or "const" in schema and not same(schema["const"]):
        out.append(f"{at}:enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}:minimum"] * (value < schema.get("minimum", -math.inf)) + [f"{at}:maximum"] * (value > schema.get("maximum", math.inf))
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            out += [f"{at}:{low}"] * (len(value) < schema.get(low, 0)) + [f"{at}:{high}"] * (len(value) > schema.get(high, math.inf))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}:unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{i}]")
    return out


def levels(stage: Stage, calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level int)`` for calls ``(conv, call_id, after)`` with unique ids: 0 for a call that uses no known other,
    else one more than the call it uses. Null for calls that wait for each other in a circle, and for all that wait for them."""
    ids = calls.select("conv", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    now = stage.put(calls.join(ids, ["conv", "after"], "left").select(
        "conv", "call_id", F.when(F.col("there"), F.col("after")).otherwise(F.col("call_id")).alias("to"),
        F.when(F.col("there"), 1).otherwise(0).alias("steps"), F.col("there").isNull().alias("ended")))
    waiting, before = now.where("not ended").count(), -1
    while waiting and waiting != before:  # as long as any chain is unfinished, each round finishes some
        there = now.select("conv", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("ends"))
        moved = now.where("not ended").join(there, ["conv", "to"]).select(
            "conv", "call_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("ended"))
        nxt = stage.put(now.where("ended").union(moved))
        stage.drop(now)
        now, before = nxt, waiting
        waiting = now.where("not ended").count()
    return now.select("conv", "call_id", F.when(F.col("ended"), F.col("steps")).alias("level"))


def placed(stage: Stage, df: DataFrame, group: str, keys: list) -> DataFrame:
    """``df`` with ``position long`` in its group (from 0), in the order of ``keys`` after the group, by one range shuffle; a group may span
    partitions."""
    cols = df.columns
    order = [F.col(group).asc_nulls_first(), *keys]
    held = stage.put(df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # rows stand in partitions as written, so a row's place in its partition is its number less the partition's least
    sizes = held.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("least"))
    starts = sizes.select("part", "least", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                                      F.lit(0)).alias("start"))
    known = held.join(F.broadcast(starts), "part").withColumn("place", F.col("at") - F.col("least") + F.col("start"))
    first = known.groupBy(F.col(group).alias("g")).agg(F.min("place").alias("first"))
    return known.join(first, F.col(group).eqNullSafe(F.col("g"))).select(*cols, (F.col("place") - F.col("first")).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls ``(conv, turn, call_id, name, arguments, after)`` and results ``(conv, turn, call_id, content)``, linked.

    One row for each call, and one for each result that no call row takes: ``conv``, ``turn``, ``call_id``, ``kind``
    (call, result), ``status``, ``errors``, ``level``, ``position`` and ``message``.

    ``status`` of a call is ``repeated`` (not the first call of its id in the conversation by turn), ``no_id``,
    ``unanswered``, ``early`` (its result stands before it), ``circular``, ``unknown_after`` or ``linked``. That of a result
    row is ``orphan`` (no call has its id), ``repeated`` or ``no_id``. ``errors`` lists what the arguments break, joined by
    ``;``: ``not_json`` (see ``parsed``), ``unknown_tool``, or paths with the rule; null if nothing. ``position`` counts from 0 in a conversation by level
    (null last), turn, kind, id and copy. ``message`` holds the call, its parsed arguments (null if not JSON) and its
    result. Null turns stand first. Other columns are left out, whatever their names. Empty tables give an empty table.
    """
    stage = Stage(calls.sparkSession, "chat")
    calls = stage.put(calls.select("conv", "turn", "call_id", "name", "arguments", "after").withColumn("row", F.monotonically_increasing_id()))
    results = stage.put(results.select("conv", "turn", "call_id", "content").withColumn("row", F.monotonically_increasing_id()))
    rank = lambda *cols: F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("t"), *cols, F.col("row").alias("r"))
    named = lambda df, *cols: df.where(F.col("conv").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(
        F.min(rank(*cols)).alias("m"))
    first = named(calls, F.coalesce("name", F.lit("")).alias("n"), F.coalesce("arguments", F.lit("")).alias("a")).select(
        "conv", "call_id", F.col("m.r").alias("call_row"))
    answer = named(results, F.coalesce("content", F.lit("")).alias("c")).select("conv", "call_id", F.col("m.r").alias("result_row"))
    pairs = stage.put(first.join(answer.hint("shuffle_hash"), ["conv", "call_id"], "full"))
    level = levels(stage, calls.join(pairs.select("call_row"), F.col("row") == F.col("call_row"), "left_semi").select("conv", "call_id", "after"))
    known = pairs.where("call_row is not null").join(level, ["conv", "call_id"], "left")
    ids = pairs.where("call_row is not null").select(F.col("conv").alias("c"), F.col("call_id").alias("i"))
    taken = results.select(F.col("row").alias("result_row"), F.col("turn").alias("result_turn"), "content")
    told = (calls.join(known.select(F.col("call_row").alias("row"), "result_row", "level", F.lit(True).alias("is_first")), "row", "left")
            .join(taken, "result_row", "left")
            .join(ids, (F.col("conv") == F.col("c")) & (F.col("after") == F.col("i")), "left"))
    status = (F.when(F.col("conv").isNull() | F.col("call_id").isNull(), "no_id").when(F.col("is_first").isNull(), "repeated")
              .when(F.col("result_row").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early")
              .when(F.col("level").isNull(), "circular").when(F.col("after").isNotNull() & F.col("i").isNull(), "unknown_after")
              .otherwise("linked"))
    called = told.select("conv", "turn", "call_id", F.lit("call").alias("kind"), status.alias("status"), "level", "name", "arguments", "after",
                         "result_turn", "content", "row")
    used = pairs.where("call_row is not null and result_row is not null").select(F.col("result_row").alias("row"))
    lone = pairs.where("call_row is null").select(F.col("result_row").alias("row"), F.lit(True).alias("orphan"))
    left = results.join(used, "row", "left_anti").join(lone, "row", "left")
    lonely = left.join(ids, (F.col("conv") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    missing = (F.when(F.col("conv").isNull() | F.col("call_id").isNull(), "no_id").when(F.col("i").isNull(), "orphan").otherwise("repeated"))
    none = F.lit(None).cast("string")
    other = lonely.select("conv", "turn", "call_id", F.lit("result").alias("kind"), missing.alias("status"), F.lit(None).cast("int").alias("level"),
                          none.alias("name"), none.alias("arguments"), none.alias("after"), F.col("turn").alias("result_turn"), "content", "row")

    def make():
        def one(r: dict) -> tuple[str | None, str]:
            wrong, value = [], None
            if r["kind"] == "call":
                try:
                    value = parsed(r["arguments"] or "")
                except ValueError:
                    wrong = ["not_json"]
                if r["name"] not in schemas:
                    wrong = ["unknown_tool", *wrong]
                elif not wrong:
                    wrong = faults(value, schemas[r["name"]])
            got = {"content": r["content"], "turn": r["result_turn"]} if r["result_turn"] is not None or r["content"] is not None else None
            whole = {"id": r["call_id"], "result": got}
            if r["kind"] == "call":
                whole |= {"after": r["after"], "function": {"arguments": value, "name": r["name"]}}
            return ";".join(wrong) or None, canonical(whole)

        def fn(batch: pa.RecordBatch) -> list:
            made = [one(r) for r in batch.to_pylist()]
            return [pa.array([e for e, _ in made], pa.string()), pa.array([m for _, m in made], pa.string())]

        return fn

    said = append_columns(called.unionByName(other), [StructField("errors", StringType()), StructField("message", StringType())], make)
    said = said.select("conv", "turn", "call_id", "kind", "status", "errors", "level", "message", "row")
    out = placed(stage, said, "conv", [F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("kind"),
                                       F.col("call_id").asc_nulls_first(), F.col("message"), F.col("row")])
    return out.select("conv", "turn", "call_id", "kind", "status", "errors", "level", "position", "message")
