"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated and written as canonical JSON.

Calls are rows (conv_id, call_id, turn, name, arguments, after): `arguments` JSON text, `after` the ids of calls of the
same conversation whose results they use.  Results are rows (conv_id, call_id, turn, content).  An identifier that
repeats is reduced before the join, to its earliest row (then the smallest text) and a count, so equal ids never multiply.

`level` is 0 for calls that wait for nothing, else one more than the highest level they wait for: sorted by level, every
call comes after all that it uses, whatever its turn.  Conversations of up to `MAX_GROUP` calls are levelled by one task
each, larger ones in blocks of so many calls, beside and after one another, with the same result; calls on a cycle or behind one have no
level and are marked.  Ids in `after` that
name no call are counted and do not delay a call.

Arguments are checked against a subset of JSON Schema: type, properties, required, additionalProperties, items, enum,
minimum, maximum, minLength, maxLength.  Canonical JSON sorts keys by UTF-16 code units, writes no spaces, escapes only
what must be, and prints numbers in their shortest form.

status: linked, no_result, orphan_result, cycle (linked or not), no_id.  Rows whose conversation or id is null cannot be
linked: each stands for itself with status no_id.  Arguments that are null, or no JSON object, are invalid and canonical
as null, and so are those that no UTF-8 or double can hold (lone surrogates, integers beyond doubles) or that nest deeper
than `MAX_DEPTH`.  Names without a schema are invalid.  Texts are taken whole; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep, stored
from tamis.operators.order import numbered

#: Calls that one task levels: a conversation, or a block of a larger one.
MAX_GROUP = 50_000
#: Levels of arrays and objects that arguments may nest.
MAX_DEPTH = 200
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical_number(x: float | int) -> str:
    """The shortest form of a number, as ECMAScript prints it."""
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    digits = repr(x)
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        digits = f"{Decimal(digits):f}"
        return digits.removesuffix(".0") if x else "0"
    mantissa, _, power = digits.partition("e")
    return f"{mantissa}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def canonical(x: object) -> str:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, int | float):
        return canonical_number(x)
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in keys) + "}"


def _fits(x: object, kind: object) -> bool:
    number = isinstance(x, int | float) and not isinstance(x, bool)
    if kind in ("number", "integer"):
        return number and (kind == "number" or isinstance(x, int) or x.is_integer())
    return isinstance(kind, str) and kind in _TYPES and isinstance(x, _TYPES[kind])


def violations(x: object, schema: object, at: str = "$") -> list[str]:
    """What in x breaks schema, as paths and rules.

    A type may be a name or a list of names; nothing is of an unknown type.  The schema true (or null) allows everything
    and false nothing.  Bounds that are no numbers, and rules of another shape than theirs, are passed over.
    """
    if not isinstance(schema, dict):
        return [f"{at}: not allowed"] if schema is False else []
    out: list[str] = []
    of = lambda key, kind, missing: schema[key] if isinstance(schema.get(key), kind) and not isinstance(schema.get(key), bool) else missing
    if kind := schema.get("type"):
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(_fits(x, k) for k in kinds):
            return [f"{at}: not {' or '.join(map(str, kinds))}"]
    if "enum" in schema and x not in of("enum", list, [x]):
        out.append(f"{at}: not in enum")
    if isinstance(x, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(x) < of("minLength", int | float, 0)), ("maxLength", len(x) > of("maxLength", int | float, len(x)))) if bad]
    elif isinstance(x, int | float) and not isinstance(x, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", x < of("minimum", int | float, x)), ("maximum", x > of("maximum", int | float, x))) if bad]
    elif isinstance(x, list) and "items" in schema:
        for i, y in enumerate(x):
            out += violations(y, schema["items"], f"{at}[{i}]")
    elif isinstance(x, dict):
        known = of("properties", dict, {})
        out += [f"{at}.{k}: missing" for k in of("required", list, []) if isinstance(k, str) and k not in x]
        for k in x:
            if k in known:
                out += violations(x[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(more := schema.get("additionalProperties"), dict):
                out += violations(x[k], more, f"{at}.{k}")
    return out


def too_deep(x: object, most: int = MAX_DEPTH) -> bool:
    level = [x]
    for _ in range(most):
        level = [y for z in level if isinstance(z, dict | list) for y in (z.values() if isinstance(z, dict) else z)]
        if not level:
            return False
    return any(isinstance(z, dict | list) for z in level)


def parsed(text: str | None) -> tuple[dict | None, str | None]:
    """The object that text holds, if it can be checked against a schema, and why it cannot be written again, if so."""
    value = None
    try:
        value = json.loads(text) if text is not None else None
        if not isinstance(value, dict):
            return None, "$: no object"
        if too_deep(value):
            return None, "$: too deep"
        canonical(value).encode()
    except RecursionError:
        return None, "$: too deep"
    except UnicodeEncodeError:
        return None, "$: not Unicode"
    except json.JSONDecodeError:
        return None, "$: no object"
    except (OverflowError, ValueError):
        return value, "$: not a JSON number"
    return value, None


def _checked(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors, texts = [], []
        for r in batch.select(["call_id", "name", "arguments", "content"]).to_pylist():
            found, value = [], None
            if r["name"] is not None or r["arguments"] is not None:
                value, why = parsed(r["arguments"])
                if value is not None:
                    found = violations(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no schema"]
                if why:
                    value, found = None, [*found, why]
            texts.append(canonical({"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["content"]}))
            errors.append(found)
        keep_ = [c for c in batch.schema.names if c not in ("arguments", "content")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep_), pa.array(map(len, errors), pa.int64()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*keep_, "n_errors", "errors", "canonical"])


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null on or behind a cycle), n_missing of calls with distinct ids (conv_id, call_id, after)."""
    turn = next((F.col(c) for c in ("call_turn", "turn") if c in calls.columns), F.lit(0))
    nodes = keep(calls.select("conv_id", "call_id", turn.alias("turn"), F.array_distinct(F.filter(F.coalesce("after", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("after")))
    wanted = nodes.select("conv_id", "call_id", F.explode("after").alias("used"))
    here = nodes.select("conv_id", F.col("call_id").alias("used"), F.lit(True).alias("there"))
    edges = keep(wanted.join(here, ["conv_id", "used"], "left"))
    missing = edges.where(F.col("there").isNull()).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_missing"))
    edges = edges.where("there")
    sized = keep(nodes.join(edges.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n_calls")))
    few, many = sized.where(F.col("n_calls") <= MAX_GROUP).select("conv_id"), sized.where(F.col("n_calls") > MAX_GROUP).select("conv_id")
    # nothing waits in the other conversations
    out = nodes.join(sized, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    id_type = nodes.schema["conv_id"].dataType.simpleString()
    inner = nodes.join(few, "conv_id", "left_semi").select("conv_id", "call_id", F.to_json("after").alias("after"))
    out = out.unionByName(inner.groupBy("conv_id").applyInArrow(_leveled, f"conv_id {id_type}, call_id string, level int"))
    if many.limit(1).count():
        out = out.unionByName(_levels_by_blocks(nodes.join(many, "conv_id", "left_semi"), edges.join(many, "conv_id", "left_semi"), MAX_GROUP))
    return out.join(missing, ["conv_id", "call_id"], "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def _leveled(table: pa.Table) -> pa.Table:
    """Levels of the calls of one conversation."""
    ids = table.column("call_id").to_pylist()
    uses = {c: [u for u in json.loads(a)] for c, a in zip(ids, table.column("after").to_pylist(), strict=True)}
    users: dict[str, list[str]] = {}
    waits = {}
    for c, us in uses.items():
        us = [u for u in us if u in uses]
        waits[c] = len(us)
        for u in us:
            users.setdefault(u, []).append(c)
    level, ready = {}, [c for c, n in waits.items() if not n]
    for c in ready:
        level.setdefault(c, 0)
    while ready:
        after = []
        for u in ready:
            for c in users.get(u, ()):
                waits[c] -= 1
                level[c] = max(level.get(c, 0), level[u] + 1)
                if not waits[c]:
                    after.append(c)
        ready = after
    return pa.table({"conv_id": table.column("conv_id"), "call_id": table.column("call_id"), "level": pa.array([level[c] if not waits[c] else None for c in ids], pa.int32())})


def _block_levels(table: pa.Table) -> pa.Table:
    """Levels of those calls of one block that wait only for calls of the block, or for calls whose levels are known."""
    ids, uses = table.column("call_id").to_pylist(), table.column("inside").to_pylist()
    waits = {c: len(us or ()) + (n > 0) for c, us, n in zip(ids, uses, table.column("n_open").to_pylist(), strict=True)}
    level = {c: b + 1 for c, b in zip(ids, table.column("base").to_pylist(), strict=True)}
    users: dict[str, list[str]] = {}
    for c, us in zip(ids, uses, strict=True):
        for u in us or ():
            users.setdefault(u, []).append(c)
    ready = [c for c in ids if not waits[c]]
    for u in ready:  # grows as calls become ready
        for c in users.get(u, ()):
            waits[c] -= 1
            level[c] = max(level[c], level[u] + 1)
            if not waits[c]:
                ready.append(c)
    done = [not waits[c] for c in ids]
    return pa.table({"conv_id": table.column("conv_id"), "call_id": table.column("call_id"), "level": pa.array([level[c] for c in ids], pa.int32())}).filter(pa.array(done, pa.bool_()))


def _levels_by_blocks(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Levels of conversations too large for one task: blocks of calls in order of turn, each levelled by a task as far as what it waits for is known.

    A round levels at least the first block that is open wherever calls use earlier turns, so rounds follow the number of blocks and not
    the length of chains; a round that levels nothing leaves cycles only.
    """
    put = lambda df: stored(df, "levels")
    id_type = nodes.schema["conv_id"].dataType.simpleString()
    placed = numbered(nodes.select("conv_id", "call_id", F.struct("turn", "call_id").alias("by")), "conv_id", "by")
    waiting = put(placed.select("conv_id", "call_id", F.floor((F.col("place") - 1) / size).alias("block")))
    of = lambda x: waiting.select("conv_id", F.col("call_id").alias(x), F.col("block").alias(f"{x}_block"))
    edges = put(edges.select("conv_id", "call_id", "used").join(of("call_id"), ["conv_id", "call_id"]).join(of("used"), ["conv_id", "used"]))
    known = keep(nodes.sparkSession.createDataFrame([], f"conv_id {id_type}, call_id string, level int"))
    while True:
        seen = edges.join(known.select("conv_id", F.col("call_id").alias("used"), "level"), ["conv_id", "used"], "left")
        own = F.col("call_id_block") == F.col("used_block")
        found = seen.groupBy("conv_id", "call_id").agg(
            F.max("level").alias("base"), F.count_if(F.col("level").isNull() & ~own).alias("n_open"), F.collect_list(F.when(F.col("level").isNull() & own, F.col("used"))).alias("inside")
        )
        rows = waiting.join(found, ["conv_id", "call_id"], "left").withColumns({"base": F.coalesce("base", F.lit(-1)), "n_open": F.coalesce("n_open", F.lit(0))})
        new = put(rows.groupBy("conv_id", "block").applyInArrow(_block_levels, f"conv_id {id_type}, call_id string, level int"))
        if not new.limit(1).count():
            return known.unionByName(waiting.select("conv_id", "call_id", F.lit(None).cast("int").alias("level")))
        known, waiting = put(known.unionByName(new)), put(waiting.join(new, ["conv_id", "call_id"], "left_anti"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, name, call_turn, result_turn, level, n_calls, n_results, n_missing, status, n_errors, errors, canonical."""
    calls = calls.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", "after")
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("call_turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls")
    one = keep(one)
    told = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "content")).alias("r"), F.count("*").alias("n_results")).select("conv_id", "call_id", "r.*", "n_results")
    joined = one.join(told.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(levels(one), ["conv_id", "call_id"], "left")
    status = F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    rows = joined.select("conv_id", "call_id", "name", "call_turn", "result_turn", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), status.alias("status"), "arguments", "content")
    alone = calls.where(~named).select("conv_id", "call_id", "name", "call_turn", F.lit(1).alias("n_calls"), "arguments").unionByName(results.where(~named).select("conv_id", "call_id", "result_turn", F.lit(1).alias("n_results"), "content"), allowMissingColumns=True)
    alone = alone.withColumns({"status": F.lit("no_id"), "n_calls": F.coalesce("n_calls", F.lit(0)), "n_results": F.coalesce("n_results", F.lit(0)), "n_missing": F.lit(0), "level": F.lit(None).cast("int")})
    rows = rows.unionByName(alone).withColumns({c: F.col(c).cast("long") for c in ("n_calls", "n_results", "n_missing")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("arguments", "content"))
    return rows.mapInArrow(lambda b: _checked(b, schemas), f"{schema}, n_errors long, errors array<string>, canonical string")


#: The tools that plain conversations are read as: a system text configures, a user text asks for the reply that follows.
TURN_SCHEMAS = {
    "configure": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False},
    "reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False},
}


def calls_of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of rows (conv_id, turn, role, text): each system and user text a call, using the two turns before; each assistant text the result of the turn before."""
    call_id = lambda back: F.concat_ws(":", F.when(F.col("turn").isNotNull(), F.col("conv_id").cast("string")), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = messages.where(F.col("role").isin("system", "user"))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("text", "turn")))
    calls = calls.select("conv_id", F.when(known, call_id(0)).alias("call_id"), "turn", F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"), arguments.alias("arguments"), F.filter(F.array(F.when(known & (F.col("turn") >= 1), call_id(1)), F.when(known & (F.col("turn") >= 2), call_id(2))), lambda x: x.isNotNull()).alias("after"))
    results = messages.where(F.col("role") == "assistant").select("conv_id", F.when(known, call_id(1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
