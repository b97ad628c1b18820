"""Chat formatting by schema fingerprints.

A record is JSON of unknown layout.  Its nested field paths ("messages[].role"),
sorted and hashed, are its fingerprint.  A fingerprint selects the first
declarative mapping, in the order of ``MAPPINGS``, whose required paths the record
has; whatever other fields it has doesn't matter.  The mapping says where turns,
roles and texts lie.  Records become canonical turns: (turn, role, text) with the
roles system, user, assistant and tool, turns numbered from 0 without gaps.  A
field ``system`` is a turn before the others.  A text given as a list of parts is
the texts of its parts, joined.

Fingerprints need Python (one pass that gives a number and a mapping for each
record); the conversion itself is Spark SQL built from the mapping.

Defined results: turns with null or empty text are dropped (a turn of blanks is
kept as it is); unknown roles become user; a null, empty, unparsable or too
deeply nested record, or one that no mapping fits, gives no turns and is listed by
``unmapped``; fields that the mapping doesn't name are ignored; very long texts are
kept whole; a null identifier is kept; identifiers keep their type; repeated
records give their turns each time; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Layout: list of turns ("each", "role", "text"), or fixed fields in order with their roles ("fields"), or bare texts that alternate ("texts").
MAPPINGS: dict[str, dict] = {
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "conversations": {"each": "conversations", "role": "from", "text": "value"},
    "dialogue": {"each": "dialogue", "role": "speaker", "text": "utterance"},
    "turns": {"each": "turns", "role": "role", "text": "text"},
    "instruction": {"fields": [("instruction", "user"), ("input", "user"), ("output", "assistant")], "optional": ["input"]},
    "prompt_response": {"fields": [("prompt", "user"), ("response", "assistant")]},
    "prompt_completion": {"fields": [("prompt", "user"), ("completion", "assistant")]},
    "question_answer": {"fields": [("question", "user"), ("answer", "assistant")]},
    "utterances": {"texts": "utterances"},
    "single": {"fields": [("text", "user")]},
}
HEAD = "system"
ROLES = {"human": "user", "user": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "chatgpt": "assistant", "system": "system", "tool": "tool", "function": "tool"}


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; [] stands for the items of a list."""
    if isinstance(value, dict):
        return set().union({at} if at else set(), *(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return {at, f"{at}[]"}.union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def required(mapping: dict) -> frozenset[str]:
    """The paths a record must have for a mapping."""
    if "each" in mapping:
        return frozenset(f"{mapping['each']}[].{mapping[x]}" for x in ("role", "text"))
    if "texts" in mapping:
        return frozenset([f"{mapping['texts']}[]"])
    return frozenset({f for f, _ in mapping["fields"]} - set(mapping.get("optional", [])))


def fingerprint(found: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found))) - (1 << 63)


def choice(found: set[str], mappings: dict) -> str | None:
    return next((name for name, mapping in mappings.items() if required(mapping) <= found), None)


def fingerprint_batches(mappings: dict):
    """(row, fingerprint, mapping) of rows (row, record)."""

    def run(batches):
        known: dict[frozenset, tuple] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    found = frozenset(paths(json.loads(text)))
                except (TypeError, ValueError, RecursionError):
                    out.append((None, None))
                    continue
                if found not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[found] = (fingerprint(found), choice(found, mappings))
                out.append(known[found])
            prints, names = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(names, pa.string())], names=["id", "record", "fingerprint", "layout"])

    return run


def turn(role: Column, text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.struct(F.coalesce(F.try_element_at(known, F.lower(F.trim(role))), F.lit("user")).alias("role"), text.alias("text"))


def part_text(part: Column) -> Column:
    """The text of a part: a string, or an object with a text; other objects have none."""
    return F.when(part.startswith("{"), F.coalesce(F.from_json(part, "text string")["text"], F.lit(""))).otherwise(part)


def converted(record: Column, mapping: dict) -> Column:
    """The array of turns that a mapping declares."""
    if "each" in mapping:
        each, role, text = mapping["each"], mapping["role"], mapping["text"]
        items = F.from_json(record, f"`{each}` array<struct<`{role}`: string, `{text}`: string>>")[each]
        lists = F.from_json(record, f"`{each}` array<struct<`{text}`: array<string>>>")[each]
        parts = lambda i: F.get(lists, i)[text]
        return F.transform(items, lambda x, i: turn(x[role], F.when(parts(i).isNotNull(), F.array_join(F.transform(parts(i), part_text), "")).otherwise(x[text])))
    if "texts" in mapping:
        items = F.from_json(record, f"`{mapping['texts']}` array<string>")[mapping["texts"]]
        return F.transform(items, lambda x, i: turn(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), x))
    row = F.from_json(record, ", ".join(f"`{f}` string" for f, _ in mapping["fields"]))
    return F.array(*[turn(F.lit(role), row[f]) for f, role in mapping["fields"]])


def selected(records: DataFrame, id_col: str, record_col: str, mappings: dict) -> DataFrame:
    kind = records.schema[id_col].dataType.simpleString()
    rows = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{record_col}`").alias("record"))
    return rows.mapInArrow(fingerprint_batches(mappings), f"id {kind}, record string, fingerprint long, layout string")


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: dict | None = None) -> DataFrame:
    """(id_col, turn, role, text) of all records that have a mapping."""
    mappings = MAPPINGS if mappings is None else mappings
    record, turns = F.col("record"), None
    for name, mapping in mappings.items():
        hit, value = F.col("layout") == name, converted(record, mapping)
        turns = F.when(hit, value) if turns is None else turns.when(hit, value)
    head = F.when(F.col("layout").isNotNull(), F.array(turn(F.lit("system"), F.from_json(record, f"{HEAD} string")[HEAD])))
    kept = F.filter(F.concat(head, turns), lambda x: x["text"].isNotNull() & (x["text"] != ""))
    out = selected(records, id_col, record_col, mappings).select("id", F.posexplode(kept).alias("turn", "t"))
    return out.select(F.col("id").alias(id_col), F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def unmapped(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: dict | None = None) -> DataFrame:
    """(id_col, fingerprint) of the records without a mapping; unparsable ones have no fingerprint."""
    marked = selected(records, id_col, record_col, MAPPINGS if mappings is None else mappings)
    return marked.where("layout IS NULL").select(F.col("id").alias(id_col), "fingerprint")


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): conversations(conv_id, turn, role, text) as JSON of all layouts; which one depends on the identifier and on what a layout can hold.

    Empty turns stay in.  Every ninth conversation has an unknown record besides, every ninth a broken one.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = conversations.groupBy("conv_id").agg(ordered.alias("t")).withColumn("f", F.filter("t", lambda x: x["text"].isNotNull() & (x["text"] != "")))
    json_of = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    items = lambda role, text, name, of="t": F.transform(of, lambda x: F.struct(x["role"].alias(role), x["text"].alias(text))).alias(name)
    headed = F.coalesce((F.get("f", F.lit(0))["role"] == "system") & (F.get("t", F.lit(0))["role"] == "system"), F.lit(False))
    whole = whole.withColumn("head", F.when(headed, F.get("f", F.lit(0))["text"])).withColumn("core", F.when(headed, F.slice("f", 2, 1 << 30)).otherwise(F.col("f"))).withColumn("rest", F.when(headed & (F.get("t", F.lit(0))["text"] == F.get("f", F.lit(0))["text"]), F.slice("t", 2, 1 << 30)))
    head = F.col("head").alias("system")
    text, role = (lambda i: F.get("core", F.lit(i))["text"]), (lambda i: F.get("core", F.lit(i))["role"])
    pair = (F.size("core") == 2) & (role(0) == "user") & (role(1) == "assistant")
    one = (F.size("core") == 1) & (role(0) == "user")
    turning = F.forall(F.transform("core", lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x) & (F.size("core") > 0)
    parts = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages")
    which, small = F.pmod("conv_id", F.lit(8)), F.pmod("conv_id", F.lit(4))
    record = (
        F.when(pair & (small == 0), json_of(head, text(0).alias("prompt"), text(1).alias("response")))
        .when(pair & (small == 1), json_of(head, text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output"), F.concat(text(0), text(1)).alias("text")))
        .when(pair & (small == 2), json_of(head, text(0).alias("question"), text(1).alias("answer")))
        .when(pair, json_of(head, text(0).alias("prompt"), text(1).alias("completion")))
        .when(one, json_of(head, text(0).alias("text")))
        .when(F.col("rest").isNotNull() & (which < 2), json_of(head, items("from", "value", "conversations", "rest")))
        .when(which < 2, json_of(items("from", "value", "conversations")))
        .when(which == 2, json_of(items("speaker", "utterance", "dialogue")))
        .when(which == 3, json_of(items("role", "text", "turns")))
        .when(turning & (which == 4), json_of(head, F.transform("core", lambda x: x["text"]).alias("utterances")))
        .when(which == 5, json_of(parts))
        .when(which == 6, json_of(F.get("t", F.lit(0))["text"].alias("prompt"), items("role", "content", "messages")))
        .otherwise(json_of(items("role", "content", "messages")))
    )
    more = whole.where("conv_id % 9 < 2").select("conv_id", F.when(F.col("conv_id") % 9 == 0, '{"unknown": [1]}').otherwise('{"broken": ').alias("record"))
    return whole.select("conv_id", record.alias("record")).unionByName(more)


def turns_and_unmapped(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """canonical_turns, and for each record without a mapping a row of role "unmapped" without turn and text."""
    none = unmapped(records, id_col).select(id_col, F.lit(None).cast("long").alias("turn"), F.lit("unmapped").alias("role"), F.lit(None).cast("string").alias("text"))
    return canonical_turns(records, id_col).unionByName(none)


ORACLE_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
       CASE lower(trim(role)) WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'user' END AS role, text
FROM conversations WHERE text IS NOT NULL AND text <> ''
UNION ALL
SELECT DISTINCT conv_id, NULL::BIGINT AS turn, 'unmapped' AS role, NULL AS text FROM conversations WHERE conv_id % 9 < 2
"""
