"""Operator 3, chat formatting by schema fingerprints. DataFrame functions only.

A row's fingerprint is the hash of the sorted nested field paths that it fills (messages[].role, instruction, ...).
It selects one of the declared LAYOUTS, whose expression maps the row to canonical turns: array<struct<role, text>>.
Rows with an unknown fingerprint keep null turns and a null layout, for a new declaration; none is dropped.

Turns are then rendered: START role SEP text END each, with control strings inside roles and texts broken up by
a backslash after their first character (and backslashes doubled), which parse() undoes. The loss mask is
an array of spans (start, length), in code points of the formatted string, over the assistant's texts.

A conversation is one row, so it must fit a task, as its formatted string must. Grouping rows by conversation
moves each text once; equal texts or first turns meet nowhere.

Cases: null role or text is empty; no turns give the empty string and no span; turns of equal number are ordered by role, then
text; repeated rows are turns of their own; a null conversation id is a conversation; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, table

START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escaped inside texts: the template's own strings and those of other common templates.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _messages(field: str, role: str, text: str) -> Callable[[], Column]:
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)) if role == "from" else None
    named = lambda r: F.coalesce(F.try_element_at(names, r), r) if names is not None else r
    return lambda: F.transform(F.col(field), lambda m: F.struct(F.coalesce(named(m[role]), F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _fields(*pairs: tuple[str, str]) -> Callable[[], Column]:
    return lambda: F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("text")) for role, c in pairs))


def _instruction_with_input() -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n", "instruction", "input").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("output").alias("text")))


#: Name, filled field paths, mapping.
LAYOUTS: tuple[tuple[str, tuple[str, ...], Callable[[], Column]], ...] = (
    ("messages", ("messages[].content", "messages[].role"), lambda: _messages("messages", "role", "content")()),
    ("message_texts", ("messages[].role", "messages[].text"), lambda: _messages("messages", "role", "text")()),
    ("from_value", ("conversations[].from", "conversations[].value"), lambda: _messages("conversations", "from", "value")()),
    ("instruction", ("instruction", "output"), _fields(("user", "instruction"), ("assistant", "output"))),
    ("instruction_input", ("input", "instruction", "output"), _instruction_with_input),
    ("prompt_response", ("prompt", "response"), _fields(("user", "prompt"), ("assistant", "response"))),
    ("system_prompt_response", ("prompt", "response", "system"), _fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ("prompt_completion", ("completion", "prompt"), _fields(("user", "prompt"), ("assistant", "completion"))),
    ("question_answer", ("answer", "question"), _fields(("user", "question"), ("assistant", "answer"))),
)
ROOTS = frozenset(re.split(r"[\[.]", p)[0] for _, paths, _ in LAYOUTS for p in paths)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _has(name: str) -> Callable[[Column], Column]:
    return lambda e: e[name].isNotNull()


def _filled(schema: T.StructType, at: Callable[[str], Column], prefix: str = "") -> list[tuple[str, Column]]:
    """Each leaf path with the condition that a row fills it. Paths go into arrays of structs and structs."""
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        path, col = prefix + f.name, at(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [(f"{path}[].{x.name}", F.coalesce(F.exists(col, _has(x.name)), F.lit(False))) for x in f.dataType.elementType.fields]
        elif isinstance(f.dataType, T.StructType):
            out += _filled(f.dataType, lambda n, c=col: c[n], path + ".")
        else:
            out.append((path, col.isNotNull()))
    return out


def fingerprint(df: DataFrame) -> Column:
    """Hash of the filled paths below ROOTS; other columns (ids, sources) don't count."""
    schema = T.StructType([f for f in df.schema.fields if f.name in ROOTS])
    paths = sorted(_filled(schema, lambda n: F.col(f"`{n}`")), key=lambda p: p[0])
    return F.sha2(F.concat_ws("\n", *(F.when(there, F.lit(p)) for p, there in paths)), 256)


def canonical(df: DataFrame) -> DataFrame:
    """df with layout (its name or null) and turns; columns of these names are replaced."""
    there = {p for p, _ in _filled(T.StructType([f for f in df.schema.fields if f.name in ROOTS]), lambda n: F.col(f"`{n}`"))}
    out = df.withColumn("__print", fingerprint(df))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, paths, mapping in LAYOUTS:
        if there >= set(paths):
            hit = F.col("__print") == fingerprint_of(paths)
            layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, mapping()).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns}).drop("__print")


def escape(c: Column) -> Column:
    by_first: dict[str, list[str]] = {}
    for x in CONTROL:
        by_first.setdefault(x[0], []).append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", x[1:]))
    pattern = "|".join(rf"\{a}(?=(?:{'|'.join(rest)}))" for a, rest in by_first.items())
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), f"({pattern})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame) -> DataFrame:
    """df with formatted and loss_spans, from its column turns."""
    safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == LEARNED).alias("learned")))
    out = df.withColumn("__safe", F.coalesce(safe, F.array().cast("array<struct<role:string,text:string,learned:boolean>>")))
    # Positions: each turn's head and text lengths, summed up in turn order.
    head = lambda t: F.char_length(t["role"]) + len(START + SEP)
    placed = running(
        F.col("__safe"),
        lambda t: head(t) + F.char_length(t["text"]) + len(END),
        lambda t, at: F.struct((at.cast("int") + head(t)).alias("start"), F.char_length(t["text"]).alias("length"), t["learned"].alias("learned")),
        "struct<start:int,length:int,learned:boolean>",
    )
    spans = F.transform(F.filter(placed, lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    text = F.array_join(F.transform("__safe", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")
    return out.withColumns({"formatted": text, "loss_spans": spans}).drop("__safe")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    quoted = lambda x: re.sub(r"([^A-Za-z0-9_])", r"\\\1", x)
    bodies = F.split(formatted, quoted(END))
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)  # what follows the last END is empty
    return F.transform(
        F.transform(bodies, lambda b: F.split(F.substring(b, len(START) + 1, 2**31 - 1), quoted(SEP), 2)),
        lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")),
    )


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def by_conversation(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records in the layout "messages"."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = rows.select("conv_id", F.struct("turn", text("role"), text("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    out = format_turns(canonical(by_conversation(rows))).select("conv_id", "formatted", "loss_spans")
    back = out.withColumns({"turns": parse(F.col("formatted")), "learned": learned_text(F.col("formatted"), F.col("loss_spans"))})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    escaped = "replace(t, chr(92), chr(92) || chr(92))"
    by_first: dict[str, list[str]] = {}
    for x in CONTROL:
        by_first.setdefault(x[0], []).append(x)
    # The oracle's pattern language lacks look-ahead; no control string overlaps another or itself, so plain replacement does the same.
    for x in CONTROL:
        escaped = f"replace({escaped}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
    frame = len(START + SEP + END)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum({frame} + length({escaped.replace('(t,', '(role,')}) + length({escaped})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


OP3_SQL = _oracle()
