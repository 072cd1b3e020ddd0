"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is JSON of unknown layout. Its nested field paths, taken from the value itself and stripped
of types, are hashed; the hash selects a declarative mapping, which is a set of SQL expressions that
turn the record into canonical turns ``array<struct<turn, role, text>>``. Records of flat tables (one row a
turn) use the same way and are gathered by conversation.

The template is ``<|turn|>role<|text|>text<|end|>`` per turn. A control string inside a role or text
gets one backslash after its first character, and one more for each that it has already, so
that removing one backslash restores it: escaping and unescaping are inverse on every string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of others in wide use, as what follows their first character.
TAILS = r"(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE = rf"([<\[])(\\*){TAILS}"
UNESCAPE = rf"([<\[])\\(\\*){TAILS}"
#: Turns of one conversation that a first pass joins; the second pass joins the pieces.
PIECE = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


@dataclass(frozen=True)
class Layout:
    """``paths``: a sample of the nested field paths, as ``paths_of`` writes them. ``turns``: a SQL expression
    over the variant ``v`` that gives array<struct<turn bigint, role string, text string>>."""

    name: str
    paths: str
    turns: str


def paths_of(v: str) -> str:
    """SQL for the nested field paths of variant ``v`` without the types of their leaves."""
    return f"regexp_replace(schema_of_variant({v}), ': (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|FLOAT|BINARY|DECIMAL[(][^)]*[)])', '')"


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _fixed(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})" for i, (role, text) in enumerate(pairs))
    return f"array({items})"


def _listed(path: str, role: str, text: str, named: str = "x.r") -> str:
    items = f"from_json(to_json(try_variant_get(v, '$.{path}', 'variant')), 'array<struct<`{role}` string, `{text}` string>>')"
    return f"transform({items}, (y, i) -> element_at(transform(array(named_struct('r', y.`{role}`)), x -> named_struct('turn', cast(i as bigint), 'role', {named}, 'text', y.`{text}`)), 1))"


_NAMES = "CASE x.r WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.r END"
#: Mappings by layout. Objects list their keys in alphabetical order, as variants do.
LAYOUTS = (
    Layout("turn_row", "OBJECT<role, text, turn>", f"array(named_struct('turn', {_get('turn', 'bigint')}, 'role', {_get('role')}, 'text', {_get('text')}))"),
    Layout("prompt_completion", "OBJECT<completion, prompt>", _fixed(("user", _get("prompt")), ("assistant", _get("completion")))),
    Layout("prompt_response", "OBJECT<prompt, response>", _fixed(("user", _get("prompt")), ("assistant", _get("response")))),
    Layout("question_answer", "OBJECT<answer, question>", _fixed(("user", _get("question")), ("assistant", _get("answer")))),
    Layout("instruction_output", "OBJECT<instruction, output>", _fixed(("user", _get("instruction")), ("assistant", _get("output")))),
    Layout("instruction_input_output", "OBJECT<input, instruction, output>",
           _fixed(("user", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("assistant", _get("output")))),
    Layout("system_prompt_response", "OBJECT<prompt, response, system>", _fixed(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("response")))),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _listed("messages", "role", "content")),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _listed("conversations", "from", "value", _NAMES)),
    Layout("system_messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>, system>",
           f"concat(array(named_struct('turn', -1L, 'role', 'system', 'text', {_get('system')})), {_listed('messages', 'role', 'content')})"),
)


def canonical_turns(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null: unknown, or not JSON) and ``turns`` (null with it) to ``records``."""
    known = {x.name: x for x in layouts}
    df = records.withColumn("v", F.try_parse_json(F.col(json_col))).withColumn("fingerprint", F.expr(f"xxhash64({paths_of('v')})"))
    names = "CASE " + " ".join(f"WHEN fingerprint = xxhash64('{x.paths}') THEN '{x.name}'" for x in layouts) + " END"
    turns = "CASE layout " + " ".join(f"WHEN '{n}' THEN {x.turns}" for n, x in known.items()) + " END"
    return df.withColumn("layout", F.when(F.col("v").isNotNull(), F.expr(names))).withColumn("turns", F.expr(turns)).drop("v")


def format_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From rows (conv, turn, role, text) to one row a conversation: conv, formatted, loss_spans, n_turns.

    Turns come in the order of (turn, role, text), nulls first; null roles and texts are empty; repeated rows
    are turns of their own. ``loss_spans`` holds [start, end) in code points of ``formatted`` for each
    assistant text. A null conversation id is one conversation. An empty table gives no rows. Turns
    are escaped and measured where they lie; pieces of turns are joined before the
    conversation is, so the rows that meet at one key are fewer than its turns.
    """
    w = turns.select(
        F.col(conv_col).alias("_conv"), F.col("turn").cast("long").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"),
        escape(F.coalesce("role", F.lit(""))).alias("_r"), escape(F.coalesce("text", F.lit(""))).alias("_t"))
    head = F.concat(F.lit(TURN), "_r", F.lit(TEXT))
    role, text = F.coalesce("_role", F.lit("")), F.coalesce("_text", F.lit(""))
    w = w.select("_conv", F.floor(F.col("_turn") / PIECE).alias("_piece"), "_turn", role.alias("_k1"), text.alias("_k2"), F.concat(head, "_t", F.lit(END)).alias("s"),
                 F.char_length(head).alias("h"), F.char_length("_t").alias("n"), (role == "assistant").alias("loss"))
    # Starts are running totals, of turns in a piece and of pieces in a conversation; no array is built step by step.
    before = lambda by, order: F.coalesce(F.sum(F.char_length("s")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    w = w.withColumn("at", before(["_conv", "_piece"], ["_turn", "_k1", "_k2"]))
    pieces = w.groupBy("_conv", "_piece").agg(F.array_sort(F.collect_list(F.struct("at", "s", "h", "n", "loss"))).alias("_ms"))
    pieces = pieces.select("_conv", "_piece", F.expr("array_join(transform(_ms, m -> m.s), '')").alias("s"), F.size("_ms").alias("k"),
                           F.expr("transform(filter(_ms, m -> m.loss), m -> named_struct('start', m.at + m.h, 'end', m.at + m.h + m.n))").alias("spans"))
    whole = pieces.withColumn("at", before(["_conv"], ["_piece"])).groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("at", "s", "k", "spans"))).alias("_ps"))
    spans = "flatten(transform(_ps, p -> transform(p.spans, x -> named_struct('start', p.at + x.start, 'end', p.at + x.end))))"
    return whole.select(F.col("_conv").alias(conv_col), F.expr("array_join(transform(_ps, p -> p.s), '')").alias("formatted"), F.expr(spans).alias("loss_spans"),
                        F.expr("aggregate(_ps, 0L, (a, p) -> a + p.k)").alias("n_turns"))


def format_chat(records: DataFrame, json_col: str = "record", conv_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Format JSON records of any known layout, several records a conversation or one.

    Records of an unknown layout stay visible: they come back with ``formatted`` null and their
    conversation id, one row a record, so none is lost without a trace.
    """
    mapped = canonical_turns(records.select(F.col(conv_col), F.col(json_col)), json_col, layouts)
    rows = mapped.where("layout is not null").select(conv_col, F.explode("turns").alias("t")).select(conv_col, "t.turn", "t.role", "t.text")
    done = format_turns(rows, conv_col)
    unknown = mapped.where("layout is null").select(conv_col, F.lit(None).cast("string").alias("formatted"),
                                                     F.lit(None).cast(done.schema["loss_spans"].dataType).alias("loss_spans"), F.lit(0).cast("long").alias("n_turns"))
    return done.unionByName(unknown)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` array<struct<role, text>> and ``loss_text``, both read from ``formatted`` alone."""
    parts = r"slice(split(formatted, '<[|]turn[|]>', -1), 2, 1000000000)"
    unesc = lambda x: f"regexp_replace({x}, r'{UNESCAPE}', '$1$2$3')"
    turns = f"transform({parts}, p -> named_struct('role', {unesc(f"substring_index(p, '{TEXT}', 1)")}, 'text', {unesc(f"substring(p, instr(p, '{TEXT}') + {len(TEXT)}, char_length(p) - instr(p, '{TEXT}') - {len(TEXT)} - {len(END)} + 1)")}))"
    loss = f"array_join(transform(loss_spans, s -> {unesc('substring(formatted, s.start + 1, s.end - s.start)')}), '')"
    return formatted.withColumn("turns", F.expr(turns)).withColumn("loss_text", F.expr(loss))
