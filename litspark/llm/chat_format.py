"""Chat formatting as relational formatting, in DataFrame functions only.

A conversation's turns are collected as structs and sorted by turn (null first; ties by role, then text); adjacent turns of
one role are merged by an array aggregation; the runs are concatenated under a template of four control strings:

    open role body text [again text ...] close

``again`` stands between the merged turns of a run, so that reading gives every turn back.  A control string inside a role
or text is escaped by a backslash after its first character, before any that are there; reading takes one away.  Other
backslashes stay as they are.  The loss mask lists the spans (start and length, in characters of the part) of the texts
of the trained role; marks are never in it.

Turns are collected in cells of CELL consecutive turn numbers and cut into parts of at most CELL turns, so a conversation
with many turns is sorted, merged and escaped by many tasks, and no array grows with it; a part starts or ends inside a run
where its neighbours' roles say so.  Only ``joined`` and the digest, whose values are one string a conversation, hold a
whole conversation in one row; such a string cannot exceed 2 GB.

Results: null role or text is empty; rows without conv_id are left out; repeated rows are turns of their own; an empty text
gives an empty span; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 64  # a power of two
SHIFT = CELL.bit_length() - 1


class Template(NamedTuple):
    """Control strings; each is unlike the others, and its first character occurs in none of them again."""

    open: str = "[INST]"
    body: str = "[/INST]"
    again: str = "<s>"
    close: str = "</s>"

    def checked(self) -> Template:
        firsts = {c[:1] for c in self}
        if len(set(self)) < 4 or any(len(c) < 2 or c[1] == "\\" or firsts & set(c[1:]) for c in self) or "\\" in firsts:
            raise ValueError("control strings must differ, and the first character of each must occur only there")
        return self

    def pattern(self, least: str) -> str:
        """First characters of control strings, and what follows them after ``least`` backslashes."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self}))
        return f"([{firsts}]){least}(\\\\*(?:{'|'.join(re.escape(c[1:]) for c in self)}))"


INST = Template()
CHATML = Template("<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>")


def escape(text: Column, template: Template = INST) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern("")), F.lit("$1\\\\$2"))


def unescape(text: Column, template: Template = INST) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern("\\\\")), F.lit("$1$2"))


def _merged(turns: Column) -> Column:
    """Runs (role, texts) of adjacent turns of one role."""
    last = lambda runs: F.element_at(runs, -1)

    def add(runs, turn):
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1)).role == turn.role)
        longer = F.struct(turn.role.alias("role"), F.concat(last(runs).texts, F.array(turn.text)).alias("texts"))
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts")))))

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)"), add)


def format_conversations(conversations: DataFrame, template: Template = INST, trained: str = "assistant") -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, part (from 1), text, loss: array of (start, length), offset
    (characters of the parts before)."""
    template.checked()
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    cells = rows.groupBy("conv_id", F.shiftright("turn", SHIFT).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    slices = F.transform(F.sequence(F.lit(0), F.size("turns") - 1, F.lit(CELL)), lambda i: F.slice("turns", i + 1, F.lit(CELL)))
    parts = cells.select("conv_id", "cell", F.posexplode(slices).alias("sub", "turns"))

    order = Window.partitionBy("conv_id").orderBy(F.col("cell").asc_nulls_first(), "sub")
    first, last = F.element_at("turns", 1).role, F.element_at("turns", -1).role
    parts = parts.withColumn("before", F.lag(last).over(order)).withColumn("after", F.lead(first).over(order)).withColumn("part", F.row_number().over(order))
    parts = parts.withColumn("last", last).withColumn("runs", _merged(F.col("turns")))

    def opening(role, i):
        mark = F.concat(F.lit(template.open), escape(role, template), F.lit(template.body))
        continued = (i == 0) & F.coalesce(F.col("before") == role, F.lit(False))
        return F.when(continued, F.lit(template.again)).when(i == 0, mark).otherwise(F.concat(F.lit(template.close), mark))

    def pieces(run, i):
        return F.transform(run.texts, lambda t, j: F.struct(
            F.when(j > 0, F.lit(template.again)).otherwise(opening(run.role, i)).alias("mark"), escape(t, template).alias("text"), (run.role == trained).alias("loss")))

    def place(so_far, piece):
        start = so_far.at + F.length(piece.mark)
        span = F.array(F.struct(start.alias("start"), F.length(piece.text).cast("long").alias("length")))
        return F.struct((start + F.length(piece.text)).alias("at"), F.when(piece.loss, F.concat(so_far.spans, span)).otherwise(so_far.spans).alias("spans"))

    parts = parts.withColumn("pieces", F.flatten(F.transform("runs", pieces)))
    end = F.when(F.coalesce(F.col("after") == F.col("last"), F.lit(False)), F.lit("")).otherwise(F.lit(template.close))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p.mark, p.text)), ""), end)
    spans = F.aggregate("pieces", F.expr("struct(cast(0 as bigint) as at, cast(array() as array<struct<start: bigint, length: bigint>>) as spans)"), place).spans
    parts = parts.select("conv_id", "part", text.alias("text"), spans.alias("loss"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def _in_order(value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("part", value))), lambda p: p[value])


def joined(parts: DataFrame) -> DataFrame:
    """conv_id, text, loss: whole conversations, spans in characters of the whole text."""
    shifted = F.transform("loss", lambda s: F.struct((s.start + F.col("offset")).alias("start"), s.length.alias("length")))
    rows = parts.withColumn("loss", shifted).groupBy("conv_id").agg(_in_order("text").alias("texts"), F.flatten(_in_order("loss")).alias("loss"))
    return rows.select("conv_id", F.array_join("texts", "").alias("text"), "loss")


def read_turns(text: Column, template: Template = INST) -> Column:
    """The turns (role, text) that a whole formatted conversation holds."""
    cut = lambda s, mark, n: F.split(s, f"\\Q{mark}\\E", n)
    runs = cut(text, template.close, -1)
    runs = F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), lambda r: cut(r, template.body, 2))
    role = lambda r: unescape(r[0].substr(F.lit(len(template.open) + 1), F.length(r[0])), template)
    return F.flatten(F.transform(runs, lambda r: F.transform(cut(r[1], template.again, -1), lambda t: F.struct(role(r).alias("role"), unescape(t, template).alias("text")))))


def read_loss(template: Template = INST) -> Column:
    """The unescaped text under a part's mask."""
    return F.array_join(F.transform("loss", lambda s: unescape(F.substring("text", (s.start + 1).cast("int"), s.length.cast("int")), template)), "")


def digest(parts: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from text and loss."""
    rows = parts.select("conv_id", "part", "text", read_loss(template).alias("trained"))
    whole = rows.groupBy("conv_id").agg(F.array_join(_in_order("text"), "").alias("text"), F.array_join(_in_order("trained"), "").alias("trained"))
    whole = whole.withColumn("turns", F.transform(read_turns(F.col("text"), template), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(F.array_join("turns", "")).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), sha(F.col("trained")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


def probe(spark) -> DataFrame:
    """Conversation -1: two turns that consist of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same,
    regexp_replace(role, '([\[<])(\\*(?:INST\]|/INST\]|s>|/s>))', '\1\\\2', 'g') AS safe_role, regexp_replace(text, '([\[<])(\\*(?:INST\]|/INST\]|s>|/s>))', '\1\\\2', 'g') AS safe_text
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe_text) + CASE WHEN same THEN 3 ELSE 6 + length(safe_role) + 7 + 4 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
