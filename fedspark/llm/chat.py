"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Turns of a conversation that are rendered into one row; longer conversations go on in further rows.
BLOCK_TURNS = 256


def rotate_perspectives(messages: DataFrame, block_turns: int | None = BLOCK_TURNS) -> DataFrame:
    """Renders every conversation of messages (conv_id, turn, role, text) once for each of its participants.

    The participant's own messages are the assistant's, those of others a named user's, and those of the role system
    stay the system's. Each message becomes `<|im_start|>header\\ntext<|im_end|>\\n`. Returns for each conversation,
    participant and block of turns: n_messages, rendered, and mask: where the participant's texts stand in rendered, as
    start:end in code points, joined by commas; only there a loss is taken. Long conversations are cut by turn number
    into blocks, so that no task gathers a whole one; later blocks don't repeat the system's turns. With block_turns None each
    conversation is one block. Texts stand as they are, marks like <|im_end|> in them included: the mask says what is text. A null role is the participant "unknown", a null text is empty, a
    null turn stands in a block -1 of its own, before all others, ties in turn are ordered by role and text, rows equal
    in all four columns are one message, and a null conv_id is a conversation of its own. A conversation with system messages only has no
    participant and gives no row; an empty table gives an empty one; other columns aren't read.
    """
    base = messages.select(
        messages["conv_id"].cast("long").alias("conv_id"),
        messages["turn"].cast("long").alias("turn"),
        F.coalesce(messages["role"].cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(messages["text"].cast("string"), F.lit("")).alias("text"),
    ).distinct()
    at = F.floor(F.col("turn") / block_turns) if block_turns else F.when(F.col("turn").isNotNull(), 0)
    base = base.withColumn("block", F.coalesce(at, F.lit(-1)).cast("long"))
    speakers = base.filter(F.col("role") != "system").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    blocks = base.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = lambda m, who: F.concat(
        F.lit("<|im_start|>"), F.when(m["role"] == "system", F.lit("system")).when(m["role"] == who, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["role"])), F.lit("\n")
    )
    end = "<|im_end|>\n"
    segments = F.transform("turns", lambda m: F.struct(head(m, F.col("speaker")).alias("head"), m["text"].alias("text"), (m["role"] == F.col("speaker")).alias("own")))
    rendered = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["text"], F.lit(end))), "")
    step = lambda acc, s: F.struct(
        F.when(
            s["own"],
            F.concat(acc["spans"], F.array(F.concat((acc["at"] + F.char_length(s["head"])).cast("string"), F.lit(":"), (acc["at"] + F.char_length(s["head"]) + F.char_length(s["text"])).cast("string")))),
        ).otherwise(acc["spans"]).alias("spans"),
        (acc["at"] + F.char_length(s["head"]) + F.char_length(s["text"]) + len(end)).alias("at"),
    )
    spans = F.aggregate("segments", F.struct(F.expr("cast(array() as array<string>)").alias("spans"), F.lit(0).alias("at")), step, lambda acc: acc["spans"])
    return both.withColumn("segments", segments).select(
        "conv_id", "speaker", "block", F.size("turns").cast("long").alias("n_messages"), rendered.alias("rendered"), F.array_join(spans, ",").alias("mask")
    )


def op7_chat(spark, sf_dir):
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP7_SQL = f"""
with base as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         coalesce(cast(floor(turn / {BLOCK_TURNS}.0) as bigint), -1) as block
  from conversations),
speakers as (select distinct conv_id, role as speaker from base where role <> 'system'),
lines as (
  select b.conv_id, s.speaker, b.block, b.turn, b.role, b.text, b.role = s.speaker as own,
         '<|im_start|>' || case when b.role = 'system' then 'system' when b.role = s.speaker then 'assistant' else 'user name=' || b.role end || chr(10) as head
  from base b join speakers s on b.conv_id is not distinct from s.conv_id),
placed as (
  select *, row_number() over w as k,
         sum(length(head) + length(text) + 11) over w - length(text) - 11 as pos
  from lines window w as (partition by conv_id, speaker, block order by turn nulls first, role, text rows unbounded preceding))
select conv_id, speaker, block, count(*) as n_messages,
       string_agg(head || text || '<|im_end|>' || chr(10), '' order by k) as rendered,
       coalesce(string_agg(cast(pos as varchar) || ':' || cast(pos + length(text) as varchar), ',' order by k) filter (where own), '') as mask
from placed group by conv_id, speaker, block
"""
