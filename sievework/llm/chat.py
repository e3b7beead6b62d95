"""Chat formatting by prefix-target expansion: each assistant turn becomes an example of its own, with
all preceding turns of the conversation as context, and only that reply trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _rendered() -> Column:
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))


def expand(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, example, context_turns, prompt, completion, train_from, train_to) for each assistant turn.

    prompt is the rendered context with the header of the reply, completion the reply and its end mark; in the
    text prompt || completion, characters train_from (0-based) to train_to - 1 are trainable. Turns are ordered by turn, then role, then
    text, nulls first; example counts a conversation's examples from 0. The assistant is found by the
    trimmed, lower-cased role. A null role is rendered as user, a null text as empty; an assistant turn with a null or empty
    text is context but no example. Rows with a null conv_id belong to no conversation and are
    left out. Rows that are repeated are turns of their own. Very long texts are whole; the context of a reply is one string, so a conversation must fit in a task. The marks
    inside a role or text are kept as they are: who trains on prompt || completion must escape them before if texts may hold them. An empty table gives an empty
    result. Other columns are not read.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reply = (F.lower(F.trim("role")) == "assistant") & (F.length("text") > 0)
    seen = turns.withColumns({"context": F.collect_list(_rendered()).over(before), "reply": F.coalesce(reply, F.lit(False)), "example": F.count(F.when(reply, 1)).over(before)})
    prompt = F.concat(F.concat_ws("", "context"), F.lit(f"{OPEN}assistant\n"))
    shown = seen.where("reply").select("conv_id", "turn", "example", F.size("context").cast("long").alias("context_turns"), prompt.alias("prompt"), F.concat("text", F.lit(CLOSE)).alias("completion"))
    return shown.withColumns({"train_from": F.length("prompt").cast("long"), "train_to": (F.length("prompt") + F.length("completion")).cast("long")})


_CLOSE_SQL = CLOSE.replace("\n", "' || chr(10) || '")
SQL = f"""
with t as (
  select conv_id, turn, text, coalesce(lower(trim(role)) = 'assistant' and length(text) > 0, false) reply,
    '{OPEN}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '{_CLOSE_SQL}' r,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) k
  from conversations where conv_id is not null),
e as (
  select conv_id, turn, text, reply, k - 1 context_turns, count(case when reply then 1 end) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding) example,
    coalesce(string_agg(r, '') over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), '') || '{OPEN}assistant' || chr(10) prompt, text || '{_CLOSE_SQL}' completion from t)
select conv_id, turn, example, context_turns, prompt, completion, cast(length(prompt) as bigint) train_from, cast(length(prompt) + length(completion) as bigint) train_to from e where reply
"""


def op3_prefix_target_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(spark, read(spark, sf_dir, "conversations"))
