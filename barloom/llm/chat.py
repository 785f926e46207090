r"""Chat formatting by prefix-target expansion.

A turn is written as ``### <role>: <text> </turn>`` and a line feed. Inside roles and texts the escape sign is a
backslash: it stands before a backslash, before the slash of ``</turn>``, between the signs of ``##`` and, in roles, before a
colon, so that no text can forge a mark and every text comes back unchanged.

``expand`` gives one example per assistant turn: the preceding turns as context and that reply as the only
trainable text. ``mask_start`` and ``mask_end`` are the code points of the reply inside ``formatted``. Turns after the last
reply (or a conversation without one) form a last example without a mask, so nothing is lost. A conversation is
gathered in one row, because a context is the whole of it; an example never holds another conversation.

Defined results: null text is empty, null role is the empty role, null turns come first, ties in turn go by role and text,
repeated rows are turns of their own, rows with null conv_id form one conversation. Other columns are ignored. An empty table
gives no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import table

checks = Checks()

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
TARGET = "assistant"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(x, F.lit("##"), F.lit("#\\#"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(SEP), escape(text), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (1-based), n_turns, formatted, mask_start, mask_end (null where nothing is trainable), is_last."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    df = df.withColumn("_parts", F.transform("_turns", lambda t: F.struct(
        rendered(t["role"], t["text"]).alias("all"), F.length(escape(t["text"])).alias("reply"), (t["role"] == TARGET).alias("train"))))
    n = F.size("_parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.col("_parts")[i - 1]["train"] | (i == n))
    df = df.select("conv_id", "_parts", F.posexplode(ends).alias("example", "n_turns"))
    df = df.withColumn("formatted", F.array_join(F.transform(F.slice("_parts", F.lit(1), F.col("n_turns")), lambda p: p["all"]), ""))
    last = F.col("_parts")[F.col("n_turns") - 1]
    stop = F.length("formatted") - len(CLOSE)
    return df.select("conv_id", (F.col("example") + 1).alias("example"), "n_turns", "formatted",
                     F.when(last["train"], stop - last["reply"]).alias("mask_start"), F.when(last["train"], stop).alias("mask_end"),
                     (F.col("n_turns") == F.size("_parts")).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    marked = F.filter(F.split(formatted, "(?<= </turn>)\n", -1), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(
        unescape(F.regexp_extract(x, r"(?s)^### ((?:[^\\:]|\\.)*+): ", 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)^### (?:[^\\:]|\\.)*+: (.*) </turn>$", 1)).alias("text")))


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold the control strings of a template."""
    said = "\\### Assistant: </turn> ok"
    # two literal rows, taken from the range so that no local data is shipped
    two = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"),
        F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(two)


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) AS lt,
  length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ':', '\:')) AS lr
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(lt + lr + {len(OPEN + SEP + CLOSE)}) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""


@checks.add("op10_chat_formatting", ORACLE)
def op10_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    """Digests read back from the written examples; formatted_chars counts the text of all examples of a conversation."""
    ex = expand(with_probe(table(spark, d, "conversations")))
    reply = unescape(F.substring("formatted", F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")))
    turns = F.when(F.col("is_last"), F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    read = ex.select("conv_id", "example", F.length("formatted").alias("chars"), reply.alias("reply"), turns.alias("turns"),
                     F.when(F.col("is_last"), F.size(read_turns(F.col("formatted")))).alias("n"))
    # examples of a conversation are still together: no second shuffle
    both = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("turns").alias("turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return both.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
