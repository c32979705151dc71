"""Chat formatting by prefix-target expansion, in SQL expressions only.

A turn is written <|role|>, newline, text, <|end|>, newline. Inside roles and texts &, <, > and [ are written as
entities, so that no text can hold a control string of this or of a bracketed template, and reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import table

#: In the order of escaping; unescaping goes backwards.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsqb;"))
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row an example: conv_id, n_turns, example (from 0), context, target, after.

    Every assistant turn is an example: context holds all turns before it and the reply's header, target the reply, the
    only part that is trained on, after its end mark. The turns behind the last reply, or all turns of a conversation
    without reply, close the conversation's last row: there they follow the end mark in after, or stand in context with
    a null target. So context || target || after of the last row is the whole conversation.

    turns: conv_id, turn, role, text. Null roles and texts are empty. Turns are ordered by turn (nulls first), ties by
    role, then text; repeated rows are turns of their own. A row without conv_id is a conversation of its own. Empty
    table: empty result. One conversation must fit a task; its examples are made one by one and never stand together.
    """
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.monotonically_increasing_id()))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", own.alias("lone"), one.alias("t")).groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"), escape(t["text"]), F.lit(END))
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    ready = talks.select("conv_id", "lone", F.size("turns").cast("long").alias("n_turns"), "turns", F.transform("turns", whole).alias("parts"), places.alias("places"))
    each = ready.select("*", F.posexplode(F.when(F.size("places") == 0, F.array(F.lit(-1))).otherwise(F.col("places"))).alias("example", "at"))
    last = F.col("example") >= F.size("places") - 1
    upto = lambda start, n: F.array_join(F.slice("parts", start, n), "")
    reply = F.col("at") >= 0
    context = F.when(reply, F.concat(upto(1, F.greatest(F.col("at"), F.lit(0))), F.lit("<|assistant|>\n"))).otherwise(upto(1, F.size("parts")))
    after = F.when(reply, F.concat(F.lit(END), F.when(last, upto(F.col("at") + 2, F.size("parts"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    return each.select("conv_id", "lone", "n_turns", "example", context.alias("context"), F.when(reply, escape(F.get("turns", F.col("at"))["text"])).alias("target"), after.alias("after"))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted rows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text = F.concat("context", F.coalesce("target", F.lit("")), "after")
    found = examples.groupBy("conv_id", "lone").agg(F.max_by(text, "example").alias("whole"), F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("replies"), F.sum(F.length(text)).alias("formatted_chars"))
    parts = F.slice(F.split("whole", r"<\|end\|>\n"), 1, F.greatest(F.lit(0), F.size(F.split("whole", r"<\|end\|>\n")) - 1))
    role = lambda p: F.substr(p, F.lit(3), F.instr(p, "|>\n") - 3)
    body = lambda p: F.substr(p, F.instr(p, "|>\n") + 3, F.length(p))
    read = F.array_join(F.transform(F.col("parts"), lambda p: F.concat(unescape(role(p)), F.lit("\n"), unescape(body(p)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("replies", lambda r: unescape(r["target"])), "")
    return found.withColumn("parts", parts).select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(format_conversations(rows.unionByName(more)))


SQL = {
    "op9_chat": r"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER o AS pos, sum(2 + len(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;')) + 3
         + len(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;')) + 8) OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
      FROM t WINDOW o AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, CASE WHEN pos = max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id, lone) THEN max(upto) OVER (PARTITION BY conv_id, lone) WHEN role = 'assistant' THEN upto END AS chars,
         max(upto) OVER (PARTITION BY conv_id, lone) AS everything FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(chars), max(everything)) AS BIGINT) AS formatted_chars
FROM q GROUP BY conv_id, lone""",
}
