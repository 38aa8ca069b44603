"""Chat formatting: conversations as one marked string each, by Spark expressions alone.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block whose
texts are parts, so merging loses nothing. A block is ``<|start|>role<|message|>text(<|part|>text)*<|end|>\\n``.
Inside roles and texts a backslash goes before every backslash and after the first character of every control string
(CONTROLS), so no text can open or close a turn; dropping each backslash and keeping the character behind it undoes it.

Rows: null roles and texts are empty. Rows are ordered by turn, then role, then text; null turns come first and rows
with equal turns are all kept. A null conv_id is a conversation of its own. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

START, MESSAGE, PART, END = "<|start|>", "<|message|>", "<|part|>", "<|end|>\n"

#: Strings that a tokenizer or another template may take for control: fixed values.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_conversations(
    rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, formatted and n_blocks, a row for each conversation."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def opens(t: Column, i: Column) -> Column:
        return (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])

    def piece(t: Column, i: Column) -> Column:
        close = F.when(i == 0, F.lit("")).otherwise(F.lit(END))
        head = F.concat(close, F.lit(START), escape(t["role"]), F.lit(MESSAGE))
        return F.concat(F.when(opens(t, i), head).otherwise(F.lit(PART)), escape(t["text"]))

    body = F.array_join(F.transform("turns", piece), "")
    blocks = F.size(F.filter("turns", opens)).cast("long")
    return turns.select("conv_id", F.concat(body, F.lit(END)).alias("formatted"), blocks.alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), the turns as they were before formatting; the loss mask lies on texts of role assistant."""

    def quoted(x: str) -> str:
        return re.sub(r"([^\w\n])", r"\\\1", x)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, MESSAGE, 1))
        body = F.replace(F.substring_index(block, MESSAGE, -1), F.lit(END), F.lit(""))
        return F.transform(F.split(body, quoted(PART)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, quoted(START)), lambda b: b != ""), turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all `conversations` and one made of control strings, formatted and read back; see the module."""
    odd = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    read = format_conversations(rows).withColumn("turns", read_back(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.withColumns({"spoken": spoken, "loss": loss}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def _sql() -> str:
    def esc(x: str) -> str:
        out = f"replace({x}, chr(92), chr(92) || chr(92))"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
        return out

    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length({esc("text")}) + CASE WHEN opens THEN {len(START + MESSAGE + END)} + length({esc("role")}) ELSE {len(PART)} END))::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM o GROUP BY conv_id
"""


ORACLE_SQL = _sql()
