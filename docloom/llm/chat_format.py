"""Chat formatting by relational operations and Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role
become one run. A run is ``<|start|>role<|message|>text<|end|>``, its further texts after
``<|also|>``; a conversation is ``<s>``, its runs, ``</s>``. Inside roles and texts a
backslash is doubled and one is put after the first character of every control string, so
none of these occurs there, and dropping single backslashes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
START, MESSAGE, ALSO, STOP = "<|start|>", "<|message|>", "<|also|>", "<|end|>"
#: Strings of this and of other common templates that no text may bring in.
CONTROL = (BEGIN, END, START, MESSAGE, ALSO, STOP, "[INST]", "[/INST]")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _literal(mark: str) -> str:
    return "".join("\\" + x if x in "<|>/[]" else x for x in mark)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: ``formatted``, and ``segments`` (text, loss), whose texts make up ``formatted``.

    Only conv_id, turn, role and text are read. Null roles and texts count as empty, a null
    turn comes first, equal turns go by role and text, and rows with a null conv_id are one
    conversation. Repeated rows are turns of their own.
    """
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    rows = rows.withColumn("heads", heads)
    rows = rows.withColumn("runs", F.transform("heads", lambda h, k: F.slice("turns", h + 1, F.coalesce(F.get("heads", k + 1), F.size("turns")) - h)))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def run(turns: Column) -> Column:
        role = turns[0]["role"]
        head = segment(F.concat(F.lit(START), escape(role), F.lit(MESSAGE)), F.lit(False))
        texts = F.transform(turns, lambda t, i: F.when(i == 0, F.array(segment(escape(t["text"]), role == LOSS_ROLE))).otherwise(F.array(segment(F.lit(ALSO), F.lit(False)), segment(escape(t["text"]), role == LOSS_ROLE))))
        return F.concat(F.array(head), F.flatten(texts), F.array(segment(F.lit(STOP), F.lit(False))))

    rows = rows.withColumn("segments", F.concat(F.array(segment(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform("runs", run)), F.array(segment(F.lit(END), F.lit(False)))))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted) - len(BEGIN) - len(END))
    runs = F.filter(F.split(body, _literal(STOP)), lambda r: r != "")

    def turns(run: Column) -> Column:
        parts = F.split(run, _literal(MESSAGE))
        role = unescape(F.substring(parts[0], F.lit(len(START) + 1), F.char_length(parts[0])))
        return F.transform(F.split(parts[1], _literal(ALSO)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = format_conversations(given.unionByName(more))
    rows = rows.withColumn("back", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = rows.withColumn("loss_text", loss)
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  ({len(BEGIN + END)} + sum(length({_sql_escape('text')}) + CASE WHEN before IS DISTINCT FROM role
     THEN {len(START + MESSAGE + STOP)} + length({_sql_escape('role')}) ELSE {len(ALSO)} END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
