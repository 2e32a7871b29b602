r"""Chat formatting: every assistant turn becomes an example of its own, trained on that reply alone.

Template: a turn is `<s>role`, a newline, the text, `</s>`. In roles and texts a backslash becomes `\0`, `<` becomes `\1`, `[`
becomes `\2` (so neither `<s>`, `</s>` nor any bracketed control string can stand there), in roles a newline becomes `\3`.
An example is the turns of its conversation up to an assistant's; its mask spans that turn's text, end mark excluded. Turns that
follow the last reply, or a conversation without one, make a closing example with an empty mask, so no turn is lost.

Defined cases: a null text or role counts as an empty one; rows of one turn number follow by role, then text; rows with a null
turn come first; a null conv_id is a conversation of its own; an empty table gives no example. Other columns are not read.
All turns of a conversation meet in one row, as its digests need; conversations, however many, are spread by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import held, table

# The template's control strings and the escapes, in the order of escaping.
OPEN, CLOSE = "<s>", "</s>"
TEXT_ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
ROLE_ESCAPES = [*TEXT_ESCAPES, ("\n", "\\3")]
PROBE = "</s>[INST] ok [/INST]"


def escape(col: Column, pairs=tuple(TEXT_ESCAPES)) -> Column:
    for plain, code in pairs:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column, pairs=tuple(TEXT_ESCAPES)) -> Column:
    for plain, code in reversed(pairs):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start and loss_end (code points; equal in a closing example), closing."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    df = held(df, _heads=F.transform("_turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"))), _bodies=F.transform("_turns", lambda t: escape(t["text"])))
    df = held(df, _parts=F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))))
    replies = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda i: F.get("_turns", i - 1)["role"] == "assistant")
    df = held(df, _replies=replies)
    last = F.size("_turns")
    ends = F.when(F.coalesce(F.element_at("_turns", -1)["role"] == "assistant", F.lit(False)), F.col("_replies")).otherwise(F.concat("_replies", F.array(last)))
    df = df.select("*", F.posexplode(ends).alias("_k", "_end"))
    df = held(df, closing=F.get("_turns", F.col("_end") - 1)["role"] != "assistant", formatted=F.array_join(F.slice("_parts", 1, F.col("_end")), ""), _body=F.length(F.get("_bodies", F.col("_end") - 1)))
    end = F.length("formatted") - len(CLOSE)
    return df.select("conv_id", (F.col("_k") + 1).alias("example"), "formatted", (end - F.when(F.col("closing"), 0).otherwise(F.col("_body"))).alias("loss_start"), end.alias("loss_end"), "closing")


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as an array of role and text."""
    parts = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)
    role = lambda p: unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**30), "\n", 1), ROLE_ESCAPES)
    text = lambda p: unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def digests(formatted_examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text and masks."""
    loss = unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    df = formatted_examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("_size"), loss.alias("_loss"))
    df = df.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "").alias("_all_loss"),
        F.sum("_size").alias("formatted_chars"),
    )
    df = held(df, _read=read_turns(F.col("_whole")))
    return df.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_all_loss").cast("long").alias("loss_chars"),
        F.sha2("_all_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations and the probe, whose texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return digests(examples(rows.unionByName(probe)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '[', '\2'), chr(10), '\3'))
              + length(replace(replace(replace(text, '\', '\0'), '<', '\1'), '[', '\2')) + 8 AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n FROM t),
v AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM u)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM v GROUP BY conv_id
"""
