"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn; adjacent turns of one role
become one block, and the blocks are joined to one string:

    user         [INST] text [/INST]
    assistant    <s>text</s>
    system       <<SYS>>text<</SYS>>
    any other    <<ROLE>>role<</ROLE>>text<</TURN>>
    between the texts of one block   <<NEXT>>

A control string inside a text or role gets a backslash after its first character, before those
that are there already; reading takes one away. So no text holds a control string, and every text
comes back as it was.

``loss_mask`` has the runs of ``formatted``, which are its control strings and its texts that are
not empty, in order: each with its code points and whether it is trained on (assistants' texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAIL = r"(/?INST\]|/?s>|<(?:/?SYS|/?ROLE|/TURN|NEXT)>>)"
_PLAIN = rf"([<\[])(\\*){_TAIL}"
_ESCAPED = rf"([<\[])\\(\\*){_TAIL}"
_CONTROL = r"(?:\[INST\] | \[/INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<</TURN>>|<<NEXT>>)"
_SEGMENT = rf"(?s){_CONTROL}|.+?(?={_CONTROL}|\z)"
_BLOCK = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<<ROLE>>.*?<</ROLE>>.*?<</TURN>>"
#: role: (before, after)
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _by_role(role: Column, k: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[k])).otherwise(out)
    return out


def format_chat(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_mask`` array<struct<n_chars int, loss boolean>> of each conversation.

    Null texts and roles count as empty. Rows with equal turns go by role, then text; repeated rows
    all stay. Rows with a null turn come first; those with a null conversation are one conversation.
    Other columns are not read.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Places in which a run of one role starts; a run ends where the next starts.
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[F.greatest(i - 1, F.lit(0))]["role"]))
    one = one.withColumn("at", starts).withColumn("upto", F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("t"))))
    blocks = F.zip_with("at", "upto", lambda i, j: F.struct(F.col("t")[i]["role"].alias("role"), F.transform(F.slice("t", i + 1, j - i), lambda x: escape(x["text"])).alias("texts")))
    one = one.select("conv_id", blocks.alias("blocks"))

    def segments(b: Column) -> Column:
        def run(text: Column, loss: Column | bool) -> Column:
            return F.struct(text.alias("s"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

        known = b["role"].isin(*MARKS)
        before = F.when(known, F.array(run(_by_role(b["role"], 0, F.lit("")), False))).otherwise(F.array(run(F.lit("<<ROLE>>"), False), run(escape(b["role"]), False), run(F.lit("<</ROLE>>"), False)))
        texts = F.flatten(F.transform(b["texts"], lambda x, i: F.when(i == 0, F.array(run(x, b["role"] == "assistant"))).otherwise(F.array(run(F.lit("<<NEXT>>"), False), run(x, b["role"] == "assistant")))))
        return F.concat(before, texts, F.array(run(_by_role(b["role"], 1, F.lit("<</TURN>>")), False)))

    one = one.select("conv_id", F.filter(F.flatten(F.transform("blocks", segments)), lambda s: s["s"] != "").alias("seg"))
    return one.select(
        "conv_id",
        F.array_join(F.transform("seg", lambda s: s["s"]), "").alias("formatted"),
        F.transform("seg", lambda s: F.struct(F.length(s["s"]).alias("n_chars"), s["loss"].alias("loss"))).alias("loss_mask"),
    )


def read_chat(df: DataFrame) -> DataFrame:
    """``df`` with ``turns`` array<struct<role, text>> and ``loss_text``, read out of ``formatted`` and ``loss_mask``.

    ``loss_text`` is null if the mask's runs aren't those of the string.
    """
    blocks = F.regexp_extract_all("formatted", F.lit(_BLOCK), F.lit(0))

    def turns(b: Column) -> Column:
        role = F.lit(None).cast("string")
        inner = F.regexp_extract(b, r"(?s)\A<<ROLE>>.*?<</ROLE>>(.*)<</TURN>>\z", 1)
        for name, (before, after) in MARKS.items():
            own = b.startswith(F.lit(before))
            role = F.when(own, F.lit(name)).otherwise(role)
            inner = F.when(own, F.substr(b, F.lit(len(before) + 1), F.length(b) - len(before) - len(after))).otherwise(inner)
        role = F.coalesce(role, unescape(F.regexp_extract(b, r"(?s)\A<<ROLE>>(.*?)<</ROLE>>", 1)))
        return F.transform(F.split(inner, "<<NEXT>>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    seg = F.regexp_extract_all("formatted", F.lit(_SEGMENT), F.lit(0))
    df = df.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "_mr_seg": seg})
    fits = F.transform("_mr_seg", lambda s: F.length(s)) == F.transform("loss_mask", lambda m: m["n_chars"])
    under = F.filter(F.zip_with("_mr_seg", "loss_mask", lambda s, m: F.when(m["loss"], unescape(s))), lambda s: s.isNotNull())
    return df.withColumn("loss_text", F.when(fits, F.array_join(under, ""))).drop("_mr_seg")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")))
    return read_chat(format_chat(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>|<(?:/?SYS|/?ROLE|/TURN|NEXT)>>)', '\1\\\2\3', 'g')) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joined
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN joined THEN 8 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 7 WHEN role = 'system' THEN 15
    ELSE 26 + length(regexp_replace(role, '([<\[])(\\*)(/?INST\]|/?s>|<(?:/?SYS|/?ROLE|/TURN|NEXT)>>)', '\1\\\2\3', 'g')) END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
