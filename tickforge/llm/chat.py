"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor over the parts of each turn writes text (escaped) and placeholders for
image, audio and document parts in order, and records each attachment's
reference, its place in the output and its expanded token count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MID, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Expanded tokens of a part: base + per * units, by type.
EXPANSION = {"image": (2, 256), "audio": (2, 25), "document": (2, 512)}
# Each of these characters of a text is written as a backslash and a letter, so nothing that texts
# hold, alone or joined, reads as a mark, and the way back needs no look ahead.
ESCAPES = {"<": "\\l", "[": "\\b"}


def escape(text: Column) -> Column:
    """The text without control strings: no `<` and no `[` is left; backslashes are doubled."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for char, code in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """escape() undone: doubled backslashes separate stretches in which a backslash can only begin a code."""

    def plain(part: Column) -> Column:
        for char, code in ESCAPES.items():
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_mask, attachments, expanded_tokens).

    turns: (conv_id, turn, role, parts), parts being
    array<struct<type:string, text:string, ref:string, units:int>>; other columns
    are ignored. loss_mask holds (start, length) in code points of each
    assistant's content, end mark excluded; attachments holds (type, ref, start, tokens) with the
    placeholder's start. Null roles, texts, parts and part types ("text") count
    as empty; a part of an unknown type is written as its escaped text. Ties in
    turn go by role, then content; repeated rows are all kept. A null conv_id is a
    conversation of its own. No rows give no rows. Places are running sums over turns, and over
    the parts of turns with attachments, so a long conversation costs time in proportion.
    """
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    attached = lambda p: kind(p).isin(*EXPANSION)
    piece = lambda p: F.when(attached(p), placeholder(kind(p))).otherwise(escape(p["text"]))

    def cost(p: Column) -> Column:
        units = F.coalesce(p["units"], F.lit(0)).cast("long")
        out = F.lit(0).cast("long")
        for name, (base, per) in EXPANSION.items():
            out = F.when(kind(p) == name, base + per * units).otherwise(out)
        return out

    empty = F.array().cast("array<struct<type:string,text:string,ref:string,units:int>>")
    parts = F.filter(F.coalesce("parts", empty), lambda p: p.isNotNull())
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).withColumn("pieces", F.transform("parts", piece))
    seen = F.transform("parts", lambda p: F.struct(attached(p).alias("is"), kind(p).alias("type"), p["ref"].alias("ref"), cost(p).alias("tokens")))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MID))
    t = t.select("conv_id", "turn", "role", head.alias("head"), F.array_join("pieces", "").alias("body"), F.transform("pieces", F.length).alias("sizes"), seen.alias("seen"))
    t = t.withColumn("whole", F.concat("head", "body", F.lit(END))).withColumn("size", F.length("whole"))
    # no turn is empty, so its place names it; turns that tie in all are alike
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("seen")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("begin", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("int"))
    mask = F.when(F.col("role") == "assistant", F.struct((F.col("begin") + F.length("head")).alias("start"), F.length("body").alias("length")))
    whole = t.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "whole"))), lambda r: r["whole"]), "").alias("formatted"),
        F.sort_array(F.collect_list(mask)).alias("loss_mask"),
    )
    place = Window.partitionBy("conv_id", "begin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    more = t.where(F.exists("seen", lambda s: s["is"])).select("conv_id", "begin", (F.col("begin") + F.length("head")).alias("first"), F.posexplode(F.arrays_zip("seen", "sizes")).alias("at", "part"))
    more = more.withColumn("start", (F.col("first") + F.coalesce(F.sum("part.sizes").over(place), F.lit(0))).cast("int")).where("part.seen.is")
    found = more.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("part.seen.type").alias("type"), F.col("part.seen.ref").alias("ref"), F.col("part.seen.tokens").alias("tokens")))).alias("attachments"),
        F.sum("part.seen.tokens").alias("expanded_tokens"),
    )
    both = whole.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    none = F.array().cast("array<struct<type:string,ref:string,start:int,tokens:bigint>>")
    shown = F.transform("attachments", lambda a: F.struct(a["type"].alias("type"), a["ref"].alias("ref"), a["start"].alias("start"), a["tokens"].alias("tokens")))
    return both.select("conv_id", "formatted", "loss_mask", F.coalesce(shown, none).alias("attachments"), F.coalesce("expanded_tokens", F.lit(0)).cast("long").alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array<struct<role, text>>, attachments as their placeholders."""
    bodies = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda s: s.startswith(START))
    inner = F.transform(bodies, lambda s: F.split(F.substring(s, len(START) + 1, 2147483647), r"<\|says\|>", 2))
    return F.transform(inner, lambda a: F.struct(unescape(a[0]).alias("role"), unescape(a[1]).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of format_chat()'s rows, all read back from the output."""
    turns = read_back(F.col("formatted"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    out = formatted.withColumn("turns", turns).withColumn("under", under)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_query(spark, sf_dir: str) -> DataFrame:
    """op2: every conversation, and conversation -7 whose texts look like control strings."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], said.schema)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    return digests(format_chat(said.unionByName(added).select("conv_id", "turn", "role", F.array(part).alias("parts"))))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 2 * length(role || text) - length(regexp_replace(role || text, '[<\[\\]', '', 'g')) + 24 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
