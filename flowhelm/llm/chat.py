"""Chat formatting of typed content parts, as native expressions.

A turn is an array of parts ``struct<kind, text, ref, units>``. The visitor :func:`flatten` turns them in order into
template text: text parts are escaped, image, audio and document parts become numbered placeholders whose references are
listed beside the text, and every part counts its expanded tokens (words for text, ``units`` times a rate otherwise).

Template of a turn: ``<|turn|>role<|says|>content<|end|>``. Inside roles and texts a backslash follows the first
character of every control string (those of this template and the usual ``<s> </s> [INST] [/INST]``), and backslashes
are doubled; dropping one backslash before each character gives the text back. The loss mask holds the contents of the
assistant's turns. Null texts, roles and part lists are empty; unknown kinds are placeholders of their own name; ties of
``turn`` follow role, then content; an empty table gives no rows. A conversation is one value of the output, so its rows
meet in one place by definition; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\||/?s>|/?INST\])"
RATES = {"image": 576.0, "audio": 25.0, "document": 1500.0}
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def flatten(parts: Column) -> dict[str, Column]:
    """``content`` (text with placeholders numbered by position in the turn), ``attachments`` and ``n_tokens`` of a turn."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))

    def content(part: Column, i: Column) -> Column:
        return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))) \
            .otherwise(F.concat(F.lit("<|"), escape(_kind(part)), F.lit(":"), i.cast("string"), F.lit("|>")))

    def tokens(part: Column) -> Column:
        rate = F.lit(1.0)
        for kind, x in RATES.items():
            rate = F.when(_kind(part) == kind, F.lit(x)).otherwise(rate)
        words = F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
        return F.when(_kind(part) == "text", words).otherwise(F.ceil(rate * F.coalesce(part["units"], F.lit(1.0)))).cast("long")

    attached = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))), lambda a: a["kind"] != "text")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + tokens(p))
    return {"content": F.array_join(F.transform(parts, content), ""), "attachments": attached, "n_tokens": total}


def format_turns(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conversation: ``pieces`` (a piece per turn; ``formatted`` joins them), ``loss`` (piece, start, end of
    the masked text inside it, code points), ``attachments`` (piece, part, kind, ref, tokens) and ``n_tokens``."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit("<|turn|>"), escape(role), F.lit("<|says|>"))
    rows = turns.withColumns(flatten(F.col(parts))).withColumn("_head", head)
    start = F.length("_head")
    turn = F.struct(
        F.col("turn"), role.alias("role"), F.col("content"), F.concat("_head", "content", F.lit("<|end|>\n")).alias("piece"),
        start.alias("start"), (start + F.length("content")).alias("end"), F.col("attachments"), F.col("n_tokens"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    loss = F.filter(F.transform("_t", lambda t, i: F.struct(i.alias("piece"), t["start"].alias("start"), t["end"].alias("end"), (t["role"] == "assistant").alias("on"))), lambda m: m["on"])
    attached = F.flatten(F.transform("_t", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.alias("piece"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return told.select(
        "conv_id", F.transform("_t", lambda t: t["piece"]).alias("pieces"), loss.alias("loss"), attached.alias("attachments"),
        F.aggregate("_t", F.lit(0).cast("long"), lambda s, t: s + t["n_tokens"]).alias("n_tokens")) \
        .withColumn("formatted", F.array_join("pieces", ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and masked text again, from the formatted text and its mask alone."""
    segments = F.split("formatted", r"<\|end\|>\n")
    turns = F.transform(F.filter(segments, lambda s: s != ""), lambda s: F.split(F.substring_index(s, "<|turn|>", -1), r"<\|says\|>"))
    said = F.transform(turns, lambda t: F.concat(unescape(F.get(t, F.lit(0))), F.lit("\n"), unescape(F.get(t, F.lit(1))), F.lit("\n")))
    masked = F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.get("pieces", m["piece"]), m["start"] + 1, m["end"] - m["start"]))), "")
    return formatted.withColumn("_loss", masked).select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens")


SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS e,
  regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS er FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(e) + length('<|turn|><|says|><|end|>') + 1)::BIGINT AS formatted_chars,
  sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM escaped GROUP BY conv_id
"""
