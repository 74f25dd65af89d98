"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation's rows, by turn, become one string. A row's content is a list of parts; a visitor flattens them in
order: text is escaped, an image, audio or document part becomes a placeholder, is recorded as an attachment (turn,
type, reference, number of tokens it expands to), and unknown types count as documents.

Template: each turn is <|turn|>role, a line break, the content, <|end|>. Control strings begin with < or [, so these
two and the escape character itself are escaped in roles and texts (\\ as \\e, < as \\l, [ as \\b, a line break in a role
as \\n): whatever a text says, it can't form a control string, and unescaping gives it back. Every escape is two
characters and unescaping replaces \\e last, so no replacement forms a new escape.

The loss mask covers the content of assistant turns; spans are code points of the formatted string, from 0.

Rows are ordered by turn, then role, then content (null first); rows that repeat are turns of their own. Null texts
and roles are empty, and a null list of parts is an empty one. Rows of null conversation id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Tokens that a part without a number of its own expands to.
TOKENS = {"image": 256, "audio": 128, "document": 512}
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for raw, code in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("tokens")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio", "document"), part["type"]).otherwise(F.lit("document"))


def _visit(part: Column) -> Column:
    """What a part becomes in the string."""
    return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def formatted(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments) per conversation.

    parts: array<struct<type, text, ref, tokens>>. loss_spans: array<struct<start, end>>; attachments:
    array<struct<turn, type, ref, tokens>> in order, turn being the position from 0.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast("array<struct<type:string,text:string,ref:string,tokens:int>>"))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    content = F.array_join(F.transform(parts, _visit), "")
    attached = F.transform(
        F.filter(parts, lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], *[F.when(_kind(p) == k, n) for k, n in TOKENS.items()]).cast("int").alias("tokens")),
    )
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turn = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), content.alias("content"), head.alias("head"), attached.alias("attached")).alias("t"))
    turns = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["head"])
        end = start + F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == loss_role, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", at, step, lambda s: s["spans"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of a formatted string; placeholders are taken out of the texts."""
    turns = F.slice(F.split(text, r"<\|turn\|>"), F.lit(2), F.greatest(F.size(F.split(text, r"<\|turn\|>")) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        body = F.substring(t, F.length(role) + 2, F.length(t) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(F.regexp_replace(body, r"<\|(image|audio|document)\|>", "")).alias("text"))

    return F.transform(turns, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """The unescaped text of the spans, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(found: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted strings."""
    read = found.select("conv_id", "formatted", "loss_spans", parsed(F.col("formatted")).alias("read"))
    read = read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
