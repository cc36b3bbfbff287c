r"""Chat formatting with typed content parts.

A conversation is a set of turns; a turn's content is an array of typed parts.
A visitor over the parts writes text (escaped) and, for images, audio and
documents, numbered placeholders; the attachments themselves are recorded beside
the text with the tokens that each will expand to.

Template, for every turn:

    [ROLE]role[/ROLE][INST]text[/INST]     role user
    [ROLE]role[/ROLE][MSG]text</s>         any other role

after one ``<s>`` for the conversation.  Control strings inside roles and texts,
within a part or spread over neighbouring ones, are broken by a backslash after their first character and backslashes are
doubled, so no text can end a turn, and ``unescape`` restores it exactly.

The output is run-length coded: ``segments`` is an array of (text, loss) whose
texts joined are ``formatted``; assistant texts, and nothing else, carry loss.

Everything is DataFrame functions.  One shuffle by conversation: the unit of a
digest or a training sample is the conversation, so its turns must meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What follows the first character of each control string.
_CONTROL = r"s>|/s>|/?INST\]|/?ROLE\]|MSG\]|(?:IMAGE|AUDIO|DOCUMENT) [0-9]+\]"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Make ``text`` free of control strings; null stays null."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content array of one text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]).cast(PART))


def expanded_tokens(part: Column, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1024) -> Column:
    """Tokens that a model will see in place of an attachment's placeholder; unknown sizes count as one unit."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(patch)), F.lit(1)) / patch)
    image = side(part["width"]) * side(part["height"])
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * audio_rate)
    pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(pages).cast("long")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*ATTACHMENTS), F.lit(False))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, content -> one row for each conversation.

    Returns conv_id, formatted, segments (text, loss), attachments (ordinal,
    kind, ref, tokens) and attachment_tokens.  ``content`` is array<PART>; other
    columns are ignored.  Turns are ordered by turn, then role and content, null
    first; repeated rows are repeated turns.  A null role is the empty role, null
    or empty content an empty text, a part of unknown type its text.  A null
    conv_id is one conversation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.array().cast(f"array<{PART}>")).alias("content"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    files = F.filter("content", _is_attachment)
    rows = rows.withColumn("files", files).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("before", F.sum(F.size("files")).over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna({"before": 0})

    # texts between two attachments are one text: a control string may be spread over parts
    places = F.array_compact(F.transform("content", lambda p, i: F.when(_is_attachment(p), i + 1)))
    rows = rows.withColumn("places", places)

    def visit(k: Column) -> Column:
        first = F.coalesce(F.get("places", k - 1), F.lit(0)) + 1
        last = F.coalesce(F.get("places", k), F.size("content") + 1)
        text = F.array_join(F.transform(F.slice("content", first, last - first), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        kind = F.get("content", last - 1)["type"]
        mark = F.concat(F.lit("["), F.upper(kind), F.lit(" "), (F.col("before") + k).cast("string"), F.lit("]"))
        return F.concat(escape(text), F.when(k < F.size("places"), mark).otherwise(""))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.size("places")), visit), "")
    user, loss = F.col("role") == "user", F.col("role") == "assistant"
    opening = F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"), F.when(user, F.lit("[INST]")).otherwise(F.lit("[MSG]")))
    closing = F.when(user, F.lit("[/INST]")).otherwise(F.lit("</s>"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    rows = rows.select("conv_id", "at", F.array(segment(opening, F.lit(False)), segment(body, loss), segment(closing, F.lit(False))).alias("segments"), F.transform("files", lambda f, i: F.struct((F.col("before") + i).alias("ordinal"), f["type"].alias("kind"), f["ref"].alias("ref"), expanded_tokens(f).alias("tokens"))).alias("files"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "segments", "files"))).alias("turns"))
    start = F.array(segment(F.lit("<s>"), F.lit(False)))
    grouped = grouped.select("conv_id", F.concat(start, F.flatten("turns.segments")).alias("segments"), F.flatten("turns.files").alias("attachments"))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return grouped.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "attachments", tokens.alias("attachment_tokens"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, r"\[ROLE\]", -1)
    body = r"(?s)^.*?\[/ROLE\]\[(?:INST|MSG)\](.*)(?:\[/INST\]|</s>)$"
    read = lambda p: F.struct(unescape(F.substring_index(p, "[/ROLE]", 1)).alias("role"), unescape(F.regexp_extract(p, body, 1)).alias("text"))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back from its output and summed up."""
    read = chats.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
