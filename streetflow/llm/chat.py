"""Chat formatting with typed content parts: one visitor flattens every kind of part into marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, NEXT, END, OPEN, CLOSE = "<|start|>", "<|text|>", "<|next|>", "<|end|>", "<|", "|>"
#: What no text may hold as it is: this template's own marks and those of common instruction templates.
CONTROL = r"([<\[])(?=/?s>|/?INST\]|/?SYS\]|/?<?SYS>|<SYS>>|</SYS>>|\|)"
#: Tokens an attachment takes up: image patches of 14 x 14, 25 audio frames a second, 512 tokens a page.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    r"""Break up control strings: a backslash becomes two, and one follows the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def text_part(text: Column) -> Column:
    """A content part of type text."""
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))


def _visit(part: Column) -> Column:
    """One part as (piece of text, kind, uri, tokens its attachment expands to).

    Text is escaped, attachments become ``<|kind|>``; a part of unknown or no type counts as a document.
    """
    kind = F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise("document")
    patches = F.ceil(F.coalesce(part["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(PATCH)) / PATCH)
    tokens = (
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE).otherwise(0).cast("long"))
    piece = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit(OPEN), kind, F.lit(CLOSE)))
    return F.struct(piece.alias("piece"), kind.alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts ``array<PART>``).

    Returns conv_id, formatted, loss_spans (offset and length in bytes of the UTF-8 text), attachments
    ``array<struct<turn,part,kind,uri,tokens>>`` in the order of their placeholders, and expanded_tokens.

    Turns come by ``turn``, ties by role and content; repeated rows are turns of their own. A null turn comes first,
    a null role or text counts as empty, a null or empty list of parts is a turn without content, a null conv_id is
    one conversation. Other columns are ignored. An empty table gives no rows.
    """
    role = F.coalesce("role", F.lit(""))
    visited = turns.select(
        "conv_id", "turn", role.alias("role"),
        F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _visit).alias("seen"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    # neighbouring texts stay apart, so that no control string can form across them
    body = F.array_join(F.transform("seen", lambda p, i: F.when(
        (i > 0) & (p["kind"] == "text") & (F.get("seen", i - 1)["kind"] == "text"),
        F.concat(F.lit(NEXT), p["piece"])).otherwise(p["piece"])), "")
    pieces = visited.select(
        "conv_id", "turn", "role", head.alias("head"), body.alias("body"),
        F.filter(F.transform("seen", lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"),
                                                            p["tokens"].alias("tokens"))),
                 lambda p: p["kind"] != "text").alias("files"))
    order = ["turn", "role", "body"]
    by_turn = Window.partitionBy("conv_id").orderBy(*order)
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    placed = (
        pieces.withColumn("at", F.row_number().over(by_turn))
        .withColumn("begin", F.sum(size).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - size + F.octet_length("head")))
    is_loss = F.col("role").isin(*loss_roles)
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("text")))).alias("texts"),
        F.sort_array(F.collect_list(F.when(is_loss, F.struct(
            F.col("begin").cast("long").alias("begin"), F.octet_length("body").cast("long").alias("bytes"))))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(F.size("files") > 0, F.struct("at", "files")))).alias("files"))
    attachments = F.flatten(F.transform("files", lambda f: F.transform(f["files"], lambda p: F.struct(
        f["at"].alias("turn"), p["part"].alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id", F.array_join("texts.text", "").alias("formatted"), "loss_spans", attachments.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role,text>>`` of a formatted conversation; placeholders are no part of the text."""
    rows = F.slice(F.split(formatted, r"<\|end\|>", -1), 1, F.size(F.split(formatted, r"<\|end\|>", -1)) - 1)

    def turn(row: Column) -> Column:
        sides = F.split(F.substr(row, F.lit(len(START) + 1)), r"<\|text\|>", 2)
        text = F.regexp_replace(sides[1], r"<\|[a-z]+\|>", "")
        return F.struct(unescape(sides[0]).alias("role"), unescape(text).alias("text"))

    return F.transform(rows, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    raw = formatted.cast("binary")
    parts = F.transform(spans, lambda s: unescape(F.regexp_replace(
        F.substring(raw, (s["begin"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"), r"<\|[a-z]+\|>", "")))
    return F.array_join(parts, "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations."""
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
