"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document; parts of any other kind stand as `file`. A visitor walks each list in order and flattens it
to text: text parts are escaped, other parts become numbered placeholders, and each placeholder is recorded with its
reference and the tokens that it stands for. Turns are laid out as

    <|im_start|>role newline content <|im_end|> newline

Escaping is reversible: a backslash is doubled, "<|" becomes "<\\|", and in roles a line end becomes "\\n"; a "|" that begins
a part which is not the first becomes "\\|" too, as the part before may end in "<". So no control string can come from a text
or from several, and splitting at "<|im_start|>" finds the turns.

Defined results: a null text or role is the empty one; turns are ordered by (turn, role, content), a null turn first, so
ties are stable and repeated rows stay; rows without a conversation id form one conversation; an empty table gives an
empty result. A conversation is one row of the output and so is bounded by what Spark holds in a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of parts that placeholders name; no other word of a part's type gets into the text.
KINDS = ("image", "audio", "document")
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of an image patch of PATCH x PATCH pixels, of a second of audio, of a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    """Left to right, every backslash opens an escape; so doubled ones are found by splitting, and the rest replaced."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def part_tokens(p: Column) -> Column:
    """Tokens that a part other than text expands to; 0 where its size is missing."""
    image = F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH)
    return F.coalesce(
        F.when(p["type"] == "image", image).when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_RATE)).when(p["type"] == "document", p["pages"].cast("long") * PAGE_TOKENS),
        F.lit(0),
    ).cast("long")


def visit(parts: Column) -> tuple[Column, Column]:
    """(flattened text, attachments): attachments are (slot, type, uri, tokens) in order; a null part is skipped."""
    kind = lambda p: F.when(p["type"].isin(*KINDS), p["type"]).otherwise("file")
    there = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    media = F.filter(there, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    before = lambda i: F.size(F.filter(F.slice(there, F.lit(1), i), lambda p: F.coalesce(p["type"], F.lit("text")) != "text"))
    inner = lambda c, i: F.when((i > 0) & F.startswith(c, F.lit("|")), F.concat(F.lit("\\"), c)).otherwise(c)
    flat = F.transform(
        there,
        lambda p, i: F.when(F.coalesce(p["type"], F.lit("text")) == "text", inner(escape(F.coalesce(p["text"], F.lit(""))), i)).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), before(i).cast("string"), F.lit("|>"))),
    )
    refs = F.transform(media, lambda p, i: F.struct(i.cast("int").alias("slot"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
    return F.array_join(flat, ""), refs


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    fields = ["cast(null as string) uri", "cast(null as int) width", "cast(null as int) height", "cast(null as double) seconds", "cast(null as int) pages"]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *map(F.expr, fields)))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points of each `learn` content), attachments, media_tokens."""
    flat, refs = visit(turns[parts_col])
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), flat.alias("body"), refs.alias("refs"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "refs", "body", F.concat(head, "body", F.lit(END + "\n")).alias("piece"), F.length(head).cast("long").alias("lead"), F.length("body").cast("long").alias("len"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"n": F.row_number().over(order), "at": before + F.col("lead")})
    span = F.when(F.col("role") == learn, F.struct(F.col("at").alias("start"), F.col("len").alias("length")))
    refs_at = F.struct("n", "refs")
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(F.size("refs") > 0, refs_at))).alias("refs"),
    )
    attachments = F.flatten(F.transform("refs", lambda r: F.transform(r["refs"], lambda a: F.struct(r["n"].alias("position"), a["slot"].alias("slot"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "loss_spans",
        attachments.alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), read from the text alone."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda c: c != "")

    def turn(c: Column) -> Column:
        line = F.instr(c, "\n")
        body = F.substr(c, line + 1, F.length(c) - line - (len(END) + 1))
        return F.struct(unescape(F.substr(c, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(chunks, turn)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what format_chat returned."""
    turns = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("loss"))
    learnt = F.array_join("loss", "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
