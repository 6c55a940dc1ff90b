"""Chat formatting with typed content parts, in DataFrame expressions only.

A conversation becomes one string of turns::

    <turn ROLE>BODY</turn>\\n

``BODY`` is what :class:`PartVisitor` makes of the turn's parts, in order; a turn's
text is its first part.  Every attachment becomes a placeholder
``<part KIND TURN.INDEX>`` and is recorded with its reference and the number of
tokens that the model will expand it to; the tokens of text are counted, too.

Escaping is reversible: a backslash goes behind the ``<`` of whatever could be
read as a control string (``<turn``, ``</turn``, ``<part``, with any number of
backslashes already there); other texts stay as they are.  Text is escaped after
the parts are joined, so no control string can be put together from several parts.
In roles ``%``, ``<``, ``>`` and line breaks are percent-encoded.

Defined results: a null text, role or part list counts as empty, and so does a null
part; a part of unknown kind is its text; missing sizes count as one tile, no sound
or one page, negative ones as 0; turns with the
same number are ordered by role, then text, then parts; a null conversation id
is a conversation of its own; an empty table gives an empty table.  Other
columns of the input are not looked at.  One conversation must fit into one row
(Spark's limit for a value is 2 GB), because its digest and its training string
are single values; every step over its turns is linear in its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS_SCHEMA = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_CONTROL = r"<(\\*)(/?(?:turn|part)\b)"
_ESCAPED = r"<\\(\\*)(/?(?:turn|part)\b)"
_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


_ROLE_CODES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


def escape_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    for raw, code in _ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


# within a body that is not escaped yet: a mark of its own, and the start of a placeholder
_MARK, _OWN, _PART = "\u0001", "\u0001a", "\u0001b"


class PartVisitor:
    """Turns one part into ``(body, tokens)``; subclass it to change placeholders or
    costs.  Bodies are joined and then escaped, but for the placeholders."""

    tile = 512
    tokens_per_tile = 170
    image_base = 85
    audio_tokens_per_second = 25
    document_tokens_per_page = 800
    #: what counts as a token of text: a run of letters, digits and marks, or one other character
    text_token = r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]"

    def visit_text(self, part: Column, place: Column) -> tuple[Column, Column]:
        text = F.coalesce(part["text"], F.lit(""))
        return F.replace(text, F.lit(_MARK), F.lit(_OWN)), F.regexp_count(text, F.lit(self.text_token))

    def visit_image(self, part: Column, place: Column) -> tuple[Column, Column]:
        tiles = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(0)) / self.tile)
        return self.placeholder("image", place), tiles("width") * tiles("height") * self.tokens_per_tile + self.image_base

    def visit_audio(self, part: Column, place: Column) -> tuple[Column, Column]:
        return self.placeholder("audio", place), F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * self.audio_tokens_per_second)

    def visit_document(self, part: Column, place: Column) -> tuple[Column, Column]:
        return self.placeholder("document", place), F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)).cast("long") * self.document_tokens_per_page

    def placeholder(self, kind: str, place: Column) -> Column:
        return F.concat(F.lit(f"{_PART}{kind} "), place, F.lit(">"))

    def flatten(self, parts: Column, turn: Column) -> Column:
        """array of struct(body, kind, ref, tokens, attached), in the order of ``parts``."""

        def visit(part: Column, i: Column) -> Column:
            place = F.concat(turn.cast("string"), F.lit("."), i.cast("string"))
            body, tokens = self.visit_text(part, place)
            attached = F.lit(False)
            for kind, f in (("image", self.visit_image), ("audio", self.visit_audio), ("document", self.visit_document)):
                own_body, own_tokens = f(part, place)
                is_kind = F.coalesce(part["kind"] == kind, F.lit(False))
                body, tokens = F.when(is_kind, own_body).otherwise(body), F.when(is_kind, own_tokens).otherwise(tokens)
                attached = attached | is_kind
            return F.struct(body.alias("body"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"), attached.alias("attached"))

        return F.transform(F.filter(parts, lambda p: p.isNotNull()), visit)

    def body(self, flat: Column) -> Column:
        """The bodies of flattened parts as one escaped string with placeholders."""
        joined = escape(F.array_join(F.transform(flat, lambda p: p["body"]), ""))
        return F.replace(F.replace(joined, F.lit(_PART), F.lit("<part ")), F.lit(_OWN), F.lit(_MARK))


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_roles: tuple[str, ...] = ("assistant",),
    visitor: PartVisitor | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``n_turns``,
    ``turn_spans`` (code point start and length of every body, and whether it is
    under the loss mask), ``attachments``, ``attachment_tokens`` and ``text_tokens``.

    One shuffle by the conversation id: the window that numbers turns and adds
    up offsets and the final grouping use the same partitioning.
    """
    visitor = visitor or PartVisitor()
    said = F.coalesce(F.col(text_col), F.lit(""))
    first = F.array(F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), said)).cast("array<struct<kind:string,text:string>>")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    first = F.transform(first, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), *nothing))
    parts = F.concat(first, F.coalesce(F.col(parts_col).cast(PARTS_SCHEMA), F.array().cast(PARTS_SCHEMA))) if parts_col else first
    own = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        parts.alias("parts"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    flat = own.withColumn("at", F.row_number().over(order)).select("conv_id", "at", "role", visitor.flatten(F.col("parts"), F.col("at")).alias("flat"))
    found = F.transform(F.filter("flat", lambda p: p["attached"]), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    text_tokens = F.aggregate("flat", F.lit(0).cast("long"), lambda n, p: n + F.when(p["attached"], F.lit(0).cast("long")).otherwise(p["tokens"]))
    flat = flat.select("conv_id", "at", "role", F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">")).alias("head"), visitor.body(F.col("flat")).alias("body"), found.alias("found"), text_tokens.alias("text_tokens"))
    size = F.length("head") + F.length("body") + len(_END)
    before = Window.partitionBy("conv_id").orderBy("at")
    flat = flat.select(
        "conv_id",
        "at",
        F.concat("head", "body", F.lit(_END)).alias("segment"),
        "found",
        "text_tokens",
        F.struct(
            (F.sum(size.cast("long")).over(before) - F.length("body") - len(_END)).alias("start"),
            F.length("body").cast("long").alias("length"),
            F.col("role").isin(*loss_roles).alias("loss"),
        ).alias("span"),
    )
    grouped = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "segment", "span", "found", "text_tokens"))).alias("turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: t["span"]).alias("turn_spans"),
        F.flatten(F.transform("turns", lambda t: t["found"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["text_tokens"]).alias("text_tokens"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse for text turns: ``conv_id``, ``turns`` (array of role, text,
    loss), read from the formatted string and its mask alone.  A masked text is what
    stands at its span's ``start``; a turn begins where the body before it, and its
    end mark, stop."""
    chunks = F.split("formatted", _END, -1)
    cut = formatted.select("conv_id", "formatted", "turn_spans", F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens", "text_tokens", F.slice(chunks, F.lit(1), F.size(chunks) - 1).alias("chunks"))

    # starts are relative to the first one, which has to stand behind the first head
    shift = F.get(F.col("turn_spans"), F.lit(0))["start"] - F.instr(F.get(F.col("chunks"), F.lit(0)), F.lit(">"))

    def read(chunk: Column, i: Column) -> Column:
        gt = F.instr(chunk, F.lit(">"))
        span = F.get(F.col("turn_spans"), i)
        before = F.get(F.col("turn_spans"), i - 1)
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(before["start"] + before["length"] + len(_END))
        role = F.substring(chunk, F.lit(7), gt - 7)
        masked = F.substring(chunk, (span["start"] - begin + F.when(i == 0, F.lit(0)).otherwise(shift) + 1).cast("int"), span["length"].cast("int"))
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(chunk, gt + 1, F.length(chunk))).alias("text"),
            F.when(span["loss"], unescape(masked)).alias("masked"),
        )

    return cut.select("conv_id", "formatted", "n_attachments", "attachment_tokens", "text_tokens", F.transform("chunks", read).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract returns, read back from the formatted strings."""
    back = read_chats(formatted).select(
        "conv_id",
        "n_attachments",
        "attachment_tokens",
        "text_tokens",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["masked"].isNotNull()), lambda t: t["masked"]), "").alias("loss"),
    )
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("all", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "attachment_tokens",
        "text_tokens",
    )
