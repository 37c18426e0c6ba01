"""Chat formatting: typed content parts flattened to ordered placeholders.

A message's text is either plain or a JSON array of parts, each with a ``type``
of text, image, audio or document.  A visitor goes over the parts in order: text
stays, any other part becomes ``<|type|>`` with an attachment reference (turn,
place in the turn, type, url) and an expanded token count: words of text; a cell
of 28 x 28 pixels of an image; 25 a second of audio; 512 a page of a document,
with fixed counts where the size is not given.  Turns are joined per
conversation as ``<|role|>\\ncontent<|end|>\\n``.  All of it is built-in
expressions, so it stays inside the JVM.

Defined cases: a null text is an empty message, a null role reads ``unknown``;
text that is no JSON array of objects is plain; a part of unknown type or
without one becomes ``<|unknown|>`` with no tokens; a size that is negative, not
finite or beyond ``MOST`` counts as not given; ``<|`` in a text or role becomes
``<\\|``, and ``<`` at the end of a part before others ``<\\``, so that no text can pass
for a marker; line breaks in a url become ``%0A``;
turns of equal number are ordered by role, then text; null turns come first and
read ``null`` in references; rows of a null conv_id are one conversation; repeated
rows are repeated messages; texts of any length are kept whole; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,url:string,width:double,height:double,seconds:double,pages:double>>"
BLANK = r"[^ \t\n\r\f]+"
#: Largest size of a part that is believed.
MOST = 1e7
CELL, IMAGE, PER_SECOND, AUDIO, PER_PAGE, DOCUMENT = 28, 256, 25, 250, 512, 512
KINDS = ("text", "image", "audio", "document")


def words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK)).cast("long")


def parted(text):
    """Text whose marker openings can't be taken for markers."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def cost(part):
    """The expanded token count of one part."""

    def size(name):
        return F.when(part[name].between(0, MOST), part[name])

    image = F.ceil(size("width") / CELL) * F.ceil(size("height") / CELL)
    return (
        F.when(part["type"] == "text", words(part["text"]))
        .when(part["type"] == "image", F.coalesce(image, F.lit(IMAGE)))
        .when(part["type"] == "audio", F.coalesce(F.ceil(size("seconds") * PER_SECOND), F.lit(AUDIO)))
        .when(part["type"] == "document", F.coalesce(F.ceil(size("pages") * PER_PAGE), F.lit(DOCUMENT)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def shown(part):
    """What stands for a part in the flattened text."""
    kind = F.when(part["type"].isin(*KINDS), part["type"]).otherwise(F.lit("unknown"))
    return F.when(part["type"] == "text", parted(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def messages(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, content, tokens, refs: one row per message."""
    text = F.coalesce(F.col("text"), F.lit(""))
    looks = F.ltrim(text).startswith("[")
    parsed = F.when(looks, F.from_json(text, PART))
    typed = looks & parsed.isNotNull() & (F.size(parsed) > 0) & ~F.exists(parsed, lambda p: p.isNull())
    plain = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("width", "double"), ("height", "double"), ("seconds", "double"), ("pages", "double")))))
    parts = F.when(typed, parsed).otherwise(plain)
    base = conversations.select("conv_id", "turn", parted(F.coalesce("role", F.lit("unknown"))).alias("role"), parts.alias("parts"))
    refs = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.cast("long").alias("place"), F.when(p["type"].isin(*KINDS), p["type"]).otherwise(F.lit("unknown")).alias("type"), F.regexp_replace(F.coalesce(p["url"], F.lit("")), r"[\r\n]+", "%0A").alias("url"), cost(p).alias("tokens"))),
        lambda r: r["type"] != "text",
    )
    return base.select(
        "conv_id",
        "turn",
        "role",
        F.array_join(F.transform("parts", lambda p, i: F.when(i < F.size("parts") - 1, F.regexp_replace(shown(p), r"<\z", r"<\\")).otherwise(shown(p))), "").alias("content"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + cost(p)).alias("tokens"),
        refs.alias("refs"),
    )


def render(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, n_turns, text, n_tokens, attachments, attachment_tokens: one row per conversation.

    attachment_tokens has the expanded count of each attachment, in their order."""
    # turns sort by their fields, nulls inside a struct first
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "content", "tokens", "refs")))
    whole = messages(conversations).groupBy("conv_id").agg(order.alias("turns"))
    line = lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))
    refs = F.flatten(F.transform("turns", lambda m: F.transform(m["refs"], lambda r: F.concat_ws(":", F.coalesce(m["turn"].cast("string"), F.lit("null")), r["place"].cast("string"), r["type"], r["url"]))))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", line), "").alias("text"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda total, m: total + m["tokens"]).alias("n_tokens"),
        F.array_join(refs, "\n").alias("attachments"),
        F.flatten(F.transform("turns", lambda m: F.transform(m["refs"], lambda r: r["tokens"]))).alias("attachment_tokens"),
    )


ORACLE = """
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') AS role, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '<\\|') AS text FROM conversations)
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       sum(len(regexp_extract_all(raw, '[^ \\t\\n\\r\\f]+')))::BIGINT AS n_tokens,
       '' AS attachments
FROM c GROUP BY conv_id
"""
