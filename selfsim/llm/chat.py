"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an array of parts: text, image, audio or document. The visitor
flattens them in order: texts are escaped, other parts become placeholders whose
references and expanded token counts are recorded. Turns stand between control strings;
the characters that begin control strings are escaped inside texts, so that no text can
hold one and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"
#: Fixed values of the escapes; the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("\n", "&nl;"))
#: Square pixels of an image tile, milliseconds of an audio frame, bytes of a document chunk for each token.
IMAGE_TILE, AUDIO_FRAME, DOCUMENT_CHUNK = 28, 80, 4
CHUNK = 64
PART = "struct<type: string, text: string, ref: string, width: int, height: int, duration_ms: long, bytes: long>"


def escape(text: Column, last: int = 3) -> Column:
    """Texts keep their line breaks (last = 3); roles don't (last = 4)."""
    for a, b in ESCAPES[:last]:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def text_part(text: Column) -> Column:
    """The content of a turn that has a text alone; null is empty."""
    empty = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), empty("string").alias("ref"), empty("int").alias("width"), empty("int").alias("height"), empty("long").alias("duration_ms"), empty("long").alias("bytes")))


def part_tokens(p: Column) -> Column:
    """Tokens that a placeholder expands to: tiles of an image, frames of an audio, chunks of a document; 1 at least, 0 for text."""
    up = lambda a, b: F.ceil(F.coalesce(a, F.lit(0)) / F.lit(b))
    n = F.when(p["type"] == "image", up(p["width"], IMAGE_TILE) * up(p["height"], IMAGE_TILE)).when(p["type"] == "audio", up(p["duration_ms"], AUDIO_FRAME)).otherwise(up(p["bytes"], DOCUMENT_CHUNK))
    return F.when(p["type"] == "text", F.lit(0)).otherwise(F.greatest(n, F.lit(1))).cast("long")


def flatten(content: Column) -> Column:
    """The turn's flattened text: escaped texts and placeholders [kind:k], k counting parts from 0; unknown kinds are documents."""
    kind = lambda p: F.when(p["type"].isin("image", "audio"), p["type"]).otherwise("document")
    return F.array_join(F.transform(content, lambda p, k: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("["), kind(p), F.lit(":"), k.cast("string"), F.lit("]")))), "")


def attachments(content: Column) -> Column:
    """Of each part but texts: its place, kind, reference and token count."""
    placed = F.transform(content, lambda p, k: F.struct(k.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.filter(placed, lambda a: ~a["type"].eqNullSafe("text"))


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens), a row for each conv_id of turns (conv_id, turn, role, content).

    Turns go by turn, then role, then text; a null turn comes first, a null role is
    empty, repeated rows stay. loss_spans are (start, chars), from 1, of the trained role's
    texts in formatted. Long conversations are put together by chunks of CHUNK turns first, so
    that no task sorts all turns of one. A null conv_id is a conversation of its own. No turns: no rows.
    """
    own = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.expr(f"turn div {CHUNK}").alias("chunk"),
        F.coalesce("role", F.lit("")).alias("role"),
        flatten(F.col("content")).alias("body"),
        attachments(F.col("content")).alias("files"),
    ).select("conv_id", "chunk", F.struct("turn", "role", "body", "files").alias("x"))
    # (text, spans, files) of a chunk, the spans counted from the chunk's start
    chunk = own.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    head = lambda x: F.concat(F.lit(START), escape(x["role"], 4), F.lit("\n"))
    line = lambda x: F.concat(head(x), x["body"], F.lit(END + "\n"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, chars: bigint>>").alias("spans"))
    chunk = chunk.select("conv_id", "chunk", F.explode(F.array(F.transform("xs", lambda x: F.struct((x["role"] == trained).alias("on"), F.length(head(x)).cast("long").alias("lead"), F.length(x["body"]).cast("long").alias("chars"), line(x).alias("line"))))).alias("ts"), F.expr("flatten(transform(xs, x -> transform(x.files, f -> named_struct('turn', x.turn, 'part', f.part, 'type', f.type, 'ref', f.ref, 'tokens', f.tokens))))").alias("files"))
    spans = F.aggregate("ts", zero, lambda a, x: F.struct((a["at"] + F.length(x["line"])).alias("at"), F.when(x["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["lead"] + 1).alias("start"), x["chars"].alias("chars"))))).otherwise(a["spans"]).alias("spans")))
    chunk = chunk.select("conv_id", F.struct("chunk", F.array_join(F.transform("ts", lambda x: x["line"]), "").alias("text"), spans["spans"].alias("spans"), "files").alias("c"))
    whole = chunk.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    moved = F.expr(
        "aggregate(cs, named_struct('at', 0L, 'spans', CAST(array() AS ARRAY<STRUCT<start: BIGINT, chars: BIGINT>>)), "
        "(a, c) -> named_struct('at', a.at + length(c.text), 'spans', concat(a.spans, transform(c.spans, s -> named_struct('start', s.start + a.at, 'chars', s.chars))))).spans"
    )
    out = whole.select("conv_id", F.array_join(F.transform("cs", lambda c: c["text"]), "").alias("formatted"), moved.alias("loss_spans"), F.flatten(F.transform("cs", lambda c: c["files"])).alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the roles and texts parsed from formatted, and the text under its loss spans, unescaped."""
    parts = F.slice(F.split("formatted", r"<\|start\|>"), 2, 1 << 30)
    turn = F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.split_part(F.substr(p, F.locate("\n", p) + 1), F.lit(END), F.lit(1))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["chars"].cast("int")))), "")
    return formatted.select("conv_id", turn.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of turns (conv_id, turn, role, text), read back from the formatted text."""
    back = read_back(format_conversations(turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS x, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(x) + length(r) + 18) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
