"""Operator 10, chat formatting [native]: typed content parts flattened into one marked, reversible string.

Everything is built-in column functions. A visitor over a turn's parts writes text escaped and every other part as a
numbered placeholder, and keeps the attachment's reference and the number of tokens that it will expand to.

The template: a turn is `<|turn:role|>`, its text, `<|end|>`. In texts and roles `&`, `<` and `>` are written `&amp;`,
`&lt;` and `&gt;`, so none of the template's marks can come from a text, and undoing them gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.session import table

#: What a message's parts look like; size is pixels, milliseconds or pages, by kind.
PARTS = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,millis:bigint,pages:bigint>>"
PATCH, MILLIS, PAGE = 28, 40, 512  # pixels, milliseconds and tokens that one token or page stands for


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def _patches(x: Column) -> Column:
    return F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(1)) / PATCH)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for: patches of an image, steps of a sound, pages of a document; texts none."""
    return (
        F.when(part["kind"] == "image", _patches(part["width"]) * _patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["millis"], F.lit(0)), F.lit(0)) / MILLIS))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * PAGE)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def text_part(text: Column) -> Column:
    """A text as parts: one, of kind text."""
    fields = [F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).alias(c) for c in ("ref", "width", "height", "millis", "pages")]]
    return F.array(F.struct(*fields)).cast(PARTS)


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """A turn's text with placeholders, in the order of its parts, and its attachments as an array of structs.

    A null array or part is empty; a part without a kind is text.
    """
    whole = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    others = F.filter(whole, lambda p: ~_is_text(p))
    numbered = F.transform(whole, lambda p, i: F.struct(p.alias("p"), F.size(F.filter(F.slice(whole, 1, i + 1), lambda q: ~_is_text(q))).alias("n")))
    text = F.array_join(F.transform(numbered, lambda x: F.when(_is_text(x["p"]), escape(x["p"]["text"])).otherwise(F.concat(F.lit("<|"), escape(x["p"]["kind"]), F.lit(":"), x["n"].cast("string"), F.lit("|>")))), "")
    refs = F.transform(others, lambda p, i: F.struct((i + 1).cast("bigint").alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return text, refs


def format_chats(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted, spans (start, size: what is learnt, in code points), attachments, tokens.

    messages: conv_id, turn, role, and either parts (see PARTS) or text, which counts as one text part. Turns go by turn
    (null first), ties by role and text, so repeated rows are repeated turns. Null roles and texts are empty. A null
    conv_id is a conversation like any other. One conversation is one output value; it must fit in a row, as the output must.
    """
    text, refs = flatten_parts(F.col("parts") if "parts" in messages.columns else text_part(F.col("text")))
    turns = messages.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("body"), refs.alias("refs")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda x: F.concat(F.lit("<|turn:"), escape(x["role"]), F.lit("|>"))
    pieces = F.transform("t", lambda x: F.struct(head(x).alias("head"), x["body"].alias("body"), x["role"].isin(*learn).alias("learn")))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len("<|end|>")
    # a running offset beside the spans: state is (offset, spans)
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + size(x)).cast("bigint").alias("at"),
            F.when(x["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["head"])).cast("bigint").alias("start"), F.length(x["body"]).cast("bigint").alias("size"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    whole = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("<|end|>"))), "")
    refs = F.flatten(F.transform("t", lambda x, i: F.transform(x["refs"], lambda r: F.struct(i.cast("bigint").alias("position"), r["n"].alias("n"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    out = chats.withColumn("pieces", pieces)
    return out.select("conv_id", whole.alias("formatted"), spans.alias("spans"), refs.alias("attachments")).withColumn("tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, r: s + r["tokens"]))


def read_back(chats: DataFrame, *more: str) -> DataFrame:
    """What formatted strings and their spans say: conv_id, turns (role and text with placeholders), learnt text, lengths; and `more` columns."""
    marks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: F.startswith(x, F.lit("<|turn:")))
    turns = F.transform(marks, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(8)), "|>", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "|>") + 2)).alias("text")))
    learnt = F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("bigint").alias("formatted_chars"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation through the visitor; the last columns say what it found beside text."""
    own = spark.sql("SELECT -7L AS conv_id, x AS turn, IF(x = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(0L, 1L)) AS x)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    found = chats.select("conv_id", "formatted", "spans", F.size("attachments").cast("bigint").alias("n_attachments"), F.col("tokens").alias("attachment_tokens"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(found, "n_attachments", "attachment_tokens")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "attachment_tokens",
    )


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS et, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + length(er) + 16)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
