"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role are merged into a block by an array
aggregation. A block is written between the marks of its role; turns inside it are parted by [SEP]:

    user       [INST]...[/INST]
    system     [SYS]...[/SYS]
    assistant  <s>...</s>
    other      [ROLE]name[SEP]...[/ROLE]

Marks inside texts are escaped: each backslash is doubled, then a backslash follows the first character of each mark.
No mark is then left inside a text, and dropping one backslash before any character gives the text back.
The loss mask covers the assistant's escaped texts: each turn's own span, marks and [SEP] left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role -> opening and closing mark.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
SEP = "[SEP]"
#: Any mark: its first character, then the rest.
MARK = r"([\[<])(/?(?:INST|SYS|ROLE)\]|SEP\]|/?s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), MARK, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(SEP))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id (null is one of its own): conv_id, formatted, loss_spans.

    conversations: conv_id, turn, role, text. Null role or text counts as empty. Turns are sorted by turn (null
    first), then role and text, so ties and repeated rows have one order. loss_spans: array of (start, length) in code
    points of formatted, one for each assistant turn. A conversation is one output row and has to fit in a task.
    Empty input gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), role.alias("role"), text.alias("text"))))
    sorted_ = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))

    # each turn becomes (prefix, text, suffix): marks where its block begins or ends, [SEP] between turns of a block
    def framed(p: Column, i: Column) -> Column:
        before, after = F.get(F.col("pieces"), i - 1)["role"], F.get(F.col("pieces"), i + 1)["role"]
        opens = F.when(before.eqNullSafe(p["role"]), F.lit(SEP)).otherwise(_opening(p["role"]))
        closes = F.when(after.eqNullSafe(p["role"]), F.lit("")).otherwise(_closing(p["role"]))
        return F.struct(p["role"].alias("role"), opens.alias("opens"), p["text"].alias("text"), closes.alias("closes"))

    framed_ = sorted_.select("conv_id", pieces.alias("pieces")).select("conv_id", F.transform("pieces", framed).alias("pieces"))
    whole = F.array_join(F.flatten(F.transform("pieces", lambda p: F.array(p["opens"], p["text"], p["closes"]))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def span(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["opens"])
        size = F.length(p["text"]).cast("long")
        here = F.array(F.struct(start.cast("long").alias("start"), size.alias("length")))
        spans = F.when(p["role"] == "assistant", F.concat(s["spans"], here)).otherwise(s["spans"])
        return F.struct((start + size + F.length(p["closes"])).cast("long").alias("at"), spans.alias("spans"))

    return framed_.select("conv_id", whole.alias("formatted"), F.aggregate("pieces", zero, span, lambda s: s["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array of (role, text), read from its marks alone."""
    opening = "|".join([r"\[INST\]", r"\[SYS\]", "<s>", r"\[ROLE\]"])
    closing = "|".join([r"\[/INST\]", r"\[/SYS\]", "</s>", r"\[/ROLE\]"])
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{opening}).*?(?:{closing})"), F.lit(0))

    def turns(block: Column) -> Column:
        other = block.startswith(OTHER[0])
        role = F.lit(None).cast("string")
        body = F.lit(None).cast("string")
        for name, (a, b) in [*MARKS.items(), (None, OTHER)]:
            inside = F.substring(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))
            body = F.when(block.startswith(a), inside).otherwise(body)
            role = role if name is None else F.when(block.startswith(a), F.lit(name)).otherwise(role)
        parts = F.split(body, r"\[SEP\]", -1)
        named = F.when(other, unescape(F.get(parts, F.lit(0)))).otherwise(role)
        texts = F.when(other, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.transform(texts, lambda t: F.struct(named.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask: each span's, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
