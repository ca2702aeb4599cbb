"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role are merged into a block with array expressions; blocks are rendered
and concatenated.  One conversation becomes one string, so a conversation must
fit in a task: that is the size of the result itself, not of the method.

Template (``SEP`` parts the texts of a merged block, so merging is reversible)::

    user        [INST] text [/INST]
    system      [SYS] text [/SYS]
    assistant   [ANS] text </s>
    other role  [ROLE] role [TXT] text [/ROLE]

A control string inside a text gets one more backslash after its first
character (``[INST]`` -> ``[\\INST]`` -> ``[\\\\INST]``); reading removes one.
Control strings hold their first character nowhere else, so none can arise
where a text meets a control string.

Null texts and roles are empty; null turns sort first; equal turn numbers sort
by role, then text; rows without a conversation id form one conversation;
further columns are ignored; an empty table gives no rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ANS] ", " </s>")}
OTHER, SEP, TXT = ("[ROLE] ", " [/ROLE]"), "[SEP]", " [TXT] "
_TAIL = r"/?(?:INST|SYS|ANS|ROLE|TXT|SEP)\]|/?s>"
LOSS_ROLE = "assistant"
#: Pieces whose lengths are summed at once.
STEP = 256


def escape(text):
    return F.regexp_replace(text, rf"([\[<])(\\*)({_TAIL})", r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({_TAIL})", "$1$2$3")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask array<struct<start,length>>)`` from rows ``(conv_id, turn, role, text)``.

    ``start`` (from 0) and ``length`` count code points of ``formatted``; the
    mask covers each assistant text, without its marks.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    starts = sorted_turns.select(
        "conv_id", "t", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])).alias("starts")
    )
    merged = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("t", s)["role"].alias("role"),
                F.transform(F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s), lambda x: x["text"]).alias("texts"),
            ),
        ).alias("blocks"),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def marks(role, k):
        out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(TXT)) if k == 0 else F.lit(OTHER[1])
        for name, pair in MARKS.items():
            out = F.when(role == name, F.lit(pair[k])).otherwise(out)
        return out

    def render(block):
        loss = block["role"] == LOSS_ROLE
        texts = F.transform(
            block["texts"], lambda x, i: F.when(i == 0, F.array(segment(escape(x), loss))).otherwise(F.array(segment(F.lit(SEP), no), segment(escape(x), loss)))
        )
        return F.concat(F.array(segment(marks(block["role"], 0), no)), F.flatten(texts), F.array(segment(marks(block["role"], 1), no)))

    segments = merged.select("conv_id", F.flatten(F.transform("blocks", render)).alias("segments"))
    placed = segments.select("conv_id", "segments", _starts(F.transform("segments", lambda s: F.length(s["text"]))).alias("starts"))
    spans = F.zip_with("segments", "starts", lambda s, at: F.struct(at.alias("start"), F.length(s["text"]).alias("length"), s["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return placed.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), mask.alias("loss_mask"))


def _starts(lengths):
    """Where each of the pieces of these lengths starts, from 0.

    Sums run within STEP pieces, then over the totals of those, so that no
    array grows piece by piece over a long conversation.
    """
    none = F.from_json(F.lit("[]"), "array<int>")

    def running(part):
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("starts")), add)

    def whole(lengths):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda i: running(F.slice(lengths, i * STEP + 1, STEP)))
        return F.flatten(F.flatten(F.transform(F.array(parts), shifted)))

    def shifted(sums):
        return F.zip_with(sums, running(F.transform(sums, lambda p: p["at"]))["starts"], lambda p, at: F.transform(p["starts"], lambda x: x + at))

    return F.flatten(F.transform(F.array(lengths), whole))  # an array of one item is mapped, so that its item is made once


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read :func:`format_conversations` back: adds ``turns array<struct<role,text>>`` and ``loss_texts array<string>``."""
    ends = "|".join((r" \[/INST\]", r" \[/SYS\]", r" </s>", r" \[/ROLE\]"))

    def body(block, opening, closing):
        return F.substring(block, F.lit(len(opening) + 1), F.length(block) - len(opening) - len(closing))

    def read(block):
        inner = body(block, *OTHER)
        role, text = unescape(F.substring_index(inner, TXT, 1)), F.substring(inner, F.length(F.substring_index(inner, TXT, 1)) + len(TXT) + 1, F.length(inner))
        for name, pair in MARKS.items():
            mine = F.startswith(block, F.lit(pair[0]))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, body(block, *pair)).otherwise(text)
        return F.transform(F.split(text, r"\[SEP\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.filter(F.split("formatted", f"(?<={ends})"), lambda x: x != "")
    return formatted.select(
        *formatted.columns,
        F.flatten(F.transform(blocks, read)).alias("turns"),
        F.transform("loss_mask", lambda p: unescape(F.substring("formatted", p["start"] + 1, p["length"]))).alias("loss_texts"),
    )
