r"""Chat formatting with a grammar that can be read back.

    conversation := turn*
    turn         := "### " head ": " body "</turn>" "\n"
    head         := "User" | "Assistant" | "System" | "@" escaped role
    body         := text without "</turn>" or "### ", in which \\ \/ \# \: stand for \ / # :

Rendered text is parsed again and the turns are compared with the source. A turn is first written as it is; where it
doesn't come back identical, its control strings are broken by a backslash; where that doesn't either (the text has
backslashes of its own that would be read as escapes), its backslashes are doubled as well, which always comes back.
"</turn>\n" doesn't overlap itself, so nothing that spans two turns can be read as its end: what holds for each turn
holds for the conversation, and the whole is compared once more all the same; one that didn't come back identical would
be written with all backslashes doubled and compared again, and `identical` tells the outcome.

Null roles and texts count as empty; rows of a conversation go by turn, equal turns by role and text, null turns
first; repeated rows are repeated turns; rows with a null conversation id form one conversation of their own.
A conversation is one string of the result, so its length is bounded by that of a string (2 GB).
Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "### ", "</turn>"
END = CLOSE + "\n"
HEADS = {"user": "User", "assistant": "Assistant", "system": "System"}
_HEAD = r"(?s)^### ((?:[^\\:]++|\\.)*+): "


def _broken(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(CLOSE), F.lit("<\\/turn>")), F.lit(OPEN), F.lit("#\\## "))


def _doubled(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#:])", "$1")


def _head(role: Column) -> Column:
    known = F
    for name, head in HEADS.items():
        known = known.when(role == name, F.lit(head))
    return known.otherwise(F.concat(F.lit("@"), F.replace(_broken(_doubled(role)), F.lit(":"), F.lit("\\:"))))


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), _head(role), F.lit(": "), body)


def read_turn(turn: Column) -> Column:
    """The parser for one turn without its end: struct(role, text, body_at, body_chars), or null if it isn't one."""
    lead = F.regexp_extract(turn, _HEAD, 0)
    head = F.regexp_extract(turn, _HEAD, 1)
    role = F
    for name, shown in HEADS.items():
        role = role.when(head == shown, F.lit(name))
    role = role.otherwise(unescape(F.substring(head, 2, 2147483647)))
    body = F.substr(turn, F.length(lead) + 1)
    fits = (lead != "") & ~F.contains(body, F.lit(CLOSE)) & ~F.contains(body, F.lit(OPEN))
    return F.when(fits, F.struct(role.alias("role"), unescape(body).alias("text"), F.length(lead).alias("body_at"), F.length(body).alias("body_chars")))


def write_turn(role: Column, text: Column) -> Column:
    """The turn with the least escaping that reads back as (role, text), its end included."""

    def same(turn: Column) -> Column:
        back = read_turn(turn)
        return F.coalesce((back["role"] == role) & (back["text"] == text), F.lit(False))

    plain, broken, strict = (_turn(role, body) for body in (text, _broken(text), _broken(_doubled(text))))
    # Only texts with a control string or a backslash can fail as they are.
    clean = ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit(CLOSE)) & ~F.contains(text, F.lit(OPEN))
    return F.concat(F.when(clean | same(plain), plain).when(same(broken), broken).otherwise(strict), F.lit(END))


def read_conversation(formatted: Column) -> Column:
    """The parser: array of read_turn() of each turn, an element null where the text doesn't fit the grammar."""
    parts = F.split(formatted, END)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), read_turn)


def loss_spans(formatted: Column) -> Column:
    """array of struct(at, chars): code points of the formatted text that bear loss, which are the assistant's bodies."""
    ends = len(END)

    def add(state: Column, turn: Column) -> Column:
        at = state["at"] + turn["body_at"]
        span = F.array(F.struct(at.alias("at"), turn["body_chars"].alias("chars")))
        return F.struct(
            (at + turn["body_chars"] + ends).alias("at"),
            F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<at:int,chars:int>>)").alias("spans"))
    return F.aggregate(read_conversation(formatted), start, add, lambda s: s["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (loss mask), identical (whether the whole reads back as the source turns)."""
    turns = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("written", write_turn(F.col("role"), F.col("text")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "written"))).alias("turns"))
    plain = F.array_join(F.col("turns.written"), "")
    strict = F.array_join(F.transform("turns", lambda t: F.concat(_turn(t["role"], _broken(_doubled(t["text"]))), F.lit(END))), "")

    def same(formatted: Column) -> Column:
        back = F.transform(read_conversation(formatted), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.coalesce(back == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))

    whole = whole.withColumn("formatted", plain).withColumn("identical", same(F.col("formatted")))
    strict_too = whole.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(strict))
    whole = strict_too.withColumn("identical", F.col("identical") | same(F.col("formatted")))
    return whole.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("spans"), "identical")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, with what can be read back from the output."""
    rows = table(spark, sf_dir, "conversations")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.expr("array(0L, 1L)")).alias("turn"))
    extra = extra.select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_chats(rows.select("conv_id", "turn", "role", "text").unionByName(extra))
    back = out.select("conv_id", "formatted", "spans", read_conversation(F.col("formatted")).alias("read"))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["at"] + 1, s["chars"]))), "")
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
