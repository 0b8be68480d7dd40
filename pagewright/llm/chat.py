r"""Chat formatting by grammar round trip, in DataFrame functions only.

Grammar (roles other than the three have their name in hexadecimal):

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    other      <<ROLE 6e616d65>>text<</ROLE>>

A turn is rendered as it is and parsed again; a turn that does not come back identical (its text holds a
control string, or something that reads as an escaped one) is rendered with escapes: one backslash is put
after the first character of each control string and of each string that is a control string but for
backslashes there. Reading takes one backslash away from the latter, so escaping is reversible for any
text. An escaped text holds no control string and no closing mark begins with its own end, so the parser
finds each closing mark at its first occurrence: parsing is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings without their first character.
_TAILS = r"/?s>|/?INST\]|</?SYS>>|<ROLE |</ROLE>>"
#: A control string, with any number of backslashes after its first character. The tails of the double
#: marks begin with their second "<".
_CONFLICT = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<<ROLE [0-9A-F]*>>.*?<</ROLE>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, body: Column) -> Column:
    """One turn; ``body`` is the text as it is to stand in the output."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), body, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<ROLE "), F.hex(F.encode(role, "UTF-8")), F.lit(">>"), body, F.lit("<</ROLE>>")))
    )


def _inner(turn: Column, opening: Column | int, closing: int) -> Column:
    opening = F.lit(opening) if isinstance(opening, int) else opening
    return unescape(F.substring(turn, opening + 1, F.greatest(F.length(turn) - opening - closing, F.lit(0))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""

    def one(turn: Column) -> Column:
        named = F.regexp_extract(turn, r"^<<ROLE ([0-9A-F]*)>>", 1)
        struct = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
        return (
            F.when(turn.startswith("[INST] "), struct(F.lit("user"), _inner(turn, 7, 8)))
            .when(turn.startswith("<s>"), struct(F.lit("assistant"), _inner(turn, 3, 4)))
            .when(turn.startswith("<<SYS>>"), struct(F.lit("system"), _inner(turn, 7, 8)))
            .otherwise(struct(F.decode(F.unhex(named), "UTF-8"), _inner(turn, F.length(named) + 9, 9)))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def format_turn(role: Column, text: Column) -> Column:
    """A turn rendered plainly if it is read back identical, else with escapes."""
    plain = render(role, text)
    back = parse(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text) & (F.array_join(F.regexp_extract_all(plain, F.lit(_TURN), F.lit(0)), "") == plain)
    return F.when(same, plain).otherwise(render(role, escape(text)))


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col``, ``formatted``, ``turns`` read back from it, ``round_trip``.

    Turns are rendered row by row before anything is gathered; a conversation is then one row, as it is one
    training example (it must fit a row, 2 GB). Rows are ordered by turn, ties by role and text; repeated
    rows stay repeated turns; null turns come first. A null text is an empty text and a null role the role
    with the empty name. Rows with a null id form one conversation. Other columns are ignored; an empty
    table gives no rows.
    """
    role, text = F.coalesce(F.col("_role"), F.lit("")), F.coalesce(F.col("_text"), F.lit(""))
    rows = turns.select(F.col(id_col).alias(id_col), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    rows = rows.select(id_col, F.struct("_turn", role.alias("role"), text.alias("text"), format_turn(role, text).alias("_out")).alias("_row"))
    joined = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    formatted = joined.select(id_col, F.array_join(F.transform("_rows", lambda r: r["_out"]), "").alias("formatted"), F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("_source"))
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    return back.select(id_col, "formatted", "turns", (F.col("turns") == F.col("_source")).alias("round_trip"))


def conversation_digests(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back: all turns, and the assistant texts under the loss mask."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        id_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(every, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "round_trip",
    )
