"""Chat formatting with Spark expressions only.

`format_conversations` collects a conversation's turns as structs, sorts them by (turn, role, text), merges
adjacent turns of one role into a block (array functions), and concatenates the blocks:

    <|im_start|>role\\n text [<|im_sep|> text ...] <|im_end|>\\n

so that merged turns keep their boundaries. Inside texts a control opener is escaped: `<`, then any
number of backslashes, then `|` gets one backslash more; reading back takes one away, so the change is
reversible and no other character is touched. Roles are percent-coded where they could break the header line. `read_back` parses the formatted string into turns again.

A conversation is one output string, so its turns meet in one row by definition; its size is bounded by that
row. Nulls: a null text is empty, a null role is the empty role, a null conv_id is a conversation of its own,
null turns sort first. Ties of turn are ordered by role, then text (code points). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A role stands on the header line, so these characters are written as codes there (`%` first).
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted): one row for each conversation."""
    header = F.coalesce(F.col(role), F.lit(""))
    for plain, code in ROLE_CODES:
        header = F.replace(header, F.lit(plain), F.lit(code))
    turns = df.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("raw"), F.coalesce(F.col(text), F.lit("")).alias("text"), header.alias("role")).alias("t"))
    got = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # a block starts where the role differs from the turn before
    starts = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.element_at("ts", i)["raw"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["raw"]))
    got = got.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("ts") + 1))
    got = got.withColumn("blocks", F.zip_with("starts", ends, lambda a, b: F.struct(F.element_at("ts", a)["role"].alias("role"), F.transform(F.slice("ts", a, b - a), lambda t: escaped(t["text"])).alias("texts"))))
    block = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))
    return got.select(F.col("conv").alias(conv), F.array_join(F.transform("blocks", block), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped, merged turns apart."""
    parts = F.split(formatted, r"<\|im_start\|>")
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turns(block: Column) -> Column:
        header = F.substring_index(block, "\n", 1)
        role = header
        for plain, code in reversed(ROLE_CODES):
            role = F.replace(role, F.lit(code), F.lit(plain))
        body = F.substring(block, F.length(header) + 2, F.length(block) - F.length(header) - len(END) - 2)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def training_view(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds to (…, formatted) the turns read back and the text under the loss mask (that of one role)."""
    return df.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), ""))
