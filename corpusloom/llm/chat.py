r"""Chat formatting: render conversations to one text each, proved by parsing the text back.

Grammar of a formatted conversation, turn after turn::

    system     [SYS]text[/SYS]
    user       [INST]text[/INST]
    assistant  <s>text</s>                      (the text is under the loss mask)
    any other  [TURN]role[SAID]text[/TURN]

A text that holds one of these control strings is escaped by one backslash behind the bracket
(``[INST]`` becomes ``[\INST]``); where backslashes stand there already, one more is added. A turn
is rendered as it is, parsed back and compared, and only a text that does not come back identical
is escaped. Everything is Column expressions; a turn is rendered and proved on its own row before
rows of a conversation meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bind, scan

#: The control strings without their first bracket and slash.
NAMES = r"s>|INST\]|SYS\]|TURN\]|SAID\]"
CONTROL = rf"[<\[]/?(?:{NAMES})"
ESCAPABLE = rf"([<\[]/?)(\\*)({NAMES})"
ESCAPED = rf"([<\[]/?)\\(\\*)({NAMES})"
#: Role: opening and closing string.
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[SAID]", "[/TURN]")
AFTER_TURN = r"(?<=</s>|\[/INST\]|\[/SYS\]|\[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    """The turn in the grammar; ``text`` as given, not escaped."""
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (start, end) in TURNS.items():
        out = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
    return out


def parse_turn(piece: Column) -> Column:
    """role, text, and the length of what stands before the text and of the raw text itself.

    All null where the piece is no turn of the grammar: a control string inside its raw text is none.
    """

    def inner(start: str, end: str) -> Column:
        return F.substring(piece, len(start) + 1, F.length(piece) - len(start) - len(end))

    def turn(role: Column, before: Column, raw: Column) -> Column:
        return F.when(
            ~raw.rlike(CONTROL),
            F.struct(
                role.alias("role"), unescape(raw).alias("text"),
                before.cast("long").alias("before"), F.length(raw).cast("long").alias("chars"),
            ),
        )

    def shape(start: str, end: str) -> Column:
        return piece.startswith(start) & piece.endswith(end) & (F.length(piece) >= len(start) + len(end))

    other = inner(OTHER[0], OTHER[2])
    said = F.locate(OTHER[1], other)
    raw_role = F.substring(other, 1, said - 1)
    out = F.when(
        shape(OTHER[0], OTHER[2]) & (said > 0),
        turn(
            unescape(raw_role),
            F.lit(len(OTHER[0]) + len(OTHER[1])) + F.length(raw_role),
            F.substring(other, said + len(OTHER[1]), F.length(other)),
        ),
    )
    for name, (start, end) in TURNS.items():
        out = F.when(shape(start, end), turn(F.lit(name), F.lit(len(start)), inner(start, end))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation: role, text, start and end of the raw text, loss."""
    pieces = F.filter(F.split(formatted, AFTER_TURN), lambda p: p != "")
    turns = F.transform(
        pieces, lambda p: F.struct(parse_turn(p).alias("t"), F.length(p).cast("long").alias("n"))
    )
    none = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast(_TURN).alias("t"), none.alias("at"), none.alias("next"))
    placed = bind(
        turns,
        lambda held: scan(
            held,
            start,
            lambda s, x: F.struct(
                x["t"].alias("t"), s["next"].alias("at"), (s["next"] + x["n"]).alias("next")
            ),
        ),
    )
    return F.transform(
        placed,
        lambda x: F.struct(
            x["t"]["role"].alias("role"),
            x["t"]["text"].alias("text"),
            (x["at"] + x["t"]["before"]).alias("start"),
            (x["at"] + x["t"]["before"] + x["t"]["chars"]).alias("end"),
            (x["t"]["role"] == "assistant").alias("loss"),
        ),
    )


_TURN = "struct<role:string,text:string,before:bigint,chars:bigint>"


def format_turns(rows: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with ``_rendered`` and ``_proved``: the first rendering that parses to its source, ``_plain`` if nothing is escaped."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    plain, safe = render_turn(role, text), render_turn(role, escape(text))

    def proved(piece: Column) -> Column:
        same = bind(parse_turn(piece), lambda turn: (turn["role"] == role) & (turn["text"] == text))
        return F.coalesce(same, F.lit(False))

    return rows.withColumn("_rendered", F.when(proved(plain), plain).otherwise(safe)).withColumn(
        "_proved", proved(F.col("_rendered"))
    ).withColumn("_plain", F.col("_rendered") == plain)


def _filled(name: str) -> Column:
    return F.coalesce(name, F.lit("")).alias(name)


def format_chats(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``turns`` (read back from it), ``proved``.

    Rows stand by turn (null first), equal turns by role and text; repeated rows are turns of their
    own. Null roles and texts are empty, a null conversation id is one conversation, an empty table
    has none, other columns take no part. A conversation is one output text, so its own length is
    what a task must hold; nothing else of it is gathered.
    """
    each = format_turns(
        rows.select(
            F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
            F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
        ),
        "_role", "_text",
    )
    whole = each.groupBy("_conv").agg(
        F.array_sort(F.collect_list(F.struct("_turn", _filled("_role"), _filled("_text"), "_plain"))).alias("_all"),
        F.bool_and("_proved").alias("_proved"),
    )

    def rendered(turn: Column) -> Column:
        safe = F.when(turn["_plain"], turn["_text"]).otherwise(escape(turn["_text"]))
        return render_turn(turn["_role"], safe)

    text = whole.select("_conv", "_proved", F.array_join(F.transform("_all", rendered), "").alias("formatted"))
    return text.select(
        F.col("_conv").alias(conv_col), "formatted", parse(F.col("formatted")).alias("turns"),
        F.col("_proved").alias("proved"),
    )
