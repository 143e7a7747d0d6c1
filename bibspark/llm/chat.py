"""Chat formatting into token-budgeted, turn-aligned windows.

Prefix sums of turn tokens cut each conversation into spans of whole turns. Every window keeps
the system turn, repeats a limited history before its own turns, and carries a loss mask that
covers each assistant text once: repeated turns are masked.

Template of a turn: ``### role: text </turn>`` and a newline. In roles and texts ``\\``, ``#``
and ``<`` are escaped (in roles also ``:``), so that no control string can occur inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import word_count

HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
ESCAPES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column, colon: bool = False) -> Column:
    """The text without control strings; unescaped() is its inverse."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in ESCAPES[: 3 if colon else 2]:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """Undoes escaped(): pairs of backslashes are found from the left, then the codes between."""

    def plain(part: Column) -> Column:
        for char, code in ESCAPES:
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def piece(role: Column, text: Column) -> Column:
    """A formatted turn."""
    return F.concat(F.lit(HEAD), escaped(role, True), F.lit(COLON), escaped(text), F.lit(TAIL))


def head_length(role: Column) -> Column:
    return F.length(escaped(role, True)) + len(HEAD) + len(COLON)


def format_windows(conversations: DataFrame, budget: int = 512, history_tokens: int = 128, history_turns: int = 2, target: str = "assistant") -> DataFrame:
    """A row for each window: conv_id, window, formatted, n_repeated, loss, n_tokens, over_budget.

    ``loss`` lists (start, length) in code points of ``formatted``. A turn has its words plus
    TURN_TOKENS tokens. A window holds ``budget`` tokens at most: the system turn (the first
    turn if its role is ``system``), up to ``history_turns`` earlier turns within
    ``history_tokens`` and what its own turns leave, then its own turns. A turn of over
    ``history_tokens`` has a window to itself, and goes over budget only if it alone does so.
    Null roles and texts are empty, null conversation ids are one conversation, turns with the
    same number follow each other by role and text, repeated rows are repeated turns, and other
    columns are ignored. An empty table gives no rows. Conversations are never gathered: one
    sorted pass of window functions for each, then a group of at most ``budget`` tokens.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tok": word_count(F.col("text")) + TURN_TOKENS, "chars": F.length(piece(F.col("role"), F.col("text"))).cast("long")})
    rows = rows.withColumns(
        {
            "i": F.row_number().over(order) - 1,
            "end": F.sum("tok").over(so_far),
            "char_end": F.sum("chars").over(so_far),
            "first": F.first(F.struct("role", "text", "tok")).over(so_far),
            "long": F.col("tok") > history_tokens,
            "was": F.lag(F.col("tok") > history_tokens).over(order),
            "past": F.array(*(F.lag(F.struct("role", "text", "tok")).over(order) if k == 1 else F.lag(F.struct("role", "text", "tok"), k).over(order) for k in range(1, history_turns + 1))) if history_turns else F.array().cast("array<struct<role:string,text:string,tok:bigint>>"),
        }
    )
    rows = rows.withColumn("system", F.col("first.role") == "system").withColumn("system_tok", F.when(F.col("system"), F.col("first.tok")).otherwise(0))
    opens = F.col("was").isNull() | F.col("long") | F.col("was")
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("system_tok"))
    rows = rows.withColumn("base", F.last(F.when(opens, F.col("end") - F.col("tok")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("cell", F.floor((F.col("end") - F.col("base") - 1) / room)).withColumn("opens", opens)
    starts = F.col("opens") | (F.col("cell") != F.lag("cell").over(order))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("window", F.sum("starts").over(so_far) - 1)
    # a window's own tokens: a run of short turns in a cell of `room` may start up to
    # history_tokens - 1 before it, or one long turn
    own = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "role", "text", (F.col("char_end") - F.col("chars")).alias("at")))).alias("own"),
        F.sum("tok").alias("own_tok"),
        F.min(F.struct("i", "past")).alias("lead"),
        F.max(F.when(F.col("system"), F.col("first"))).alias("system"),
    )
    start = F.col("lead.i")
    kept = F.col("system").isNotNull() & (start > 0)
    system_tok = F.when(F.col("system").isNotNull(), F.when(start > 0, F.col("system.tok")).otherwise(0)).otherwise(0)
    spare = F.greatest(F.lit(0), F.least(F.lit(history_tokens), F.lit(budget) - system_tok - F.col("own_tok")))
    # the k-th turn before the window; the system turn is kept already and isn't repeated twice
    past = F.col("lead.past")
    usable = [(start - k >= F.when(kept, 1).otherwise(0)) for k in range(1, history_turns + 1)]
    used, upto = F.lit(0), F.lit(0)
    for k in range(history_turns):
        upto = upto + F.coalesce(past[k]["tok"], F.lit(0))
        used = F.when(usable[k] & (upto <= spare), F.lit(k + 1)).otherwise(used)
    out = own.withColumns({"used": used.cast("int"), "kept": kept})
    history = F.reverse(F.slice(past, 1, F.col("used")))
    repeats = F.concat(
        F.when(F.col("kept"), F.array(piece(F.col("system.role"), F.col("system.text")))).otherwise(F.array().cast("array<string>")),
        F.transform(history, lambda t: piece(t["role"], t["text"])),
    )
    out = out.withColumn("prefix", F.array_join(repeats, ""))
    base = F.col("own")[0]["at"]
    loss = F.transform(
        F.filter(F.col("own"), lambda t: t["role"] == target),
        lambda t: F.struct((F.length("prefix") + t["at"] - base + head_length(t["role"])).alias("start"), F.length(escaped(t["text"])).cast("long").alias("length")),
    )
    tokens = F.aggregate(history, F.col("own_tok") + system_tok, lambda a, t: a + t["tok"])
    return out.select(
        "conv_id",
        "window",
        F.concat("prefix", F.array_join(F.transform("own", lambda t: piece(t["role"], t["text"])), "")).alias("formatted"),
        (F.col("kept").cast("int") + F.col("used")).alias("n_repeated"),
        loss.alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, from its text alone."""
    pieces = F.filter(F.split(formatted, TAIL), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, COLON)
        role = F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(p, at + len(COLON))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the mask covers, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests and lengths of each conversation, read from its windows.

    The digest is one value over all turns of a conversation, so here they do meet in a row.
    """
    turns = F.slice(parsed(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parsed(F.col("formatted"))) - F.col("n_repeated")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = windows.select(
        "conv_id",
        F.struct("window", F.size(turns).alias("n"), lines.alias("lines"), loss_text(F.col("formatted"), F.col("loss")).alias("loss")).alias("w"),
        F.length("formatted").cast("long").alias("chars"),
    )
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    text, loss = F.array_join(F.col("w.lines"), ""), F.array_join(F.col("w.loss"), "")
    return rows.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
