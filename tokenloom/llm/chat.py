"""Chat formatting (6): conversations as training windows of a token budget, in DataFrame functions alone.

A turn is ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside texts and roles are escaped reversibly, so only the
template's own marks are marks.  Prefix sums of the turns' tokens (runs of non-space characters, plus the marks) choose
the windows: a conversation's token line is cut every ``budget`` tokens, the turns that lie within a piece are a window,
and a turn that crosses a cut is one of its own.  So a window never has more new tokens than ``budget``, unless a single
turn has.  Every window begins with the system turn, then repeats the latest turns of up to ``history`` tokens, then has
its new turns.  The loss mask covers the assistant's new texts alone: repeated turns are masked, so each text counts once.

Defined cases: null text and null role count as empty; turns come in the order of (turn, role, text), null first, so
repeated rows are repeated turns; a null conversation id is a conversation; other columns are ignored; a first turn of
role ``system`` is the system turn; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of this template, and the control strings of common chat formats.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARK = "\ue000"                 # begins an escape; itself written as MARK + "0"
NEWLINE = "\n"
MARK_TOKENS = 3


def escaped(text: Column, newline: bool = False) -> Column:
    """Without control strings (and line ends, if asked): each is MARK and a letter, and MARK is MARK and a zero."""
    out = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    for letter, control in zip("abcdefgh", CONTROL):
        out = F.replace(out, F.lit(control), F.lit(MARK + letter))
    return F.replace(out, F.lit(NEWLINE), F.lit(MARK + "n")) if newline else out


def unescaped(text: Column) -> Column:
    """The text before ``escaped``.  An escaped text has no MARK but those that begin an escape; the zero comes last."""
    out = text
    for letter, control in [*zip("abcdefgh", CONTROL), ("n", NEWLINE)]:
        out = F.replace(out, F.lit(MARK + letter), F.lit(control))
    return F.replace(out, F.lit(MARK + "0"), F.lit(MARK))


def _turns(df: DataFrame, budget: int, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn with its formatted text, tokens, and the tokens of the turns before it."""
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", escaped(F.col("role"), True).alias("r"), escaped(F.col("text")).alias("t"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(OPEN), "r", F.lit(NEWLINE)).alias("head"), "t",
                       (F.regexp_count("t", F.lit(r"\S+")) + MARK_TOKENS).cast("bigint").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    system = F.first(F.when((F.col("n") == 1) & (F.col("role") == "system"), F.concat("head", "t", F.lit(CLOSE)))).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    own = F.floor(F.col("before") / budget)
    crosses = F.col("before") + F.col("tokens") > (own + 1) * budget
    return rows.withColumn("system", system).withColumn("window", (2 * own + crosses.cast("int")).cast("bigint"))


def formatted_windows(df: DataFrame, budget: int = 512, history: int = 128, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, ``window``, ``formatted``, ``repeated`` (turns at its head that are not new),
    ``loss`` (spans of characters: start, length), ``tokens``."""
    turns = _turns(df, budget, conv, turn, role, text)
    # The turns before, as far as their tokens fit; prefix sums grow by at least MARK_TOKENS a turn, which bounds the frame.
    recent = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    plain = F.when((F.col("n") > 1) | F.col("system").isNull(), F.struct(F.concat("head", "t", F.lit(CLOSE)).alias("s"), "tokens"))
    turns = turns.withColumn("past", F.collect_list(plain).over(recent))
    inside = Window.partitionBy("conv_id", "window").orderBy("n")
    turns = turns.withColumn("first", F.row_number().over(inside) == 1)
    # A window's own lead: the system turn unless the window begins with it, then the repeated turns.
    lead_system = F.when((F.col("n") > 1) & F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<string>"))
    lead = F.when(F.col("first"), F.concat(lead_system, F.col("past.s")))
    turns = turns.withColumn("lead", lead).drop("past", "system")
    groups = turns.groupBy("conv_id", "window").agg(
        F.max("lead").alias("lead"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("n", "head", "t", "role"))).alias("turns"))
    head = F.array_join("lead", "")
    body = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["t"], F.lit(CLOSE))), "")
    ends = F.aggregate(
        "turns", F.struct(F.length(head).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["t"]) + len(CLOSE)).alias("at"),
            F.when(x["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["head"])).alias("start"), F.length(x["t"]).alias("length"))))).otherwise(a["spans"]).alias("spans")))
    return groups.select("conv_id", "window", F.concat(head, body).alias("formatted"), F.size("lead").alias("repeated"),
                         ends["spans"].alias("loss"), "tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows alone: its turns and the texts under the loss mask, in order."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0)))
    turns = F.transform(new, lambda x: F.struct(
        unescaped(F.regexp_replace(F.substring_index(x, NEWLINE, 1), r"^<\|turn\|>", "")).alias("role"),
        unescaped(F.substr(x, F.instr(x, NEWLINE) + 1)).alias("text")))
    targets = F.transform("loss", lambda x: unescaped(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    each = windows.select("conv_id", F.struct("window", turns.alias("turns"), targets.alias("targets"),
                                              F.length("formatted").cast("bigint").alias("chars")).alias("w"))
    grouped = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("w.chars").alias("formatted_chars"))
    return grouped.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.targets").alias("targets"), "formatted_chars")


def report(df: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Digests of what ``read_back`` finds, one row per conversation."""
    found = read_back(formatted_windows(df, budget, history))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return found.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                        F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def probe(df: DataFrame) -> DataFrame:
    """``df`` plus conversation -7, whose texts hold control strings."""
    rows = [f"SELECT -7L AS conv_id, {n}L AS turn, '{role}' AS role, '</s>[INST] ok [/INST]' AS text"
            for n, role in enumerate(("user", "assistant"))]
    return df.select("conv_id", "turn", "role", "text").unionByName(df.sparkSession.sql(" UNION ALL ".join(rows)))
