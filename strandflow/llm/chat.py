"""Chat formatting in budgeted windows.

Turns are marked by a template whose control strings can't occur inside an escaped text.
Prefix sums of the turns' tokens cut a conversation into spans of whole turns; a window is
the system turn, a few turns of history and the span. Only assistant texts of the span
are under the loss mask; what is repeated is masked out. Everything is decided on rows
without texts; these then travel to the place of their turn, and to the windows that have
it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BUDGET = 384
#: Turns of history at most, and the tokens they may take.
HISTORY = 2
HISTORY_TOKENS = 96
#: Tokens that a turn's marks take.
MARKS = 4

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``#`` or ``<`` is left, so no control string; each backslash starts an escape."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    """As a text, and without a colon, so that the separator's first place ends the role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\c"), F.lit(":"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """About the tokens of a text where nobody has counted them: a quarter of its bytes."""
    return F.ceil(F.octet_length(text) / 4)


def _prefixes(turns: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``turns`` (part, conv_id, ..) with, for each entry of ``sums``, the sum of a column
    over the turns before in the conversation, and with first: its first turn.

    Each part of a conversation is summed by itself and shifted by the sums of its parts
    before, so a conversation of any length is spread over many tasks, and so are turns
    that share a number.
    """
    order = ["turn", "role", "h1", "h2"]
    inside = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    per = turns.groupBy("part", "conv_id").agg(F.min(F.struct(*order, "tokens")).alias("first"), *[F.sum(c).alias(f"_{n}_all") for n, c in sums.items()])
    across = Window.partitionBy("conv_id").orderBy("part")
    shift = [F.coalesce(F.sum(f"_{n}_all").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}_shift") for n in sums]
    first = F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first")
    per = per.select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), first, *shift)
    joined = turns.join(per, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    plain = [c for c in turns.columns if c not in {f"_{n}" for n in sums} | {"first"}]
    return joined.select(*plain, "first", *[(F.col(f"_{n}") + F.col(f"_{n}_shift")).alias(n) for n in sums])


def _placements(turns: DataFrame, budget: int) -> DataFrame:
    """(h1, h2, conv_id, window, idx, context): which turn stands in which window.

    ``turns``: (conv_id, turn, role, h1, h2, tokens), with h1 and h2 naming what a turn says.
    """
    parts = turns.repartitionByRange("conv_id", "turn", "role", "h1", "h2").withColumn("part", F.spark_partition_id())
    turns = _prefixes(materialise(parts, "turns").withColumn("one", F.lit(1)), {"idx": "one", "before": "tokens"})
    system = F.when(F.col("first.role") == "system", F.col("first"))
    room = F.greatest(F.lit(budget) - HISTORY_TOKENS - F.coalesce(system["tokens"], F.lit(0)), F.lit(64))
    turns = turns.drop("one").withColumn("system", system).withColumn("room", room).withColumn("long", (F.col("tokens") * 2 > F.col("room")).cast("int"))
    turns = _prefixes(turns.drop("first"), {"longs": "long"})
    half = F.floor(F.col("before") * 2 / F.col("room"))
    span = Window.partitionBy("conv_id", half, "longs", "long")
    turns = materialise(turns.withColumn("window", F.min("idx").over(span)).select("conv_id", "h1", "h2", "tokens", "idx", "system", "window"), "numbered")
    windows = turns.groupBy("conv_id", "window").agg(F.first("system").alias("system"))
    own = turns.select("h1", "h2", "conv_id", "window", "idx", F.lit(False).alias("context"))
    # history: the turns just before the span, as far as their tokens allow
    wanted = windows.select(F.col("conv_id").alias("_conv"), F.col("window").alias("_at"), F.explode(F.sequence(F.col("window") - HISTORY, F.col("window") - 1)).alias("_idx")).where("_idx >= 0")
    back = turns.where(F.col("system").isNull() | (F.col("idx") > 0)).join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("idx") == F.col("_idx")))
    late = Window.partitionBy("conv_id", "_at").orderBy(F.desc("idx"))
    back = back.withColumn("taken", F.sum("tokens").over(late)).where(F.col("taken") <= HISTORY_TOKENS)
    history = back.select("h1", "h2", "conv_id", F.col("_at").alias("window"), "idx", F.lit(True).alias("context"))
    heads = windows.where(F.col("system").isNotNull() & (F.col("window") > 0))
    heads = heads.select("system.h1", "system.h2", "conv_id", "window", F.lit(0).cast("bigint").alias("idx"), F.lit(True).alias("context"))
    return own.unionByName(history).unionByName(heads)


def format_windows(conversations: DataFrame, budget: int = BUDGET, tokens: str = "n_tokens") -> DataFrame:
    """conv_id, window, n_context, formatted and targets ((start, length) from 1) per window.

    The first ``n_context`` turns of ``formatted`` repeat earlier ones. A span takes the
    turns that begin in the same half of the room left by the system turn and the history;
    a turn of more than half of it is a span of its own, whole even beyond the budget. The
    budget is in the tokens of the column ``tokens``, as a token count gives them; a quarter
    of the bytes stands in where that column or its value is lacking.

    Turns follow their number, ties the role and then a hash of the text; rows repeat as
    given; a null text or role is empty, null conv_ids are one conversation. Columns other
    than these are not read, and an empty table gives an empty result.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.col(tokens) if tokens in conversations.columns else F.lit(None)).cast("bigint").alias("counted"))
    name = ["conv_id", "turn", "role", "text", "counted"]  # two hashes: no two turns share both
    turns = turns.select("*", F.xxhash64(*name).alias("h1"), F.xxhash64(F.lit("second"), *name).alias("h2"))
    size = F.coalesce("counted", estimated_tokens(escape(F.col("text")))) + MARKS
    placed = _placements(turns.select("conv_id", "turn", "role", "h1", "h2", size.cast("bigint").alias("tokens")), budget)
    said = turns.groupBy("h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    turn = F.struct("idx", "role", "text", "context")
    spans = placed.join(said, ["h1", "h2"]).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    opened = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SEP))
    marked = F.transform("turns", lambda t: F.concat(opened(t), escape(t["text"]), F.lit(CLOSE)))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    start = F.struct(F.lit(1).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin, size = acc["at"] + F.length(opened(t)), F.length(escape(t["text"])).cast("bigint")
        target = F.array(F.struct(begin.cast("bigint").alias("start"), size.alias("length")))
        out = F.when((t["role"] == "assistant") & ~t["context"], F.concat(acc["out"], target)).otherwise(acc["out"])
        return F.struct((begin + size + len(CLOSE)).cast("bigint").alias("at"), out.alias("out"))

    return spans.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda t: t["context"])).alias("n_context"),
        F.array_join(marked, "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["out"]).alias("targets"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted window, unescaped."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    bare = lambda t: F.substring(t, len(OPEN) + 1, 1 << 30)
    at = lambda t: F.instr(bare(t), SEP)
    return F.transform(turns, lambda t: F.struct(unescape(F.left(bare(t), at(t) - 1)).alias("role"), unescape(F.substring(bare(t), at(t) + len(SEP), F.lit(1 << 30))).alias("text")))


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say, read back: turns and targets once each, in order.

    A target that is a turn's text travels as that turn's place. Each conversation's turns
    meet in one row, as one digest of them all needs; nothing else gathers them. Null
    conv_ids are one conversation, and an empty table gives an empty result.
    """
    w = windows.withColumn("all", read_turns(F.col("formatted")))
    own = F.slice("all", F.col("n_context") + 1, F.greatest(F.size("all") - F.col("n_context"), F.lit(0)))
    under = F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), t["start"].cast("int"), t["length"].cast("int"))))
    w = w.select("conv_id", "window", own.alias("own"), under.alias("under"), F.length("formatted").alias("chars"))
    place = lambda x: F.array_position(F.transform("own", lambda t: t["text"]), x).cast("int")
    loss = F.transform("under", lambda x: F.struct(place(x).alias("at"), F.when(place(x) == 0, x).alias("text")))
    part = F.struct("window", "own", loss.alias("loss"))
    grouped = w.groupBy("conv_id").agg(F.sum(F.size("own")).alias("n_turns"), F.sort_array(F.collect_list(part)).alias("parts"), F.sum("chars").alias("formatted_chars"))
    of_turns = lambda p: F.array_join(F.transform(p["own"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    of_loss = lambda p: F.array_join(F.transform(p["loss"], lambda x: F.when(x["at"] > 0, F.get(p["own"], x["at"] - 1)["text"]).otherwise(x["text"])), "")
    said, heard = (F.array_join(F.transform("parts", f), "") for f in (of_turns, of_loss))
    grouped = grouped.select("conv_id", "n_turns", said.alias("said"), heard.alias("loss"), "formatted_chars")
    return grouped.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
