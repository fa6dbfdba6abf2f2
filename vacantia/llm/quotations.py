"""Chat formatting by quotation linking: who replies to whom, without the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import fresh, rank_in_group, written

# A quoting prefix, and the line that announces a quotation in four languages.
QUOTE = r"^\s*+(?:>\s?+)++"
BLANKS = " \t\n\x0b\x0c\r"
ANNOUNCED = r"(?i)^\s*(?:on|am|le|el|il)\b.*\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$|^\s*\S+ (?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"


def parsed_lines(text: Column) -> Column:
    """Array of ``(level, body)``: how many quote marks lead the line, and the line without them."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("body"),
        ),
    )


def own_text(lines: Column) -> Column:
    """The text without quoted lines and the lines that announce them."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["body"].rlike(ANNOUNCED)
        & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) + F.coalesce(
            F.when(F.trim(F.get(lines, i + 1)["body"]) == "", F.get(lines, i + 2)["level"]), F.lit(0)) > 0)
    ))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), F.lit(BLANKS))


def passages(lines: Column) -> Column:
    """Sentences of a run of lines, normalised (lower case, single spaces), for hashing.

    Lines are joined first, so that a quotation wrapped at another width still fits.
    """
    joined = F.trim(F.regexp_replace(F.lower(F.array_join(lines, " ")), r"\s+", " "))
    return F.filter(F.split(joined, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def linked(messages: DataFrame) -> DataFrame:
    """Adds ``own_text``, ``quoted_levels``, ``parent_turn`` and ``thread_turn`` to every message.

    The quoted sentences of the outermost level of a message are hashed and joined, within the
    conversation, to the first message that has the sentence in its own text: its original. The
    parent is the earlier message that is the original of most quoted letters (ties: the later). A
    thread's root is found by following parents, in doubling steps.

    An original is a minimum per sentence, combined before the shuffle, so a sentence or conversation
    with a third of all rows costs one row a task. Messages with a NULL id or turn quote nothing
    and are quoted by none; NULL text is empty. Equal rows are linked alike. Columns with the new
    names are replaced. Marks and lines may be as many as they like: every text is read in one go.
    """
    messages = messages.drop("own_text", "quoted_levels", "parent_turn", "thread_turn")
    lines, quoted = fresh(messages.columns, "lines", "quoted")
    levels = F.transform(lines, lambda x: x["level"])
    # The outermost level is bound to a variable, so that it is found once and not for every line.
    outer = F.array(F.array_min(F.filter(levels, lambda v: v > 0)))
    of_level = F.transform(outer, lambda least: F.transform(
        F.filter(lines, lambda x: x["level"] == least), lambda x: x["body"]))
    base = written(
        messages.withColumn(lines, parsed_lines(F.col("text"))).withColumns({
            "own_text": own_text(F.col(lines)), "quoted_levels": F.array_max(levels), quoted: F.get(of_level, F.lit(0)),
        }).drop(lines),
        "messages",
    )
    valid = base.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = written(
        valid.filter("quoted_levels > 0")
        .select("conv_id", "turn", F.explode(F.array_distinct(passages(F.col(quoted)))).alias("s"))
        .select("conv_id", "turn", F.xxhash64("s").alias("h"), F.length("s").alias("n")).distinct(),
        "quoting",
    )
    own = (
        valid.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(passages(F.array("own_text"))).alias("s"))
        .groupBy("conv_id", F.xxhash64("s").alias("h")).agg(F.min("turn").alias("original"))
    )
    parents = (
        quoting.join(own, ["conv_id", "h"]).filter("original < turn")
        .groupBy("conv_id", "turn", "original").agg(F.sum("n").alias("letters"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct("letters", "original")).alias("best"))
        .select("conv_id", "turn", F.col("best.original").alias("parent_turn"))
    )
    roots = written(parents.withColumn("thread_turn", F.col("parent_turn")), "parents")
    while True:
        # A parent is always earlier, so there are no circles; every step doubles the reach.
        above = roots.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("up"))
        further = roots.join(above, ["conv_id", "thread_turn"], "left")
        if further.filter("up IS NOT NULL").isEmpty():
            break
        roots = written(further.select(
            "conv_id", "turn", "parent_turn", F.coalesce("up", "thread_turn").alias("thread_turn")
        ), "parents")
    return base.drop(quoted).join(roots, ["conv_id", "turn"], "left").withColumn(
        "thread_turn", F.coalesce("thread_turn", "turn")
    )


def conversations(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations, one row per message, ready to be written in order.

    Adds to :func:`linked` the ``position`` in the conversation (from 0): threads in the order of
    their first message, and in a thread messages by turn, so that a reply follows what it
    quotes. ``formatted`` is the message as a chat turn with its role. Messages stay rows: a
    conversation of any length is never gathered in one place. Columns of the two names are replaced.
    """
    found = linked(messages.drop("position", "formatted"))
    order = ["thread_turn", "turn"] + (["role"] if "role" in messages.columns else []) + ["own_text"]
    ranked = rank_in_group(found, ["conv_id"], order, "position")
    role = F.coalesce(F.col("role"), F.lit("user")) if "role" in messages.columns else F.lit("user")
    return ranked.withColumn("formatted", F.concat(
        F.lit("<|"), role, F.lit("|>\n"), F.col("own_text"), F.lit("\n<|end|>\n")
    ))
