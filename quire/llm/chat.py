"""Chat formatting with DataFrame functions only.

Turns are collected as structs, sorted by turn, neighbours of one role merged by an array aggregation, and
concatenated:

    <turn role="user">text</turn>\\n<turn role="assistant">text<part/>more</turn>\\n

``&``, ``<`` and (in roles) ``"`` are escaped as ``&amp;``, ``&lt;`` and ``&quot;``, so no text can
hold a control string, and the escape is undone exactly. ``<part/>`` stands between the merged texts of a turn.
The loss mask is an array of [start, length) ranges of code points of the formatted text: the assistant's texts.

Defined cases: a null text or role is an empty one. Turns sort by turn (null first), then role, then text, so
repeated rows stay, side by side. Rows with a null conv_id form one conversation of their own. An
empty table gives no rows. Extra columns are ignored. A very long text is one turn like any other; a conversation is as long as one row may be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"
GROUP = 64  # pieces whose lengths are summed together
BLOCK = 4096  # code points of a block that ranges are cut from
OPEN, OPENED, PART, CLOSE = '<turn role="', '">', "<part/>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often and inside whichever lambda it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged(turns: Column) -> Column:
    """Runs of one role as (role, parts), from a sorted array of turns (role, text).

    A run begins where the role differs from the turn before; one slice for each run.
    """

    def runs(begins: Column) -> Column:
        def one(b: Column, k: Column) -> Column:
            n = F.coalesce(F.get(begins, k + 1), F.size(turns)) - b
            return F.struct(F.get(turns, b)["role"].alias("role"), F.transform(F.slice(turns, b + 1, n), lambda t: t["text"]).alias("parts"))

        return F.transform(begins, one)

    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return _let(begins, runs)


def _pieces(runs: Column, learned_role: str) -> Column:
    """The strings of a conversation in order: heads, texts and closings, each with whether it is learned (m)."""
    plain = lambda s: F.struct(s.alias("s"), F.lit(False).alias("m"))

    def turn(r: Column) -> Column:
        parts = F.transform(r["parts"], lambda p, i: F.array(plain(F.when(i > 0, F.lit(PART)).otherwise(F.lit(""))), F.struct(escape(p).alias("s"), (r["role"] == learned_role).alias("m"))))
        return F.concat(F.array(plain(F.concat(F.lit(OPEN), escape(r["role"]), F.lit(OPENED)))), F.flatten(parts), F.array(plain(F.lit(CLOSE))))

    return F.flatten(F.transform(runs, turn))


def _mask(pieces: Column) -> Column:
    """The ranges of the learned pieces: a fold over the sums of groups of pieces, then over the group of each."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x

    def with_sizes(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(GROUP)), lambda g: F.aggregate(F.slice(n, g + 1, GROUP), zero, add))
        base = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def with_base(at: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(at, F.floor(i / GROUP).cast("int")) + F.aggregate(F.slice(n, i - i % GROUP + 1, i % GROUP), zero, add)
                return F.when(x["m"], F.struct(start.alias("start"), F.get(n, i).alias("length")))

            return F.filter(F.transform(pieces, span), lambda s: s.isNotNull())

        return _let(base, with_base)

    return _let(F.transform(pieces, lambda x: F.length(x["s"]).cast("long")), with_sizes)


def format_chat(conversations: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask) of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def made(pieces: Column) -> Column:
        return F.struct(F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("formatted"), _mask(pieces).alias("loss_mask"))

    done = gathered.select("conv_id", F.transform(F.array(F.col("turns")), lambda t: _let(_pieces(merged(t), learned_role), made)).alias("c"))
    return done.select("conv_id", F.explode("c").alias("c")).select("conv_id", "c.formatted", "c.loss_mask")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones told apart again."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")
    both = F.transform(F.transform(turns, lambda t: F.split(t, OPENED, 2)), lambda t: F.struct(F.substring(t[0], len(OPEN) + 1, 1 << 30).alias("role"), F.split(t[1], PART).alias("parts")))
    return F.flatten(F.transform(both, lambda t: F.transform(t["parts"], lambda p: F.struct(unescape(t["role"]).alias("role"), unescape(p).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between.

    The text is cut into blocks first, so that a range costs its own length, however far in it starts.
    """

    def with_blocks(blocks: Column) -> Column:
        def stretch(s: Column) -> Column:
            first = F.floor(s["start"] / BLOCK).cast("int")
            last = F.floor((s["start"] + s["length"]) / BLOCK).cast("int")
            return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (s["start"] % BLOCK + 1).cast("int"), s["length"].cast("int"))

        return F.array_join(F.transform(mask, lambda s: unescape(stretch(s))), "")

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), 0), with_blocks)
