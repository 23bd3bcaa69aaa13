"""Quality rules as a short-circuit cascade.

A rule is a name and a function of a :class:`Text`, true if the text is to go. Features are worked out when a
rule first asks for them, so a text that an early rule rejects never pays for the later ones. The
order is learned: on a sample, each rule is timed and its rejections counted, task by task, and rules
run from the most rejections per second down. The order changes the cost, never the verdict.

Defined cases: null or empty text has no words and fails ``few_words``. Repeated rows get the same
verdict. An empty table has no sample; the rules then run as they are listed. Extra columns are kept. Very long
texts are read whole; a rule's bound holds at the bound itself (ties are kept).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.llm.shared import as_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_CAPITAL_PERCENT = 40
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 15)
SAMPLE_ROWS = 2000
WINDOW = 3
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_NOT_CAPITALS = bytes(sorted(set(range(256)) - set(range(65, 91))))
_NOT_LETTERS = bytes(sorted(set(range(256)) - set(range(65, 91)) - set(range(97, 123))))


class Text:
    """A UTF-8 text and its features, each worked out once and only if asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _NOT_WORD_HEADS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw.translate(None, _NOT_CAPITALS))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw.translate(None, _NOT_LETTERS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of three words that are found twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {w for w, n in Counter(windows).items() if n > 1}
        reach = total = 0
        for i, w in enumerate(windows):
            if w in often:
                total += i + WINDOW - max(i, reach)
                reach = i + WINDOW
        return total


_NOT_WORD_HEADS = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])  # what is left: a byte for each code point inside words

Rule = tuple[str, Callable[[Text], bool]]

#: The base rules come first only in this list; the cascade orders all of them.
BASE_RULES: list[Rule] = [
    ("few_words", lambda t: t.n_words < MIN_WORDS),
    ("repeated_windows", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
]
RULES: list[Rule] = [
    *BASE_RULES,
    ("symbols", lambda t: 100 * t.n_symbols > MAX_SYMBOL_PERCENT * t.n_words),
    ("capitals", lambda t: 100 * t.n_capitals > MAX_CAPITAL_PERCENT * t.n_letters),
    ("short_words", lambda t: t.word_chars < WORD_LENGTH[0] * t.n_words),
    ("long_words", lambda t: t.word_chars > WORD_LENGTH[1] * t.n_words),
    ("repeated_lines", lambda t: 100 * t.n_dup_lines > MAX_DUP_LINE_PERCENT * len(t.lines)),
]


def measure(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule, texts, rejected, seconds) on about ``sample_rows`` texts, whichever way the table is cut.

    Each rule starts from a text whose features are not yet worked out, so its cost stands alone.
    """
    part = min(1.0, sample_rows / max(1, docs.count()))
    keys = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]  # copies of a text, and nulls, fall in or out one by one
    sample = docs.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000_000)) < int(part * 1_000_000_000)) if part < 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: [0, 0, 0.0] for name, _ in rules}
        for batch in batches:
            for raw in batch.column(0):
                for name, test in rules:
                    text, began = Text(raw.as_py()), time.perf_counter()
                    hit = test(text)
                    row = found[name]
                    row[0] += 1
                    row[1] += hit
                    row[2] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([r[i] for r in found.values()]) for i in range(3))], names=["rule", "texts", "rejected", "seconds"])

    per_task = sample.select(as_bytes().alias("text")).mapInArrow(run, "rule string, texts long, rejected long, seconds double")
    return per_task.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("texts", "rejected", "seconds")))


def ordered(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules from the most rejections per second down; rules that reject nothing by cost."""
    seen = {r["rule"]: r for r in measure(docs, rules, sample_rows).collect()}  # one row for each rule

    def rank(item: tuple[int, Rule]):
        r = seen.get(item[1][0])
        if not r or not r["texts"]:
            return (0.0, 0.0, item[0])
        return (-r["rejected"] / max(r["seconds"], 1e-9), r["seconds"], item[0])

    return [rule for _, rule in sorted(enumerate(rules), key=rank)]


def first_failure(text: Text, rules: list[Rule]) -> str | None:
    return next((name for name, test in rules if test(text)), None)


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    order = ordered(docs, rules, sample_rows)

    def good(raw: pa.Array) -> pa.Array:
        return pa.array([first_failure(Text(t.as_py()), order) is None for t in raw], pa.bool_())

    return docs.where(arrow_udf(good, "boolean")(as_bytes()))  # only the text goes to Python, and one bit comes back


def report(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, the base features, base_failed, kept, rejected_by) for every row.

    All base features are asked for here, whatever rejects the text; ``keep_good`` skips them.
    """
    order = ordered(docs, rules, sample_rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):  # a text and its features at a time
                text = Text(raw.as_py())
                by, base = first_failure(text, order), first_failure(text, BASE_RULES) is not None
                rows.append((*(getattr(text, n) for n in names), base, by is None and not base, by))
            kinds = [pa.int64()] * len(names) + [pa.bool_(), pa.bool_(), pa.string()]
            found = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *names, "base_failed", "kept", "rejected_by"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, schema)
