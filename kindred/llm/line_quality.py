"""Quality rules, lines first.

Each line with a word is judged by itself: too many symbols, menu and table
separators instead of sentences, boilerplate phrases in a short line, or no
sentence punctuation at all in a line of many words. Failing lines are removed.
A document is rejected when the removed lines hold more than ``most_lost``
percent of its word characters, or when a measure of the whole text fails: fewer
than ``least_words`` words, or more than ``most_repeated`` percent of the words
in runs of five words that occur again in the text.

All expressions are built-in; each document is judged in its row, without a
shuffle.

Defined cases: a null or empty text has no words, fails and keeps no text. Blank
lines are removed without counting as lost. A text of any length is judged whole,
in one task. Equal lines are judged alike; repeated rows are each judged. An empty
table gives no rows. Columns of the input that have the name of an output column
are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.exprs import BLANKS, let, packed, strip, unpacked, words

LEAST_WORDS = 10
MOST_REPEATED = 20
MOST_LOST = 50
SYMBOLS = "#*$%&|<>"
SHORT_LINE = 200
LONG_LINE_WORDS = 12
#: Phrases of menus, notices and licences; compared in lower case.
BOILERPLATE = "cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|sign (up|in)|log ?in|click here|read more|javascript|licensed under|copyright|powered by"


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def without_blanks(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words that lie in a run of ``size`` words which the text has twice or more."""

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(t: Column) -> Column:
            n = F.size(t)
            none = F.lit(None).cast("struct<h:bigint,i:int>")
            before = F.concat(F.array(none), F.slice(t, 1, n - 1))
            after = F.concat(F.slice(t, 2, n - 1), F.array(none))
            same = F.zip_with(t, F.zip_with(before, after, lambda a, b: F.struct(a.h.alias("a"), b.h.alias("b"))), lambda x, y: F.when(x.h.eqNullSafe(y.a) | x.h.eqNullSafe(y.b), x.i))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            following = F.concat(F.slice(p, 2, F.size(p) - 1), F.array(F.lit(None).cast("int")))
            steps = F.zip_with(p, following, lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(tagged, lambda t: let(positions(t), total))

    def of(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - size), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(size))))
        return F.when(F.size(v) < size, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(w, of).cast("long")


def bad_line(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    chars = without_blanks(line)
    n_words = F.size(words(line))
    symbols = count_of(line, SYMBOLS) * 10 > chars
    menu = (count_of(line, "|•»›") * 4 >= n_words) & (count_of(line, "|•»›") >= 2)
    notice = (F.length(line) <= SHORT_LINE) & F.lower(line).rlike(BOILERPLATE)
    unpunctuated = (n_words >= LONG_LINE_WORDS) & (count_of(line, ".!?,;:…\"") == 0)
    return symbols | menu | notice | unpunctuated


def clean_lines(docs: DataFrame, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, most_lost: int = MOST_LOST) -> DataFrame:
    """``docs`` with clean_text, the measures, base_failed and kept."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    good = F.filter(lines, lambda x: ~bad_line(x))
    measured = packed(
        docs,
        stats=let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))),
        n_dup_lines=let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        clean_text=F.array_join(good, "\n"),
        word_chars=without_blanks(text).cast("long"),
        n_symbols=count_of(text, SYMBOLS).cast("long"),
    ).select("*", "stats.*")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * without_blanks(F.col("clean_text")) >= (100 - most_lost) * F.col("word_chars"))
    measures = ["clean_text", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words", "base_failed"]
    return unpacked(measured, docs.columns, {**{n: F.col(n) for n in measures}, "kept": kept})
