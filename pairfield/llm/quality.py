"""Quality rules: lines are cleaned first, then documents are judged by what is left.

Only DataFrame functions run here, one pass over the documents, no shuffle.

A line (split at \\n) with a word fails as
- navigation: three or more cells parted by a menu separator,
- boilerplate: at most BOILERPLATE_CHARS characters with a licence, cookie or menu phrase,
- punctuation: no sentence end in it, or marks (#*$%&|<> or doubled !) at a
  rate of more than one in MARK_EVERY words.
Failing lines are removed; a document whose removed lines hold more than
MOST_LOST of its words is rejected, as are those that fail the base rules (fewer
than 50 words, or more than half of the words in three-word windows that the
text repeats).

Null and empty texts have no words and are rejected; repeated rows are judged
one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, word_array

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_LOST = 0.5
MARK_EVERY = 5
BOILERPLATE_CHARS = 200
#: Repeated windows of a text that are looked up one by one.
FEW = 24
#: A document without any of these has no line that fails for its marks or bars.
SUSPECT = "[#*$%&|<>»•·]|!!"
SENTENCE_END = r"""[.!?…。！？]["'”’»)]*([ \t\x0B\f\r]|\z)"""
#: What boilerplate lines say, in lower case. "Sign in" and "log in" count where the line says little else.
BOILERPLATE = (
    r"(?:^|[^a-z])(?:all rights reserved|(?:licen[cs]ed|released|distributed|available) under (?:the|an?) [a-z0-9 .-]{2,40} licen[cs]e|licen[cs]ed under cc"
    r"|copyright (?:©|\(c\))|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|subscribe to our|back to top|skip to content)(?:[^a-z]|\z)"
    r"|^[^a-z]*(?:[a-z]+[^a-z]+)?(?:sign|log) in(?:[^a-z]+[a-z]+)?[^a-z]*\z"
)


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, suspect: Column) -> Column:
    """Whether a line with a word fails a line rule; suspect: its text holds marks or bars."""
    marks = _count_of(line, SYMBOLS) + 2 * (F.size(F.split(line, "!!")) - 1)
    return (
        ~line.rlike(SENTENCE_END)
        | (suspect & ((_count_of(line, "|»•·") >= 2) | (marks * MARK_EVERY > F.size(word_array(line)))))
        | ((F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE))
    )


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def spread(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def few(hashes: Column, twice: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i).otherwise(F.lit(-1)))
        return spread(F.filter(marked, lambda i: i >= 0))

    def many(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            ranked,
            lambda r: F.filter(r, lambda x, i: (F.get(r, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(r, i + 1)["h"].eqNullSafe(x["h"]))),
        )
        return spread(F.transform(again, lambda x: x["i"]))

    def counted(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda r: F.array_distinct(F.filter(r, lambda h, i: F.get(r, i - 1).eqNullSafe(h))))
        # two ways to the same count: a look-up in few repeated windows costs less than a sort
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).when(F.size(t) <= FEW, few(hashes, t)).otherwise(many(hashes)))

    return let(let(words, windows), counted)


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the base counts, the cleaned text and the verdict."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def measured(t: Column) -> Column:
        """All of it as one struct, each part bound once."""
        words = let(
            word_array(t),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                repeat_words(ws).cast("long").alias("n_repeat_words"),
            ),
        )

        def lines(suspect: Column) -> Column:
            return let(
                F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
                lambda ls: let(
                    F.transform(ls, lambda x: line_fails(x, suspect)),
                    lambda bad: F.struct(
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                        F.when(suspect, _count_of(t, SYMBOLS)).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
                        F.filter(ls, lambda x, i: F.get(bad, i)).alias("removed"),
                        F.filter(ls, lambda x, i: ~F.get(bad, i)).alias("good"),
                    ),
                ),
            )

        return F.struct(words.alias("w"), let(t.rlike(SUSPECT), lines).alias("l"))

    m = base.select(*keep, "__text", F.explode(F.array(measured(F.col("__text")))).alias("m")).select(*keep, "__text", "m.w.*", "m.l.*")
    lost = F.aggregate("removed", F.lit(0), lambda n, x: n + F.size(word_array(x)))
    judged = m.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.size("removed").cast("long").alias("n_lines_removed"),
        lost.cast("long").alias("n_words_removed"),
        F.when(F.size("removed") == 0, F.col("__text")).otherwise(F.array_join("good", "\n")).alias("clean_text"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_removed") <= MOST_LOST * F.col("n_words")))
