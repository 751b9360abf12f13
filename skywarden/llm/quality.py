"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects a document. Each rule's rejection rate and run time are estimated on a sample, and the
rules are ordered by rejections per second; in the cascade a rule is evaluated only for documents that all earlier rules
let through. The order changes the time, never the verdict.

The rules: fewer than 50 words; more than half of the words inside repeated 3-word windows; mean word length outside 2.5 to
12; more than one symbol in ten words; more than 40 % of the lines equal to an earlier line.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.session import written

SAMPLE_ROWS = 2000
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    """Words of a text; none for a null one."""
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def letters(text: Column) -> Column:
    """Code points outside white space."""
    return F.coalesce(F.length(F.regexp_replace(text, SPACES, "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")), lambda x: x.rlike(WORD))


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, also where the function reads it inside a lambda."""
    return F.transform(F.array(value), function)[0]


def _hashed_places(words: Column) -> Column:
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def _covered(ordered: Column) -> Column:
    def repeated(x: Column, k: Column) -> Column:
        return (F.get(ordered, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, k + 1)["h"].eqNullSafe(x["h"]))
    return F.size(F.array_distinct(F.flatten(F.transform(
        F.filter(ordered, repeated), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Window hashes are sorted with their places; a window is repeated if a neighbour has its hash.
    """
    return bound(words, lambda w: bound(_hashed_places(w), _covered))


def repeated_lines(rows: Column) -> Column:
    return bound(rows, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each row."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", "text", word_list(t).alias("words"), lines(t).alias("lines"))
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), letters(t).alias("word_chars"),
        symbols(t).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        repeated_lines(F.col("lines")).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))


def rules(n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column,
          n_repeat_words: Column) -> dict[str, Column]:
    """Conditions that reject, over columns or over expressions of the text."""
    return {
        "few_words": n_words < 50,
        "repeated_words": 100 * n_repeat_words > 50 * n_words,
        "word_length": (2 * word_chars < 5 * n_words) | (word_chars > 12 * n_words),
        "symbols": 10 * n_symbols > n_words,
        "repeated_lines": 10 * n_dup_lines > 4 * n_lines,
    }


def text_rules(text: str = "text") -> dict[str, Column]:
    """The rules as expressions of the text itself, so that a rule that is not reached costs nothing."""
    t = F.col(text)
    words, rows = word_list(t), lines(t)
    return rules(F.size(words), letters(t), symbols(t), F.size(rows), repeated_lines(rows),
                 repeated_words(words))


def estimated_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, estimated on a sample of about ``sample_rows`` documents of the whole table.

    The sample is drawn by all tasks of the scan and only then put into one file. A rule is timed twice and the shorter time
    counts, as the first run also compiles it. An empty table keeps the order given.
    """
    found = text_rules(text)
    rows = docs.select(F.count(F.lit(1))).first()[0]
    if not rows:
        return list(found)
    sample = written(docs.select(text).sample(min(1.0, sample_rows / rows), seed=7).repartition(1), "sample")
    sample.agg(F.count(text)).first()
    score = {}
    for name, rule in found.items():
        seconds = []
        for _ in range(2):
            began = time.perf_counter()
            rejected, seen = sample.agg(F.count_if(rule), F.count(F.lit(1))).first()
            seconds.append(time.perf_counter() - began)
        score[name] = rejected / max(seen, 1) / min(seconds)
    return sorted(score, key=lambda name: -score[name])


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = None
    for name in order:
        verdict = F.when(conditions[name], name) if verdict is None else verdict.when(conditions[name], name)
    return verdict


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, all measures, base_failed, kept and rejected_by (first rule of the cascade that rejects).

    A null or empty text has no words and fails. Repeated rows are judged each for itself. Other columns are not looked at.
    """
    order = order or estimated_order(docs, text)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    found = rules(*(F.col(n) for n in names))
    return measured(docs, doc_id, text).select(
        "*", (found["few_words"] | found["repeated_words"]).alias("base_failed"), cascade(found, order).alias("rejected_by")
    ).withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns; each rule runs only on what earlier rules let through."""
    order = order or estimated_order(docs, text)
    return docs.where(cascade(text_rules(text), order).isNull())
