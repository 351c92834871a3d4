"""Line-first quality rules with DataFrame functions only.

Every line is judged alone, by rules of three kinds. Punctuation: runs of marks, and long lines in which no word ends a sentence. Navigation: cells
between bars or arrows, and lines without a letter. Boilerplate: stock phrases, capitals, markup symbols. Lines that fail are removed,
and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import unused

GAP, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", "[#*$%&|<>]"
WINDOW = 5
#: Of a line's words, in percent: symbols from which it fails, cells between bars, and runs of marks such as !!.
SYMBOL_PERCENT, CELL_PERCENT, SHOUT_PERCENT = 20, 20, 20
#: Words from which a line must have one that ends a sentence, unless it is the whole text.
END_WORDS = 12
#: Of a line's letters, in percent, and letters that it must have for it to count.
CAPITAL_PERCENT, CAPITAL_LEAST = 70, 12
#: Of a text's word characters, in percent, that it may lose.
LOSS_PERCENT = 50
#: Phrases of menus and notices, of our own choice; a line of at most STOCK_WORDS words that has one fails.
STOCK = (
    "skip to content", "all rights reserved", "cookie policy", "privacy policy", "terms of use", "sign in", "log in", "subscribe to our newsletter", "click here", "read more",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "anmelden", "mehr lesen", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "iniciar sesión", "leer más", "haga clic aquí",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "se connecter", "lire la suite", "cliquez ici",
)
STOCK_WORDS = 12
CELL, SHOUT, END = "[|»›→]", "[!?]{2,}", r"""[.!?…。]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""


def words_of(text: Column) -> Column:
    """The maximal runs without white space."""
    return F.array_remove(F.split(text, GAP, -1), "")


def solid(text: Column) -> Column:
    """The code points that aren't white space."""
    return F.length(F.regexp_replace(text, GAP, ""))


def line_facts(line: Column) -> Column:
    """What the rules ask of a line, each counted once. Patterns scan a text faster here than translate() does."""
    return F.struct(
        line.alias("line"),
        F.lower(line).alias("low"),
        F.regexp_count(line, F.lit(WORD)).alias("n"),
        F.regexp_count(line, F.lit(SYMBOL)).alias("symbols"),
        F.regexp_count(line, F.lit(CELL)).alias("cells"),
        F.regexp_count(line, F.lit(SHOUT)).alias("shouts"),
        F.rlike(line, F.lit(END)).alias("ends"),
        F.length(F.regexp_replace(line, r"[^\p{L}]+", "")).alias("letters"),
        F.regexp_count(line, F.lit(r"\p{Lu}")).alias("capitals"),
    )


def line_fails(facts: Column, alone: Column) -> Column:
    """Whether a line fails; alone: whether it is the whole text."""
    n, symbols, cells, shouts, ends, letters, capitals = (facts.getField(f) for f in ("n", "symbols", "cells", "shouts", "ends", "letters", "capitals"))
    stock = F.lit(False)
    for phrase in STOCK:
        stock |= F.contains(facts.getField("low"), F.lit(phrase))
    return (
        (100 * symbols > SYMBOL_PERCENT * n)
        | (100 * cells > CELL_PERCENT * n)
        | (100 * shouts > SHOUT_PERCENT * n)
        | ((n >= END_WORDS) & ~ends & ~alone)
        | ((letters >= CAPITAL_LEAST) & (100 * capitals > CAPITAL_PERCENT * letters))
        | ((n > 0) & (letters == 0))
        | ((n <= STOCK_WORDS) & stock)
    )


def judged(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with the counts of a text, base_failed, lost_chars, kept and clean_text added.

    Words are maximal runs without white space. n_repeat_words counts the words that a window of 5 words
    covers whose words stand twice or more in the text. base_failed: under 10 words, or more than a fifth of
    them repeat. clean_text is the text without failing lines, lost_chars the word characters of these; kept is
    false if base_failed or if more than LOSS_PERCENT of word_chars are lost. Null and empty texts have
    no words and fail. Columns of docs with one of these names are replaced. No shuffle.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text")
    own = docs.drop(*new)
    p = unused(own.columns)
    names = [F.col(f"`{c}`") for c in own.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    some = own.select(*names, words_of(text).alias(p + "w"), F.split(text, "\n", -1).alias(p + "lines"))
    n = F.size(p + "w")
    window = lambda i: F.xxhash64(*[F.get(F.col(p + "w"), i + j) for j in range(WINDOW)])
    some = some.withColumn(p + "g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)))
    paired = F.array_sort(F.transform(p + "g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    some = some.withColumn(p + "s", F.when(F.size(F.array_distinct(p + "g")) < F.size(p + "g"), paired))
    same = lambda x, j: F.get(F.col(p + "s"), j).getField("g") == x.getField("g")
    twice = F.filter(p + "s", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    some = some.withColumn(p + "d", F.array_sort(F.transform(twice, lambda x: x.getField("i"))))
    # A window covers its words up to the next one's.
    covered = F.transform(p + "d", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p + "d"), j + 1) - x, F.lit(WINDOW))))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    worded = F.filter(p + "lines", lambda x: F.rlike(x, F.lit(WORD)))
    left = F.transform(F.filter(F.transform(p + "lines", line_facts), lambda x: ~line_fails(x, F.size(p + "lines") == 1)), lambda x: x.getField("line"))
    some = some.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(p + "w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        worded.alias(p + "worded"),
        repeats.alias("n_repeat_words"),
        F.array_join(left, "\n").alias("clean_text"),
    )
    some = some.withColumn("n_dup_lines", (F.size(p + "worded") - F.size(F.array_distinct(p + "worded"))).cast("long"))
    some = some.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    some = some.withColumn("lost_chars", F.col("word_chars") - solid(F.col("clean_text")))
    some = some.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOSS_PERCENT * F.col("word_chars")))
    return some.select(*names, *new)
