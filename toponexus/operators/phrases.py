"""Candidate phrases: the product of the options of a name's words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toponexus.functions.text import is_article

#: Options of a word, and phrases of a name, that the bounded form keeps.
PER_WORD, PHRASES = 5, 600


def word_options(word: Column, known: Column, per_word: int | None = PER_WORD) -> Column:
    """An article stands for itself, a word with candidates for those, any other word for itself."""
    kept = known if per_word is None else F.slice(known, 1, per_word)
    return F.when(~is_article(word) & (F.size(F.coalesce(known, F.array())) > 0), kept).otherwise(F.array(word))


def product(options: Column, most: int | None = PHRASES) -> Column:
    """All phrases in lexicographic order of the options; no options give no phrase.

    Every step is cut at ``most``. The first phrases of a product come from the first of its prefixes,
    so the cut leaves what a cut at the end would.
    """

    def step(made: Column, words: Column) -> Column:
        longer = F.flatten(F.transform(made, lambda p: F.transform(words, lambda w: F.when(p == "", w).otherwise(F.concat_ws(" ", p, w)))))
        return longer if most is None else F.slice(longer, 1, most)

    start = F.array(F.lit(""))
    made = F.aggregate(options, start, step)
    return F.when(F.size(options) > 0, made).otherwise(F.array().cast("array<string>"))


def place_in_product(options: Column, phrase: Column) -> Column:
    """The first place (from 0) of ``phrase`` in the whole product of the options, null if it is not there.

    Only beginnings of ``phrase`` are carried from word to word, so the product is never written out.
    """
    number = "decimal(38,0)"

    def step(made: Column, words: Column) -> Column:
        def longer(p: Column) -> Column:
            return F.transform(
                words, lambda w, i: F.struct(F.when(p["text"] == "", w).otherwise(F.concat_ws(" ", p["text"], w)).alias("text"), (p["nth"] * F.size(words) + i).cast(number).alias("nth"))
            )

        begun = F.filter(F.flatten(F.transform(made, longer)), lambda p: F.startswith(phrase, p["text"]))
        # of equal beginnings the first in order leads to the first place
        return F.filter(begun, lambda p: F.forall(begun, lambda q: (q["text"] != p["text"]) | (q["nth"] >= p["nth"])))

    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0).cast(number).alias("nth")))
    made = F.filter(F.aggregate(options, start, step), lambda p: p["text"] == phrase)
    return F.array_min(F.transform(made, lambda p: p["nth"]))
