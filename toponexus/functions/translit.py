"""Arabic to Latin letters.

Our own table: consonants and long vowels by their usual plain-ASCII spelling. Scores on the Latin
path therefore need not equal those of another table to the last digit.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spelling of each sign.
LETTERS = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ٱ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh",
    "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "`",
    "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "~",
    "ة": "@", "ء": "'", "ؤ": "w'", "ئ": "y'", "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g", "ڤ": "v", "ک": "k", "ی": "y",
}
#: Vowel signs and the elongation mark.
MARKS = {"َ": "a", "ُ": "u", "ِ": "i", "ً": "an", "ٌ": "un", "ٍ": "in", "ّ": "", "ْ": "", "ـ": "", "ٰ": "a"}
TABLE = LETTERS | MARKS


@lru_cache(maxsize=1 << 16)
def latin(text: str | None) -> str:
    return "" if text is None else "".join(TABLE.get(sign, sign) for sign in text)


def latin_column(c: Column) -> Column:
    """The same as a column expression: signs of one letter at once, then those of more or none."""
    one = {a: b for a, b in TABLE.items() if len(b) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for sign, spelling in TABLE.items():
        if len(spelling) != 1:
            out = F.replace(out, F.lit(sign), F.lit(spelling))
    return out
