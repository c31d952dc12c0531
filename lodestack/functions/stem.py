"""The suffix stripping algorithm of Porter (1980), applied to a vocabulary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.functions.text import text_or_empty

# The suffixes of steps 2, 3 and 4, each with what takes its place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c for a consonant and v for a vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    end = longest(w, ("ed", "ing"))
    if end is None or "v" not in shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and short_end(w) else w


def replaced(w: str, table: dict[str, str]) -> str:
    end = longest(w, table)
    return w[: -len(end)] + table[end] if end and measure(w[: -len(end)]) else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = past(plural(word))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(w, STEP2), STEP3)
    end = longest(w, STEP4)
    if end and measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def folding() -> tuple[str, str]:
    """Accented Latin letters and the plain ones, by their decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded_tokens(c: Column | str) -> Column:
    """Runs of letters and digits of any script, lower case, without accents."""
    return F.regexp_extract_all(F.lower(F.translate(text_or_empty(c), *folding())), F.lit(r"[\p{L}\p{N}]+"), 0)
