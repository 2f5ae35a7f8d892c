"""Cleaning of raw text: eleven steps in a fixed order, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LETTERS = "áàâãéêíóôõúçü"
_UPPER = _LETTERS.upper()
#: Letters before which a mark after a digit is set apart.
LETTERS = f"A-Za-z{_UPPER}{_LETTERS}"
#: Characters that cleaned text may have, by language, as the inside of a Java character class.
ALLOWED = {"pt": rf"A-Za-z{_UPPER}{_LETTERS}\d_\s.,:;!?/°ºª²³µ%$€£¢¥₹₽()\[\]{{}}–—-"}
ALLOWED["any"] = rf"\p{{L}}\p{{M}}{ALLOWED['pt']}"

#: What names a place on the web, a book or a person's account. Longer forms come before those that they begin with.
ADDRESSES = {
    "web": r"(?:https?|ftp)://\S+",
    "bare": r"www\.[-A-Za-z0-9]+\.\S+",
    "doi": r"doi:\s*10\.\S+",
    "handle": r"\b10\.\d{4,}/\S+",
    "isbn": r"\bisbn[-:\s]+(?:97[89][-\s]?)?(?:\d[-\s]?){9,12}\d\b",
    "isbn13": r"\b97[89][-\s](?:\d[-\s]?){9}\d\b",
    "isbn10": r"\b\d[-\s](?:\d[-\s]){7,8}[\dX]\b",
    "mail": r"[-A-Z0-9._%+]+@[-A-Z0-9.]+\.[A-Z]{2,}",
    "mention": r"@\w+",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
}
ADDRESS = "(?iU)(?:" + "|".join(ADDRESSES.values()) + ")"
_EYES, _MOUTH = "[:;=]", r"[\]\[(){}<>dp3@$*/\\|]"  # Java takes a bare bracket inside a class for a nested class
_FACES = rf"(?:{_EYES}-?{_MOUTH}|{_MOUTH}-?{_EYES}|<3|xd|\^[_.]?\^|>_<|>.<|-_-|\._\.|o_o|0_0|t_t|to?t)"
EMOTICON = rf"(?iU)(?<!\S){_FACES}(?!\S)"
#: The same for a whole token between white space, for engines without lookaround.
EMOTICON_TOKEN = f"(?i){_FACES}"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Composed form, by Arrow batches: Spark has no function for it."""
    return _nfc(text)


def drop_addresses(text: Column) -> Column:
    """Addresses become blanks, in texts with any of the characters @ . / : alone."""
    return F.when(text.rlike("[@./:]"), F.regexp_replace(text, ADDRESS, " ")).otherwise(text)


def drop_emoticons(text: Column) -> Column:
    return F.regexp_replace(text, EMOTICON, " ")


def space_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\S)([{\[(])", "$1 $2"), r"(?U)([}\])])(\S)", "$1 $2")


def space_after_letters(text: Column) -> Column:
    return F.regexp_replace(text, "([A-Za-zªº°])([:;,])", "$1 $2 ")


def space_after_digits(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)(\d)([:;,])(?=[{LETTERS}])", "$1 $2 ")


def drop_repeated_marks(text: Column) -> Column:
    return F.regexp_replace(text, "[-.,:;!?]{2,}", " ")


def keep_allowed(text: Column, lang: str = "pt") -> Column:
    return F.regexp_replace(text, f"(?U)[^{ALLOWED[lang]}]", " ")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def clean(text: Column, lang: str = "pt", compose: bool = True) -> Column:
    """All steps in order. compose=False leaves out the composed form, for text that is known to be in it: then all is JVM code."""
    if compose:
        text = nfc(text)
    for step in (drop_addresses, drop_emoticons, space_brackets, space_after_letters, space_after_digits, drop_repeated_marks):
        text = step(text)
    return squeeze(keep_allowed(text, lang))
