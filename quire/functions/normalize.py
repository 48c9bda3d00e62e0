"""The normaliser of Arabic text: one Arrow function for what needs Unicode decomposition, and none at all for texts that don't.

Texts of ASCII and plain Latin letters are unchanged by the decomposition and the Arabic rules, so only their white space is cleaned, by built-in functions; the Arrow function gets null for them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import ligatures
from quire.functions import text as T

_bidi = re.compile("[‎‏‪-‮⁦-⁩﻿​-‍]")
# Letters and hamza or madda marks, and the letter they make, in order.
RECOMPOSE = (
    ("ا", "ٕ", "إ"),
    ("ٕ", "ا", "إ"),
    ("ا", "ٔ", "أ"),
    ("ٔ", "ا", "أ"),
    ("ا", "ٓ", "آ"),
    ("ٓ", "ا", "آ"),
    ("و", "ٔ", "ؤ"),
    ("ي", "ٔ", "ئ"),
    ("ى", "ٔ", "ئ"),
)
_brackets = str.maketrans("()[]{}«»<>", ")(][}{»«><")
_eastern = {0x660 + i: str(i) for i in range(10)}


def reversed_text(text: str) -> bool:
    words = re.findall("[؀-ۿ]+", text)
    if any(w[0] == "ة" for w in words):
        return True
    backward = sum(w.endswith("لا") for w in words)
    return backward > sum(w.startswith("ال") for w in words)


def turn_line(line: str) -> str:
    """A line in visual order put in reading order; numbers already are."""
    return re.sub(r"[\d٠-٩]+", lambda m: m[0][::-1], line[::-1].translate(_brackets))


def turn(text: str) -> str:
    return "\n".join(map(turn_line, text.split("\n"))) if reversed_text(text) else text


def normalized(text: str | None, strip_vowels: bool = False, western_digits: bool = False, repair: bool = True) -> str:
    """The whole chain, in order."""
    if not text:
        return ""
    text = re.sub(ligatures.BESIDE, "", re.sub(f"[{ligatures.ARTEFACTS}]", "", text))
    text = unicodedata.normalize("NFKD", text)
    if repair:
        text = turn(text)
    text = unicodedata.normalize("NFC", _bidi.sub("", text.replace("\u0640", "")).replace("\xa0", " "))
    for first, second, whole in RECOMPOSE:
        text = text.replace(first + second, whole)
    if repair:
        text = ligatures.repair(text)
    if strip_vowels:
        text = re.sub(f"[{T.VOWELS}]", "", text)
    if western_digits:
        text = text.translate(_eastern)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n")))
    text = re.sub(r"(?m)^:\s*([؀-ۿ\s]+)$", r"\1:", text)
    return re.sub(r"(?m)^[،,:]\s*", "", text).strip()


#: Characters that the decomposition and the Arabic rules leave alone.
PLAIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"


def _function(strip_vowels: bool, western_digits: bool, repair: bool):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalized(t, strip_vowels, western_digits, repair))

    return run


def normalize(x: Column | str, strip_vowels: bool = False, western_digits: bool = False, repair: bool = True) -> Column:
    text = T.text_of(x)
    arabic = text.rlike(PLAIN)
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"(?m)^:\s*(\s+)$", "$1:")
    plain = T.strip(F.regexp_replace(plain, r"(?m)^[،,:]\s*", ""))
    return F.coalesce(_function(strip_vowels, western_digits, repair)(F.when(arabic, text)), plain)


def fix_reversed(x: Column | str) -> Column:
    """Lines in visual order turned, if the whole text is in visual order."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else turn(t))

    text = T.text_of(x)
    return F.coalesce(run(F.when(T.is_reversed(text), text)), text)


def repair_ligatures(x: Column | str) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ligatures.repair(t))

    text = T.text_of(x)
    return F.coalesce(run(F.when(text.rlike(f"[{T.ARABIC}{ligatures.ARTEFACTS}]"), text)), text)


def drop_artefacts(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(T.text_of(x), f"[{ligatures.ARTEFACTS}]", ""), ligatures.BESIDE, "")


def term_key(x: Column | str) -> Column:
    """The key under which a term is kept."""
    return T.strip(F.regexp_replace(normalize(T.strip(x), strip_vowels=True), r"(?U)\s+", " "))
