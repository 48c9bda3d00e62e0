"""Scalar text functions, Column -> Column. None (null) counts as "" throughout, as documents are never told from empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 1.35

# The marks that vowel stripping removes (letters, and with or without shaddah U+0651).
VOWELS = "ؗ-ًؚ-ْٖ-ٰٟ"
VOWELS_BUT_SHADDAH = "ؗ-ًؚ-ِْٖ-ٰٟ"
ARABIC = "؀-ۿ"

# Language names by code.
LANGUAGES = {"en": "English", "da": "Danish", "sw": "Swahili", "ar": "Arabic", "de": "German", "fr": "French", "es": "Spanish", "fa": "Persian", "ur": "Urdu", "tr": "Turkish"}

# Paper sizes by their other names.
PAPER = {"b5": "iso-b5", "iso-b5": "iso-b5", "isob5": "iso-b5", "a4": "a4", "iso-a4": "a4", "a5": "a5", "iso-a5": "a5", "letter": "us-letter", "us-letter": "us-letter"}

# Words dropped from the start of a term's translation.
LEAD_IN = (
    "the a an that this these those is are was were be to of in for with by on at from as it and or "
    "author authors establishes states defines explains mentions calls called known namely e.g. viz. termed term"
).split()

# Paragraph tags such as [P1], [1], P1:, ### [P 2].
TAG = r"(?:^|\n)\s*(?:[#*_\-]+\s*)?(?:\[\s*P?\s*(\d+)\s*\]|P\s*(\d+)\s*[:\-–—.)])[:\-–—.)]*(?:\s*[*_]+)?\s*"
# Lines in which a model talks to itself.
MONOLOGUE = (
    r"^\s*(?:Wait[!,]|Wait\s+a\s+moment|Let'?s\s+see|Look\s+at\s+what|In\s*,\s*|Can\s+we\s+present|First,\s+the\s+completion\s+of|Notice\s+that|Here\s+is\s+the|Untangling\s+the\s+two\s+fragments).*$",
    r"^\s*If\s+we\s+read\s+.*\s+clearly!?\s*$",
    r"^\s*Wait,\s+look\s+at\s+how\s+beautiful\s+that\s+is:?\s*$",
    r"^\s*If\s+we\s+translate\s+both\s+clauses\s+in\s*,.*$",
    r"^\s*Let'?s\s+check\s*:?\s*$",
    r"^\s*(?:Right|Left)\s+text:\s*\"[^\"]*\".*$",
    r"^\s*Formatting\s+check:?\s*$",
    r"^\s*Only\s+translate\s+what\s+is\s+in.*$",
    r"^\s*Each\s+paragraph\s+tag.*must\s+be\s+strictly\s+preserved.*$",
)
BULLET = r"^\s*[-*•]\s*[\"\'«]?([؀-ۿ\s\d.,;?!:()]+)[\"\'»]?\s*(?:->|→|:)\s*[\"\'«]?(.*?)[\"\'»]?\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


#: What Unicode calls white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.trim(text_of(x), F.lit(WHITE))


def token_count(x: Column | str) -> Column:
    n = F.length(text_of(x))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), (n / F.lit(CHARS_PER_TOKEN)).cast("int")))


def trailing_context(x: Column | str, max_tokens: int = 200) -> Column:
    """The end of a text, about max_tokens long, from a word's start."""
    if max_tokens <= 0:
        return F.lit("")
    text, most = text_of(x), int(max_tokens * CHARS_PER_TOKEN)
    tail = F.substring(text, F.length(text) - most + 1, F.lit(most)) if most else F.lit("")
    after = F.when(F.instr(tail, " ") > 0, F.substring(tail, F.instr(tail, " ") + 1, F.length(tail))).otherwise(tail)
    return F.when(F.length(text) <= most, strip(text)).otherwise(strip(after))


def strip_vowels(x: Column | str, keep_shaddah: bool = False) -> Column:
    return F.regexp_replace(text_of(x), f"[{VOWELS_BUT_SHADDAH if keep_shaddah else VOWELS}]", "")


def is_reversed(x: Column | str) -> Column:
    """Whether Arabic stands in visual order: a word begins with teh marbuta, or more words end in lam-alef reversed than begin with the article."""
    words = F.regexp_extract_all(text_of(x), F.lit(f"[{ARABIC}]+"), F.lit(0))
    article = F.size(F.filter(words, lambda w: F.startswith(w, F.lit("ال"))))
    backward = F.size(F.filter(words, lambda w: F.endswith(w, F.lit("لا"))))
    return F.exists(words, lambda w: F.startswith(w, F.lit("ة"))) | (backward > article)


def western_digits(x: Column | str) -> Column:
    return F.translate(text_of(x), "".join(chr(0x660 + i) for i in range(10)), "0123456789")


def clean_tags(x: Column | str) -> Column:
    """A text without paragraph tags."""
    text = F.regexp_replace(text_of(x), f"(?iU){TAG}", "\n")
    text = F.regexp_replace(text, r"(?iU)\[\s*P?\s*\d+\s*\]", "")
    return strip(F.regexp_replace(text, r"(?m)^[ \t]+", ""))


def sanitize(x: Column | str) -> Column:
    """A model's answer without lines in which it talks to itself, and with `- source -> target` bullets as a quote and its translation."""
    lines = F.split(F.regexp_replace(text_of(x), r"\n\z", ""), "\n")
    own = "|".join(f"(?:{p})" for p in MONOLOGUE)
    text = F.array_join(F.filter(lines, lambda line: ~line.rlike(f"(?iU){own}")), "\n")
    text = F.regexp_replace(text, f"(?mU){BULLET}", "> $1\n\n$2")
    # quotes and space around the two parts of a bullet
    return strip(text)


def clean_target(x: Column | str) -> Column:
    """A term's translation without quotes around it and function words before it."""
    text = F.regexp_replace(text_of(x), "^[ '`*\"“”„«»]+|[ '`*\"“”„«»]+\\z", "")
    words = "|".join(w.replace(".", r"\.") for w in LEAD_IN)
    text = F.array_join(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != ""), " ")
    return F.regexp_replace(text, rf"(?i)^(?:(?:{words})(?: |\z))+", "")


def language_name(x: Column | str) -> Column:
    code = F.lower(strip(x))
    known = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(F.element_at(known, code), F.concat(F.upper(F.substring(text_of(x), 1, 1)), F.lower(F.substring(text_of(x), 2, 1_000_000))))


def page_tag(skip: Column | str, take: Column | str) -> Column:
    """A file name's tag for pages skipped and taken (null: to the end)."""
    skip, take = col(skip), col(take)
    first, last = (skip + 1).cast("string"), (skip + take).cast("string")
    return F.when(take == 1, F.concat(F.lit("p"), first)).when(take.isNotNull(), F.concat(F.lit("p"), first, F.lit("-"), last)).when(skip > 0, F.concat(F.lit("p"), first, F.lit("-end"))).otherwise("")


def paper_size(x: Column | str) -> Column:
    known = F.create_map(*[F.lit(v) for pair in PAPER.items() for v in pair])
    return F.coalesce(F.element_at(known, F.lower(strip(x))), F.lit("iso-b5"))


def output_path(path: Column | str, lang: Column | str, tag: Column | str | None = None, bilingual: Column | bool = False) -> Column:
    """book.pdf, da, p10-25, bilingual: book_p10-25_bilingual_da.md"""
    stem = F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*\z", "")
    tag = F.lit("") if tag is None else text_of(tag)
    kind = F.when(F.lit(bilingual) if isinstance(bilingual, bool) else bilingual, "_bilingual").otherwise("_translated")
    return F.concat(stem, F.when(tag != "", F.concat(F.lit("_"), tag)).otherwise(""), kind, F.when(F.lower(col(lang)) != "en", F.concat(F.lit("_"), F.lower(col(lang)))).otherwise(""), F.lit(".md"))


def audit_path(path: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*\z", ""), F.lit("_audit.md"))


def pdf_path(path: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*\z", ""), F.lit(".pdf"))
