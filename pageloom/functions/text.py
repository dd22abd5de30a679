r"""Text cleaning and splitting as built-in column expressions.

All patterns are Java regular expressions that run in linear time on any input: a run of
whitespace or of non-blank characters is entered at its start only, so one page holding a
megabyte of padding or of encoded data costs no more per character than prose does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let

# Fixed values: (pattern, replacement, a literal every match contains) in the order they apply.
# The text is ASCII after the first. The e-mail and punctuation rules are written so that a long run is
# entered once, and the last rule leaves alone what already has its form.
CLEANING_RULES = [
    (r"[^\x00-\x7F]+", "", None),                                           # non-ASCII characters
    (r"http[s]?://\S+", "", "http"),                                        # URLs
    (r"(?<!\S)(?:[^\s@]++@\S+|@\S*@\S+)", "", "@"),                         # e-mail addresses
    (r"\[\d+(-\d+)?(,\s*\d+(-\d+)?)*+\]", "", "["),                         # [1], [1-3,5]
    (r"\b\d+\.\d+([eE][-+]?\d+)?\s*mg\b", "", "mg"),                        # 2.3 mg
    (r"\b\d+\.\d+([eE][-+]?\d+)?\b", "", None),                             # 1.5e-4
    (r"\[[Jj]\]\.", "", "]."),                                              # [J].
    (r"(?d)\b([A-Z][a-z]*\b\.?\s*){1,4}(\d{4}).*?\d+", "", None),  # authors, year, up to digits
    (r"\s(?<!\s\s)\s*+([,.!?])\s*|([,.!?])(?! (?![\s,.!?]))\s*", "$1$2 ", None),  # one blank after , . ! ?
    (r"\b([A-Z]\.)\s*", "$1", None),                                       # J. D. -> J.D.
    (r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f]{2,}|[\t\n\x0b\f\r\x1c\x1d\x1e\x1f]", " ", None),  # blanks collapse
]

# the first rule with a match that may hold a blank, and the rule that may match over any number of sentences
NUMBERS_RULE, AUTHORS_RULE = 3, 7

# Fixed value: a blank after . or ? ends a sentence, but not after "x.y." or "Dr."
# The blank is tested first, as nearly all positions fail on it.
SENTENCE_END = r"(?U)\s(?<=[.?]\s)(?<!\w\.\w.\s)(?<![A-Z][a-z]\.\s)"

# The characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(text: Column) -> Column:
    """Apply every cleaning rule in order; NULL stays NULL."""
    return F.trim(_steps(text, 0, len(CLEANING_RULES)))


def _steps(text: Column, first: int, end: int) -> Column:
    for step in range(first, end):
        text = cleaning_step(text, step)
    return text


def cleaning_step(text: Column, step: int) -> Column:
    """One rule of :func:`clean_text` on its own (0-based).

    A text without the rule's literal is passed on untouched, which costs a byte search in place of
    a regular expression over the decoded text.
    """
    pattern, replacement, literal = CLEANING_RULES[step]
    apply = lambda t: F.regexp_replace(t, F.lit(pattern), F.lit(replacement))
    if step == 0:
        return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(apply(t)))
    if literal is None:
        return apply(text)
    return let(text, lambda t: F.when(F.contains(t, F.lit(literal)), apply(t)).otherwise(t))


# How a text ends: so that a cleaning rule may go on in what follows, in a lower-case word, or in a capital one.
OPEN, CLOSED, NAMED = 0, 1, 2


def edges(text: Column) -> Column:
    """What tells whether texts joined by a blank may be cleaned apart: (ends, continues, begins, settles).

    They may where the first ends CLOSED, or NAMED and the second does not continue, unless a match of the
    rule for authors and years is begun and not settled. In the rules before that one a match holds no blank, or
    ends in digits, brackets or "mg"; those after it treat a full stop and the blanks behind it alike at the end of a text.

    * ends: CLOSED after a lower-case word other than "mg" with . or ?, NAMED after a capital word of two letters or more with either.
    * continues: it begins with up to three names and four digits, or is at most three names long.
    * begins: four digits stand in its last line, so that a match may go on up to the next digits.
    * settles: it has a digit or a line break, where such a match ends or fails.

    All but the first non-ASCII rule are told from the text as the rule for authors meets it.
    """
    return let(_steps(text, 0, AUTHORS_RULE), lambda t: F.struct(
        _ends(t, "+").alias("ends"), *[met(t).alias(name) for name, met in _EDGES.items()]
    ))


_EDGES = {
    "continues": lambda t: t.rlike(r"\A\s*(?:[A-Z][a-z]*\b\.?\s*){0,3}(?:\d{4}|\z)"),
    "begins": lambda t: t.rlike(r"\d{4}[^\n]*\z"),
    "settles": lambda t: t.rlike(r"[\d\n]"),
}


def _ends(t: Column, letters: str) -> Column:
    return let(F.substring_index(t, " ", -1), lambda last: (
        F.when(last.rlike(rf"(?:\A|\s)(?!mg[.?]\z)[a-z]{letters}[.?]\z"), CLOSED)
        .when(last.rlike(rf"(?:\A|\s)[A-Z][a-z]{letters}[.?]\z"), NAMED)
        .otherwise(OPEN)
    ))


# What cleaned_sentence() tells of a sentence besides how it ends, as bits of one number.
CONTINUES, BEGINS, SETTLES, JOINS = 4, 8, 16, 32


def cleaned_sentence(text: Column) -> Column:
    """(cleaned, edges): :func:`clean_text` of a sentence, and what tells whether it may be cleaned and split apart.

    ``edges`` has the bits of :func:`edges`, where CLOSED and NAMED are so after two and three letters only: then what
    ends there is a sentence of the cleaned text too, whatever stands before. JOINS: what it begins with, before the rule for
    numbers in brackets, may be matched together with the end of an OPEN text before it (a digit, "mg", or nothing at all).
    """
    bit = lambda holds, value: F.when(holds, value).otherwise(0)

    def told(head: Column, met: Column) -> Column:
        # what begins has digits, so it settles too
        digits = F.when(_EDGES["settles"](met), SETTLES + bit(_EDGES["begins"](met), BEGINS)).otherwise(0)
        return _ends(met, "{2,}") + bit(_EDGES["continues"](met), CONTINUES) + digits + bit(head.rlike(r"\A\s*(?:\d|mg|\z)"), JOINS)

    return let(_steps(text, 0, NUMBERS_RULE), lambda head: let(_steps(head, NUMBERS_RULE, AUTHORS_RULE), lambda met: F.struct(
        F.trim(_steps(met, AUTHORS_RULE, len(CLEANING_RULES))).alias("cleaned"), told(head, met).alias("edges")
    )))


def strip(text: Column) -> Column:
    """Drop blanks of every kind at both ends; ``trim`` alone would drop spaces only."""
    return F.btrim(text, F.lit(BLANKS))


def split_sentences(text: Column) -> Column:
    """Ordered array of stripped, non-empty sentences."""
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def split_cleaned(text: Column) -> Column:
    """:func:`split_sentences` of a cleaned text, which is one sentence unless it holds a full stop or a question mark and a blank."""
    several = lambda t: F.contains(t, F.lit(". ")) | F.contains(t, F.lit("? "))
    return let(text, lambda t: F.when(several(t), split_sentences(t)).otherwise(F.filter(F.array(t), lambda s: s != "")))


def distinct_sentences(text: Column) -> Column:
    """:func:`split_sentences` with later copies dropped, inside one row and without a shuffle."""
    return F.array_distinct(split_sentences(text))


def token_count(text: Column) -> Column:
    """Default token measure: runs of non-blank characters."""
    return F.regexp_count(text, F.lit(r"\S+"))


def cleaned_token_count(text: Column) -> Column:
    """:func:`token_count` of a non-empty sentence of cleaned text, whose blanks are single spaces."""
    return F.size(F.split(text, " "))


def words(text: Column) -> Column:
    """Lower-case alphanumeric terms, the vocabulary of summaries and embeddings."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
