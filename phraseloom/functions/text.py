"""Whole-text expressions: titles, sentences, word counts, HTML."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom.functions.columns import basename, let
from phraseloom.functions.patterns import BLANK_RUN, SENTENCE_END, TRAILING_BLANKS, at_least_words


def title(path: Column) -> Column:
    """File name without its folder and without any ``.txt`` in it."""
    return F.replace(basename(path), F.lit(".txt"), F.lit(""))


def titled_text(path: Column, text: Column) -> Column:
    return F.concat(title(path), F.lit(". "), text)


def sentences(text: Column) -> Column:
    """Pieces between end marks, blanks and empty pieces included."""
    return F.split(text, SENTENCE_END, -1)


def word_count(text: Column) -> Column:
    """Runs of non-blank characters; a leading blank counts as one more
    (empty) word, trailing blanks as none."""
    return F.when(text == "", 0).otherwise(
        F.size(F.split(F.regexp_replace(text, TRAILING_BLANKS, ""), BLANK_RUN, -1))
    )


def is_summary_sentence(sentence: Column, longer_than: int, min_words: int) -> Column:
    """``word_count(sentence) >= min_words`` as one match, plus the length."""
    return (F.length(sentence) > longer_than) & sentence.rlike(at_least_words(min_words))


# --- fixed values: character references by name -----------------------------
# The names of HTML 4, and one of XML. A blank that does not break is a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
# What follows an ampersand: a number, a number in hexadecimal, or a name.
REFERENCE = "^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));"
# Scripts and styles go first: their bodies may hold what looks like tags. What
# is never closed reaches to the end of the page. A tag ends before the next
# one begins, so a page of stray brackets is still read once.
MARKUP = (
    (r"(?is)<(?:script|style)(?:[ \t\r\n/][^<>]*+)?>.*?(?:</(?:script|style)[^<>]*+>|\z)", " "),
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?i)</(?:p|div|li|h[1-6]|article|title)>|<br ?/?>", "\n"),
    (r"<[^<>]*+>", ""),
)
LAYOUT = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))


def character(code: Column) -> Column:
    """The character of a code point; NULL where there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded_references(text: Column) -> Column:
    """Character references replaced in one pass: what a reference leaves is
    text, so ``&amp;#39;`` becomes ``&#39;``. What is no reference stays."""
    names = F.expr("map(%s)" % ", ".join(f"'{n}', {_literal(c)}" for n, c in ENTITIES.items()))

    def piece(part: Column) -> Column:
        decimal, hexadecimal, name = (F.regexp_extract(part, REFERENCE, i) for i in (1, 2, 3))
        found = (
            F.when(decimal != "", character(decimal.cast("long")))
            .when(hexadecimal != "", character(F.conv(hexadecimal, 16, 10).cast("long")))
            .when(name != "", F.try_element_at(names, name))
        )
        rest = F.substring_index(part, ";", 1)
        after = F.substr(part, F.length(rest) + 2)
        return let(found, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(c, after)))

    pieces = F.transform(F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(piece(part)))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def _literal(character: str) -> str:
    return "'" + character.replace("\\", "\\\\").replace("'", "\\'") + "'"


def html_to_text(html: Column) -> Column:
    for pattern, replacement in MARKUP:
        html = F.regexp_replace(html, pattern, replacement)
    html = let(html, decoded_references)
    for pattern, replacement in LAYOUT:
        html = F.regexp_replace(html, pattern, replacement)
    return F.regexp_replace(html, r"^[ \n]+|[ \n]+$", "")
