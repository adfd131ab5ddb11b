"""Tokens, tags and singular forms as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom.functions import lexicon as lx
from phraseloom.functions.columns import let
from phraseloom.functions.patterns import CLITIC, DIGITS, LETTERS_OR_DIGITS, TOKEN, WORD_OR_TOKEN


def split_clitics(text: Column) -> Column:
    """A text without an apostrophe has none, and is not searched."""

    def split(t: Column) -> Column:
        marked = F.contains(t, F.lit("'")) | F.contains(t, F.lit("’"))
        return F.when(marked, F.regexp_replace(t, CLITIC, " $1")).otherwise(t)

    return let(text, split)


def tokenize(text: Column) -> Column:
    """array<string> of tokens; punctuation marks are tokens of their own."""
    return F.regexp_extract_all(split_clitics(text), F.lit(TOKEN), F.lit(0))


def shaped_tokens(text: Column) -> Column:
    """The tokens, those of another shape than ``LETTERS_OR_DIGITS`` and those
    of digits alone as empty strings: the pattern that finds a token tests it."""
    return F.regexp_extract_all(split_clitics(text), F.lit(WORD_OR_TOKEN), F.lit(1))


def is_letters_or_digits(token: Column) -> Column:
    return token.rlike(LETTERS_OR_DIGITS)


def has_content_shape(token: Column, min_length: int) -> Column:
    return (F.length(token) >= min_length) & is_letters_or_digits(token)


def is_noun(token: Column, tag: Column, min_length: int) -> Column:
    return tag.contains("NN") & has_content_shape(token, min_length)


def is_adjective_or_verb(token: Column, tag: Column, min_length: int) -> Column:
    return (tag.contains("JJ") | tag.contains("VB")) & has_content_shape(token, min_length)


def is_content(token: Column, tag: Column, min_length: int) -> Column:
    named = tag.contains("NN") | tag.contains("JJ") | tag.contains("VB")
    return named & has_content_shape(token, min_length)


def rule_tag(token: Column, lexicon: lx.Lexicon) -> Column:
    """Tag of one lower-cased token: known words, then marks, then numbers,
    then suffixes. Most tokens are settled by two tests: they are of no word
    list, and they start with a letter, so they are neither mark nor number."""
    ending = F.when(F.lit(False), lexicon.default_tag)
    for suffix, name in lexicon.suffixes:
        ending = ending.when(token.endswith(suffix), name)
    ending = ending.otherwise(lexicon.default_tag)
    tail = (
        F.when(F.left(token, F.lit(1)).between("a", "z"), ending)
        .when(token.isin(".", "!", "?"), ".")
        .when(token == ",", ",")
        .when(token.isin(":", ";"), ":")
        .when(~token.rlike(r"[\p{L}\p{N}]"), "SYM")
        .when(token.rlike(DIGITS), "CD")
        .otherwise(ending)
    )
    known = lexicon.words()
    if not any(known.values()):
        return tail
    tag = F.when(~token.isin(*{w for ws in known.values() for w in ws}), tail)
    for name, ws in known.items():
        tag = tag.when(token.isin(*ws), name)
    return tag.otherwise(tail)


def closes_phrase(token: Column, lexicon: lx.Lexicon, min_length: int, shaped: bool = False) -> Column:
    """True where ``rule_tag`` gives a tag that is no content or the token has
    not the shape of content. Same rules, without naming the tag: cheap tests
    first, and most tokens are settled by the first two. ``shaped`` tokens, of
    ``shaped_tokens``, are empty where their shape closes."""
    words = lexicon.words()
    breaks = [w for tag, ws in words.items() if not lexicon.is_content(tag) for w in ws]
    content = [w for tag, ws in words.items() if lexicon.is_content(tag) for w in ws if w not in breaks]
    rules = list(lexicon.suffixes)
    default = lexicon.is_content(lexicon.default_tag)
    while rules and lexicon.is_content(rules[-1][1]) == default:
        rules.pop()  # says what the default says
    case = F.when(F.length(token) < (max(min_length, 1) if shaped else min_length), True)
    if breaks:
        case = case.when(token.isin(*breaks), True)
    if not shaped:
        case = case.when(token.rlike(r"[^\p{L}\p{Nd}]|" + DIGITS), True)
    for i, (suffix, tag) in enumerate(rules):
        hit = token.endswith(suffix)
        if content and i == 0:
            hit = hit & ~token.isin(*content)
        case = case.when(hit, not lexicon.is_content(tag))
    return case.otherwise(not default)


def singular(token: Column) -> Column:
    """Singular of one lower-cased English word. Applied to verbs and
    adjectives as well as to nouns."""
    irregular = F.expr("map(%s)" % ", ".join(f"'{a}', '{b}'" for a, b in lx.IRREGULAR.items()))
    case = F.when(token.isin(*lx.UNCHANGED), token)
    for plural, single in lx.ENDINGS:
        fits = token.endswith(plural)
        if plural == "ies":  # ties, pies, lies
            fits = fits & (F.length(token) > len(plural) + 1)
        case = case.when(fits, F.concat(F.left(token, F.length(token) - len(plural)), F.lit(single)))
    for ending in lx.KEEP_S:
        case = case.when(token.endswith(ending), token)
    changed = case.otherwise(F.left(token, F.length(token) - 1))
    # Everything that changes ends in s or in men, or is irregular. Most words
    # leave here; in the lambdas of arrays each further rule costs all of them.
    unchanged = ~(token.endswith("s") | token.endswith("men"))
    return F.when(token.isin(*lx.IRREGULAR), F.element_at(irregular, token)).when(unchanged, token).otherwise(changed)
