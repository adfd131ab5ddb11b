"""Taggers: the one place where user code can enter.

A tagger turns the token array of a document into an array of tags. The rule
tagger is a native expression; ``PandasTagger`` wraps any Python function over
token lists and runs it in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phraseloom.functions import words
from phraseloom.functions.columns import BAR, fold, let
from phraseloom.functions.lexicon import ENGLISH, ENGLISH_CONTEXT, LEXICONS, ContextRule, Lexicon
from phraseloom.params import Params


class Tagger(Protocol):
    singularize: bool

    def tags(self, tokens: Column) -> Column:
        """array<string> of tags, one per token."""

    def marked_words(self, text: Column, p: Params) -> Column:
        """array<string>: the normalized word where a token is content, a bar
        where it closes the running phrase."""


class RuleTagger:
    """Closed-class words, then suffix rules; anything else is a noun."""

    def __init__(self, lexicon: Lexicon = ENGLISH):
        self.lexicon = lexicon
        self.singularize = lexicon.singularize

    def tag(self, token: Column) -> Column:
        return words.rule_tag(fold(token), self.lexicon)

    def tags(self, tokens: Column) -> Column:
        # Inside a higher-order function an expression is computed as often as
        # it is named, so each token is folded before the rules read it.
        return F.transform(F.transform(tokens, fold), lambda word: words.rule_tag(word, self.lexicon))

    def word(self, token: Column) -> Column:
        """What a phrase holds for a content token."""
        return let(fold(token), words.singular) if self.singularize else fold(token)

    def marked_words(self, text: Column, p: Params) -> Column:
        # The rules ignore case, so the text is folded once, not each token.
        def mark(token: Column) -> Column:
            word = words.singular(token) if self.singularize else token
            return F.when(words.closes_phrase(token, self.lexicon, p.min_token_length, shaped=True), BAR).otherwise(word)

        return F.transform(words.shaped_tokens(fold(text)), mark)


class ContextTagger(RuleTagger):
    """A rule tagger whose tags are then changed by an ordered list of rules
    over neighbouring tags. Every rule passes once over the tags that the one
    before it left, all places at once; a place outside the text has no tag."""

    def __init__(self, lexicon: Lexicon = ENGLISH, rules: Sequence[ContextRule] = ENGLISH_CONTEXT):
        super().__init__(lexicon)
        self.rules = tuple(rules)

    def tags(self, tokens: Column) -> Column:
        tags = super().tags(tokens)
        for rule in self.rules:
            tags = self._changed(tags, rule)
        return tags

    def _changed(self, tags: Column, rule: ContextRule) -> Column:
        def all_places(found: Column) -> Column:
            def one(tag: Column, i: Column) -> Column:
                fits = tag.isin(*rule.tag)
                if rule.after:
                    fits = fits & F.when(i > 0, F.get(found, i - 1).isin(*rule.after)).otherwise(False)
                if rule.before:
                    fits = fits & F.coalesce(F.get(found, i + 1).isin(*rule.before), F.lit(False))
                return F.when(fits, rule.to).otherwise(tag)

            return F.transform(found, one)

        return let(tags, all_places)

    def marked_words(self, text: Column, p: Params) -> Column:
        def one(token: Column, tag: Column) -> Column:
            return F.when(words.is_content(token, tag, p.min_token_length), self.word(token)).otherwise(BAR)

        return let(words.tokenize(text), lambda tokens: F.zip_with(tokens, self.tags(tokens), one))


class LanguageTagger:
    """A rule tagger per language, chosen by a column of the documents.

    Phrases made with it carry their language, and counts, corpus scalars,
    models and matches are kept per language: a word is another word in another
    language. Documents of no language, or of one without a lexicon, count as
    ``default``, so there are never more languages than lexicons. ``column`` is
    None for documents that are all of the default.
    """

    def __init__(
        self, column: str | None = "lang", lexicons: dict[str, Lexicon] = LEXICONS, default: str = ENGLISH.lang
    ):
        self.column = column
        self.default = default
        self.taggers = {lang: RuleTagger(lexicon) for lang, lexicon in lexicons.items()}

    @property
    def columns(self) -> list[str]:
        return [] if self.column is None else [self.column]

    def language(self) -> Column:
        if self.column is None:
            return F.lit(self.default)
        return F.when(F.col(self.column).isin(*self.taggers), F.col(self.column)).otherwise(self.default)

    def _chosen(self, make: Callable[[RuleTagger], Column]) -> Column:
        """What the tagger of the row's language makes; no other is evaluated."""
        rest = make(self.taggers[self.default])
        if self.column is None:
            return rest
        case = F
        for lang, tagger in self.taggers.items():
            if lang != self.default:
                case = case.when(F.col(self.column) == lang, make(tagger))
        return rest if case is F else case.otherwise(rest)

    def tag(self, token: Column) -> Column:
        return self._chosen(lambda t: t.tag(token))

    def tags(self, tokens: Column) -> Column:
        return self._chosen(lambda t: t.tags(tokens))

    def word(self, token: Column) -> Column:
        return self._chosen(lambda t: t.word(token))

    def marked_words(self, text: Column, p: Params) -> Column:
        return self._chosen(lambda t: t.marked_words(text, p))


class PandasTagger:
    """``function`` maps the tokens of one document to as many tags."""

    def __init__(self, function: Callable[[Sequence[str]], Sequence[str]], singularize: bool = True):
        self.function = function
        self.singularize = singularize

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def tag_batch(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda ts: None if ts is None else list(function(list(ts))))

        self._tag_batch = tag_batch

    def tags(self, tokens: Column) -> Column:
        return self._tag_batch(tokens)

    def marked_words(self, text: Column, p: Params) -> Column:
        return self.mark(words.tokenize(text), self.tags(words.tokenize(text)), p)

    def mark(self, tokens: Column, tags: Column, p: Params) -> Column:
        def one(token: Column, tag: Column) -> Column:
            word = words.singular(fold(token)) if self.singularize else fold(token)
            return F.when(words.is_content(token, tag, p.min_token_length), word).otherwise(BAR)

        return let(F.struct(tokens.alias("a"), tags.alias("b")), lambda s: F.zip_with(s["a"], s["b"], one))


def content_marks(tagged: Column, p: Params, singularize: bool = True) -> Column:
    """The same marks from tokens that already carry tags:
    array<struct<token,tag>>."""

    def one(t: Column) -> Column:
        word = words.singular(fold(t["token"])) if singularize else fold(t["token"])
        return F.when(words.is_content(t["token"], t["tag"], p.min_token_length), word).otherwise(BAR)

    return F.transform(tagged, one)
