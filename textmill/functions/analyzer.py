"""Analyzers: from a field's value to the bag of terms that is indexed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions import text

STOP_WORDS: tuple[str, ...] = tuple(
    sorted(
        {"a", "an", "and", "are", "as", "at"}
        | {"be", "but", "by", "do", "each", "for", "from"}
        | {"had", "has", "have", "he", "how"}
        | {"in", "is", "it", "its", "of", "on"}
        | {"said", "she", "that", "the", "their", "they", "this", "to"}
        | {"was", "what", "which", "will", "with"}
    )
)


@dataclass(frozen=True)
class Analyzer:
    """``tokenizer`` gets lower-case text and gives an array of tokens; ``stemmer`` maps one token.

    Stop words are compared after stemming, as the engine this follows does, so ``this`` stemmed to
    ``thi`` is indexed.
    """

    stemmer: Callable[[Column], Column] | None = None
    stop_words: tuple[str, ...] = STOP_WORDS
    tokenizer: Callable[[Column], Column] = text.tokenize

    @staticmethod
    def make(stem: bool = False, stop_words: Iterable[str] | None = None, tokenizer: Callable[[Column], Column] | None = None) -> Analyzer:
        words = STOP_WORDS if stop_words is None else tuple(sorted({w.lower() for w in stop_words}))
        return Analyzer(text.stem if stem and tokenizer is None else None, words, tokenizer or text.tokenize)

    @staticmethod
    def fast() -> Analyzer:
        """The profile of the high-throughput index: lighter stemmer, no stop words."""
        return Analyzer(text.stem_fast, ())

    def tokens(self, value: Column) -> Column:
        """Array of the terms of a text, with repetitions."""
        found = self.tokenizer(F.lower(value) if self.tokenizer is not text.tokenize else value)
        if self.stemmer is not None:
            found = F.transform(found, self.stemmer)
        if self.tokenizer is not text.tokenize:
            found = F.transform(found, lambda t: F.trim(t))
        if not self.stop_words:
            return F.filter(found, lambda t: t != "")
        return F.filter(found, lambda t: (t != "") & ~t.isin(*self.stop_words))


DEFAULT = Analyzer()
