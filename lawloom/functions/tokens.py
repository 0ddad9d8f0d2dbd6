"""Token counts behind a small interface.

The default is a pattern whose matches are counted by the JVM: words and single marks. Its
counts are not those of any model's vocabulary. A vocabulary file can take its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a token by default.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("int")


@dataclass(frozen=True)
class PatternTokenizer:
    """Counts and cuts text by the default pattern; the cuts keep all text between tokens."""

    pattern: str = TOKEN

    def column(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern)).cast("int")

    def count(self, text: str) -> int:
        return sum(1 for _ in re.finditer(self.pattern, text, re.ASCII))

    def cut(self, text: str, size: int) -> list[str]:
        starts = [m.start() for m in re.finditer(self.pattern, text, re.ASCII)][::size]
        if not starts:
            return [text] if text else []
        bounds = [0, *starts[1:], len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@dataclass(frozen=True)
class VocabularyTokenizer:
    """The same by a vocabulary file of the tokenizers library, given by its path."""

    path: str

    def _load(self):
        from tokenizers import Tokenizer

        if self.path not in _LOADED:
            _LOADED[self.path] = Tokenizer.from_file(self.path)
        return _LOADED[self.path]

    def column(self, text: Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found = self._load().encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
                yield pd.Series([len(x.ids) for x in found], dtype="int32")

        return F.pandas_udf(run, "int")(text)

    def count(self, text: str) -> int:
        return len(self._load().encode(text, add_special_tokens=False).ids)

    def cut(self, text: str, size: int) -> list[str]:
        spans = self._load().encode(text, add_special_tokens=False).offsets
        bounds = [0, *[a for a, _ in spans][size::size], len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_LOADED: dict = {}
