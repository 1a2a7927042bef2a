"""Tokenizers: how a text column becomes words, and how a query is cut into the same words on the driver."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: What Python's str.split() takes for white space.
_WHITE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"
_FANCY, _PLAIN = "‘’´“”–", "'''\"\"-"


@dataclass(frozen=True)
class Tokenizer:
    """column: text column to array<string>; query: the same for one Python string; name: what a saved index remembers."""

    name: str
    column: Callable[[Column], Column]
    query: Callable[[str], list[str]]

    def __call__(self, text: str | None) -> list[str]:
        if text is None:
            return []
        if not isinstance(text, str):
            raise ValueError(f"only strings can be cut into words, not {type(text).__name__}")
        return self.query(text)


def _split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE), lambda t: t != "")


_BLANKS = str.maketrans(dict.fromkeys(string.punctuation, " "))
_NO_MARKS = str.maketrans("", "", string.punctuation)
_FOLD = str.maketrans(_FANCY, _PLAIN)

#: Runs of anything but white space, as they are.
whitespace = Tokenizer("whitespace", _split, str.split)
lowercase = Tokenizer("lowercase", lambda c: _split(F.lower(c)), lambda q: q.lower().split())
#: Lower case without ASCII punctuation; a word of nothing else stays as an empty one.
stripped = Tokenizer(
    "stripped",
    lambda c: F.transform(_split(F.lower(c)), lambda t: F.regexp_replace(t, "\\p{Punct}", "")),
    lambda q: [t.translate(_NO_MARKS) for t in q.lower().split()],
)
#: ASCII punctuation becomes spaces, then typographic quotes and dashes become ASCII ones.
folded = Tokenizer(
    "folded",
    lambda c: _split(F.lower(F.translate(F.regexp_replace(c, "\\p{Punct}", " "), _FANCY, _PLAIN))),
    lambda q: q.translate(_BLANKS).translate(_FOLD).lower().split(),
)
#: The whole text as one word.
keyword = Tokenizer("keyword", lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lower(c))), lambda q: [q.lower()])
#: Every word reads "b".
constant = Tokenizer("constant", lambda c: F.transform(_split(c), lambda _: F.lit("b")), lambda q: ["b"] * len(q.split()))

NAMED = {t.name: t for t in (whitespace, lowercase, stripped, folded, keyword, constant)}


#: Bytes of text whose words are Python objects at the same time.
STRETCH = 256 << 10


def from_callable(cut: Callable[[str], Sequence[str]], name: str | None = None) -> Tokenizer:
    """Any Python function from a string to words, run on Arrow batches, of which a stretch at a time is cut; a null has no words."""

    def batch(texts: pa.Array) -> pa.Array:
        done, words, size = [], [], 0
        for t in texts:
            text = t.as_py()
            words.append(list(cut(text)) if isinstance(text, str) else [])
            size += len(text or "")
            if size >= STRETCH:
                done.append(pa.array(words, pa.list_(pa.string())))
                words, size = [], 0
        return pa.concat_arrays([*done, pa.array(words, pa.list_(pa.string()))])

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # the types themselves: this module's annotations are strings
    return Tokenizer(name or getattr(cut, "__name__", "custom"), lambda c: F.arrow_udf(batch, "array<string>")(c.cast("string")), lambda q: list(cut(q)))


def resolve(tokenizer: Tokenizer | Callable[[str], Sequence[str]] | str | None) -> Tokenizer:
    if tokenizer is None:
        return whitespace
    if isinstance(tokenizer, str):
        return NAMED[tokenizer]
    return tokenizer if isinstance(tokenizer, Tokenizer) else from_callable(tokenizer)
