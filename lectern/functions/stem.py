"""A stemmer with the first two steps of Porter's algorithm, over distinct terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Suffixes of the second step and what replaces them, in the order in which they are tried.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}


def _shape(word: str) -> str:
    """``v`` for vowels, ``c`` for others; a y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or ch == "y" and out.endswith("c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends with consonant, vowel and a consonant other than w, x and y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one term; terms of one or two characters stay as they are."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                    if word[-1] not in "lsz":
                        word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for end, new in SECOND.items():
        if word.endswith(end):
            if _measure(word[: -len(end)]) > 0:
                word = word[: -len(end)] + new
            break
    return word


def stem_tokens(df: DataFrame, column: str = "tokens") -> DataFrame:
    """``df`` with the terms in an array column replaced by their stems; null stays null."""
    kind = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            new = pa.array([None if x is None else [None if w is None else stem(w) for w in x] for x in b.column(i).to_pylist()], pa.list_(pa.string()))
            yield b.set_column(i, column, new)

    return df.mapInArrow(run, kind)


def stemmed_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """``(term, stem)`` of each distinct non-null term: work in proportion to the vocabulary, not to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0)
            yield pa.RecordBatch.from_arrays([t, pa.array([stem(w) for w in t.to_pylist()], pa.string())], names=["term", "stem"])

    return terms.select(F.col(column).alias("term")).where("term is not null").distinct().mapInArrow(run, "term string, stem string")
