"""Text functions as column expressions: they stay in the JVM and take part in code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits of the indexing rules.
RULES_VERSION = "1.0"
COLOR = r"\\?color(?:\[[^\]]*\])?\{[^\}]*\}"
LEFT_RIGHT = r"\\(?:left|right)\b"
SPACING = r"\\[,;!]|\\(?:quad|qquad|enspace)\b"
STYLE = r"\\(?:mathbf|bm|mathrm|text|textbf|mathit|mathcal|mathsf|boldsymbol)\{([^{}]*)\}"
STYLE_PASSES = 3
COLOR_STRICT = r"\\color(?:\[[^\]]*\])?\{[^\}]*\}"
SPACING_STRICT = r"\\(?:[,;!]|quad|qquad|enspace)\b"
TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+|[\p{L}\p{N}]+@\p{Nd}+|[\p{L}\p{N}]+"
STOP_WORDS = ("a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "what", "when", "where", "which", "who", "will", "with")
ABBREVIATIONS = ("approx", "et al", "Refs", "Secs", "Tabs", "dept", "prof", "Eqs", "Fig", "Ref", "Sec", "Tab", "e.g", "i.e", "vol", "Eq", "al", "dr", "no", "pp", "vs")
TAGS = ("math", "mrow", "mi", "mo", "mn", "table", "tr", "td", "th", "div", "span", "p", "a", "img", "svg", "section", "body")
TAG = r"(?s)<\s*([a-zA-Z0-9_\-]+)(?:\s+[^>]*)?>|<!--.*?-->"
COMMAND = r"\\[a-zA-Z]+"
#: A private character that stands for a full stop that ends no sentence.
_DOT = "\ue000"


@dataclass(frozen=True)
class TokenizerConfig:
    """How texts become terms."""

    lowercase: bool = True
    preserve_compound: bool = True
    remove_stopwords: bool = False
    stemming: bool = False

    def to_dict(self) -> dict[str, bool]:
        return {"lowercase": self.lowercase, "preserve_compound": self.preserve_compound, "remove_stopwords": self.remove_stopwords, "stemming": self.stemming}

    @classmethod
    def from_dict(cls, d: dict[str, bool]) -> TokenizerConfig:
        return cls(**{k: bool(v) for k, v in d.items() if k in cls.__dataclass_fields__})


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none around the text."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    tidy = collapse_space(text)
    return F.when(F.coalesce(F.length(tidy), F.lit(0)) == 0, 0).otherwise(F.length(tidy) - F.length(F.replace(tidy, F.lit(" "), F.lit(""))) + 1).cast("int")


def words(text: Column) -> Column:
    """The words between white space, in order."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def clean_latex(text: Column) -> Column:
    """A text without typesetting noise; the text itself if nothing else would remain, and empty for null."""
    t = F.coalesce(text, F.lit(""))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, COLOR, ""), LEFT_RIGHT, ""), SPACING, " ")
    for _ in range(STYLE_PASSES):
        c = F.regexp_replace(c, STYLE, "$1")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    done = bound(c, lambda x: F.when(~x.rlike(r"(?U)\S") & t.rlike(r"(?U)\S"), t).otherwise(x))
    # most texts have none of the commands
    noisy = F.contains(t, F.lit("\\")) | F.contains(t, F.lit("color"))
    plain = F.when(t.rlike(r"[ \t]{2}|\t") & t.rlike(r"(?U)\S"), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t)
    return F.when(noisy, done).otherwise(plain)


def clean_latex_strict(text: Column) -> Column:
    """The variant for noise statistics: a colour needs its backslash, spacing commands a word boundary, and a text may become blank."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COLOR_STRICT, ""), LEFT_RIGHT, ""), SPACING_STRICT, " ")
    for _ in range(STYLE_PASSES):
        c = F.regexp_replace(c, STYLE, "$1")
    return F.regexp_replace(c, r"[ \t]+", " ")


def tokens(text: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """Terms in order, with repetitions; compounds are followed by their parts. Stemming is a separate step."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(t) if config.lowercase else t, F.lit(TOKEN), F.lit(0))
    if config.preserve_compound:
        found = F.flatten(F.transform(found, lambda x: F.when(F.contains(x, F.lit("-")), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))
    if config.remove_stopwords:
        found = F.filter(found, lambda x: ~x.isin(*STOP_WORDS))
    return found


def sentences(text: Column) -> Column:
    """Sentences of a scientific text; its abbreviations end none. The text itself if it has no end."""
    kept = F.regexp_replace(text, r"(?i)(?U)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.", "$1" + _DOT)
    parts = F.filter(F.transform(F.split(kept, r"(?<=[.!?])(?U)\s+"), lambda x: F.regexp_replace(F.translate(x, _DOT, "."), r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(parts)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(items: Column, n: int = 8) -> Column:
    """All runs of ``n`` consecutive items, joined by spaces; none if there are fewer."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    return bound(items, runs)


def ngram_hashes(items: Column, n: int = 8) -> Column:
    """Hashes of all runs of ``n`` consecutive items."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, n)))

    return bound(items, runs)


def plain_title(title: Column) -> Column:
    """A title in lower case without punctuation, for the search of repeated ones."""
    return collapse_space(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", ""))


def residual_tags(text: Column) -> Column:
    """The markup tags left in a text, each once, in order of their names."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), F.lower)
    return F.array_sort(F.array_intersect(found, F.array(*map(F.lit, TAGS))))


def middle(text: Column, size: int = 400) -> Column:
    """``size`` characters around the middle."""
    return F.substring(text, F.greatest(F.floor(F.length(text) / 2) - size // 2, F.lit(0)).cast("int") + 1, F.lit(size))


def first_words(text: Column, n: int = 15) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def preview(text: Column, n: int = 120) -> Column:
    """One line of up to ``n`` characters."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)
