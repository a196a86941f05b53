"""Text statistics of documents, and the documents that are not running prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .quality_holdout import HOLDOUT

#: Documents whose statistics reach the driver, about: those with the least hashes of key and text. Never more than twice as many.
SAMPLE = 20_000
#: Documents of the sample with a weak label of prose that are trained on; of the other kinds, which are fewer, all.
PROSE = 3_000
KINDS = ("prose", "list", "table", "junk")
#: Share of a text that isn't running sentences beyond which its weak label isn't prose.
SHARE = 0.75
#: Words among which repeated ones are counted.
WINDOW = 250

STATISTICS = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "end_mark_share", "short_line_share", "mean_line_length", "words_per_mark", "unique_share", "top_pair_share", "noisy_share", "long_word_share", "separated_share", "bullet_share", "symbol_kinds", "mixed_share", "prose_share", "list_share", "table_share", "code_share", "bare_share")

#: What the classifier sees: not the sizes, as a kind doesn't depend on a text's length, and not the shares of kinds of
#: lines by which the weak labels are made, so that it goes by other evidence where those rules err.
LABELLED_BY = ("prose_share", "list_share", "table_share", "code_share", "bare_share")
FEATURES = [i for i, c in enumerate(STATISTICS) if c not in ("n_chars", "n_words", "n_lines", "mean_line_length", *LABELLED_BY)]

_END = re.compile(r"[.!?…。！？।؟][\"”’»“)）」\]]*(?:\[\d+\])?\s*\Z")
_MARK = re.compile(r"[.!?…।؟](?=[\s\"”’»“)\[]|\Z)|[。！？]")
#: Combining marks that stand inside words.
_MARKS = "̀-ًͯ-ٟऀ-ःऺ-ॏัิ-ฺ็-๎"
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")
_SYMBOL = re.compile(rf"[^\w\s{_MARKS}]+")
_ALIGNED = re.compile(r"\S(?: {3,}|\t)\S|\S {2,}\S.*\S {2,}\S")
_CSV = re.compile(r"[^,]{1,60}(?:,[^,\s][^,]{0,60}|,(?=,|\Z)){2,}\Z|[^;]{1,60}(?:;[^;]{1,40}){3,}\Z")
_HEX = re.compile(r"[0-9a-fA-F]{6,8}:? +(?:[0-9a-fA-F]{2,4} ){4}")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
_CODE = re.compile(r"\s*(?:def \w+\(|return\b|import \w|from \w+ import|class \w+|for .*[:{]\Z|if .*[:{]\Z|while .*[:{]\Z|#include|(?:var|let|const|int|float) \w+ ?=|[})\];]+\Z|\w[\w.\[\]]* ?[-+*/]?= ?\S+.*[()\[\]{};]|</?\w+[^>]*>\Z|\w+\([^)]*\);?\Z)")
_FORMULA = re.compile(r"\\[A-Za-z]+|[_^]\{[^}]*\}")
_BULLET = re.compile(r"(?:[-*•·‣▪◦–—+]|\(?\d{1,3}[.)]|\[\d{1,4}\]|\(?[a-zA-Z][.)])\s+\S")
_REFERENCE = re.compile(r"\[\d{1,4}\]\s.*\b(?:1[89]|20)\d\d\b|.*\b(?:Proc|arXiv|doi|vol)\b.*\b(?:1[89]|20)\d\d\b\.?\Z")
_MIXED = re.compile(r"\d[A-Za-z]|[A-Za-z]\d")
_WIDE = re.compile(r"\S {2,}(?=\S)")
_PAIR = re.compile(r"[^:：.!?]{1,60}[:：] ?\S+(?: \S+){0,3}\Z")
_NOISY = re.compile(r"(?<=[A-Za-zÀ-ɏ])[|\d¤¦©®€£¥§�]+(?=[a-zà-ɏ])|[¤¦©®€�]")
_BLOB = re.compile(r"(?=\S*\d)(?=\S*[a-z])[A-Za-z0-9+/=_-]{20,}\Z")
#: Letters in lower case, other ASCII characters as spaces; symbols and digits as they are counted in ASCII texts.
_LETTERS = "".join(chr(c) if 97 <= c <= 122 else " " for c in range(128))
_ALNUM_SPACE = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace() or c == 95)
_NOT_DIGITS = bytes(c for c in range(128) if not chr(c).isdigit())
_ASCII_STOPS = (". ", ".\n", '."', ".)", "? ", "?\n", "! ", "!\n")
_STOPS = (". ", ".\n", '."', ".)", ".”", ".»", "? ", "?\n", "! ", "!\n", "… ", "。", "？", "！", "।", "؟")


def _words(low: str) -> list[str]:
    """The words of a lower-cased text."""
    low = low.replace("-", "")
    return low.translate(_LETTERS).split() if low.isascii() else _WORD.findall(low)


def _counts(text: str) -> tuple[int, int]:
    """Characters that are symbols, and digits."""
    if text.isascii():
        raw = text.encode()
        return len(raw.translate(None, _ALNUM_SPACE)), len(raw.translate(None, _NOT_DIGITS))
    return sum(map(len, _SYMBOL.findall(text))), sum(map(len, re.findall(r"\d+", text)))
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_DENSE = re.compile("[ก-๎぀-ヿ㐀-鿿]")
_THAI = re.compile("[ก-๎]")
_QUOTE = re.compile(r"\s*(?:>\s*)+")


class Common:
    """The common words of all languages: whole words, and characters or substrings for scripts without spaces."""

    def __init__(self, words: list[str]):
        self.words = frozenset(w.lower() for w in words)
        self.parts = tuple(w for w in words if _CJK.match(w) or _THAI.match(w))
        self.joined = re.compile("|".join(map(re.escape, sorted(self.parts, key=len, reverse=True))) or r"(?!)")

    def share(self, line: str, words: list[str]) -> float:
        """Share of common words in a lower-cased line; where there are no spaces, of three times the common words' characters, at most 1."""
        share = sum(map(self.words.__contains__, words)) / len(words) if words else 0.0
        if not line.isascii() and _DENSE.search(line):
            dense = len(_CJK.findall(line)) + len(_THAI.findall(line))
            if dense > len(line) // 3:
                share = max(share, min(1.0, 3 * sum(map(len, self.joined.findall(line))) / dense))
        return share


def _line_kind(line: str, words: list[str], common: float) -> str:
    n = len(line)
    if common >= 0.2 and n > 150:
        return "prose"
    if _HEX.match(line) or _LOG.match(line):
        return "code"
    if sum(map(len, words)) < 0.2 * n and len(set(line)) > 12 and _counts(line)[0] > 0.5 * n and sum(map(str.isalnum, line)) < 0.2 * n:  # signs without cells
        return "code"
    # white space between cells; pipes; ampersands of LaTeX rows; commas without spaces
    if line.count("|") >= 2 and (line[0] == "|" or line.count(" | ") >= 2) or "\t" in line and common < 0.2 or line.endswith("\\\\") and "&" in line or line.count(" & ") >= 2 and common < 0.1:
        return "table"
    if common < 0.12 and (("  " in line or "\t" in line) and _ALIGNED.search(line) or (line.count(",") > 1 or line.count(";") > 2) and _CSV.match(line)):
        return "table"
    if _CODE.match(line) and common < 0.25 or "\\" in line and sum(map(len, _FORMULA.findall(line))) > 0.4 * n or _counts(line)[0] > 0.4 * n or common < 0.12 and sum(len(c) for c in line.split() if len(c) > 19 and _BLOB.match(c)) > 0.4 * n:
        return "code"
    if (line[0] == "[" or "Proc" in line or "arXiv" in line or "doi" in line or "vol" in line) and _REFERENCE.match(line) or (_BULLET.match(line) and (common < 0.12 or len(words) <= 6)):
        return "list"
    if common >= 0.12:
        return "prose"
    if _MARK.search(line) and (len(words) > 3 or _CJK.search(line)):
        return "prose"
    if _THAI.search(line) and n > 40:
        return "prose"
    if _PAIR.match(line) or n <= 70 and len(words) <= 7:
        return "short"
    return "bare"


def statistics(text: str, common: Common) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; zeros for an empty or blank one."""
    n = len(text)
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    if not lines:
        return [float(n)] + [0.0] * (len(STATISTICS) - 1)
    size = dict.fromkeys(("prose", "list", "table", "code", "bare"), 0)
    words: list[str] = []
    before, ends, short, run, weight = "", 0, 0, 0, 0.0
    separated = bullets = 0
    for raw in lines:
        line = (_QUOTE.sub("", raw, count=1) if raw.lstrip()[:1] == ">" else raw).strip()
        if not line:
            continue
        separated += raw.count(",") > 1 or raw.count("|") > 1 or raw.count(";") > 1 or raw.count("\t") > 1 or raw.count("&") > 1 or "  " in line and len(_WIDE.findall(line)) > 1
        bullets += not line[0].isupper() and bool(_BULLET.match(line))
        low = line.lower()
        own = _words(low)
        words += own
        common_share = common.share(low, own)
        weight += common_share * len(own)
        kind = _line_kind(line, own, common_share)
        ended = bool(_END.search(line[-12:]))
        ends += ended
        short += len(line) < 60 and not ended
        # short entries one after another make a list; a single one is a heading, or the rest of a wrapped line
        if kind == "short":
            kind = before if before in ("prose", "code") and run == 0 else "list"
            run = run + 1 if kind != "list" else run
        else:
            run = 0
            before = kind
        size[kind] += len(line)
    total = sum(size.values()) or 1
    chunks = text.split()
    dense = sum(map(len, chunks))
    symbols, digits = _counts(text)
    plain = text.isascii()
    marks = sum(map(text.count, _ASCII_STOPS if plain else _STOPS)) + (text[-1] in ".!?…")
    # different words in runs of up to WINDOW words: over a whole long text their share falls with its length
    w = len(words)
    unique = sum(len(set(words[i : i + WINDOW])) for i in range(0, w, WINDOW))
    pair = max(Counter(zip(words, words[1:])).values(), default=0)
    noisy = len(_NOISY.findall(text)) if not plain or digits or "|" in text else 0
    return [
        float(n), float(w), float(len(lines)), sum(map(len, words)) / w if w else 0.0, symbols / max(1, dense), digits / max(1, dense),
        weight / w if w else 0.0, ends / len(lines), short / len(lines), sum(map(len, lines)) / len(lines), w / (marks + 1), unique / w if w else 0.0,
        pair / w if w else 0.0, noisy / max(1, len(chunks)), len([c for c in chunks if len(c) > 30]) / len(chunks),
        separated / len(lines), bullets / len(lines), float(sum(not (c.isalnum() or c.isspace()) for c in set(text))),
        len([c for c in chunks if not c.isalpha() and _MIXED.search(c)]) / len(chunks) if digits else 0.0,
        size["prose"] / total, size["list"] / total, size["table"] / total, size["code"] / total, size["bare"] / total,
    ]


def weak_label(s: list[float]) -> str | None:
    """A label from hand-made rules over the statistics, or none where these are in doubt."""
    v = dict(zip(STATISTICS, s))
    if not v["n_lines"]:
        return None
    if v["noisy_share"] > 0.25 or v["n_words"] > 30 and v["unique_share"] < 0.12 or v["top_pair_share"] > 0.2 and v["n_words"] > 20:
        return "junk"
    if v["bare_share"] > SHARE or v["words_per_mark"] > 60 and v["common_share"] < 0.05 and v["list_share"] + v["table_share"] < 0.3:
        return "junk"
    other = {"list": v["list_share"], "table": v["table_share"], "junk": v["code_share"] + v["bare_share"]}
    kind = max(other, key=other.get)
    if v["prose_share"] < 1 - SHARE - 0.03:
        return kind if other[kind] > 0.5 else None
    return "prose" if v["prose_share"] > 1 - SHARE + 0.03 else None


def train(seen: np.ndarray, common: Common) -> Boosted:
    """Gradient-boosted trees on statistics, a row for each document, with weak labels; their probabilities are calibrated on
    half of the hand-checked holdout, none of which is trained on."""
    labels = [weak_label(list(s)) for s in seen]
    prose = [i for i, k in enumerate(labels) if k == "prose"][:PROSE]
    used = prose + [i for i, k in enumerate(labels) if k not in (None, "prose")]
    x = seen[used].reshape(-1, len(STATISTICS))
    model = Boosted(len(KINDS), rounds=60, depth=4, rate=0.2).fit(x[:, FEATURES], np.array([KINDS.index(labels[i]) for i in used], int))
    half = HOLDOUT[::2]
    return model.calibrate(np.array([statistics(t, common) for t, _ in half])[:, FEATURES], np.array([KINDS.index(k) for _, k in half]))


def quality_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The statistics of every document with ``kind`` and ``probability``.

    ``kind`` is ``prose``, ``list``, ``table`` or ``junk``, by trees that are
    trained on the statistics of about ``sample`` documents; it is null for null,
    empty and blank texts, whose statistics are null or 0. The common words are
    few and fixed (an error is raised above 20,000). Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = [r[0] for r in common_words.select("word").where("word is not null").distinct().limit(20_001).collect()]
    if len(words) > 20_000:
        raise ValueError("more than 20,000 common words")
    common = Common(sorted(words))
    t = F.col(text)
    numbers = ", ".join(f"{c} double" for c in STATISTICS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(x, common) for x in b.column("t").to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("h"), *map(pa.array, rows.T)], names=["h", *STATISTICS])

    # rows whose hash is below a bound that about ``sample`` rows are: their numbers, not their texts, reach the driver
    real = docs.select(t.alias("t"), F.xxhash64(key, t).alias("h")).where(t.isNotNull() & (F.length(F.trim(t)) > 0))
    n = real.count()
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, sample / max(1, n)))
    rows = real.where(F.col("h") <= min(bound, (1 << 63) - 1)).mapInArrow(describe, f"h bigint, {numbers}").limit(2 * sample).collect()
    seen = np.array([r[1:] for r in sorted(map(tuple, rows))]).reshape(-1, len(STATISTICS))
    shared = spark.sparkContext.broadcast((common, train(seen, common) if len(seen) else None))
    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"{c} double" for c in STATISTICS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = np.array([statistics(x or "", common) for x in texts]).reshape(-1, len(STATISTICS))
            real = rows[:, STATISTICS.index("n_lines")] > 0
            p = model.probabilities(rows[:, FEATURES]) if model is not None else np.full((len(rows), len(KINDS)), 0.25)
            best = p.argmax(1)
            null = np.array([x is None for x in texts], bool)
            cols = [pa.array(rows[:, i], mask=null) for i in range(len(STATISTICS))]
            kinds = pa.array([KINDS[k] if r else None for k, r in zip(best, real)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, kinds, pa.array(p[np.arange(len(p)), best], mask=~real)], names=[key, *STATISTICS, "kind", "probability"])

    return docs.select(key, t.alias("_t")).mapInArrow(score, f"`{key}` {kind}, {columns}, kind string, probability double")
