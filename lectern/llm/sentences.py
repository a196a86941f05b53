"""Sentence boundaries across languages and scripts, by a finite transducer.

A text is read as symbols: full marks with the class of the word before them,
closing and opening marks, white space, line ends, and the classes of what follows
them. A symbol depends on a bounded part of the text around it. The transducer's
state has all that is still open: the quotation, the mark whose sentence may be at
an end with the word before it and the marks that closed it since, white space and
line ends since then. So nothing is looked ahead for over white space of any length.

A chunk of a text is a function from the state before it to the state after it and
the ends it writes. The functions of a text's chunks are composed by a prefix scan
in ``log2`` steps, which gives every chunk the state it begins in. A text of one
chunk begins in the first state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distinct import distinct_by
from ..sharedfs import written
from .chunked import chunk_rows

#: Characters of a chunk, and those around it that are needed for its symbols.
CHUNK, MARGIN = 1 << 15, 256

# Abbreviations, by what may follow them.
#: Nothing after these begins a sentence.
NEVER = frozenset("fig figs eq eqs eqn sec secs tab approx aprox vs cf dr mr mrs ms prof sr sra dra env ca bzw bspw abb vgl inkl рис табл см ср стр др проф डॉ प्रो श्री ed eds hr fr st mme mlle pág págs núm gl kap seq".split())
#: A number after these belongs to them.
BEFORE_NUMBER = frozenset("no nos nr art ch chap ref refs vol pp n° bd abs g г гл т".split())
#: These may close a sentence if what follows looks like the beginning of one.
MAYBE = frozenset("etc al usw a.m p.m am pm u.a u.ä и.т.д inc ltd co corp jr jan feb aug sept oct nov dec".split())
#: Words before a number with a full stop that make it a German ordinal.
ORDINAL = frozenset("am vom zum im der den dem die das beim seit bis ab jeder".split())
#: Words that open a sentence after an acronym with full stops.
STARTERS = frozenset("The This These Those That It We Our In On At As For Each Without With If When While However But And Some Two To From By Following Let Both There They He She What Does Is".split())
#: What goes on after a quotation that ended with a full mark.
GOES_ON_ZH = re.compile(r"然后|的|地|并|而|等|之|这一|[，、；：。,;:]")
GOES_ON_JA = re.compile(r"[とっのはがをにもでへや、，。]|など")
#: Acronyms that never end a sentence.
EXAMPLES = frozenset("e.g i.e z.b d.h p.ej p.ex".split())

TERMINAL = ".!?…。！？।॥؟۔｡"
FULL = frozenset("。！？।॥؟۔｡")
QUOTES = "\"“”„«»「」『』"
#: State after a quotation mark: 0 is outside, the others name the quotation that is open.
_CLOSES = {1: '"', 2: "”", 3: "“”", 4: "»", 5: "」", 6: "』"}
_OPENS = {'"': 1, "“": 2, "„": 3, "«": 4, "「": 5, "『": 6}
#: The table of quotations and quotation marks.
STEP = {(s, q): 0 if s and q in _CLOSES[s] else s if s else _OPENS.get(q, 0) for s in range(7) for q in QUOTES}

_SP = " \t\xa0\u202f\u3000"
#: These, and the line feed after a carriage return that is in the chunk before.
_BLANK = _SP + "\n"
_THAI = r"ก-ฺเ-๎"
#: Marks that may close a sentence after its full mark.
_CLOSING = "\"“”»」』）)]】》"
#: A reference mark, shorter than MARGIN.
_REFERENCE = r"\[\d{1,5}(?:\s?[,;–-]\s?\d{1,5}){0,29}\]"
_EVENT = re.compile(rf"([{TERMINAL}])|([\xa0\u202f]»|{_REFERENCE}|[{re.escape(_CLOSING)}]|’(?!\w))|([«„「『])|(?<=[{_THAI}])( +)(?=[{_THAI}])|(?:(?<!\s)[^\S\r\n]+)?[\r\n]\s*")
_LINE = re.compile(r"\r\n?|(?<!\r)\n")
_NO_SPACE = re.compile(r"\S")
_WORD = re.compile(r"[^\s(\[{«“„\"「『—–/]{1,24}\Z")
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
_YEAR = re.compile(r"(?:1[89]|20)\d\d\b")
_NUMBER_THEN_WORD = re.compile(r"\d[\d.,]*\s+\w")
_LETTERS = re.compile(r"\w{0,24}")
_OPENING = "“„«「『\"(（[¿¡*$"

#: Classes of the word before a full stop, by what may follow after white space.
PLAIN, NO, UNLESS_YEAR, NO_NUMBER, STARTER, NO_UPPER = range(6)
#: Bits of the class of what follows a mark.
BEGINS, GOES_ON, JA, ZH, LOWER, NAME, HAN, DIGIT, ALPHA, UPPER_ALONE, UPPER, OPENING, NUMBERED, STAR, YEAR, OPENS_NUMBER, STARTS = (1 << i for i in range(17))
#: Kinds of symbols.
VISIBLE, MARK, CLOSE, OPEN, SPACE, LINE, OTHER_SPACE, THAI = range(8)
#: What a transition writes: nothing, an end where the last white space began, an end where the symbol is.
NOTHING, AT_SPACE, HERE = range(3)


def _name(text: str, i: int) -> bool:
    """A word written like ``eName``, which may begin a sentence."""
    return text[i : i + 1].islower() and text[i + 1 : i + 2].isupper() and text[i + 2 : i + 3].islower()


def _begins(text: str, i: int) -> bool:
    """Whether what is at ``i`` looks like the beginning of a sentence."""
    c = text[i]
    if c in _OPENING:
        j, end = i + 1, min(len(text), i + 32)
        while j < end and (text[j] in _OPENING or text[j] in " \xa0\u202f"):
            j += 1
        return c == "$" or j < end and (_name(text, j) or c not in "([" and text[j].isdigit() or text[j].isalpha() and not text[j].islower())
    if c.isalpha():
        return not c.islower() or _name(text, i)
    return c.isdigit() or c not in ",;:)]}-–—/%&=+|…."


def following(text: str, i: int) -> int:
    """The class of what begins at ``i``, from up to 64 characters."""
    c = text[i]
    v = BEGINS if _begins(text, i) else 0
    if c in TERMINAL or c in "，、；：":
        v |= GOES_ON
    if c.isalpha():
        v |= ALPHA
        if c.islower():
            v |= LOWER | (NAME if _name(text, i) else 0)
        elif c.isupper():
            n = text[i + 1 : i + 2]
            v |= UPPER | (UPPER_ALONE if not n.isupper() and (not n or n not in "._") else 0)
            if _LETTERS.match(text, i).group() in STARTERS:
                v |= STARTS
        if "一" <= c <= "鿿":
            v |= HAN
    elif c.isdigit():
        v |= DIGIT | (NUMBERED if _NUMBER_THEN_WORD.match(text, i, i + 64) else 0) | (YEAR if _YEAR.match(text, i) else 0)
    elif c in _OPENING:
        v |= OPENING | (STAR if c in "*$" else 0) | (OPENS_NUMBER if c in "([" and text[i + 1 : i + 2].isdigit() else 0)
    elif c.islower():
        v |= LOWER
    if not c.isascii():
        v |= (JA if GOES_ON_JA.match(text, i) else 0) | (ZH if GOES_ON_ZH.match(text, i) else 0)
    elif c in ",;:":
        v |= ZH
    return v


def preceding(text: str, s: int) -> tuple[bool, bool, int]:
    """The class of the word before the full stop at ``s``, from up to 48 characters: whether a digit or a letter can't
    begin a sentence right after the stop, and what may after white space."""
    before = text[s - 1] if s else ""
    m = _WORD.search(text, max(0, s - 24), s)
    word = m.group() if m else ""
    low = word.lower()
    acronym = bool(_ACRONYM.fullmatch(word))
    digit = before.isdigit() or low in NEVER or low in BEFORE_NUMBER or len(word) == 1 or "/" in text[max(0, s - 24) : s].split(" ")[-1]
    letter = low in NEVER or len(word) == 1 and before.isalpha() or "@" in word or acronym and low not in MAYBE
    if before.isalpha() and len(word) == 1 and (before.islower() or before.isupper()) or low in NEVER:
        kind = NO
    elif low in MAYBE:
        kind = UNLESS_YEAR
    elif low in BEFORE_NUMBER:
        kind = NO_NUMBER
    elif acronym:
        kind = NO if low in EXAMPLES else STARTER
    elif word.isdigit() and len(word) <= 3:
        head = text[max(0, s - len(word) - 16) : s - len(word)].rstrip()
        last = head.split()[-1].lower() if head else ""
        stem = last.rstrip(".").lstrip("(")
        enumerates = (not head or head[-1] in TERMINAL + ":;") and not (stem in NEVER or stem in BEFORE_NUMBER)
        kind = NO if enumerates else NO_UPPER if last in ORDINAL else PLAIN
    else:
        kind = PLAIN
    return digit, letter, kind


class Transducer:
    """States and transitions; a transition is worked out when it is first met, then looked up.

    A state is ``(quotation, open mark, line end seen)``. An open mark is ``(kind,
    word, closed, spaced)``: a full mark, a single full stop with the class of the
    word before it, an exclamation or question mark, or another; closed by nothing,
    by brackets, or by quotation marks of which the last is a corner, a curved or
    another one; white space seen since or not.
    """

    def __init__(self):
        words = [(a, b, k) for a in (False, True) for b in (False, True) for k in range(6)]
        near = [("d", w, 0, False) for w in words] + [("d", None, t, False) for t in range(1, 5)] + [(m, None, t, False) for m in "fbx" for t in range(5)]
        far = [("d", (False, False, k), 0, True) for k in range(6)] + [("d", None, t, True) for t in range(1, 5)] + [(m, None, t, True) for m in "fx" for t in range(5)]
        states = [(q, None, n) for q in range(7) for n in (False, True)] + [(q, p, False) for q in range(7) for p in near] + [(0, p, n) for p in far for n in (False, True)]
        self.states = states
        self.number = {s: i for i, s in enumerate(states)}
        self.table: list[dict[int, int]] = [{} for _ in states]

    @staticmethod
    def ends(mark: tuple, v: int) -> bool:
        """Whether the sentence with the open mark is at an end before what has the class ``v``."""
        kind, word, closed, spaced = mark
        if kind == "f" and closed < 2:
            return not v & GOES_ON
        if kind == "f":
            return not v & (JA if closed == 2 else ZH) and not v & LOWER or bool(v & NAME)
        if closed in (2, 3) and v & HAN:
            return not v & ZH
        begins = bool(v & BEGINS)
        if kind != "d":
            return begins and (spaced or bool(v & (ALPHA | OPENING)) or kind == "b" and bool(v & DIGIT))
        if closed or not begins:
            return begins
        no_digit, no_letter, what = word
        if not spaced:
            if v & DIGIT:
                return not no_digit and bool(v & NUMBERED)
            if v & ALPHA and (v & LOWER and not v & NAME or no_letter):
                return False
            return bool(v & UPPER_ALONE) if v & UPPER else not v & STAR
        if what == UNLESS_YEAR:
            return not v & (YEAR | OPENS_NUMBER)
        return what == PLAIN or what == NO_NUMBER and not v & DIGIT or what == STARTER and bool(v & STARTS) or what == NO_UPPER and not v & UPPER

    def follow(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The next state, and what is written."""
        q, mark, lines = state
        kind, a, v = symbol & 7, symbol >> 3 & 255, symbol >> 11
        if kind == LINE:
            return ((0, None, True), AT_SPACE) if lines else ((q, mark, True), NOTHING)
        if kind == OTHER_SPACE:
            return (q, mark, False), NOTHING
        if kind == SPACE:
            if mark is None or q:
                return (q, None, lines), NOTHING
            m, word, closed, _ = mark
            return (q, ("x" if m == "b" else m, (False, False, word[2]) if word else None, closed, True), lines), NOTHING
        if kind == THAI:
            return (q, None, False), NOTHING if q else AT_SPACE
        if kind == MARK and mark is not None and not mark[2] and not mark[3]:  # one more of a row of marks
            return (q, ("f" if a == 0 else "b" if a == 2 else "x", None, 0, False), False), NOTHING
        if kind == CLOSE and mark is not None and not mark[3]:
            m, _, closed, _ = mark
            if not a & 15:
                return (q, (m, None, 4 if closed >= 2 else 1, False), False), NOTHING
            after = STEP[q, QUOTES[(a & 15) - 1]]
            if not (after and not q):
                return (after, (m, None, a >> 4, False), False), NOTHING
        out = NOTHING
        if mark is not None and not q and self.ends(mark, v):
            out = AT_SPACE if mark[3] else HERE
        if kind == MARK:
            if a & 3 == 1:
                mark = ("d", (bool(a & 4), bool(a & 8), a >> 4), 0, False)
            else:
                mark = ("f" if a == 0 else "b" if a == 2 else "x", None, 0, False)
            return (q, mark, False), out
        if kind in (CLOSE, OPEN) and a & 15:
            q = STEP[q, QUOTES[(a & 15) - 1]]
        return (q, None, False), out

    def run(self, state: int, symbols: list[int], places: list[int], space: int = -1) -> tuple[int, list[int], int]:
        """The state after the symbols, the ends written, and where the last white space began.

        -1 is white space that began before the first symbol.
        """
        out: list[int] = []
        table = self.table
        for symbol, p in zip(symbols, places):
            k = symbol & 7
            if k == SPACE and p >= 0 or k == THAI:
                space = p
            code = table[state].get(symbol)
            if code is None:
                after, writes = self.follow(self.states[state], symbol)
                code = table[state][symbol] = self.number[after] * 4 + writes
            state = code >> 2
            if code & 3:
                out.append(space if code & 3 == AT_SPACE else p)
        return state, out, space


TRANSDUCER = Transducer()
_MARKS = {c: 0 if c in FULL else 1 if c == "." else 2 if c in "!?" else 3 for c in TERMINAL}
_CLOSERS = {q: i + 1 | (2 if q in "」』" else 3 if q == "”" else 4) << 4 for i, q in enumerate(QUOTES)}


def symbols(text: str, lo: int = 0, hi: int | None = None) -> tuple[list[int], list[int]]:
    """The symbols that begin in ``text[lo:hi]`` and their places.

    What is around the stretch is only looked at, MARGIN characters of it at most.
    """
    hi = len(text) if hi is None else hi
    out, at = [], []

    def spaces(a: int, b: int) -> None:
        """The white space between ``a`` and ``b``."""
        a, b = max(a, lo), min(b, hi)
        if a >= b:
            return
        begins = a == 0 or not text[a - 1].isspace()
        out.append(SPACE), at.append(a if begins else -1)
        if b - a == 1 and text[a] in _SP:
            return
        last = a
        for m in _LINE.finditer(text, a, b):
            if text[last : m.start()].strip(_BLANK):
                out.append(OTHER_SPACE), at.append(-1)
            out.append(LINE), at.append(-1)
            last = m.end()
        if text[last:b].strip(_BLANK):
            out.append(OTHER_SPACE), at.append(-1)

    def visible(i: int) -> None:
        if lo <= i < hi:
            out.append(VISIBLE | following(text, i) << 11), at.append(i)

    def past(i: int) -> int:
        """The next place without white space."""
        m = _NO_SPACE.search(text, i)
        return m.start() if m else len(text)

    # what a chunk begins with is always read; so is what follows an event
    first = max(0, lo - MARGIN)
    need, done = -1, lo
    begun = False
    for m in _EVENT.finditer(text, first):
        s, e = m.span()
        if s >= hi:
            break
        group = m.lastindex
        if s < lo:
            if e > lo and group:  # it covers the beginning of this chunk, and is read in the one before
                done = e
            continue
        if not begun:
            begun = True
            need = -1
            if group != 2 or s > done:
                need = past(done)
                spaces(done, need)
        if s < done or group is None and s < need:
            if group is None and e > need:  # white space that has been read up to here
                need = e
            continue
        if need >= 0 and need < s:
            visible(need)
        if group is None:
            spaces(s, e)
            need = e if e < len(text) else -1
            done = e
            continue
        if group == 4:
            out.append(THAI), at.append(s)
            need, done = e, e
            continue
        c = text[s]
        if group == 1:
            a = _MARKS[c]
            if a == 1:
                digit, letter, kind = preceding(text, s)
                a |= digit << 2 | letter << 3 | kind << 4
            out.append(MARK | a << 3 | following(text, s) << 11)
        elif group == 3:
            out.append(OPEN | _CLOSERS[c] << 3 | following(text, s) << 11)
        else:
            q = text[e - 1] if c.isspace() else c
            out.append(CLOSE | _CLOSERS.get(q, 0) << 3 | following(text, s + 1 if c.isspace() else s) << 11)
        at.append(s)
        done = e
        need = e
        if e < len(text) and text[e].isspace():
            need = past(e)
            if "\n" in text[e:need] or "\r" in text[e:need]:
                need = -1  # an event of its own
                continue
            if text[e] in "\xa0\u202f" and text[e + 1 : e + 2] == "»":
                need = -1
                continue
            spaces(e, need)
        if need >= len(text):
            need = -1
    if not begun:
        need = past(done)
        spaces(done, need)
    if 0 <= need < hi:
        visible(need)
    # white space at the end of the chunk may be the end of the text
    if hi > max(lo, done) and text[hi - 1].isspace() and not (text[hi - 1] in "\xa0\u202f" and text[hi : hi + 1] == "»"):
        a = lo + len(text[lo:hi].rstrip())
        if a > lo or lo == 0 or not text[lo - 1].isspace():
            out.append(SPACE), at.append(a)
    return out, at


def stretch(text: str, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, list[int], list[list[int]], int]:
    """The function of a chunk: the class of each state before it, the state after it and the ends for each class, and
    where the last white space in it began.

    States that have come together are one class from there on.
    """
    t = TRANSDUCER
    marks, places = symbols(text, lo, hi)
    before = [(s, ()) for s in range(len(t.states))]
    i, space = 0, -1
    while i < len(marks) and len({s for s, _ in before}) > 7:
        step = {}
        for s in {s for s, _ in before}:
            step[s] = t.run(s, marks[i : i + 1], places[i : i + 1], space)
        before = [(step[s][0], out + tuple(step[s][1]) if step[s][1] else out) for s, out in before]
        space = next(iter(step.values()))[2]
        i += 1
    rest = {s: t.run(s, marks[i:], places[i:], space) for s in {s for s, _ in before}}
    classes = {c: j for j, c in enumerate(dict.fromkeys(before))}
    of = np.array([classes[c] for c in before], np.int16)
    return of, [rest[s][0] for s, _ in classes], [[*out, *rest[s][1]] for s, out in classes], next(iter(rest.values()))[2]


def prefix_scan(functions: np.ndarray) -> np.ndarray:
    """All compositions of the first functions, a row each: row ``i`` is the state after functions 0 to ``i`` by the state before them.

    Each of the ``log2`` steps composes all rows with the rows a power of two before them at once.
    """
    f, step = functions.copy(), 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), 1)
        step *= 2
    return f


def tidy(ends: list[int], length: int) -> list[int]:
    """The ends in order, without repeats and those of nothing, and the end of the text without its white space."""
    out, last = [], 0
    for e in [*ends, length]:
        if e > last:
            out.append(e)
            last = e
    return out


def chunk_ends(text: str, size: int) -> list[int]:
    """The ends of a text by chunks of ``size`` characters."""
    parts = [stretch(text, lo, min(lo + size, len(text))) for lo in range(0, len(text), size)]
    if not parts:
        return []
    after = prefix_scan(np.array([np.array(p[1], np.int16)[p[0]] for p in parts]))
    states = [0, *after[:-1, 0].tolist()]
    ends, space = [], -1
    for s, p in zip(states, parts):
        ends += [space if e < 0 else e for e in p[2][p[0][s]]]
        space = p[3] if p[3] >= 0 else space
    return tidy(ends, space if text[-1].isspace() else len(text))


def sentence_ends(text: str | None) -> list[int]:
    """The number of code points up to the end of each sentence. Null, empty and blank texts have no sentences."""
    if not text:
        return []
    _, ends, space = TRANSDUCER.run(0, *symbols(text))
    return tidy(ends, space if text[-1].isspace() else len(text))


def sentences(df: DataFrame, key: str = "passage_id", text: str = "content", chunk: int = CHUNK) -> DataFrame:
    """``(<key>, ends)``: for every key, the ends of its text's sentences, in order.

    Rows that repeat key and text are one row; a key with several texts, and a null
    key, has a row for each text. A null text has null ``ends``; an empty or blank
    one has none. Texts of more than ``chunk`` characters are several chunks, which
    tasks work on independently; only their functions are gathered to find the
    state each begins in, then the ends. Other columns are ignored; an empty table
    gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = distinct_by(df.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("k", "t")), "h", by=["k", "t"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else sentence_ends(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[key, "ends"])

    short = rows.where(F.col("t").isNull() | (F.length("t") <= chunk)).select("k", "t").mapInArrow(single, f"`{key}` {kind}, ends array<int>")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.select(["lo", "hi", "base", "part"]).to_pydict()
            of, after, ends, space, length = [], [], [], [], []
            for lo, hi, base, part in zip(d["lo"], d["hi"], d["base"], d["part"]):
                c, a, e, s = stretch(part, lo - base, hi - base)
                of.append(c.tobytes())
                after.append(np.array(a, np.int16)[c].tobytes())
                ends.append([[x + base if x >= 0 else -1 for x in row] for row in e])
                space.append(s + base if s >= 0 else -1)
                length.append(None if part[hi - base - 1].isspace() else hi)
            columns = [pa.array(of, pa.binary()), pa.array(after, pa.binary()), pa.array(ends, pa.list_(pa.list_(pa.int32()))), pa.array(space, pa.int32()), pa.array(length, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("no"), *columns], names=["k", "no", "of", "after", "ends", "space", "length"])

    # the texts are known by a digest, as a key may have several
    long = rows.where(F.length("t") > chunk).select(F.struct("k", F.md5("t").alias("d"), F.length("t").alias("n")).alias("id"), "t")
    id_ = long.schema["id"].dataType.simpleString()
    chunks = chunk_rows(long, "id", "t", chunk, MARGIN).mapInArrow(functions, f"k {id_}, no int, of binary, after binary, ends array<array<int>>, space int, length int")
    chunks = written(chunks, "chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, spaces, last = [], [], []
            for rows_ in b.column("f").to_pylist():
                f = prefix_scan(np.array([np.frombuffer(r["after"], np.int16) for r in rows_]))
                states.append([0, *f[:-1, 0].tolist()])
                before, space = [], -1
                for r in rows_:
                    before.append(space)
                    space = r["space"] if r["space"] >= 0 else space
                spaces.append(before)
                last.append(rows_[-1]["length"] if rows_[-1]["length"] is not None else space)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(states, pa.list_(pa.int32())), pa.array(spaces, pa.list_(pa.int32())), pa.array(last, pa.int32())], names=["k", "states", "spaces", "last"])

    # a text has up to 2**31 bytes: the functions of its chunks have a fixed size, in all a fortieth of it
    begun = chunks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("no", "after", "space", "length"))).alias("f")).mapInArrow(scan, f"k {id_}, states array<int>, spaces array<int>, last int")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, sp, of, e in zip(*(b.column(c).to_pylist() for c in ("state", "before", "of", "ends"))):
                out.append([sp if x < 0 else x for x in e[np.frombuffer(of, np.int16)[s]]])
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("no"), pa.array(out, pa.list_(pa.int32())), b.column("last")], names=["k", "no", "ends", "last"])

    no = F.col("no")
    joined = chunks.select("k", "no", "of", "ends").join(begun, "k").select("k", "no", "of", "ends", F.get("states", no).alias("state"), F.get("spaces", no).alias("before"), "last")
    found = joined.mapInArrow(write, f"k {id_}, no int, ends array<int>, last int").groupBy("k", "last").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ends"))), lambda x: x["ends"])).alias("e"))
    ends = F.array_distinct(F.filter(F.array_append("e", F.col("last")), lambda x: x > 0))
    return short.unionByName(found.select(F.col("k.k").alias(key), ends.alias("ends")))


def sentence_rows(df: DataFrame, key: str = "passage_id", text: str = "content", chunk: int = CHUNK) -> DataFrame:
    """``(<key>, end_pos)``: one row for each sentence of each key, see :func:`sentences`."""
    return sentences(df, key, text, chunk).select(key, F.explode("ends").alias("end_pos"))
