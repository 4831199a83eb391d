"""Sentence boundaries across languages and scripts (problem 4).

Boundary rules are compiled into a finite transducer over *events*. A text is first reduced to its events
(terminators, quotation marks, line and paragraph ends, Thai spaces), each with a symbol that holds its local
context (abbreviation before it, what starts after it). The transducer's state is the quotation that is open.

A stretch of events is a function from the state before it to the state after it. The event stream of a batch is
cut into equal chunks; every chunk's function is built for all states at once, the functions are composed by a
parallel (Hillis-Steele) prefix scan, and each chunk is then replayed from the state the scan gives it. A text of
any length is thus handled as chunks, and a short one shares a chunk with its neighbours: the end of a text is an
event that resets the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------
# Never the end of a sentence: titles, months, units and the like that something must follow.
NEVER_FINAL = (
    "Mr Mrs Ms Dr Prof Mt St Sr Sra Dra Srta Hr Fr Nr No Nos Sec Dept Approx approx incl Incl vs Fig Art art pág "
    "págs p pp Abs Abb Mio Mrd Tsd Cía nº cap Mme Mlle Jan Feb Mar Apr Aug Sept Sep Oct Nov Dec Jr Gen Col Lt Capt "
    "Rev Hon Messrs ca bzw bspw vgl Vgl EE стр рис ул им гл проф Проф д डॉ श्री د أ م"
).split()
# The end of a sentence only if a new one visibly starts after it.
MAYBE_FINAL = "Co Inc Ltd Corp Ltda GmbH etc usw al руб г гг млн млрд тыс др пр bn mn m".split()
# A day's number and a period before one of these is a date.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember januar februar mars april mai juni juli august september oktober november desember".split()
# May be followed by another legal form, a capital that starts no sentence.
FORM_AFTER = ("KG", "Ltd", "Ltda", "Inc", "KGaA", "AG", "UU")

OPEN, CLOSE = {"“": 0, "«": 1, "「": 2, "『": 3, "„": 4, "‘": 9}, {"”": 0, "»": 1, "」": 2, "』": 3}
TERMINATORS = ".!?…。！？｡؟।॥։።"
WIDE = "。！？｡"
CLOSERS = "”»」』)]）］’\"“"
BULLETS = "•‣▪◦●·–—-*"

# --- character classes ----------------------------------------------------------------------------------------
(C_OTHER, C_SPACE, C_NL, C_TERM, C_WIDE, C_QUOTE, C_CLOSER, C_UPPER, C_LOWER, C_DIGIT, C_LETTER, C_THAI, C_BULLET, C_HAN, C_INV) = range(15)


def _classes() -> np.ndarray:
    t = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c == "\n":
            k = C_NL
        elif c.isspace() or c in "​﻿":
            k = C_SPACE
        elif c in WIDE:
            k = C_WIDE
        elif c in TERMINATORS:
            k = C_TERM
        elif c in OPEN or c in CLOSE or c == '"':
            k = C_QUOTE
        elif c in ")]）］’":
            k = C_CLOSER
        elif 0x0E00 <= i < 0x0E80:
            k = C_THAI
        elif 0x3040 <= i < 0x3100 or 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7B0:
            k = C_HAN
        elif c.isupper() or c.istitle():
            k = C_UPPER
        elif c.islower():
            k = C_LOWER
        elif c.isdigit():
            k = C_DIGIT
        elif c.isalpha() or 0x0900 <= i < 0x0980 or 0x0600 <= i < 0x0700 and not c.isnumeric():
            k = C_LETTER
        elif c in "•‣▪◦●":
            k = C_BULLET
        elif c in "¿¡":
            k = C_INV
        else:
            k = C_OTHER
        t[i] = k
    return t


_CLS = _classes()
_IS = lambda *ks: np.isin(np.arange(16), ks)
_WORD = _IS(C_UPPER, C_LOWER, C_LETTER)
_BLANK = _IS(C_SPACE, C_NL)
_AFTER_TERM = _IS(C_QUOTE, C_CLOSER)
_EVENT = _IS(C_NL, C_TERM, C_WIDE, C_QUOTE)

# --- the transducer -------------------------------------------------------------------------------------------
# States: 0 outside, 1..6 inside “”, «», 「」, 『』, „“, "". Symbols and what they do:
S_OUT, N_STATES = 0, 7
(Y_NONE, Y_TERM, Y_HARD, Y_O0, Y_O1, Y_O2, Y_O3, Y_O4, Y_ST, Y_C0, Y_C1, Y_C2, Y_C3, Y_O0T, Y_STT, Y_C0T, Y_C1T, Y_C2T, Y_C3T) = range(19)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` and ``emit[symbol, state]``. The symbols ending in T stand for a closing mark
    after a terminator where a new sentence starts: leaving the outermost quotation then ends the sentence."""
    step = np.tile(np.arange(N_STATES, dtype=np.uint8), (19, 1))
    emit = np.zeros((19, N_STATES), bool)
    emit[Y_TERM, S_OUT] = True
    emit[Y_HARD, :] = True
    step[Y_HARD, :] = S_OUT
    for y, s in ((Y_O0, 1), (Y_O1, 2), (Y_O2, 3), (Y_O3, 4), (Y_O4, 5), (Y_ST, 6), (Y_O0T, 1), (Y_STT, 6)):
        step[y, S_OUT] = s
    for y in (Y_O0, Y_O0T):  # “ also closes „
        step[y, 5] = S_OUT
    emit[Y_O0T, 5] = True
    for y in (Y_ST, Y_STT):
        step[y, 6] = S_OUT
    emit[Y_STT, 6] = True
    for y, yt, s in ((Y_C0, Y_C0T, 1), (Y_C1, Y_C1T, 2), (Y_C2, Y_C2T, 3), (Y_C3, Y_C3T, 4)):
        step[y, s] = step[yt, s] = S_OUT
        emit[yt, s] = True
        emit[yt, S_OUT] = True  # a closing mark that nothing opened still follows a terminator
    step[Y_C0, 5] = step[Y_C0T, 5] = S_OUT  # „…”
    emit[Y_C0T, 5] = True
    return step, emit


STEP, EMIT = _compile()
_QSYM = {ord(c): (Y_O0, Y_O1, Y_O2, Y_O3, Y_O4)[k] for c, k in OPEN.items() if k < 5} | {ord(c): Y_C0 + k for c, k in CLOSE.items()} | {ord('"'): Y_ST}
_QT = np.zeros(0x10000, np.uint8)
for _c, _y in _QSYM.items():
    _QT[_c] = _y
_TO_T = np.arange(19, dtype=np.uint8)
for _a, _b in ((Y_O0, Y_O0T), (Y_ST, Y_STT), (Y_C0, Y_C0T), (Y_C1, Y_C1T), (Y_C2, Y_C2T), (Y_C3, Y_C3T)):
    _TO_T[_a] = _b


def states_by_scan(symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
    """The state before every symbol. Chunks of ``chunk`` symbols become functions, a prefix scan composes them."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    m = -(-n // chunk)
    grid = np.full(m * chunk, Y_NONE, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(m, chunk)
    fn = np.tile(np.arange(N_STATES, dtype=np.uint8), (m, 1))  # function of each chunk: state in -> state out
    for j in range(chunk):
        fn = STEP[grid[:, j][:, None], fn]
    d = 1
    while d < m:  # Hillis-Steele: after it, fn[i] is the function of chunks 0..i
        nxt = fn.copy()
        nxt[d:] = np.take_along_axis(fn[d:], fn[:-d].astype(np.intp), axis=1)
        fn = nxt
        d *= 2
    s = np.zeros(m, np.uint8)
    s[1:] = fn[:-1, S_OUT]
    out = np.empty((m, chunk), np.uint8)
    for j in range(chunk):
        out[:, j] = s
        s = STEP[grid[:, j], s]
    return out.reshape(-1)[:n]


def _key(word: str) -> int:
    k = 0
    for c in reversed(word):
        k = (k * 1000003 + ord(c)) & 0xFFFFFFFFFFFF
    return k


_NEVER = np.array(sorted(_key(w) for w in NEVER_FINAL), np.int64)
_MAYBE = np.array(sorted(_key(w) for w in MAYBE_FINAL), np.int64)
_MAXLEN = max(map(len, [*NEVER_FINAL, *MAYBE_FINAL])) + 1


def _word_before(a: np.ndarray, cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and length of the run of letters ending just before each position, and the class before the run."""
    key, n, alive, p = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool), at - 1
    before = np.full(len(at), C_NL, np.uint8)
    for _ in range(_MAXLEN + 1):
        c = cls[np.maximum(p, 0)]
        ok = alive & (p >= 0) & _WORD[c]
        before = np.where(alive & ~ok & (p >= 0), c, before)
        alive = ok
        key = np.where(ok, (key * 1000003 + a[np.maximum(p, 0)]) & 0xFFFFFFFFFFFF, key)
        n += ok
        p = p - ok
    return key, n, np.where(alive, np.uint8(C_LOWER), before)


def _skip(cls: np.ndarray, at: np.ndarray, table: np.ndarray, by: int, rounds: int = 10**9) -> np.ndarray:
    """Move each position by ``by`` while it stands on a class of ``table``."""
    at = at.copy()
    live = np.arange(len(at))
    while len(live) and rounds:
        p = at[live]
        ok = (p >= 0) & (p < len(cls))
        ok[ok] = table[cls[p[ok]]]
        live = live[ok]
        at[live] += by
        rounds -= 1
    return at


def _lines(a: np.ndarray, cls: np.ndarray, nl: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every line that a position of ``nl`` ends: is it a list line, is it a table row (columns set off by
    two or more blanks, the last one of digits)."""
    start = np.concatenate([[0], nl[:-1] + 1]) if len(nl) else nl
    body = _skip(cls, start, _IS(C_SPACE), 1)
    inside = np.minimum(body, len(cls) - 1)
    bullet = (body < nl) & (cls[inside] == C_BULLET)
    dash = (body < nl - 1) & np.isin(a[inside], [ord(c) for c in "-*–"]) & (cls[np.minimum(inside + 1, len(cls) - 1)] == C_SPACE)
    end = _skip(cls, nl - 1, _IS(C_SPACE), -1)
    # over the last column, digits and their signs, however long: back to the last character that is neither
    inside_column = (cls == C_DIGIT) | np.isin(a, [ord(c) for c in ".,%()$€£-–—"])
    other = np.maximum.accumulate(np.where(inside_column, -1, np.arange(len(cls))))
    col = np.where(end > start, np.maximum(other[np.maximum(end, 0)], start), end)
    gap = (col < end) & (col > start) & (cls[np.maximum(col, 0)] == C_SPACE) & (cls[np.maximum(col - 1, 0)] == C_SPACE) & (cls[np.maximum(end, 0)] != C_TERM)
    tab = (col < end) & (col > start) & (a[np.maximum(col, 0)] == 9)
    return bullet | dash, gap | tab


def _events(a: np.ndarray, cls: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (of the last character of a unit, should it end there), symbols and order of all events.
    ``ends`` holds the positions of the separators after each text."""
    ev = np.flatnonzero(_EVENT[cls])
    c = cls[ev]
    n = len(cls)
    at = lambda p: cls[np.clip(p, 0, n - 1)]

    # line ends
    nl = ev[c == C_NL]
    is_end = np.isin(nl, ends)
    bullet, row = _lines(a, cls, nl, ends)
    after = _skip(cls, nl + 1, _IS(C_SPACE), 1)
    blank_next = (after >= n) | (at(after) == C_NL)
    nb, nr = np.append(bullet[1:], False), np.append(row[1:], False)
    hard = is_end | blank_next | nb | row | nr
    last = _skip(cls, nl - 1, _BLANK, -1)
    p_nl, y_nl, o_nl = last[hard], np.full(int(hard.sum()), Y_HARD, np.uint8), nl[hard]

    # terminators
    t = ev[(c == C_TERM) | (c == C_WIDE)]
    wide = cls[t] == C_WIDE
    run = _IS(C_TERM, C_WIDE)
    t, wide = (lambda k: (t[k], wide[k]))(~run[at(t + 1)])  # of "?!" or "..." the last counts
    tail = _skip(cls, t + 1, _AFTER_TERM, 1)  # behind closing marks
    # an opening mark directly after a terminator (CJK) is no closing one
    nxt = _skip(cls, tail, _BLANK, 1)
    cn, gap = at(nxt), nxt > tail
    ended = (nxt >= n) | (cn == C_NL)
    code = a[t]
    starts = np.isin(cn, (C_UPPER, C_LETTER, C_HAN, C_THAI, C_DIGIT, C_QUOTE, C_BULLET, C_INV, C_OTHER)) | np.isin(a[np.clip(nxt, 0, n - 1)], [ord("("), ord("[")])
    key, wl, before = _word_before(a, cls, t)
    dot = code == ord(".")
    never = dot & np.isin(key, _NEVER) & (wl > 0) & (before != C_TERM)
    initial = dot & (wl == 1) & (before != C_TERM) & ~np.isin(key, _MAYBE)
    maybe = dot & (np.isin(key, _MAYBE) | ((wl >= 1) & (wl <= 2) & (before == C_TERM)))
    inner = dot & (wl == 1) & (before == C_TERM)
    small = inner & np.isin(a[np.clip(t - 1, 0, n - 1)], [ord(x) for x in "eg"])  # i.e. and e.g.
    day = dot & (at(t - 1) == C_DIGIT) & ~((at(t - 2) == C_DIGIT) & (at(t - 3) == C_DIGIT)) & gap
    form = np.zeros(len(t), bool)
    for m, words in ((np.flatnonzero(maybe & (cn == C_UPPER)), FORM_AFTER), (np.flatnonzero(day), MONTHS)):
        for f in words:
            ok = np.ones(len(m), bool)
            for i, x in enumerate(f):
                ok &= a[np.clip(nxt[m] + i, 0, n - 1)] == ord(x)
            ok &= ~_WORD[at(nxt[m] + len(f))]
            form[m[ok]] = True
    dots = (code == ord("…")) & _BLANK[at(t - 1)]
    go = np.where(wide, True, gap & starts & ~never & ~initial & ~small & ~form & ~dots & (cn != C_LOWER) & ~(maybe & (cn == C_DIGIT)))
    # directly after the terminator (no closing mark): the terminator's own event
    plain = tail == t + 1
    go_plain = go & (plain | np.isin(at(t + 1), (C_CLOSER,)))
    p_t = np.where(plain, t, tail - 1)[go_plain]
    o_t = t[go_plain]
    # 。 or ？ followed by an opening mark
    wq = np.flatnonzero(wide & ~plain & np.isin(a[np.clip(t + 1, 0, n - 1)], [ord(x) for x in "“«「『„"]))
    # quotation marks
    q = ev[c == C_QUOTE]
    y_q = _QT[np.minimum(a[q], 0xFFFF)]
    strip = y_q == Y_NONE
    q, y_q = q[~strip], y_q[~strip]
    closing = np.zeros(n + 1, bool)
    # a closing mark after a terminator that starts a sentence: the last mark of the run carries it
    cand = go & ~plain
    quoted = np.where(wide, ~np.isin(cn, (C_HAN, C_LETTER, C_UPPER, C_LOWER, C_DIGIT)) | gap, True)
    k = np.flatnonzero(cand & quoted & (at(tail - 1) == C_QUOTE))
    closing[tail[k] - 1] = True
    y_q = np.where(closing[q], _TO_T[y_q], y_q)

    # Thai: a blank between two Thai letters
    sp = np.flatnonzero((cls == C_SPACE) & (np.concatenate([[0], cls[:-1]]) == C_THAI)) if (cls == C_THAI).any() else np.zeros(0, np.int64)
    sn = _skip(cls, sp, _IS(C_SPACE), 1)
    sp = sp[at(sn) == C_THAI]
    pos = np.concatenate([p_nl, p_t, t[wq], q, sp - 1])
    sym = np.concatenate([y_nl, np.full(len(p_t) + len(wq), Y_TERM, np.uint8), y_q, np.full(len(sp), Y_TERM, np.uint8)])
    order = np.concatenate([o_nl, o_t, t[wq], q, sp])
    k = np.argsort(order, kind="stable")
    return pos[k], sym[k], order[k]


def unit_ends(texts: list[str], window: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """For each unit, the index of its text and the number of characters up to its last one."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    a = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    cls = _CLS[np.minimum(a, 0xFFFF)]
    cls[a > 0xFFFF] = C_OTHER
    cls[(a >= 0x20000) & (a < 0x32000)] = C_HAN
    pos, sym, order = _events(a, cls, ends)
    hit = EMIT[sym, states_by_scan(sym)]
    pos, order = pos[hit], order[hit]
    text = np.searchsorted(ends, order)
    keep = pos >= starts[text]  # an empty text, or one of blanks only, has no unit
    text, pos = text[keep], pos[keep]
    # a unit must hold something: drop ends that follow an earlier end without a sign between
    out = np.unique(np.stack([text, pos - starts[text] + 1], 1), axis=0) if len(pos) else np.zeros((0, 2), np.int64)
    return out[:, 0], out[:, 1]


def _batches(b: pa.RecordBatch, key: str, text: str, limit: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    keys, col = b.column(key), b.column(text).to_pylist()
    lo, size = 0, 0
    for i, t in enumerate(col):
        if size and size + len(t) > limit:
            yield np.arange(lo, i), col[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(col):
        yield np.arange(lo, len(col)), col[lo:]
    del keys


def sentence_ends(df: DataFrame, key: str, text: str, window: int = 1 << 21) -> DataFrame:
    """``(key, end_pos)`` of every sentence unit of ``text``; ``end_pos`` counts characters (code points).

    Null and empty texts and texts of blanks have no unit. Copies of a row give their units once each; other
    columns of ``df`` don't matter. Texts of any length are taken whole.
    """
    kind = df.schema[key].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, texts in _batches(b, "k", "t", window):
                i, end = unit_ends(texts)
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows[i])), pa.array(end.astype(np.int32), pa.int32())], ["k", "end_pos"])

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    return src.mapInArrow(run, f"k {kind.simpleString()}, end_pos int").withColumnRenamed("k", key)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per unit in order: the columns of ``sentence_ends`` with ``unit_no`` from 0 and the unit's text."""
    kind = df.schema[key].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, texts in _batches(b, "k", "t", 1 << 20):
                i, end = unit_ends(texts)
                no, out, prev, last = [], [], 0, -1
                for x, e in zip(i.tolist(), end.tolist()):
                    prev, n = (prev, no[-1] + 1) if x == last else (0, 0)
                    out.append(texts[x][prev:e].strip())
                    no.append(n)
                    prev, last = e, x
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows[i])), pa.array(no, pa.int32()), pa.array(end.astype(np.int32)), pa.array(out, pa.string())], ["k", "unit_no", "end_pos", "sentence"])

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    return src.mapInArrow(run, f"k {kind.simpleString()}, unit_no int, end_pos int, sentence string").withColumnRenamed("k", key)
