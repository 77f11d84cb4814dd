"""Text read in the wrong character encoding: find it and give back the original.

A code-page swap (bytes of encoding T read as W) is a substitution cipher: each wrong character stands for a byte, each
byte or byte sequence for a letter. Which swap a record went through is unknown. Expectation-maximisation learns, per
source, which letter each odd symbol stands for (from all its texts; code pages are no more than a prior) and how
probable each swap is, and with that the language's own character bigrams, from which the garbled share is taken out
again in each round. A letter that the wrong reading lost (U+FFFD) is an unknown letter between its neighbours. A record
is garbled when the swaps' posterior outweighs that of the text as it stands. Learned ciphers are applied with
translate(); byte sequences are decoded.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Workspace, spread

#: Encodings that text is wrongly read in, by one byte a character and by more.
WRONG = ("cp1252", "latin_1", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "iso8859_15")
WRONG_WIDE = ("cp932", "gb18030")
#: Encodings that text is really in.
RIGHT_WIDE = ("utf_8", "cp932", "euc_jp")
RIGHT = ("cp1252", "mac_roman", "cp437", "koi8_r", "cp1251", "cp1250")
ROUNDS = 3
#: Log probability that a wrong reading loses a letter, before a source is known.
LOSS = math.log(0.02)

# --- alphabet of the bigram model -------------------------------------------------------------------------------
_SPANS = ((0x00, 0x052F), (0x2000, 0x206F), (0x2100, 0x214F), (0x2500, 0x257F), (0x3000, 0x30FF), (0xFF00, 0xFFEF))
_IDEOGRAPH, _PRIVATE, _OTHER = 1, 2, 3


@lru_cache(1)
def alphabet() -> tuple[np.ndarray, int, np.ndarray]:
    """(code of each code point, number of codes, log share of one character within its code)."""
    code = np.full(0x110000, _OTHER, np.int32)
    code[0x3400:0xA000] = _IDEOGRAPH
    code[0xF900:0xFB00] = _IDEOGRAPH
    code[0x20000:0x32000] = _IDEOGRAPH
    code[0xE000:0xF900] = _PRIVATE
    at = 4
    for a, b in _SPANS:
        code[a : b + 1] = np.arange(at, at + b - a + 1)
        at += b - a + 1
    code[0x30:0x3A] = code[0x30]
    code[0x0A] = 0
    within = np.zeros(at, np.float32)
    within[_IDEOGRAPH], within[_PRIVATE], within[_OTHER] = -math.log(7000), -math.log(6400), -math.log(60000)
    return code, at, within


def codes(text: str) -> np.ndarray:
    return alphabet()[0][np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]


class Bigrams:
    """Log probabilities of one code after another, from counts; smoothed towards the frequency of the second."""

    def __init__(self, counts: dict[tuple[int, int], float], weight: float = 5.0, ideographs: dict[int, float] | None = None):
        #: How often each ideograph was counted; bigrams have one code for all of them.
        self.ideographs = ideographs or {}
        self.at = np.array(list(counts), np.int32).reshape(len(counts), 2)
        self.n = np.maximum(0, np.fromiter(counts.values(), np.float32, len(counts)))
        self.weight = weight
        self._fill()

    def _fill(self) -> None:
        _, size, within = alphabet()
        n = np.zeros((size, size), np.float32)
        n[self.at[:, 0], self.at[:, 1]] = self.n
        single = n.sum(0) + 0.1
        single /= single.sum()
        self.log = np.log((n + self.weight * single) / (n.sum(1, keepdims=True) + self.weight)) + within
        self.unigram = np.log(single) + within

    def __getstate__(self):
        """What is sent to the workers are the counts; the table is filled there."""
        return self.at, self.n, self.weight, self.ideographs

    def __setstate__(self, state) -> None:
        self.at, self.n, self.weight, self.ideographs = state
        self._fill()

    def score(self, text: str) -> float:
        c = codes(text)
        return float(self.log[c[:-1], c[1:]].sum())

    def gain(self, left: str, old: str, new: str, right: str) -> float:
        """How much better `new` fits than `old` between its neighbours."""
        return self.score_between(left, new, right) - self.score_between(left, old, right)

    def loss_gain(self, text: str) -> float:
        """How much better the text fits if each U+FFFD is some letter that was lost: what follows a run of them is then as
        probable as anywhere."""
        c = codes(text)
        lost = np.concatenate(([False], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 0xFFFD, [False]))
        beside = lost[:-1] | lost[1:]
        after = np.flatnonzero(lost[:-1] & ~lost[1:]) + 1
        return float(self.unigram[c[after]].sum() + LOSS * lost.sum() - self.log[c[:-1], c[1:]][beside].sum())

    def score_between(self, left: str, text: str, right: str) -> float:
        c = codes(left[-1:] + text + right[:1])
        lo, hi = (1 if left else 0), (len(c) - 2 if right else len(c) - 1)
        return float(self.log[c[lo:hi], c[lo + 1 : hi + 1]].sum())


# --- swaps --------------------------------------------------------------------------------------------------------
@lru_cache(None)
def bytes_of(wrong: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes it leaves undefined are read as C1 controls."""
    table = {}
    for b in range(256):
        try:
            table.setdefault(bytes([b]).decode(wrong), b)
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def _byte_table(wrong: str) -> dict[int, int]:
    return {ord(c): b for c, b in bytes_of(wrong).items() if b >= 0x80}


@lru_cache(None)
def undefined(wrong: str) -> tuple[int, ...]:
    """Bytes that a one-byte encoding cannot read, of which a reading leaves U+FFFD."""
    return tuple(b for b in range(0x80, 0x100) if _decoded(bytes([b]), wrong) is None)


@lru_cache(None)
def _with_loss(wrong: str) -> re.Pattern:
    high = _set(wrong, 0x80, 0xFF)[1:-1]
    return re.compile(f"[{high}\ufffd]*\ufffd[{high}\ufffd]*")


def encoded(text: str, wrong: str) -> bytes | None:
    """The bytes that `wrong` read as `text`, or None."""
    try:
        return text.translate(_byte_table(wrong)).encode("latin_1") if wrong in WRONG else text.encode(wrong)
    except UnicodeEncodeError:
        return None


def _set(wrong: str, low: int, high: int) -> str:
    chars = [c for c, b in bytes_of(wrong).items() if low <= b <= high]
    return "[" + "".join(re.escape(c) for c in chars) + "]"


_PATTERNS = {
    "utf_8": rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})",
    "cp932": rb"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])",
    "euc_jp": rb"(?:[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf])",
}
_UNITS = {right: re.compile(pattern) for right, pattern in _PATTERNS.items()}
#: Byte stretches tried as encoding T: units of T, in cp932 with ASCII between them.
_STRETCH = {
    "utf_8": re.compile(_PATTERNS["utf_8"] + b"+"),
    "cp932": re.compile(_PATTERNS["cp932"] + rb"(?:[\x20-\x7e\n]{0,12}" + _PATTERNS["cp932"] + b")+"),
    "euc_jp": re.compile(_PATTERNS["euc_jp"] + b"{2,}"),
}


#: Bytes that a stretch of T must hold somewhere: Japanese text has kana; Latin text in UTF-8 has two-byte letters.
_NEEDED = {
    "utf_8": re.compile(rb"\xe3[\x80-\x83][\x80-\xbf]|[\xc2-\xdf][\x80-\xbf]|\xe2[\x80-\x84][\x80-\xbf]"),
    "cp932": re.compile(rb"[\x82\x83][\x40-\xfc]" + _PATTERNS["cp932"] + rb"|" + _PATTERNS["cp932"] + rb"[\x82\x83][\x40-\xfc]"),
    "euc_jp": re.compile(rb"[\xa4\xa5][\xa1-\xf6][\xa1-\xfe]{2}|[\xa1-\xfe]{2}[\xa4\xa5][\xa1-\xf6]"),
}
#: Kanji alone, several in a row; where a one-byte page was read the bigrams can judge them.
_KANJI_ALONE = {
    "utf_8": re.compile(rb"(?:[\xe4-\xe9][\x80-\xbf]{2}){2}"),
    "cp932": re.compile(rb"(?:[\x88-\x9f\xe0-\xea][\x40-\x7e\x80-\xfc]){3}"),
    "euc_jp": re.compile(rb"(?:[\xb0-\xf4][\xa1-\xfe]){3}"),
}


_ODD, _SIGN, _PAIR, _HALFWIDTH, _LOWER, _HAN, _LEAD, _PLAIN = (1 << i for i in range(8))


@lru_cache(1)
def kinds() -> np.ndarray:
    """What each code point can be in a text that went through a swap with a wide encoding.

    Wide text read in one-byte encodings has neighbouring characters that are neither ASCII nor East Asian, and not
    both plain. Kana in
    UTF-8 begin with the bytes E3 80 to E3 83, which wide encodings read as a few rare ideographs; kana of EUC-JP
    begin with half-width marks; Latin letters become half-width pairs or ideographs inside lower-case words.
    """
    k = np.zeros(0x110000, np.uint8)
    k[0x80:] |= _ODD
    for a, b in ((0x3000, 0x3100), (0x3400, 0xA000), (0xFF00, 0xFFF0), (0xFFFD, 0xFFFE)):
        k[a:b] &= ~np.uint8(_ODD)
    rare = {c for w in WRONG_WIDE for b in range(0x80, 0x84) if (c := _decoded(bytes([0xE3, b]), w)) and len(c) == 1}
    k[[ord(c) for c in rare | set("､･�")]] |= _SIGN
    k[0x80:0xA0] |= _SIGN
    k[0xE000:0xF900] |= _SIGN
    k[[0xFF82, 0xFF83]] |= _PAIR
    k[0xFF61:0xFF80] |= _HALFWIDTH
    k[0x61:0x7B] |= _LOWER
    k[0x3400:0xA000] |= _HAN
    k[[ord("‚"), ord("ƒ")]] |= _LEAD
    # Letters and marks that stand side by side in ordinary words; not those that UTF-8 so often begins with.
    k[[*range(0xC0, 0x100), *map(ord, "‘’“”„«»–—…°œŒ\xa0")]] |= _PLAIN
    k[[ord(c) for c in "ÃÂâ"]] &= ~np.uint8(_PLAIN)
    return k


def flags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, whether a swap with a wide encoding is possible and whether it holds any odd character at all."""
    k = kinds()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    hit = (k & _SIGN) != 0
    odd = (k & _ODD) != 0
    strange = (k & _PLAIN) == 0
    hit[:-1] |= odd[:-1] & odd[1:] & (strange[:-1] | strange[1:])
    hit[:-1] |= ((k[:-1] & _PAIR) != 0) & ((k[1:] & _HALFWIDTH) != 0)
    hit[:-1] |= ((k[:-1] & _LOWER) != 0) & ((k[1:] & _HAN) != 0)
    hit[:-2] |= ((k[:-2] & _LEAD) != 0) & ((k[2:] & _LEAD) != 0)
    wide, narrow = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    wide[np.searchsorted(ends, np.flatnonzero(hit), "right")] = True
    narrow[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
    return wide, narrow


_KANA = re.compile(rb"\xe3[\x80-\x83][\x80-\xbf]")


@lru_cache(None)
def repertoire(wrong: str) -> re.Pattern:
    """Runs of characters that `wrong` can have produced."""
    if wrong in WRONG:
        return re.compile("[\n -~" + _set(wrong, 0x80, 0xFF)[1:] + "+")
    return re.compile("[^�]+")


def _wide_runs(text: str, wrong: str):
    """Encodable pieces of text under a wide `wrong`: (start, piece, bytes, offsets of characters)."""
    for run in re.finditer("[^�\x00-\x7f]+", text):
        piece, start = run[0], run.start()
        while piece:
            try:
                raw = piece.encode(wrong)
                good = piece
            except UnicodeEncodeError as e:
                good = piece[: e.start]
                raw = good.encode(wrong)
            if good:
                yield start, good, raw
            start += len(good) + 1
            piece = piece[len(good) + 1 :]


def _offsets(piece: str, wrong: str) -> list[int]:
    if wrong in WRONG:
        return list(range(len(piece) + 1))
    at, out = 0, [0]
    for c in piece:
        at += len(c.encode(wrong))
        out.append(at)
    return out


def _decoded(raw: bytes, right: str) -> str | None:
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None


def _pieces(text: str, wrong: str) -> list[tuple[int, str, bytes]]:
    if wrong in WRONG:
        return [(m.start(), m[0], encoded(m[0], wrong)) for m in repertoire(wrong).finditer(text) if not m[0].isascii()]
    return list(_wide_runs(text, wrong))


def _aligned(piece: str, raw: bytes, wrong: str, right: str):
    """(start, end, bytes, whole) of the stretches of a piece that are whole units of `right` and whole characters of
    `wrong`; whole is the stretch with what was cut off at its ends."""
    index = None
    for m in _STRETCH[right].finditer(raw):
        a, b = m.span()
        if index is None:
            index = {o: i for i, o in enumerate(_offsets(piece, wrong))}
        if wrong in WRONG_WIDE:
            # A stretch begins and ends between characters; one that is cut in two belongs to the text beside it.
            cuts = [c for c in [*(u.start() for u in _UNITS[right].finditer(raw, a, b)), b] if c in index]
            if len(cuts) < 2:
                continue
            a, b = cuts[0], cuts[-1]
        yield index[a], index[b], raw[a:b], m[0]


def _stretches(pieces: list, wrong: str, right: str) -> list[tuple[int, int, str]]:
    """(start, end, original) of the stretches that can be strings of `right` read as `wrong`."""
    wide = wrong in WRONG_WIDE
    unicode_in_wide = wide and right == "utf_8"
    found = []
    for start, piece, raw in pieces:
        if not unicode_in_wide and not _NEEDED[right].search(raw) and (wide or not _KANJI_ALONE[right].search(raw)):
            continue
        for a, b, own, whole in _aligned(piece, raw, wrong, right):
            if unicode_in_wide or _NEEDED[right].search(whole) and not (wide and len(whole) < 6) or not wide and _KANJI_ALONE[right].search(whole):
                kana = bool(_KANA.search(whole if len(own) >= 6 else own))
                found.append((start + a, start + b, own, kana, len(piece)))
    if unicode_in_wide:
        # A few decodable bytes in a long text are chance: together they must hold kana and be thirty bytes or a fifth of
        # all. A letter of two bytes between ASCII stands on its own.
        strong = [x for x in found if len(x[2]) >= 6 or x[3]]
        total = sum(len(x[2]) for x in strong)
        if not any(x[3] for x in strong) or total < 30 and 5 * total < sum(len(raw) for _, _, raw in pieces):
            strong = []
        found = strong + [x for x in found if len(x[2]) == 2 and x[4] <= 3]
    decoded = ((a, b, _decoded(own, right)) for a, b, own, _, _ in found)
    return sorted((a, b, t) for a, b, t in decoded if t)


def all_spans(text: str) -> dict[tuple[str, str], list[tuple[int, int, str]]]:
    """Of each swap, (start, end, original) of the stretches of text that are whole strings of `right` read as `wrong`."""
    out = {}
    if text.isascii() or not flags([text])[0][0]:
        return out
    kind = kinds()
    odd = sorted(c for c in set(text) if kind[ord(c)] & _ODD)
    readings = set()
    for wrong in (*WRONG, *WRONG_WIDE):
        if wrong in WRONG:
            # Readings that most odd characters cannot come from, and readings of the same bytes, are left out.
            own = tuple(map(_byte_table(wrong).get, map(ord, odd)))
            if own.count(None) * 5 > len(own) * 2 or not own or own in readings:
                continue
            readings.add(own)
        pieces = _pieces(text, wrong)
        for right in RIGHT_WIDE:
            if (wrong, right) in WIDE_KEYS and (found := _stretches(pieces, wrong, right)):
                out[wrong, right] = found
    return out


WIDE_KEYS = {(w, t) for w in WRONG for t in RIGHT_WIDE} | {("cp932", "utf_8"), ("cp932", "euc_jp"), ("gb18030", "utf_8"), ("gb18030", "cp932")}


@lru_cache(None)
def cipher(wrong: str, right: str) -> dict[int, str]:
    """translate() table of a one-byte swap: wrong character to original letter."""
    table = {}
    for c, b in bytes_of(wrong).items():
        if b >= 0x80:
            original = _decoded(bytes([b]), right)
            if original and original != c and (original.isprintable() or original == "\xa0"):
                table[ord(c)] = original
    return table


NARROW_KEYS = [(w, t) for w in WRONG for t in RIGHT if w != t and cipher(w, t)]
_LATIN_ODD = re.compile("[^\x00-\x7f　-ヿ㐀-鿿＀-￯�]")


class Reader:
    """Hypotheses about one text under given bigrams."""

    def __init__(self, bigrams: Bigrams, pages: list[tuple[str, str]] | None = None):
        self.bigrams = bigrams
        self.pages = NARROW_KEYS if pages is None else pages
        self.gains: dict[tuple[str, str, str], float] = {}
        self.single: dict[tuple, float] = {}
        self.exchanges: dict[tuple[str, str, bool, bool], float] = {}

    def suspicious(self, texts: list[str], ciphers: list[dict[str, str] | None]) -> list[bool]:
        """Whether some swap may read each text better: one with a wide encoding by its flag, a one-byte cipher if the one
        learned for the text's source holds a character of it, or by a test of every odd character in its place."""
        out: list[bool] = []
        for part in pieces_of(texts):
            wide, narrow = flags(part)
            own = ciphers[len(out) : len(out) + len(part)]
            out += [bool(w or n and (c and not c.keys().isdisjoint(t) or self._narrow(t))) for t, w, n, c in zip(part, wide, narrow, own)]
        return out

    def _narrow(self, text: str) -> bool:
        for m in _LATIN_ODD.finditer(text):
            i = m.start()
            at = (text[i - 1 : i], text[i], text[i + 1 : i + 2])
            if at not in self.gains:
                options = {cipher(w, t).get(ord(at[1])) for w, t in self.pages} - {None}
                self.gains[at] = max((self.bigrams.gain(at[0], at[1], o, at[2]) for o in options), default=0.0)
            if self.gains[at] > 2.0:
                return True
        return False

    def apply_wide(self, text: str, found: list[tuple[int, int, str]]) -> tuple[float, str]:
        total, out, last = 0.0, [], 0
        for a, b, original in sorted(found):
            if a < last:
                continue
            g = self.bigrams.gain(text[:a], text[a:b], original, text[b:])
            if g > 0:
                total += g
                out += [text[last:a], original]
                last = b
        return total, "".join(out) + text[last:]

    def fill(self, text: str, wrong: str) -> tuple[float, str]:
        """(gain, text) with the UTF-8 letters that lost a byte: a lost byte is one that `wrong` cannot read, and of the
        letters these leave possible the bigrams choose. What fits no letter stays."""
        if "\ufffd" not in text or not undefined(wrong):
            return 0.0, text
        back, log, code = _byte_table(wrong), self.bigrams.log, alphabet()[0]
        total, out, last = 0.0, [], 0
        for m in _with_loss(wrong).finditer(text):
            raw = [None if c == "\ufffd" else back.get(ord(c)) for c in m[0]]
            new, i = "", 0
            while i < len(raw):
                lead = raw[i] or 0
                size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 0
                unit = raw[i : i + size]
                options = []
                if size and len(unit) == size and all(b is None or b < 0xC0 for b in unit[1:]):
                    choices = [(b,) if b is not None else undefined(wrong) for b in unit]
                    options = [y for x in itertools.product(*choices) if (y := _decoded(bytes(x), "utf_8"))]
                if options:
                    before = int(code[ord((new or text[: m.start()])[-1])]) if new or m.start() else 0
                    new += max(options, key=lambda y: log[before, code[ord(y)]] + (math.log(self.bigrams.ideographs.get(ord(y), 0) + 0.5) if code[ord(y)] == _IDEOGRAPH else 0.0))
                    i += size
                else:
                    new += m[0][i]
                    i += 1
            if new != m[0] and (g := self.bigrams.gain(text[: m.start()], m[0], new, text[m.end() :])) > 0:
                total += g
                out += [text[last : m.start()], new]
                last = m.end()
        return total, "".join(out) + text[last:]

    def read_wide(self, text: str, found: list[tuple[int, int, str]], wrong: str, right: str) -> tuple[float, str]:
        gain, original = self.apply_wide(text, found)
        if gain > 0 and right == "utf_8" and wrong in WRONG:
            more, original = self.fill(original, wrong)
            gain += more
        return gain, original

    def apply_narrow(self, text: str, places: list[int], table: dict[int, str]) -> tuple[float, str]:
        """translate() of the one window that the cipher improves most: all odd characters in it go through the cipher."""
        best, low, high, run, begin = 0.0, 0, 0, 0.0, 0
        for i in places:
            new = table.get(ord(text[i]))
            at = (text[i - 1 : i], text[i], new, text[i + 1 : i + 2])
            if at not in self.single:
                self.single[at] = -8.0 if new is None else self.bigrams.gain(*at)
            if run <= 0:
                run, begin = 0.0, i
            run += self.single[at]
            if run > best:
                best, low, high = run, begin, i + 1
        if not best:
            return 0.0, text
        new = text[:low] + text[low:high].translate(table) + text[high:]
        return (self.exchanged(text, new), new) if len(new) == len(text) else (0.0, text)

    def exchanged(self, old: str, new: str) -> float:
        """Gain of a text of the same length, from the pairs that differ; each pair's gain is remembered."""
        changed = [i for i in range(len(new)) if new[i] != old[i]]
        total = 0.0
        for i in sorted({*changed, *(j + 1 for j in changed)}):
            at = (old[i - 1 : i + 1] if i else old[:1], new[i - 1 : i + 1] if i else new[:1], i == 0, i == len(new))
            if at not in self.exchanges:
                pairs = [codes(x[-1:] if at[3] else x) for x in at[:2]]
                cut = slice(0, 1) if at[2] else slice(1, 2)
                self.exchanges[at] = float(self.bigrams.log[pairs[1][:-1], pairs[1][1:]][cut].sum() - self.bigrams.log[pairs[0][:-1], pairs[0][1:]][cut].sum())
            total += self.exchanges[at]
        return total

    def hypotheses(self, text: str, learned: dict[str, str] | None = None) -> list[tuple[str, float, str]]:
        """(swap, log likelihood ratio to the text as it stands, original); a swap may be followed by others.

        `learned` is the cipher learned for the text's source; characters it does not hold stand for themselves.
        """
        found = []
        if "�" in text and (g := self.bigrams.loss_gain(text)) > 0:
            found.append(("lost", g, text))
        first = [(*self.read_wide(text, stretches, w, t), f"{t}>{w}") for (w, t), stretches in all_spans(text).items()]
        found += [(name, g, original) for g, original, name in first if g > 0]
        best = max(first, default=(0.0, "", ""))
        for _ in range(3):  # the best reading may hold another swap below
            if best[0] <= 0:
                break
            more = max(((*self.read_wide(best[1], again, w, t), f"{t}>{w}") for (w, t), again in all_spans(best[1]).items()), default=(0.0, "", ""))
            if more[0] <= 6:
                break
            best = (best[0] + more[0], more[1], f"{more[2]}+{best[2]}")
            found.append((best[2], best[0], best[1]))
        if max((g for _, g, _ in found), default=0.0) > 20.0:
            return found
        places = [m.start() for m in _LATIN_ODD.finditer(text)]
        odd = sorted({ord(text[i]) for i in places})
        least = 0.0
        if learned and any(chr(o) in learned for o in odd):
            least, original = self.apply_narrow(text, places, {o: learned.get(chr(o), chr(o)) for o in odd})
            if least > 0:
                found.append(("learned", least, original))
        # Code pages add what the source's own cipher does not explain: another swap, or symbols too rare to be learned.
        readings = set()
        for w, t in self.pages:
            table = cipher(w, t)
            own = tuple(map(table.get, odd))
            if own in readings or own.count(None) == len(own):
                continue
            readings.add(own)
            g, original = self.apply_narrow(text, places, table)
            if g > max(0.0, least) + 1e-6:
                found.append((f"{t}>{w}", g, original))
        return found


def pieces_of(texts: list[str], size: int = 2_000_000):
    """The list in pieces of about so many characters, in order; what array work holds at once."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def trusted(text: str) -> bool:
    """Whether a flagged text can still be counted: few odd characters, no rare sign and no stretch that decodes."""
    k = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return not (k & _SIGN).any() and ((k & _ODD) != 0).mean() < 0.1 and not all_spans(text)


def pair_counts(texts: list[str]) -> np.ndarray:
    """Bigrams (first x codes + second) of the texts, without those that a swap with a wide encoding may have garbled."""
    return fair_counts(texts)[0]


def fair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, code points of ideographs), both without texts that a swap with a wide encoding may have garbled.

    A Latin letter of ASCII beside a letter or sign of no Latin alphabet is what one-byte ciphers leave behind, so
    such pairs are left out.
    """
    _, size, _ = alphabet()
    text = "\n".join(t for t, w in zip(texts, flags(texts)[0]) if not w or trusted(t))
    c = codes(text).astype(np.int64)
    raw = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = ((raw | 32) >= 0x61) & ((raw | 32) <= 0x7A) & (raw < 0x80)
    strange = ((kinds()[raw] & (_ODD | _PLAIN)) == _ODD) & ~((raw >= 0xC0) & (raw < 0x180))
    fine = ~((latin[:-1] & strange[1:]) | (strange[:-1] & latin[1:]))
    return np.bincount((c[:-1] * size + c[1:])[fine], minlength=size * size), raw[c == _IDEOGRAPH]


def _count(batches):
    _, size, _ = alphabet()
    total, single = np.zeros(size * size, np.int64), np.zeros(0x32000, np.int64)
    for batch in batches:
        for part in pieces_of([t for t in batch.column("text").to_pylist() if t]):
            pairs, ideographs = fair_counts(part)
            total += pairs
            single += np.bincount(ideographs, minlength=len(single))
    at = np.flatnonzero(single)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, np.int32)), pa.array(at.astype(np.int32)), pa.array(single[at].astype(np.float64))], names=["a", "b", "n"])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at].astype(np.float64))], names=["a", "b", "n"])


def _suspects(shared, pages):
    def run(batches):
        reader = Reader(shared.value, pages)
        for batch in batches:
            ciphers = [dict(c) if c else None for c in batch.column("cipher").to_pylist()]
            yield batch.filter(pa.array(reader.suspicious(batch.column("text").to_pylist(), ciphers), pa.bool_()))

    return run


# --- ciphers learned from a source's own text ---------------------------------------------------------------------
_CONTEXTS = "source string, symbol string, before int, after int, n long"


def _contexts(letters: list[str]):
    """How often each odd character stands between which neighbours (as codes of the alphabet), of texts that no wide swap
    can have garbled. Letters of the language are no odd characters."""

    def run(batches):
        code, known = alphabet()[0], set(letters)
        for batch in batches:
            count: dict[tuple, int] = {}
            texts = batch.column("text").to_pylist()
            for source, text, wide in zip(batch.column("source").to_pylist(), texts, flags(texts)[0]):
                if wide and not trusted(text):
                    continue
                for m in _LATIN_ODD.finditer(text):
                    if m[0] not in known:
                        i = m.start()
                        at = (source, m[0], int(code[ord(text[i - 1])]) if i else 0, int(code[ord(text[i + 1])]) if i + 1 < len(text) else 0)
                        count[at] = count.get(at, 0) + 1
            keys = list(count)
            kinds_ = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds_)), pa.array([count[k] for k in keys], pa.int64())], names=[c.split()[0] for c in _CONTEXTS.split(", ")])

    return run


def letters_of(counts: dict[tuple[int, int], float], least: float = 1e-3) -> list[str]:
    """Letters and quotation marks beyond ASCII that make up at least that share of all such characters counted."""
    code, size, _ = alphabet()
    single = np.zeros(size)
    for (_, b), n in counts.items():
        single[b] += n
    chars = [chr(o) for o in (*range(0xAA, 0x250), *range(0x2010, 0x2040)) if chr(o).isalpha() or chr(o) in "‘’“”„‚«»–—…°"]
    whole = sum(single[code[ord(c)]] for c in chars)
    return [c for c in chars if whole and single[code[ord(c)]] >= least * whole]


def learn_symbol(symbol: str, before: np.ndarray, after: np.ndarray, n: np.ndarray, bigrams: Bigrams, letters: list[str], pages=None, rounds: int = 12) -> tuple[str, float]:
    """(letter, probability): what an odd symbol of a source stands for, by expectation-maximisation.

    before, after and n are the codes of its neighbours and how often it stands between them. The hidden letter has the
    prior probability that the known code pages give it (any letter has a little, the symbol itself half); without pages
    all letters are alike. The language's bigrams score it between its neighbours. E step: the letter's posterior in
    every context. M step: the symbol's letters over all its contexts.
    """
    code = alphabet()[0]
    options = [symbol, *(y for y in letters if y != symbol)]
    known = [cipher(w, t).get(ord(symbol)) for w, t in (NARROW_KEYS if pages is None else pages)]
    prior = np.array([0.5] + [0.05 / len(options) + 0.45 * known.count(y) / max(1, len(known)) for y in options[1:]])
    prior /= prior.sum()
    ys = np.array([int(code[ord(y)]) for y in options])
    fit = (bigrams.log[before[:, None], ys[None, :]] + bigrams.log[ys[:, None], after[None, :]].T).astype(np.float64)
    theta = prior
    for _ in range(rounds):
        odds = np.log(theta) + fit
        weight = np.exp(odds - odds.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        theta = n @ weight + prior
        theta /= theta.sum()
    best = int(theta.argmax())
    return options[best], float(theta[best])


def _learn(shared, letters, pages):
    def run(pdf):
        source, symbol = pdf.source.iloc[0], pdf.symbol.iloc[0]
        letter, p = learn_symbol(symbol, pdf.before.to_numpy(), pdf.after.to_numpy(), pdf.n.to_numpy(np.float64), shared.value, letters, pages)
        return pd.DataFrame([(source, symbol, letter, p)] if letter != symbol else [], columns=["source", "symbol", "letter", "probability"])

    return run


def learned_ciphers(texts: DataFrame, shared, letters: list[str], certain: float = 0.8, pages=None) -> DataFrame:
    """(source, cipher): the letters that the symbols of each source stand for, where that is certain enough.

    Contexts of all texts (source, text) are counted before they are shuffled. A task gets one symbol of one source, as
    at most (codes of the alphabet) squared distinct contexts, however large the source is.
    """
    contexts = texts.select("source", "text").mapInArrow(_contexts(letters), _CONTEXTS).groupBy("source", "symbol", "before", "after").agg(F.sum("n").alias("n"))
    tables = contexts.groupBy("source", "symbol").applyInPandas(_learn(shared, letters, pages), "source string, symbol string, letter string, probability double")
    return tables.where(F.col("probability") >= certain).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "letter"))).alias("cipher"))


_EVIDENCE = "table_name string, record_id long, source string, swap string, gain double, text string, original string"


def _evidence(shared, pages):
    """One row per suspect and swap that reads it better."""

    def run(batches):
        reader = Reader(shared.value, pages)
        for batch in batches:
            rows = []
            for i, (text, learned) in enumerate(zip(batch.column("text").to_pylist(), batch.column("cipher").to_pylist())):
                best: dict[str, tuple[float, str]] = {}
                for swap, g, original in reader.hypotheses(text, dict(learned) if learned else None):
                    if g > best.get(swap, (0.0, ""))[0]:
                        best[swap] = (g, original)
                rows += [(i, swap, g, original) for swap, (g, original) in best.items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("table_name", "record_id", "source")), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), batch.column("text").take(at), pa.array([r[3] for r in rows], pa.string())],
                names=["table_name", "record_id", "source", "swap", "gain", "text", "original"],
            )

    return run


def _rescored(shared):
    """Gains of known readings under new bigrams."""

    def run(batches):
        for batch in batches:
            gains = [shared.value.score(original) - shared.value.score(text) for text, original in zip(batch.column("text").to_pylist(), batch.column("original").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table_name", "record_id", "source", "swap")), pa.array(gains, pa.float64())], names=["table_name", "record_id", "source", "swap", "gain"])

    return run


def _deltas(batches):
    """Garbled bigrams (the text minus its original), weighted by the record's posterior; to be taken out of the counts."""
    _, size, _ = alphabet()
    total: dict[int, float] = {}
    for batch in batches:
        for text, original, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "original", "posterior"))):
            if len(text) != len(original):
                continue
            a, b = codes(text).astype(np.int64), codes(original).astype(np.int64)
            for c, sign in ((a, weight), (b, -weight)):
                for k in (c[:-1] * size + c[1:]).tolist():
                    total[k] = total.get(k, 0.0) + sign
    keys = [k for k, n in total.items() if abs(n) > 1e-9]
    yield pa.RecordBatch.from_arrays([pa.array([k // size for k in keys], pa.int32()), pa.array([k % size for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.float64())], names=["a", "b", "n"])


def _bounded_counts(rows: DataFrame) -> dict[tuple[int, int], float]:
    """Counts on the driver: at most (codes of the alphabet) squared and one for each ideograph, whatever the input."""
    return {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def posteriors(evidence: DataFrame, sizes: DataFrame, work: Workspace, rounds: int = 2, prior: float = 0.02, strength: float = 50.0) -> DataFrame:
    """evidence (table_name, record_id, source, swap, gain) plus posterior, by EM over the swaps' share of each source.

    E step: a record's posterior of each swap against the text as it stands. M step: the share of each swap in the
    source, drawn towards its share in the whole collection by `strength` pseudo-records. Sums by source are combined
    before they are shuffled.
    """
    swaps = 40.0
    share = F.lit(prior / swaps)
    rows = evidence.withColumn("share", share)
    for turn in range(rounds + 1):
        odds = F.col("share") * F.exp(F.least("gain", F.lit(60.0)))
        totals = rows.groupBy("table_name", "record_id").agg(F.sum(odds).alias("all_odds"))
        rows = rows.join(totals, ["table_name", "record_id"]).withColumn("posterior", odds / (F.col("all_odds") + F.lit(1 - prior))).drop("all_odds")
        if turn == rounds:
            return rows.select(*evidence.columns, "posterior")
        rows = work.write(rows, "posterior")
        of_source = rows.groupBy("source", "swap").agg(F.sum("posterior").alias("own"))
        of_all = rows.groupBy("swap").agg(F.sum("posterior").alias("every")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("records"))))
        shares = of_source.join(sizes, "source").join(F.broadcast(of_all), "swap").select(
            "source", "swap", F.greatest(F.lit(1e-6), (F.col("own") + strength * (F.col("every") + prior) / (F.col("records") + 1)) / (F.col("n") + strength)).alias("share")
        )
        rows = rows.drop("share", "posterior").join(shares, ["source", "swap"])


def garbled(records: DataFrame, rounds: int = ROUNDS, threshold: float = 0.65, pages: list[tuple[str, str]] | None = None) -> DataFrame:
    """(table_name, record_id, swap, posterior, original) of the garbled rows of records (table_name, record_id, source, text).

    `original` is the restored text; characters that the wrong reading lost stay U+FFFD. Null and empty texts and
    texts of ASCII alone are never garbled. A null source is a source of its own. `pages` are the one-byte swaps known
    beforehand (wrong, right); an empty list leaves all of them to be learned.
    """
    spark = records.sparkSession
    work = Workspace(spark)
    records = records.withColumn("source", F.coalesce("source", F.lit("")))
    texts = spread(records.where("text is not null and text <> ''"))
    counts = _bounded_counts(texts.select("text").mapInArrow(_count, "a int, b int, n double"))
    ideographs = {b: counts.pop((a, b)) for a, b in list(counts) if a < 0}
    bigrams = Bigrams(counts, ideographs=ideographs)
    schema = "table_name string, record_id long, source string, text string, cipher map<string,string>"
    odd = texts.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("table_name", "record_id", "source", "text")
    shared = spark.sparkContext.broadcast(bigrams)
    ciphers = work.write(learned_ciphers(odd, shared, letters_of(counts), pages=pages), "ciphers")
    suspects = work.write(odd.join(ciphers, "source", "left").select("table_name", "record_id", "source", "text", "cipher").mapInArrow(_suspects(shared, pages), schema), "suspects")
    sizes = work.write(records.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    proof = work.write(spread(suspects).mapInArrow(_evidence(shared, pages), _EVIDENCE), "evidence")
    work.drop("suspects")
    thin = ["table_name", "record_id", "source", "swap"]
    # Flagged texts were never counted, so only one-letter ciphers change the bigrams and change with them.
    letters = work.write(proof.where((F.length("original") == F.length("text")) & (F.col("swap") != "lost")), "letters")
    fixed = proof.where((F.length("original") != F.length("text")) | (F.col("swap") == "lost")).select(*thin, "gain")
    judged = work.write(posteriors(fixed.unionByName(letters.select(*thin, "gain")), sizes, work), "judged")
    for _ in range(rounds - 1):
        weights = judged.where("posterior > 0.05").select(*thin, "posterior")
        minus = _bounded_counts(letters.join(weights, thin).select("text", "original", "posterior").mapInArrow(_deltas, "a int, b int, n double"))
        bigrams = Bigrams({k: counts.get(k, 0.0) - minus.get(k, 0.0) for k in counts.keys() | minus.keys()})
        again = letters.mapInArrow(_rescored(spark.sparkContext.broadcast(bigrams)), "table_name string, record_id long, source string, swap string, gain double")
        judged = work.write(posteriors(fixed.unionByName(again), sizes, work), "judged")
    best = judged.groupBy("table_name", "record_id").agg(F.sum("posterior").alias("posterior"), F.max_by("swap", F.struct((F.col("swap") != "lost").cast("int"), "gain", "swap")).alias("swap"))
    best = best.where(F.col("posterior") >= threshold)
    return best.join(proof.select("table_name", "record_id", "swap", "original"), ["table_name", "record_id", "swap"]).select("table_name", "record_id", "swap", "posterior", "original")


def documents_and_lines(documents: DataFrame, page_lines: DataFrame) -> DataFrame:
    """The records of both tables; lines are grouped into sources by their font, whose character map is at fault."""
    a = documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("record_id"), "source", "text")
    return a.unionByName(page_lines.select(F.lit("page_lines").alias("table_name"), F.col("line_id").alias("record_id"), F.concat(F.lit("font:"), F.coalesce("font_name", F.lit("")), F.lit(":"), F.coalesce(F.col("to_unicode").cast("string"), F.lit(""))).alias("source"), "text"))
