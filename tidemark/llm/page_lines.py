"""What the operators on web-page texts share: a page as a list of line elements, each hashed at several levels.

A page text is a flat tree: the page, its lines, and within a line a label or bullet and the rest. Each element is hashed
  exact   by its letters alone (case, digits, marks and spacing dropped),
  label   by the letters before a separator (``Tags:``, ``Related »``, ``Home >``),
  opening by its first two words,
  shape   by its sequence of word classes and signs, runs collapsed with their rough length,
so that copies with filled-in slots meet at one of the levels. Lines are counted from 1 and split at line feeds only.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import regex
import xxhash

_NOT_LETTER = regex.compile(r"[^\p{L}]+")
_NO_ASCII_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_CLOSERS, _ENDS = "\"'”’»)]", frozenset(".?!।॥")
#: Marks that may stand behind the last sentence of a text, and marks of a cut (fixed values).
END_MARK = re.compile(r"(?:\s*(?:\(ends\)|■|/END|###|\*\*\*|-30-|[-–—] ?[A-Z][\w&]+(?: [A-Z][\w&]+){0,3}|\|\||>>|»))+\s*$")
CUT_MARK = re.compile(r"(?:\s*(?:\[?(?:\.\.\.|…)\]?|\[\+\d+ chars\]|\(more\)|�))+(?:\s*(?:[Rr]ead more|[Rr]ead on|[Cc]ontinue reading|[Mm]ore))?\s*$")
_LABEL = re.compile(r"^([^\d:|»›>/]{2,40}?)\s*(?::|\||»|›|>|&raquo;|\s/|\s-)\s+(\S.*)$")
_BULLET = re.compile(r"^(?:[-*•–·▪>]|\(?\d{1,3}[.)])\s+")
_WORD = re.compile(r"[^\W\d_][\w'’&-]*|\d[\d.,:]*|[^\w\s]")
_NUMERIC = re.compile(r"^[\W\d_]*(?:per cent)?[\W\d_]*$")
_BULLET_SHAPE = re.compile(r"^(?:[-*•–·▪>]|0[.)])")
_RUNS = str.maketrans("abcde", "wwwww")
#: How many characters at the end of a line are looked at for marks.
_TAIL = 60

#: Bits of a line's form.
CLOSED, CUT, PROSE, ANCHOR, NUMERIC, SHORT = 1, 2, 4, 8, 16, 32


def key(text: str) -> str:
    """The letters of a line in order, in lower case."""
    if text.isascii():
        return text.encode().translate(None, _NO_ASCII_LETTER).decode().lower()
    return _NOT_LETTER.sub("", text).lower()


def digest(text: str) -> int:
    """Signed 64-bit hash of a string."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def small(text: str) -> int:
    """Signed 32-bit hash of a string, never 0."""
    h = zlib.crc32(text.encode("utf-8", "replace"))
    return (h - (1 << 32) if h >> 31 else h) or 1


def _ended(text: str) -> bool:
    """Whether a text ends with a sentence."""
    return text[-1:] in _ENDS or text[-8:].rstrip(_CLOSERS)[-1:] in _ENDS


def _run(n: int) -> str:
    return "a" if n == 1 else "b" if n < 3 else "c" if n < 6 else "d" if n < 10 else "e"


def shape(text: str) -> str:
    """Word classes and signs, runs of lower-case words collapsed to a length class."""
    out, run, last = [], 0, ""
    for w in _WORD.findall(text):
        c = w[0]
        if c.isalpha():
            if not c.isupper():
                run += 1
                continue
            kind = "C"
        else:
            kind = "0" if c.isdigit() else c
        if run:
            out.append(_run(run))
            run, last = 0, ""
        if kind == last and kind in "C0":
            continue
        out.append(kind)
        last = kind
    if run:
        out.append(_run(run))
    return "".join(out)


def coarse(shape_: str) -> int:
    """The hash of a shape without bullets and run lengths; 0 for shapes without a sign, which say too little."""
    plain = _BULLET_SHAPE.sub("", shape_).translate(_RUNS)
    return small("c" + plain) if plain.strip("Cw0") else 0


def form(text: str) -> tuple[int, int, int, int, int, int, int]:
    """(exact, label, opening, shape, shape of the rest, coarse shape, form bits) of one stripped line; 0 where a level is absent."""
    return _short_form(text) if len(text) <= 120 else _form(text)


@lru_cache(maxsize=65_536)
def _short_form(text: str) -> tuple[int, int, int, int, int, int, int]:
    """Short lines repeat, so each worker remembers a bounded number of them."""
    return _form(text)


def _form(text: str) -> tuple[int, int, int, int, int, int, int]:
    k = key(text)
    exact = digest(k) if k else digest("\x00" + text)
    tagged = "<" in text and bool(_TAG.search(text))
    plain = _TAG.sub(" ", text).strip() if tagged else text
    n = plain.count(" ") + 1
    tail = plain[-_TAIL:]
    bits = 0
    if ("..." in tail or "…" in tail or "chars]" in tail or "(more)" in tail or "�" in tail) and CUT_MARK.search(tail):
        bits = CUT
    elif _ended(tail) or _ended(END_MARK.sub("", tail)):
        bits = CLOSED
    prose = n >= 5 and (bits or n > 25) and not (tagged and n < 40)
    if prose:
        bits |= PROSE | (ANCHOR if n >= 15 else 0)
    if n < 5:
        bits |= SHORT
    if bits & ANCHOR or n > 40:  # long prose is decided by what it says, not by its form
        return exact, 0, _opening(plain), 0, 0, 0, bits
    m = _LABEL.match(plain)
    label = small("l" + key(m[1])) if m and len(m[1]) > 1 else 0
    if m and _NUMERIC.match(m[2]):
        bits |= NUMERIC
    bullet = _BULLET.match(plain)
    kind = shape(plain)
    whole, rough = small(kind), coarse(kind)
    if bullet:
        return exact, label, 0, whole, small(shape(plain[bullet.end() :])), rough, bits
    rest = small(shape(m[2])) if m and not bits & NUMERIC else 0
    return exact, label, _opening(plain), whole, rest, rough, bits


def _opening(text: str) -> int:
    return small("o" + key(" ".join(text.split(None, 2)[:2])))
