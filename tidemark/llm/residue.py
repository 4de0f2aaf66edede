"""Detectors for what a broken page or publishing system prints instead of text, and the words that tell such output apart.

Placeholders are known by their form. Filler, errors, block messages and notices aren't listed anywhere: they are known by words that
stand on pages whose text has nothing in common with its own address and title, and hardly on others. Which words those are is counted
on the pages themselves (see ``boilerplate.vocabulary``).
"""

from __future__ import annotations

import re
import zlib

#: Unfilled placeholders (fixed values).
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^%\n]{0,60}%\}|<%[^%\n]{0,60}%>|\$\{[^{}\n]{1,60}\}|\$[A-Z][A-Z_]*_[A-Z_]+\b|%%[A-Za-z_]{2,40}%%|\[\[[A-Za-z_ ]{2,40}\]\]|#?\{[a-z_.]{1,40}\}|\{\d{1,2}\}"
    r"|\[(?:INSERT|ADD|YOUR|HEADLINE|BODY|TEXT|QUOTE|NAME|DATE|TITLE)\b[A-Z ]{0,40}\]|__[A-Z][A-Z_]{1,40}__|%s\b|%\([a-z_]+\)s|@@[a-z_]{2,40}@@|\bTK TK\b|\bTK headline\b|\[object Object\]|<[A-Z][A-Z_ ]{2,40}>"
    r"|\bTODO:|<!-- ?[A-Z_]{2,40} ?-->|\bXX+ per cent \(check\)|\bXX per cent\b"
)
#: Substrings of which a match of each pattern has one: looked for first, since that is much cheaper.
_PLACEHOLDER_HINTS = ("{", "<", "[", "%%", "%s", "%(", "$", "__", "@@", "TK ", "TODO", "XX")
_TOKEN = re.compile(r"[^\W_]+")
_EXTENSION = re.compile(r"\.[a-z]{2,5}$")
_LONG = re.compile(r"[^\W_]{3,}")
_SLUG = re.compile(r"/([^/?#]+?)/?(?:[?#].*)?$")

#: Bits of a line or headline that this module sets, above the bits of its form.
HAS_PLACEHOLDER, SHARES_TERM, MISMATCHED, IN_BODY, SIDES, ABOUT = 256, 512, 1024, 2048, 4096, 8192


def terms(text: str | None) -> set[str]:
    """The distinct words of three or more characters that aren't numbers, in lower case."""
    return {w for w in _LONG.findall(text.lower()) if not w.isdigit()} if text else set()


def slug_terms(url: str | None) -> set[str]:
    """The words of the last part of an address, without its extension."""
    if not url:
        return set()
    if "?" in url or "#" in url or "\n" in url:
        m = _SLUG.search(url)
        last = m[1] if m else ""
    else:  # the same, sooner
        at = (url := url.removesuffix("/")).rfind("/")
        last = url[at + 1 :] if at >= 0 else ""
    return terms(_EXTENSION.sub("", last)) if last else set()


def story(about: set[str]) -> int:
    """A hash that versions of one story mostly share: the least hash of the words of its address or headline. 0 without words."""
    return min((zlib.crc32(w.encode()) for w in about if len(w) > 3), default=0)


def _has(text: str, hints: tuple[str, ...]) -> bool:
    for h in hints:
        if h in text:
            return True
    return False


def unfilled(text: str, sure: bool = True) -> bool:
    """Whether a text has a placeholder, or where that need not be sure, whether any part of it may have one."""
    return _has(text, _PLACEHOLDER_HINTS) and (not sure or PLACEHOLDER.search(text) is not None)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())
