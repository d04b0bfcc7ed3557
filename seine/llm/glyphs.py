"""Tables of characters that are written differently but look the same."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters that the Unicode data leaves without a single Latin letter, or gives another one than their shape.
LOOK_ALIKES_BESIDE = {"Ԛ": "Q", "ӏ": "l", "ⅿ": "m"}
# Letters that differ from a Latin one by a missing dot; missing accents are visible.
DOTLESS = "ıȷ"
_MINUS = "\u2212"


@lru_cache(maxsize=1)
def _confusables() -> tuple[str, ...]:
    """Characters the rule of :func:`look_alikes` asks about: letters without a case mapping to themselves, numerals, hyphens."""
    asked = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) in ("Lu", "Ll", "Lt", "Lo", "Nl", "Pd") or char == _MINUS:
            asked.append(char)
    return tuple(asked)


_FOUND: dict[str, str] = {}


def look_alikes(spark) -> dict[str, str]:
    """Character -> the ASCII letter or hyphen it cannot be told from by eye.

    The rule: a letter (no raised one), letter numeral or hyphen whose prototype in the public Unicode confusables data, as the ICU
    library of Spark's own JVM holds them, is one ASCII letter (for hyphens and the minus: the hyphen). The data give ``l`` as the
    prototype of the upright stroke in either case; here a capital stands for ``I``, since letter case is visible. Dotless
    letters are left out.
    """
    if not _FOUND:
        asked = _confusables()
        prototypes = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(asked)).split("\n")
        for char, to in zip(asked, prototypes, strict=True):
            dash = unicodedata.category(char) == "Pd" or char == _MINUS
            if char in DOTLESS or len(to) != 1 or not (to == "-" if dash else to.isascii() and to.isalpha()):
                continue
            capital = char.isupper() or unicodedata.category(char) == "Lu"
            _FOUND[char] = "I" if to == "l" and capital else to
        _FOUND.update(LOOK_ALIKES_BESIDE)
    return dict(_FOUND)


#: Java and Python regular-expression class of what shows nothing and is no format character or mark already.
FILLERS = "ᅟᅠㅤﾠ"
#: Format characters that are drawn.
_DRAWN = set(range(0x0600, 0x0606)) | {0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
_HANGUL = range(0xAC00, 0xD7A4)


def invisible(char: str) -> bool:
    """Format characters, variation selectors and fillers; controls other than tab and line ends."""
    code, kind = ord(char), unicodedata.category(char)
    if kind == "Cf":
        return code not in _DRAWN
    if kind == "Cc":
        return char not in "\t\n\v\f\r\x85"
    return char in FILLERS or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F


def _expand(char: str) -> str:
    """Full decomposition by canonical and width mappings; blanks become the space, invisible characters nothing."""
    if invisible(char):
        return ""
    if char != " " and unicodedata.category(char) == "Zs":
        return " "
    mapping = unicodedata.decomposition(char)
    if not mapping:
        return char
    kind, _, rest = mapping.partition(" ") if mapping.startswith("<") else ("", "", mapping)
    if kind not in ("", "<wide>", "<narrow>"):
        return char
    return "".join(_expand(chr(int(x, 16))) for x in rest.split())


@lru_cache(maxsize=1)
def decompositions() -> dict[str, str]:
    """Every character that does not stand for itself, from the rule above; its size is bounded by Unicode."""
    out = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if code < 0x80 and not invisible(char) or 0xD800 <= code <= 0xDFFF:
            continue
        to = unicodedata.normalize("NFD", char) if code in _HANGUL else _expand(char)
        if to != char:
            out[char] = to
    return out


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """Full decomposition -> character, for every character that is its own composed form."""
    out = {}
    for code in range(0xC0, sys.maxunicode + 1):
        char = chr(code)
        mapping = unicodedata.decomposition(char)
        if code in _HANGUL or (mapping and not mapping.startswith("<") and unicodedata.normalize("NFC", char) == char):
            out[unicodedata.normalize("NFD", char)] = char
    return out


@lru_cache(maxsize=1)
def mark_classes() -> dict[str, int]:
    """Canonical combining class of every mark that has one; what joins a starter without a class follows all classes."""
    marks = {chr(c): k for c in range(0x300, sys.maxunicode + 1) if (k := unicodedata.combining(chr(c)))}
    joining = {m for apart in _composed() for m in apart[1:] if m not in marks}
    finals = {chr(c) for c in range(0x11A8, 0x11C3)}
    return marks | {m: 301 if m in finals else 300 for m in joining}


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Starter with its marks in order of class -> the single character that stands for them."""
    classes = mark_classes()
    return {apart[0] + "".join(sorted(apart[1:], key=lambda m: classes.get(m, 0))): char for apart, char in _composed().items()}


_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def fold(text: str, alike: dict[str, str]) -> str:
    """The consistent form of one text, computed directly."""
    if text.isascii() and not _CONTROLS.search(text):
        return text
    apart = decompositions()
    return unicodedata.normalize("NFC", "".join(alike.get(x, x) for c in text for x in apart.get(c, c)))
