"""Code-point tables shared by the text operators; derived from the Unicode database, not listed."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

#: Invisible characters that carry no text: format controls and the soft hyphen.
INVISIBLE = dict.fromkeys([0xAD, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)])

_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")


@functools.cache
def letters() -> np.ndarray:
    """uint8 by code point: 1 for letters and marks, 0 otherwise (planes beyond the third count as no letters)."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x40000)), np.uint8, 0x40000)


@functools.cache
def base_letters() -> np.ndarray:
    """uint8 by code point: 1 for letters alone."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x40000)), np.uint8, 0x40000)


def plain(text: str) -> str:
    """Compatibility-composed form without invisible characters; ASCII is returned as it is."""
    if text.isascii():
        return text
    t = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
    return t.translate(INVISIBLE) if _INVISIBLE.search(t) else t


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
