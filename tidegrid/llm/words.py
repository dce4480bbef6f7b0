"""Words of a text: NFKD, without combining marks and format characters, lower-cased; the maximal runs of letters."""

from __future__ import annotations

import re
import unicodedata


class _Fold(dict):
    """What each code point becomes, worked out when it is first met. Letters stay; marks and format characters go;
    all else is a blank, but decimal digits where ``digits`` is set and the signs in ``kept``."""

    def __init__(self, digits: bool, kept: dict[str, str] | None = None) -> None:
        super().__init__()
        self.digits, self.kept = digits, kept or {}

    def __missing__(self, point: int) -> int | str | None:
        kind = unicodedata.category(chr(point))
        out = point if kind[0] == "L" else None if kind[0] == "M" or kind == "Cf" else " "
        if self.digits and kind == "Nd":
            out = str(unicodedata.digit(chr(point)))
        out = self.kept.get(chr(point), out)
        self[point] = out
        return out


_LETTERS = _Fold(False)
_NUMERALS = _Fold(True, {".": ".", ",": ",", "'": "'", "\u2019": "'", "/": "/", "\u2044": "/"})
_TOKEN_OR_NUMERAL = re.compile(r"[0-9]+(?:[.,'/][0-9]+)*|[^0-9\s.,'/]+")


def cased_words(text: str | None) -> list[str]:
    """Words before lower-casing."""
    if not text:
        return []
    return (text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_LETTERS).split()


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return (text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_LETTERS).lower().split()


def tokens(text: str | None) -> list[str]:
    """Words before lower-casing, and numerals in digits with the signs inside them, in their order."""
    if not text:
        return []
    return _TOKEN_OR_NUMERAL.findall((text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_NUMERALS))
