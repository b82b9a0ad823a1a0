"""Words of a text: lower case without accents, then runs of a-z and 0-9."""

from __future__ import annotations

import re
import unicodedata

_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_WORD = re.compile("[a-z0-9]+")


def fold(text: str) -> str:
    """Lower case, without accents."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str) -> list[str]:
    """Words of a text, in order."""
    return _WORD.findall(fold(text))
