"""Texts as comparable words."""

from __future__ import annotations

import unicodedata


class Folding(dict):
    """A table for ``str.translate``, filled as characters are met.

    Letters and digits become those of their decomposed, case-folded form; marks and invisible
    characters go; whatever else isn't in ``kept`` becomes a blank.
    """

    def __init__(self, kept: str = ""):
        super().__init__()
        self.kept = kept

    def __missing__(self, code: int) -> str:
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold()).casefold()
        out = []
        for c in folded:
            kind = unicodedata.category(c)
            if kind[0] == "M" or kind == "Cf":
                continue
            out.append(c if c.isalnum() or c in self.kept else " ")
        self[code] = "".join(out)
        return self[code]

    def __reduce__(self):
        return (Folding, (self.kept,))


_FOLDING = Folding()


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, without case, accents and invisible characters; what lies between them doesn't matter."""
    return text.translate(_FOLDING).split() if text else []
