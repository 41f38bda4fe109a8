"""A small grammar of what forms print: a label, a word for "number", a mark, and a value of some shape.

Labels are rows of a table in plain words; the patterns are made from them here, so a label is added without writing
one. A space in a label is any white space or none, capitals may have full stops behind them, and a slash stands as it is.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

#: After a label: a word for "number", and what parts it from its value.
NUMBER = r"(?:no|number|num)\b\.?"
MARK = r"\s*[:\-]?\s*"

#: Shapes of values.
DIGITS = "[0-9]"
CODE = r"[A-Z0-9/\-]"
PLAIN_CODE = "[A-Z0-9]"


def spelled(label: str) -> str:
    """A label as a pattern: capitals are initials, which may have full stops and a space each."""
    out = []
    for word in label.split(" "):
        if word.isupper() and len(word) > 1 and word.isalpha():
            out.append(r"\.?\s?".join(word) + r"\.?")
        else:
            out.append(re.escape(word))
    return r"\s*".join(out)


def any_of(labels: Sequence[str]) -> str:
    """Longer labels are tried first, as others may begin like them."""
    return "(?:" + "|".join(spelled(x) for x in sorted(labels, key=len, reverse=True)) + ")"


def phrases(texts: Sequence[str]) -> str:
    """Any of some phrases, however their words are spaced, also with a plural's letter at their end; longer ones are tried first."""
    return "|".join(r"\b" + r"\s+".join(re.escape(w) for w in x.split(" ")) + r"s?\b" for x in sorted(texts, key=len, reverse=True))


def run(signs: str, least: int, most: int, first: str | None = None) -> str:
    """A value of so many signs; first: what it begins with."""
    return f"{signs}{{{least},{most}}}" if first is None else f"{first}{signs}{{{least - 1},{most - 1}}}"


def grouped(*sizes: int, between: str = r"[ \t-]?") -> str:
    """Digits in groups that may be parted, and no further digit behind them."""
    return between.join(f"[0-9]{{{n}}}" for n in sizes) + f"(?!{between}[0-9])"


@dataclass(frozen=True)
class Label:
    """labels: in plain words. value: a shape. number: whether a word for "number" must (True), may (None) or can't (False)
    follow. mark: what parts label and value. near: signs of the line that may stand before the value instead. whole:
    the value ends at a word's end."""

    labels: tuple[str, ...]
    value: str
    number: bool | None = None
    mark: str = MARK
    near: int = 0
    whole: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        """Of these a text with the label has one, in any case; none where a label begins with initials, which may be parted."""
        firsts = {x.split(" ")[0] for x in self.labels}
        return () if any(w.isupper() for w in firsts) else tuple(sorted(firsts))

    @property
    def pattern(self) -> str:
        word = "" if self.number is False else rf"\s*{NUMBER}" if self.number else rf"\s*(?:{NUMBER})?"
        gap = rf"[^\n]{{0,{self.near}}}?\b" if self.near else rf"\.?{word}{self.mark}"
        return rf"(?i)\b{any_of(self.labels)}{gap}({self.value}){chr(92) + 'b' if self.whole else ''}"
