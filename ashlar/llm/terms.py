"""Sentences and terms of texts: words of any language, parts of identifiers, with a light plural stem."""

from __future__ import annotations

import functools
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
_HUMP = re.compile(r"(?<=[^\W\d_A-ZÀ-ÖØ-Þ])(?=[A-ZÀ-ÖØ-Þ])|(?<=\d)(?=[^\W\d_])")
_END = re.compile(r"[\n\r]+|(?<=[.?!)])\s+")
_WORD_OR_END = re.compile(f"{_WORD.pattern}|{_END.pattern}")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")


def stem(word: str) -> str:
    if len(word) > 4:
        if word.endswith("ies"):
            return word[:-3] + "y"
        if word.endswith(("ses", "xes", "ches", "shes")):
            return word[:-2]
        if word.endswith("s") and not word.endswith("ss"):
            return word[:-1]
    return word


@functools.lru_cache(maxsize=200_000)
def _parts(word: str) -> tuple[str, ...]:
    out = []
    for part in (word,) if word.islower() or word.isupper() else _HUMP.split(word):
        part = part.replace("-", "").lower()
        if len(part) > 1 and not part[0].isdigit():
            out.append(stem(part))
    return tuple(out)


def terms(sentence: str) -> list[str]:
    """Lower-cased parts of words split at case changes and underscores; hyphens join; numbers and single letters out."""
    return [part for word in _WORD.findall(sentence) for part in _parts(word)]


#: Stands between sentences; no term is a single sign.
MARK = "."
_MOST_KEPT = 200_000


class _Spelled(dict):
    """The terms of a word, and the mark of an end, by what was matched."""

    def __missing__(self, match: str) -> str:
        found = " ".join(_parts(match)) if match[0].isalnum() else MARK
        if len(self) >= _MOST_KEPT:
            self.clear()
        self[match] = found
        return found


_spelled = _Spelled()


def clean(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def sequence(text: str) -> str:
    """What ``sentences`` gives, as one text: terms and marks, with a space between; some are empty."""
    return " ".join(map(_spelled.__getitem__, _WORD_OR_END.findall(clean(text))))


def sentences(text: str) -> list[list[str]]:
    """The terms of each sentence or line, empty ones left out."""
    found = (terms(s) for s in _END.split(clean(text)))
    return [t for t in found if t]
