"""Top-level members of JSON objects as texts, moved, renamed and cast by a plan; numbers keep the text they have."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.scanner import make_scanner


class _Number(str):
    """A number by its text."""


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number)
_scan = make_scanner(_DECODER)
_SPACE = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_LONE = re.compile("[\ud800-\udfff]")
_encode = json.JSONEncoder(ensure_ascii=False).encode


def _quoted(value: str) -> str:
    return _encode(value) if value.isascii() or not _LONE.search(value) else json.dumps(value)


def _name(key: str) -> str:
    """A key as text that can be stored: half surrogate pairs by their escapes."""
    return key if key.isascii() or not _LONE.search(key) else json.dumps(key)[1:-1]


def text(value) -> str:
    """One spelling per value (sorted keys, no spaces), but for numbers, which are as written."""
    kind = value.__class__
    if kind is _Number:
        return str(value)
    if kind is str:
        return _quoted(value)
    if kind is dict:
        return "{" + ",".join(f"{_quoted(k)}:{text(v)}" for k, v in sorted(value.items())) + "}"
    if kind is list:
        return "[" + ",".join(map(text, value)) + "]"
    return "null" if value is None else "true" if value else "false"


def members(source: str) -> dict[str, str] | None:
    """Each key of a JSON object with the text of its value, of repeated keys the last; None for other texts."""
    try:
        at = _SPACE(source, 0).end()
        if source[at : at + 1] != "{":
            return None
        out: dict[str, str] = {}
        at = _SPACE(source, at + 1).end()
        if source[at] == "}":
            return out if _SPACE(source, at + 1).end() == len(source) else None
        while source[at] == '"':
            key, at = scanstring(source, at + 1, True)
            key = _name(key)
            if source[at] != ":":
                at = _SPACE(source, at).end()
                if source[at] != ":":
                    return None
            at += 1
            if source[at] in " \t\n\r":
                at = _SPACE(source, at).end()
            value, end = _scan(source, at)
            kind = value.__class__
            out[key] = source[at:end] if kind is not dict and kind is not list and (kind is not str or "\\" not in source[at:end]) else text(value)
            at = _SPACE(source, end).end()
            if source[at] == "}":
                return out if _SPACE(source, at + 1).end() == len(source) else None
            if source[at] != ",":
                return None
            at = _SPACE(source, at + 1).end()
        return None
    except (ValueError, IndexError, StopIteration, RecursionError):
        return None


_TYPES = {str: "string", _Number: "number", bool: "boolean", list: "list", dict: "object"}


def cast(value, want: str, inner: str = ""):
    """``value`` as the JSON type ``want`` where that loses nothing, else as it is. Scalars and their text turn into each
    other, 0 and 1 are false and true, a lone value and a list of it, and an object whose only field is ``inner``."""
    have = _TYPES.get(value.__class__)
    if have is None or have == want:
        return value
    if have == "list" and len(value) == 1 and _TYPES.get(value[0].__class__) == want:
        return value[0]
    if have == "object" and len(value) == 1:
        only = next(iter(value.values()))
        if _TYPES.get(only.__class__) == want:
            return only
    if want == "list":
        return [value]
    if want == "object":
        return {inner: value} if inner else value
    if want == "string" and have in ("number", "boolean"):
        return text(value)
    if want == "number":
        if have == "boolean":
            return _Number("1" if value else "0")
        if have == "string" and _NUMBER.fullmatch(value):
            return _Number(value)
    if want == "boolean":
        if have == "string" and value in ("true", "false"):
            return value == "true"
        if have == "number" and value in ("0", "1", "0.0", "1.0"):
            return value[0] == "1"
    return value


class Plan:
    """Moves (path to path, as tuples; ``[]`` is the element of a list) and casts (the original path to a type and,
    for objects, the field to wrap into), as a JSON text."""

    def __init__(self, moves: dict[tuple, tuple], casts: dict[tuple, tuple[str, str]]):
        self.moves, self.casts = moves, casts

    def dump(self) -> str:
        return json.dumps({"moves": sorted([list(a), list(b)] for a, b in self.moves.items()), "casts": sorted([list(a), list(b)] for a, b in self.casts.items())})

    @classmethod
    def load(cls, source: str) -> Plan:
        d = json.loads(source)
        return cls({tuple(a): tuple(b) for a, b in d["moves"]}, {tuple(a): tuple(b) for a, b in d["casts"]})

    def apply(self, source: str) -> dict[str, str] | None:
        """``members`` after the moves and casts. A field keeps its own place where another one has the new place."""
        try:
            value = _DECODER.decode(source)
        except (ValueError, RecursionError):
            return None
        if value.__class__ is not dict:
            return None
        outside: list[tuple[tuple, tuple, object]] = []
        out = self._object(value, (), (), outside)
        for own, to, moved in outside:
            if not _put(out, to, moved):
                _put(out, own, moved)
        return {_name(k): text(v) for k, v in out.items()}

    def _value(self, value, path: tuple, to: tuple, outside: list):
        if value.__class__ is dict:
            value = self._object(value, path, to, outside)
        elif value.__class__ is list:
            value = [self._value(x, path + ("[]",), to + ("[]",), outside) for x in value]
        return cast(value, *self.casts[path]) if path in self.casts else value

    def _object(self, value: dict, path: tuple, to: tuple, outside: list) -> dict:
        out: dict = {}
        waiting = []
        depth = len(to)
        for name, inner in value.items():
            own = path + (name,)
            at = self.moves.get(own, to + (name,))
            inner = self._value(inner, own, at, outside)
            if at == to + (name,):
                if not _put(out, (name,), inner):
                    waiting.append(((name,), (name,), inner))
            elif at[:depth] == to and "[]" not in at[depth:]:
                rest = at[depth:]
                taken = len(rest) == 1 and rest[0] in value and self.moves.get(path + rest, to + rest) == to + rest
                waiting.append(((name,), (name,) if taken else rest, inner))
            elif "[]" not in own and "[]" not in at:
                outside.append((to + (name,), at, inner))
            else:
                waiting.append(((name,), (name,), inner))
        for own, rest, inner in waiting:
            if not _put(out, rest, inner):
                _put(out, own, inner)
        return out


def _put(out: dict, path: tuple, value) -> bool:
    """Puts a value at a path of an object; False where another value is in the way."""
    for name in path[:-1]:
        out = out.setdefault(name, {})
        if out.__class__ is not dict:
            return False
    if path[-1] in out:
        return False
    out[path[-1]] = value
    return True
