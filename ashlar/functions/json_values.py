"""JSON values as plain Python data with one spelling per value, for the Arrow-batched operators."""

from __future__ import annotations

import json
from decimal import Decimal


def _number(text: str):
    """1.0 is 1; other numbers by their exact decimal value."""
    d = Decimal(text).normalize()
    exponent = d.as_tuple().exponent
    if 0 <= exponent <= 400:
        return int(d)
    return {"": str(d)} if exponent > 400 or exponent < -330 else _Exact(d)


class _Exact(float):
    """A float that remembers its exact decimal, so that long fractions don't fall together."""

    def __new__(cls, d: Decimal):
        self = super().__new__(cls, d)
        self.d = d
        return self

    def __repr__(self) -> str:
        return str(self.d)


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=lambda s: {"": s})


def parse(text: str):
    """The value of a JSON text; a text that is no JSON is an object of one key, so that it still compares."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return {"": text}


def spelled(value) -> str:
    """One text per value: sorted keys, nulls inside objects left out."""
    if isinstance(value, str):
        return json.dumps(value)
    if value is True:
        return "true"
    if value is False:
        return "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ",".join(map(spelled, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{spelled(v)}" for k, v in sorted(value.items()) if v is not None) + "}"


def facts(text: str | None) -> dict:
    """The top-level keys of a JSON object. Null, and JSON null, have none; another value is kept under the key ''."""
    if text is None:
        return {}
    value = parse(text)
    return value if isinstance(value, dict) else {} if value is None else {"": value}


#: The JSON types by Python's.
TYPES = {str: "string", int: "number", _Exact: "number", float: "number", bool: "boolean", list: "list", dict: "object"}
