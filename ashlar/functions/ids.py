"""Coordinate identities ``path:startLine:startCol:endLine:endCol[:suffix]`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of an id. The path is as long as it can be, so of five or more numbers the last four are the
#: coordinates, and a suffix follows only where the text behind them isn't one more number.
COORDINATE = r"^(.*):(\d+):(\d+):(\d+):(\d+)(?::(.*))?\z"

#: No backslash, no number that begins with a zero, at most four colons.
_PLAIN = r"^[^:\\]*+(?::(?!0\d)[^:\\]*+){0,4}+\z"
#: Of what ends with its four numbers: a path and lines from 1 on; and the zeros that these numbers begin with.
_VALID = r"^.+:0*[1-9]\d*:\d+:0*[1-9]\d*:\d+\z"
_ZEROS = r"(?<=:)0+(?=\d+(?::\d+){0,3}\z)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slashed(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normalize_id(c: Column | str, source_path: Column | str | None = None) -> Column:
    r"""The comparable spelling of an id: ``\`` becomes ``/``; in ids of the coordinate form what follows the four
    numbers is dropped, and the numbers lose leading zeros. The form asks for a path and for lines from 1 on; other ids,
    empty ones too, keep their text. Null stays null.

    The split comes first and its validity second: ``p:5:0:7:1:0`` has the path ``p:5`` and line 0, so it isn't of the
    form, and isn't read as ``p:5:0:7:1`` with a suffix either.

    With ``source_path`` (the file that the id is known to lie in), a path that ends with it becomes it, so prefixes go.

    Ids without a backslash, a leading zero and more than four colons can't change and skip the other patterns. The
    expression is kept short, as generated code beyond some size isn't compiled.
    """
    c = _col(c)
    plain, s = c.rlike(_PLAIN), _slashed(c)
    bare = F.regexp_replace(s, COORDINATE, "$1:$2:$3:$4:$5")
    if source_path is not None:
        known = _slashed(_col(source_path))
        path = F.regexp_extract(bare, r"^(.*)(?::\d+){4}\z", 1)
        bare = F.when((known != "") & F.endswith(path, known), F.concat(known, F.substring(bare, F.length(path) + 1, F.length(bare)))).otherwise(bare)
        plain = plain & F.coalesce(known == "", F.lit(True))
    return F.when(plain, c).when(bare.rlike(_VALID), F.regexp_replace(bare, _ZEROS, "")).otherwise(s)


def coordinate(c: Column | str) -> Column:
    """A struct of the path, the four numbers and the suffix; null for ids of another form."""
    c = _slashed(_col(c))
    part = lambda i: F.regexp_extract(c, COORDINATE, i)
    fields = [part(1).alias("path")]
    fields += [F.try_to_number(part(i), F.lit("9" * 18)).cast("long").alias(n) for i, n in enumerate(("start_line", "start_col", "end_line", "end_col"), 2)]
    fields += [F.nullif(part(6), F.lit("")).alias("suffix")]
    return F.when(c.rlike(COORDINATE), F.struct(*fields))


def normalized_sql(column: str) -> str:
    """``normalize_id`` for DuckDB, by lists instead of a pattern: the last four neighbouring numbers among the parts
    between colons."""
    digits = "regexp_full_match(array_to_string(p[i:i + 3], ':'), '[0-9]+:[0-9]+:[0-9]+:[0-9]+')"
    bare = "list_transform(p[k:k + 3], lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0'))"
    other = "k IS NULL OR array_to_string(p[1:k - 1], ':') = '' OR ltrim(p[k], '0') = '' OR ltrim(p[k + 2], '0') = ''"
    chosen = f"CASE WHEN {other} THEN array_to_string(p, ':') ELSE array_to_string(p[1:k - 1] || {bare}, ':') END"
    return (
        rf"list_transform([string_split(replace({column}, '\', '/'), ':')], lambda p: "
        f"list_transform([list_max(list_filter(range(2, len(p) - 2), lambda i: {digits}))], lambda k: {chosen})[1])[1]"
    )


def key128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns, named k1 and k2: a 16-byte stand-in for long string keys in
    shuffles. Equal keys agree; that two different ones agree has a chance of 2**-128 a pair."""
    cols = [_col(c) for c in cols]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), *reversed(cols)).alias("k2")]
