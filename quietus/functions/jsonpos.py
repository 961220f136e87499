"""Strict JSON with places: every value of a document as a row that says where it stands, and the first fault of one that is refused.

One expression cuts the text into tokens, and a stack of open containers says what may come next, so neither depth nor length is a matter of the interpreter's own stack. Places are lines from one and
columns from one in UTF-16 units, counted forwards over the text once.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.functions.text import StrictJSONError

#: Containers that may stand in each other.
MAX_DEPTH = 64
_SPACE = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(r'(?P<mark>[{}\[\],:])|(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)')
_KINDS = {"string": "string", "number": "number", "true": "boolean", "false": "boolean", "null": "null"}


class Fault(StrictJSONError):
    """What a document may not hold, and the offset it stands at."""

    def __init__(self, reason: str, offset: int):
        super().__init__(reason)
        self.offset = offset


def escaped(name: str) -> str:
    """A member's name as a segment of a JSON pointer."""
    return name.replace("~", "~0").replace("/", "~1")


def values(text: str, max_depth: int = MAX_DEPTH) -> list[dict]:
    """(pointer, kind, name_start, start, end, value) of every value, a container before what it holds, by rising start; offsets in code points, name_start only for members, value only for scalars.

    Raises Fault where the text is no JSON, repeats a member, or nests deeper than ``max_depth``.
    """
    rows: list[dict] = []
    opened: list[tuple[dict, set[str] | None]] = []  # containers still open, an object's with the names it has
    items: list[int] = []
    want, at, name = "value", 0, None
    while True:
        at = _SPACE.match(text, at).end()
        token = _TOKEN.match(text, at)
        if want == "end":
            if at < len(text):
                raise Fault("data follows the value", at)
            return rows
        if token is None:
            raise Fault("no JSON token stands here", at)
        mark, end = token["mark"], token.end()
        if mark in ("}", "]"):
            closes = opened and (mark == "}") == (opened[-1][1] is not None)
            if not closes or want not in ("next", "first name", "first value"):
                raise Fault("nothing to close here", at)
            opened.pop()[0]["end"] = end
            items.pop()
            want = "next" if opened else "end"
        elif want == "next":
            if mark != ",":
                raise Fault("a comma or an end is expected", at)
            want = "value" if opened[-1][1] is None else "name"
        elif want == "colon":
            if mark != ":":
                raise Fault("a colon is expected", at)
            want = "value"
        elif want in ("name", "first name"):
            if not token["string"]:
                raise Fault("a member's name is expected", at)
            label = json.loads(token[0])
            if label in opened[-1][1]:
                raise Fault("a member is repeated", at)
            opened[-1][1].add(label)
            name, want = (label, at), "colon"
        elif mark in (",", ":"):
            raise Fault("a value is expected", at)
        else:
            pointer = ""
            if opened:
                if opened[-1][1] is None:
                    pointer, name = f"{opened[-1][0]['pointer']}/{items[-1]}", None
                    items[-1] += 1
                else:
                    pointer = f"{opened[-1][0]['pointer']}/{escaped(name[0])}"
            row = {"pointer": pointer, "name_start": name[1] if name else None, "start": at, "end": end, "value": None}
            rows.append(row)
            name = None
            if mark:
                if len(opened) >= max_depth:
                    raise Fault(f"values nest deeper than {max_depth} levels", at)
                row["kind"] = "object" if mark == "{" else "array"
                opened.append((row, set() if mark == "{" else None))
                items.append(0)
                want = "first name" if mark == "{" else "first value"
            else:
                row["kind"] = _KINDS[token.lastgroup if token.lastgroup in _KINDS else token[0]]
                row["value"] = json.loads(token[0]) if token["string"] else token[0]
                want = "next" if opened else "end"
        at = end


def places(text: str, offsets: list[int]) -> list[tuple[int, int]]:
    """(line, column) of each of the rising ``offsets``."""
    out, line, column, at = [], 1, 1, 0
    for offset in offsets:
        passed = text[at:offset]
        if (lines := passed.count("\n")) > 0:
            line, column, passed = line + lines, 1, passed[passed.rindex("\n") + 1 :]
        column += len(passed) + sum(c > "\uffff" for c in passed)
        at = offset
        out.append((line, column))
    return out


def _whole(value: str | None) -> str | None:
    """``value`` with halves of surrogate pairs, which escapes may leave alone, replaced: a column holds none."""
    return value if value is None or value.isascii() else value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def placed(text: str | None) -> dict | None:
    """(values, fault) of a document: its values with the line and column of their member's name or else their own, or its first fault with its place."""
    if text is None:
        return None
    try:
        rows = values(text)
    except Fault as e:
        (line, column) = places(text, [e.offset])[0]
        return {"values": None, "fault": {"line": line, "col": column, "message": str(e)}}
    firsts = [r["start"] if r["name_start"] is None else r["name_start"] for r in rows]
    return {"values": [r | {"pointer": _whole(r["pointer"]), "value": _whole(r["value"]), "line": line, "col": col} for r, (line, col) in zip(rows, places(text, firsts), strict=True)], "fault": None}


PLACED = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("pointer", "kind", "value")] + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "line", "col")]))),
        T.StructField("fault", T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("message", T.StringType())])),
    ]
)


@F.pandas_udf(PLACED)
def placed_udf(texts: pd.Series) -> pd.DataFrame:
    """``placed`` of each document; both parts null for a null text."""
    names = ("pointer", "kind", "value", "start", "end", "line", "col")
    read = [placed(t) or {"values": None, "fault": None} for t in texts]
    return pd.DataFrame({"values": [None if r["values"] is None else [{n: v[n] for n in names} for v in r["values"]] for r in read], "fault": [r["fault"] for r in read]}, columns=["values", "fault"])
