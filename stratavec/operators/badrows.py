"""Rows that fail to parse: strict load, anti-join on record offsets, diagnosis of what is left.

The strict loader only ever accepts whole conforming records. What the load did not accept is found by subtracting the
accepted offsets from all offsets, so a record can neither be lost nor be both accepted and rejected; the reason is then
worked out for those few records alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("Inserted", "Changed", "Deleted", "Error")
FIELDS = ("op", "id", "string", "message")
NEEDED = {"Inserted": ("id", "string"), "Changed": ("id", "string"), "Deleted": ("id",), "Error": ("message",)}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_RECORD = re.compile(rf"({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})", re.DOTALL)
_KEYS = ("_sv_offset", "_sv_print")


class _Bad(ValueError):
    """Carries the reason for which a record does not conform."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


# Numbers become 0: only their kind matters, and Python limits the digits of an int.
_DECODER = json.JSONDecoder(parse_float=lambda s: 0, parse_int=lambda s: 0, parse_constant=_no_constant)
_SPACE = " \t\n\r"


_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
_BLANK = re.compile(r"[ \t\n\r]*")


def _deep_object(text: str) -> dict:
    """As ``_json_object`` for nesting beyond Python's recursion limit: an explicit stack instead of recursion.

    Returns the outermost members; those that are objects or arrays come out as an empty list.
    """
    out: dict = {}
    stack: list[str] = []
    key, want, i = "", "value", 0
    while True:
        i = _BLANK.match(text, i).end()
        c = text[i : i + 1]
        if want == "end":
            if c:
                raise ValueError("extra data")
            return out
        if want == "value" and c and c in "{[":
            if len(stack) == 1 and stack[0] == "{":
                out[key] = []
            stack.append(c)
            i += 1
            j = _BLANK.match(text, i).end()
            if text[j : j + 1] == ("}" if c == "{" else "]"):
                i, want = j, "next"
            else:
                want = "key" if c == "{" else "value"
        elif want == "value":
            m = _STRING.match(text, i) or _SCALAR.match(text, i)
            if not m:
                raise ValueError("no value")
            if len(stack) == 1 and stack[0] == "{":
                out[key] = json.loads(m[0], strict=True) if c == '"' else (None if m[0] == "null" else 0)
            i, want = m.end(), "next"
        elif want == "key":
            m = _STRING.match(text, i)
            if not m:
                raise ValueError("no name")
            if len(stack) == 1:
                key = json.loads(m[0])
            i = _BLANK.match(text, m.end()).end()
            if text[i : i + 1] != ":":
                raise ValueError("no colon")
            i, want = i + 1, "value"
        elif c == "," and stack:
            i, want = i + 1, "key" if stack[-1] == "{" else "value"
        elif c and stack and c == ("}" if stack[-1] == "{" else "]"):
            stack.pop()
            i, want = i + 1, "next" if stack else "end"
        else:
            raise ValueError("no separator")


def _json_object(body: str) -> dict:
    text = body.strip(_SPACE)
    if not text:
        raise _Bad("empty")
    try:
        value, end = _DECODER.raw_decode(text)
    except RecursionError:
        if text[0] != "{":
            raise _Bad("not_one_object") from None
        try:
            return _deep_object(text)
        except ValueError:
            raise _Bad("broken_json") from None
    except ValueError:
        raise _Bad("broken_json") from None
    if end != len(text):
        raise _Bad("text_after_object" if isinstance(value, dict) else "broken_json")
    if not isinstance(value, dict):
        raise _Bad("not_one_object")
    return value


def _unquote(field: str) -> str:
    return field[1:-1].replace('""', '"') if field[:1] == '"' else field


def _csv_reason(body: str) -> str:
    """Why a text is no single record of four fields."""
    if not body:
        return "empty"
    n, i = 0, 0
    while True:
        m = re.compile(_FIELD, re.DOTALL).match(body, i)
        n, i = n + 1, m.end()
        if i == len(body):
            return "column_count"
        if body[i] == ",":
            i += 1
        elif body[i] in "\r\n":
            return "line_end"
        else:
            return "broken_quoting"


def parse_line(layout: str | None, body: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """The operation of a line, or ``_Bad`` with the first reason against it."""
    if body is None:
        raise _Bad("null_body")
    if layout == "json":
        got = _json_object(body)
        row = {f: got[f] if isinstance(got.get(f), str) else None for f in FIELDS}
        if "op" not in got:
            raise _Bad("op_missing")
    elif layout == "csv":
        m = _RECORD.fullmatch(body)
        if not m:
            raise _Bad(_csv_reason(body))
        row = {f: _unquote(x) or None for f, x in zip(FIELDS, m.groups())}
        got = row
    else:
        raise _Bad("unknown_layout")
    op = row["op"]
    if op not in OPS:
        raise _Bad("op_unknown")
    for f in NEEDED[op]:
        if row[f] is None:
            raise _Bad(f"{f}_missing" if got.get(f) is None else f"{f}_not_string")
    return op, row["id"], row["string"], row["message"]


def _clean(x: str | None) -> str | None:
    """Lone surrogates, which an escape may name, can't be stored as UTF-8; they become the replacement character."""
    if x is None:
        return None
    try:
        x.encode()
        return x
    except UnicodeEncodeError:
        return x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


_LOADED = pa.schema([(_KEYS[0], pa.int64()), (_KEYS[1], pa.int64()), *((f, pa.string()) for f in FIELDS)])
_WHY = pa.schema([(_KEYS[0], pa.int64()), (_KEYS[1], pa.int64()), ("reason", pa.string()), ("body", pa.string()), ("layout", pa.string())])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, rows = [], []
        for i, (layout, body) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            try:
                rows.append([_clean(x) for x in parse_line(layout, body)])
                keep.append(i)
            except _Bad:
                pass
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], pa.string()) for k in range(4))], schema=_LOADED)


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        why = []
        for layout, body in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            try:
                parse_line(layout, body)
                why.append("not_loaded")
            except _Bad as e:
                why.append(str(e))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(why, pa.string()), b.column(3), b.column(2)], schema=_WHY)


def _raw(lines: DataFrame, offset: str, layout: str, body: str) -> DataFrame:
    """Offset, a print of the record, layout and body. The print tells apart records that share an offset or have none."""
    return lines.select(
        F.col(offset).cast("long").alias(_KEYS[0]),
        F.xxhash64(F.coalesce(F.col(layout), F.lit("\0")), F.col(body).isNull(), F.coalesce(F.col(body), F.lit(""))).alias(_KEYS[1]),
        F.col(layout).alias("layout"),
        F.col(body).alias("body"),
    )


def strict_load(lines: DataFrame, offset: str = "line_id", layout: str = "layout", body: str = "body") -> DataFrame:
    """The valid lines as operations: ``(offset, op, id, string, message)``, a repeated line once.

    ``lines`` may have any further columns, also ones named like the output; they are left out. A JSON member that the
    operation does not need and that is no string comes out as null, an empty csv field as null. A null offset stays null.
    An empty table gives an empty result.
    """
    return _loaded(_raw(lines, offset, layout, body)).dropDuplicates([*_KEYS]).select(F.col(_KEYS[0]).alias(offset), *FIELDS)


def _loaded(raw: DataFrame) -> DataFrame:
    return raw.mapInArrow(_load, "_sv_offset long, _sv_print long, op string, id string, string string, message string")


def _rest(raw: DataFrame) -> DataFrame:
    """Offsets and prints of all lines less those of the lines that loaded; a line read twice comes out once."""
    valid = _loaded(raw).select(*_KEYS)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEYS]
    return raw.select(*_KEYS).alias("a").join(valid.alias("b"), same[0] & same[1], "left_anti").distinct()


def rejected_offsets(lines: DataFrame, offset: str = "line_id", layout: str = "layout", body: str = "body") -> DataFrame:
    """Offsets of the lines that are not valid, each once; only offsets and prints are shuffled, not the bodies."""
    return _rest(_raw(lines, offset, layout, body)).select(F.col(_KEYS[0]).alias(offset)).distinct()


def rejects(lines: DataFrame, offset: str = "line_id", layout: str = "layout", body: str = "body") -> DataFrame:
    """The lines that are not valid: ``(offset, reason, layout, body)``, a repeated line once.

    Reasons: null_body, empty, unknown_layout; broken_json, text_after_object, not_one_object; column_count,
    broken_quoting, line_end; op_missing, op_unknown, and for id, string and message ``_missing`` or ``_not_string``.
    A null or unknown layout is unknown_layout. Two different lines under one offset (or without one) are judged apart.
    """
    raw = _raw(lines, offset, layout, body)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEYS]
    bad = raw.alias("a").join(_rest(raw).alias("b"), same[0] & same[1], "left_semi").dropDuplicates([*_KEYS])
    out = bad.mapInArrow(_diagnose, "_sv_offset long, _sv_print long, reason string, body string, layout string")
    return out.select(F.col(_KEYS[0]).alias(offset), "reason", "layout", "body")
