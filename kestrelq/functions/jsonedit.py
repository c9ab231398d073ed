"""JSON documents edited and walked by path: pandas functions over Arrow batches, since built-ins only read.

Paths are `$`, `.key`, `."quoted key"`, `[n]`, `[#]` (behind the end) and `[#-n]`. Output is compact,
keys stay in order, and a key that repeats keeps its last value. Text that isn't JSON gives null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_STEP = re.compile(r'\.("(?:[^"\\]|\\.)*"|[^.\[]+)|\[(#(?:-\d+)?|\d+)\]')
Step = str | tuple[bool, int]


class _MISSING:
    """Stands for no value; a class, so that it is the same one in every worker."""


class _Number(float):
    """A number with a point or an exponent, which keeps its text."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def steps(path: str) -> list[Step]:
    """Keys as text; places as (counted from the end, number)."""
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path!r}")
    out: list[Step] = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path!r}")
        key, place = m.groups()
        if key is not None:
            out.append(json.loads(key) if key.startswith('"') else key)
        else:
            out.append((True, int(place[2:] or 0)) if place.startswith("#") else (False, int(place)))
        at = m.end()
    return out


def parsed(text: str | None):
    try:
        return _MISSING if text is None else json.loads(text, parse_float=_Number, parse_constant=_refuse)
    except ValueError:
        return _MISSING


def rendered(value, indent: int | str | None = None, level: int = 0) -> str:
    """As JSON text, on one line or indented; untouched numbers as they were written."""
    if isinstance(value, _Number):
        return value.text
    if not value or not isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    step = indent if isinstance(indent, str) else " " * (indent or 0)
    line = "" if indent is None else "\n" + step * (level + 1)
    colon = ":" if indent is None else ": "
    inner = lambda x: rendered(x, indent, level + 1)
    if isinstance(value, dict):
        parts, ends = [json.dumps(k, ensure_ascii=False) + colon + inner(v) for k, v in value.items()], "{}"
    else:
        parts, ends = [inner(v) for v in value], "[]"
    return ends[0] + line + ("," + line).join(parts) + ("" if indent is None else "\n" + step * level) + ends[1]


def compact(value) -> str:
    return rendered(value)


def _place(node: list, step: tuple[bool, int]) -> int:
    return len(node) - step[1] if step[0] else step[1]


def looked_up(node, path: list[Step]):
    for s in path:
        if isinstance(s, str):
            node = node.get(s, _MISSING) if isinstance(node, dict) else _MISSING
        else:
            i = _place(node, s) if isinstance(node, list) else -1
            node = node[i] if 0 <= i < len(node or ()) else _MISSING
        if node is _MISSING:
            break
    return node


def edited(node, path: list[Step], value, create: bool, overwrite: bool):
    """Sets the value at a path: where it is missing if create, where it exists if overwrite."""
    if not path:
        return value if overwrite else node
    parent = looked_up(node, path[:-1])
    last = path[-1]
    if parent is _MISSING:
        if create:  # missing parents come into being, one step at a time
            fresh = {} if isinstance(last, str) else []
            grown = edited(node, path[:-1], fresh, True, False)
            return edited(grown, path, value, True, overwrite) if looked_up(grown, path[:-1]) is not _MISSING else node
        return node
    if isinstance(last, str) and isinstance(parent, dict):
        if overwrite if last in parent else create:
            parent[last] = value
    elif not isinstance(last, str) and isinstance(parent, list):
        i = _place(parent, last)
        if 0 <= i < len(parent):
            if overwrite:
                parent[i] = value
        elif i == len(parent) and create:
            parent.append(value)
    return node


def removed(node, path: list[Step]):
    if not path:
        return _MISSING
    parent, last = looked_up(node, path[:-1]), path[-1]
    if isinstance(last, str) and isinstance(parent, dict):
        parent.pop(last, None)
    elif not isinstance(last, str) and isinstance(parent, list) and 0 <= (i := _place(parent, last)) < len(parent):
        del parent[i]
    return node


def merged(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def _column(x: Column, f, kind: str = "string") -> Column:
    """f of every parsed document; f may return _MISSING for null."""

    @F.pandas_udf(kind)
    def run(found: pd.Series) -> pd.Series:
        done = (f(v) if (v := parsed(t)) is not _MISSING else _MISSING for t in found)
        return pd.Series([None if d is _MISSING else d for d in done], dtype=object)

    return run(x)


def _edit(x: Column, path: str, value: Column, create: bool, overwrite: bool) -> Column:
    way = steps(path)

    @F.pandas_udf("string")
    def run(found: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(found, values):
            node = parsed(t)
            out.append(None if node is _MISSING else compact(edited(node, way, json.loads(v).get("v"), create, overwrite)))
        return pd.Series(out, dtype=object)

    return run(x, F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))


def json_set(x: Column, path: str, value: Column) -> Column:
    return _edit(x, path, value, True, True)


def json_insert(x: Column, path: str, value: Column) -> Column:
    return _edit(x, path, value, True, False)


def json_replace(x: Column, path: str, value: Column) -> Column:
    return _edit(x, path, value, False, True)


def json_remove(x: Column, *paths: str) -> Column:
    """Paths go one after another; removing the root gives null."""
    ways = [steps(p) for p in paths]

    def f(node):
        for way in ways:
            if node is not _MISSING:
                node = removed(node, way)
        return _MISSING if node is _MISSING else compact(node)

    return _column(x, f)


def json_array_insert(x: Column, path: str, value: Column) -> Column:
    """Before the element at a path that ends in a place; the others move on."""
    way = steps(path)
    if not way or isinstance(way[-1], str):
        raise ValueError("the path must end in a place")

    @F.pandas_udf("string")
    def run(found: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(found, values):
            if (node := parsed(t)) is not _MISSING and isinstance(parent := looked_up(node, way[:-1]), list):
                i = _place(parent, way[-1])
                if 0 <= i <= len(parent):
                    parent.insert(i, json.loads(v).get("v"))
            out.append(None if node is _MISSING else compact(node))
        return pd.Series(out, dtype=object)

    return run(x, F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))


def json_patch(x: Column, patch: Column) -> Column:
    @F.pandas_udf("string")
    def run(found: pd.Series, patches: pd.Series) -> pd.Series:
        pairs = ((parsed(a), parsed(b)) for a, b in zip(found, patches))
        return pd.Series([None if a is _MISSING or b is _MISSING else compact(merged(a, b)) for a, b in pairs], dtype=object)

    return run(x, patch)


def json_extract(x: Column, path: str) -> Column:
    """The value at a path as JSON text."""
    way = steps(path)
    return _column(x, lambda node: _MISSING if (v := looked_up(node, way)) is _MISSING else compact(v))


def json_pretty(x: Column, indent: int = 4) -> Column:
    return _column(x, lambda node: rendered(node, indent))


def json_valid(x: Column) -> Column:
    """Null for null."""
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull())


def type_name(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    names = {int: "integer", float: "real", _Number: "real", str: "text", list: "array", dict: "object"}
    return names[type(v)]


def json_type(x: Column, path: str = "$") -> Column:
    way = steps(path)
    return _column(x, lambda node: _MISSING if (v := looked_up(node, way)) is _MISSING else type_name(v))


def json_array_length(x: Column, path: str = "$") -> Column:
    """0 for what is no array, null where the path leads nowhere."""
    way = steps(path)
    return _column(x, lambda node: _MISSING if (v := looked_up(node, way)) is _MISSING else len(v) if isinstance(v, list) else 0, "long")


def _walk(node, key, parent, where, below, out) -> None:
    me = len(out)
    leaf = not isinstance(node, (dict, list))
    shown = node if isinstance(node, str) else compact(node)
    out.append((key, shown, type_name(node), (None if node is None else shown) if leaf else None, me, parent, where, below))
    if leaf:
        return
    inner = node.items() if isinstance(node, dict) else enumerate(node)
    for k, v in inner:
        plain = isinstance(k, str) and re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", k)
        step = f"[{k}]" if isinstance(k, int) else f".{k}" if plain else f".{json.dumps(k, ensure_ascii=False)}"
        _walk(v, str(k), me, where + step, where, out)


_ROW = "array<struct<key:string,value:string,type:string,atom:string,id:long,parent:long,fullkey:string,path:string>>"


def json_tree(table: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each node of every document, parents first: key, value, type, atom, id (order of the
    walk), parent, fullkey, path, after the columns to keep. No rows for null or what isn't JSON."""

    def f(node):
        out: list[tuple] = []
        _walk(node, None, None, "$", "$", out)
        return [dict(zip(("key", "value", "type", "atom", "id", "parent", "fullkey", "path"), r)) for r in out]

    return table.select(*keep, F.inline(_column(F.col(column), f, _ROW)))


def json_quote(x: Column, kind: str = "text") -> Column:
    """A value as JSON text: text quoted, numbers as they are, null as null; kind json leaves JSON as it is."""
    if kind == "json":
        return x
    if kind == "text":
        inner = F.to_json(F.array(x.cast("string")))
        return F.coalesce(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit("null"))
    return F.coalesce(x.cast("string"), F.lit("null"))


def json_array(*parts: Column) -> Column:
    """Of JSON texts, such as json_quote gives them."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_group_object(key: Column, value: Column, order: Column) -> Column:
    """Aggregate: an object of keys and values (JSON texts) in an order; rows with a null key are left out."""
    pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(order.alias("o"), json_quote(key).alias("k"), value.alias("v")))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["v"])), ","), F.lit("}"))


@F.pandas_udf(LongType())
def json_error_position(text: pd.Series) -> pd.Series:
    """0 for JSON, else the place (from 1) of the first character that can't be part of it; null for null."""

    def place(x):
        if x is None:
            return None
        try:
            json.loads(x, parse_constant=_refuse)
            return 0
        except json.JSONDecodeError as e:
            return e.pos + 1
        except ValueError:
            return 1

    return pd.Series([place(x) for x in text], dtype="Int64")
