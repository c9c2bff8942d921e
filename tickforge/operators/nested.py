"""Deeply nested JSON records as flat tables with parent-child links.

Each record is parsed as a stream of tokens. Every value has a path, a position where it stands in an array, and, through a small
automaton over the path's keys, the nearest repeated ancestor whose row it belongs to; values are pivoted into that row as they come.
No step recurses or holds a record's tokens, so depth and length are bounded by memory alone, and all rows of a record
come from the task that parsed it: nothing is shuffled.
"""

from __future__ import annotations

import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WS = r"[ \t\n\r]*+"
_TEXT = r'"([^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+)"'
_WORD = r"(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null|NaN|-?Infinity)"
#: One step of the stream: a comma, then a key, then a word, a text or an opening bracket; or a closing bracket.
_TOKEN = re.compile(rf"{_WS}(,?+){_WS}(?:(?:{_TEXT}{_WS}:{_WS})?(?:{_WORD}|{_TEXT}|([\[{{]))|([\]}}]))")
_SPACE = re.compile(_WS)
_OPEN = re.compile(_WS + r"[\[{\"]")
_CLOSING = {"}": False, "]": True}


def _plain(text: str) -> str:
    """What a text between quotes says; lone surrogates, which no UTF-8 can hold, become the replacement character."""
    if "\\" not in text:
        return text
    out = scanstring(text + '"', 0, True)[0]
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in text else out


def is_json(text: str) -> bool:
    """Whether text is exactly one JSON value (NaN, Infinity and -Infinity are numbers)."""
    i, n, match, stack, first, done = 0, len(text), _TOKEN.match, [], True, False
    while m := match(text, i):
        comma, key, word, _, opened, closed = m.groups()
        i = m.end()
        if closed:
            if not stack or comma or stack.pop() != _CLOSING[closed]:
                return False
            first = False
        elif stack:
            if bool(comma) == first or (key is None) != stack[-1]:
                return False
            first = False
        elif done or comma or key is not None:
            return False
        if opened:
            stack.append(opened == "[")
            first = True
        done = not stack
    return done and _SPACE.match(text, i).end() == n


class Place:
    """What stands at a path. row: the kind of row an object is here; drop: how many parts its path loses to be its parent's;
    items: the place of each element, if arrays here are repeated; keys: the places below by key (None: any other)."""

    __slots__ = ("row", "drop", "items", "keys")

    def __init__(self, row: str | None = None, drop: int = 1, items: Place | None = None, keys: dict | None = None):
        self.row, self.drop, self.items, self.keys = row, drop, items, keys or {}


def _strategy() -> Place:
    """The tables of a strategy record."""
    node = Place("node")
    node.keys = {"left": node, "right": node}
    scenario = lambda kind: Place(keys={"scenarios": Place(items=Place(kind, 2, keys={"execution": Place("execution")}))})
    return Place(keys={
        "genome": node,
        "validation": Place(keys={None: Place(keys={"fold_details": Place(items=Place("fold", 2))})}),
        "robustness": Place(keys={
            "cost_sensitivity": scenario("cost_scenario"), "parameter_sensitivity": scenario("parameter_scenario"),
            "monte_carlo": Place(keys={"quantiles": Place(keys={None: Place("quantile", 2)})}),
        }),
        "execution": Place("execution"),
    })


STRATEGY = _strategy()
_NOWHERE = Place()


class _Open:
    """An object or array that is open: its place, the row its values belong to, and of an object the keys so far."""

    __slots__ = ("array", "at", "place", "row", "base", "prefix", "keys", "spans", "names", "name", "start")

    def __init__(self, array, place, row, base, names, name, start):
        self.array, self.at, self.place, self.row, self.base, self.names, self.name, self.start = array, -1, place, row, base, names, name, start
        self.prefix, self.keys, self.spans = None, None if array else set(), None


def _forget(top: _Open, key: str, prefix: str, rows: list) -> None:
    """A repeated key: what stood there before is gone."""
    for k in range(*(top.spans or {}).pop(key, (0, 0))):
        rows[k] = None
    if top.row is not None:
        fields, path = top.row[4], prefix + key
        for k in [k for k in fields if k == path or k.startswith(path + "/")]:
            del fields[k]


def rows_of(text: str | None, rules: Place = STRATEGY) -> list[tuple]:
    """(kind, node_path, parent_path, ordinal, fields) of each row of a record; none if text is null, no object or does not parse to the end.

    A lone object in place of a repeated array is its element 0. Null elements count as positions but are no rows. Of repeated keys the
    last stands. A text that itself encodes an object, array or text counts as what it encodes, however often. fields maps the
    relative slash path of every scalar below the row, down to the next row, to its text (null: null).
    """
    if text is None:
        return []
    rows: list = []
    names: list[str] = []
    stack: list[_Open] = []
    outer: list[tuple] = []  # texts that wait for the one they encode
    match, i, n, level, done = _TOKEN.match, 0, len(text), 0, False
    name, ordinal, place, top = None, None, rules, None
    while True:
        m = match(text, i)
        if m is None:
            if not done or len(stack) != level or _SPACE.match(text, i).end() != n:
                return []
            if not outer:
                break
            text, i, n, level = outer.pop()
            continue
        comma, key, word, string, opened, closed = m.groups()
        i = m.end()
        if closed:
            if len(stack) == level or comma or top.array != _CLOSING[closed]:
                return []
            stack.pop()
            if top.names:
                del names[-top.names :]
            shut, top = top, stack[-1] if stack else None
            if len(rows) > shut.start and top is not None and not top.array:
                top.spans = top.spans or {}
                top.spans[shut.name] = (shut.start, len(rows))
            done = len(stack) == level
            continue
        if len(stack) > level:
            if top.array:
                if key is not None or (top.at >= 0) != bool(comma):
                    return []
                top.at = ordinal = top.at + 1
                name, place = str(ordinal), top.place.items or top.place.keys.get(None)
            else:
                if key is None or bool(top.keys) != bool(comma):
                    return []
                name, ordinal = _plain(key), None
                place = top.place.keys.get(name) or top.place.keys.get(None)
                if name in top.keys:
                    _forget(top, name, "/".join([*names[top.base :], ""]), rows)
                else:
                    top.keys.add(name)
        elif done or comma or key is not None:
            return []
        if string is not None:
            string = _plain(string)
            if _OPEN.match(string) and is_json(string):
                outer.append((text, i, n, level))
                text, i, n, level, done = string, 0, len(string), len(stack), False
                continue
        if opened:
            array = opened == "["
            place = place or _NOWHERE
            row, base, pushed = (top.row, top.base) if top else (None, 0), 0, 0
            row, base = row
            if name is not None:
                names.append(name)
                pushed = 1
            start = len(rows)
            if not array:
                if place.items:
                    names.append("0")
                    pushed, place, ordinal = pushed + 1, place.items, 0
                if place.row:
                    row, base = [place.row, "/" + "/".join(names), "".join(f"/{x}" for x in names[: -place.drop]), ordinal, {}], len(names)
                    rows.append(row)
            top = _Open(array, place, row, base, pushed, name, start)
            stack.append(top)
            done = False
            continue
        if top is not None and top.row is not None:
            if top.prefix is None:
                top.prefix = "/".join([*names[top.base :], ""])
            top.row[4][top.prefix + name] = string if word is None else None if word == "null" else word
        done = len(stack) == level
    return [tuple(r) for r in rows if r is not None]


def flatten_records(df: DataFrame, ident: str = "record_id", payload: str = "payload", rules: Place = STRATEGY) -> DataFrame:
    """(ident, kind, node_path, parent_path, ordinal, fields MAP<STRING, STRING>): one row per object of the rules' kinds.

    Null, empty or damaged payloads give no rows (see rows_of); an empty table gives none; other columns are ignored; a repeated
    record gives its rows again. Text of any length is parsed whole. One pass gives the rows of all kinds: write it once to read several tables of it.
    """
    kind = df.schema[ident].dataType.simpleString()

    def parse(batches):
        for batch in batches:
            idents, texts = batch.column(0), batch.column(1)
            of, found, keys, values, ends = [], [], [], [], [0]

            def made():
                told = list(zip(*found, strict=True)) if found else [()] * 4
                named = [idents.take(pa.array(of, pa.int64())), *(pa.array(x, t) for x, t in zip(told, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True))]
                fields = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
                return pa.RecordBatch.from_arrays([*named, fields], [ident, "kind", "node_path", "parent_path", "ordinal", "fields"])

            for k in range(batch.num_rows):
                for *row, fields in rows_of(texts[k].as_py(), rules):
                    of.append(k)
                    found.append(row)
                    keys += fields
                    values += fields.values()
                    ends.append(len(keys))
                if len(of) >= 5000:
                    yield made()
                    of, found, keys, values, ends = [], [], [], [], [0]
            yield made()

    return df.select(F.col(ident), F.col(payload).cast("string")).mapInArrow(parse, f"{ident} {kind}, kind string, node_path string, parent_path string, ordinal int, fields map<string,string>")


def table(flat: DataFrame, kind: str, ident: str = "record_id", **fields: str) -> DataFrame:
    """The rows of one kind with the named fields (path: type) as columns; text that is no such value gives null."""
    cols = [F.try_element_at("fields", F.lit(path.replace("__", "/"))).try_cast(to).alias(path) for path, to in fields.items()]
    return flat.filter(F.col("kind") == kind).select(ident, "node_path", "parent_path", "ordinal", *cols)
