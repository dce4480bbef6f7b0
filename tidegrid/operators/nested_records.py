"""Deeply nested JSON records as related flat tables, by Merkle subtree identities.

Every object is hashed bottom-up over its canonical form, in which nested objects are replaced by their hashes. Equal
objects so have one identity, are stored once, and each place where one occurs is a bridge row with its parent's
identity, its path and its ordinal.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = ("feature", "geometry", "ring", "leg", "call")
BRIDGE = "entity string, node_path string, parent_path string, ordinal int, object_id string, parent_object_id string"
#: Below this, numbers are written out whole, whatever their spelling.
WHOLE = 1e21
#: Bytes of contents whose occurrences a task counts before it gives them on, and what a row takes besides.
HELD, HELD_ROW = 64 << 20, 300
_MULTI = {"MultiPoint", "MultiLineString", "MultiPolygon"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> int | float:
    """A number with a point or an exponent; a whole one as an integer, so 1, 1.0 and 1e0 are one value."""
    f = float(text)
    return int(f) if f.is_integer() and abs(f) < WHOLE else f


#: Floats that may be whole: only texts that have some need ``_number``.
_WHOLE_FLOAT = re.compile(r"[0-9]\.0+(?![0-9])|[0-9][eE]")
_QUICK = json.JSONDecoder(parse_constant=_no_constant)
_EXACT = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number)
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_json(text: str | None) -> object:
    """The value of a well-formed JSON text; None for null, empty and malformed ones (NaN and Infinity are no JSON)."""
    if not text or text.isspace():
        return None
    try:
        return (_EXACT if _WHOLE_FLOAT.search(text) else _QUICK).decode(text)
    except (ValueError, RecursionError) as error:
        if isinstance(error, json.JSONDecodeError):
            return None
    try:  # nested too deep for that parser, or a number too long, or a constant
        return _unlimited(_loads, text)
    except ValueError:
        return None


def canonical(value: object) -> str:
    """One text for all spellings of a value: keys sorted, no blanks, numbers as ``parse_json`` gives them."""
    try:
        return _ENCODER.encode(value)
    except (ValueError, RecursionError):
        return _unlimited(_dumps, value)


def _unlimited(work: Callable, value: object) -> object:
    """Work with integers of any length."""
    limit = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        return work(value)
    finally:
        sys.set_int_max_str_digits(limit)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORD = re.compile("null|true|false")
_WORDS = {"null": None, "true": True, "false": False}


def _loads(text: str) -> object:
    """``json.loads`` for any depth."""

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    def named(i: int) -> tuple[str, int]:
        i = skip(i)
        if text[i : i + 1] != '"':
            raise ValueError("name")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        return name, i + 1

    top: list = []
    path: list[tuple[dict | list, str | None]] = [(top, None)]  # what is open, and the name of the value to come
    i = 0
    while True:
        i = skip(i)
        c = text[i : i + 1]
        inner = None
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            inner, i = value, skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                inner, i = None, i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = _number(m[0]) if m[1] or m[2] else int(m[0]), m.end()
        elif m := _WORD.match(text, i):
            value, i = _WORDS[m[0]], m.end()
        else:
            raise ValueError("value")
        box, name = path[-1]
        if isinstance(box, dict):
            box[name] = value
        else:
            box.append(value)
        if inner is not None:
            name, i = named(i) if c == "{" else (None, i)
            path.append((inner, name))
            continue
        while True:  # after a value
            i = skip(i)
            box, c = path[-1][0], text[i : i + 1]
            if box is top:
                if c:
                    raise ValueError("more")
                return top[0]
            i += 1
            if c == ",":
                name, i = named(i) if isinstance(box, dict) else (None, i)
                path[-1] = (box, name)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end")
            path.pop()


def _dumps(value: object) -> str:
    """``canonical`` for any depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        plain, v = todo.pop()
        if plain:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            todo.append((True, "}"))
            for k, name in reversed(list(enumerate(sorted(v)))):
                todo.append((False, v[name]))
                todo.append((True, "," * (k > 0) + json.dumps(name, ensure_ascii=False) + ":"))
        elif isinstance(v, list):
            out.append("[")
            todo.append((True, "]"))
            for k, member in reversed(list(enumerate(v))):
                todo.append((False, member))
                todo.append((True, "," * (k > 0)))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def identity(entity: str, content: str) -> str:
    return blake2b(f"{entity}\0{content}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _value(v: object) -> object:
    """The value in a JSON text, if a string holds one."""
    return parse_json(v) if isinstance(v, str) else v


def _listed(v: object) -> list:
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


class Node:
    """An object's kind, place and flat content; children by name."""

    __slots__ = ("entity", "path", "ordinal", "own", "children")

    def __init__(self, entity: str, path: str, ordinal: int, own: dict) -> None:
        self.entity, self.path, self.ordinal, self.own, self.children = entity, path, ordinal, own, []


def _geometry(value: object, path: str, ordinal: int) -> Node | None:
    value = _value(value)
    if not isinstance(value, dict):
        return None
    root = Node("geometry", path, ordinal, {})
    todo = [(root, value)]
    while todo:  # collections may nest deeper than Python's stack
        node, g = todo.pop()
        kind, parts = g.get("type"), g.get("coordinates")
        kind = kind if isinstance(kind, str) else None
        inner = {"geometries"}
        if isinstance(g.get("geometries"), list):
            for i, member in enumerate(g["geometries"]):
                member = _value(member)
                if isinstance(member, dict):
                    node.children.append(Node("geometry", f"{node.path}.{i}", i, {}))
                    todo.append((node.children[-1], member))
        if isinstance(parts, list) and kind in _MULTI:
            inner = {"geometries", "coordinates"}
            for i, member in enumerate(parts):
                if member is not None:
                    node.children.append(Node("geometry", f"{node.path}.{i}", i, {}))
                    todo.append((node.children[-1], {"type": kind[5:], "coordinates": member}))
        elif isinstance(parts, list) and kind == "Polygon":
            inner = {"geometries", "coordinates"}
            node.children.extend(Node("ring", f"{node.path}.r{i}", i, {"points": ring}) for i, ring in enumerate(parts) if ring is not None)
        node.own = {k: v for k, v in g.items() if k not in inner}
    return root


def _feature(value: dict, path: str, ordinal: int, bare: bool) -> Node:
    node = Node("feature", path, ordinal, {})
    geometry = _geometry(value if bare else value.get("geometry"), f"{path}.g", 0)
    if geometry:
        node.children.append(geometry)
    if bare:
        return node
    properties = _value(value.get("properties"))
    own = {k: v for k, v in value.items() if k not in ("geometry", "properties")}
    if isinstance(properties, dict):
        own["properties"] = {k: v for k, v in properties.items() if k != "legs"}
        for i, leg in enumerate(_listed(properties.get("legs"))):
            if isinstance(leg, dict):
                leg_node = Node("leg", f"{path}.l{i}", i, {k: v for k, v in leg.items() if k != "calls"})
                leg_node.children = [Node("call", f"{leg_node.path}.c{j}", j, call) for j, call in enumerate(_listed(leg.get("calls"))) if isinstance(call, dict)]
                node.children.append(leg_node)
    node.own = own
    return node


def features_of(text: str | None) -> list[Node]:
    """The features of a record's envelope. Envelopes without a usable ``value`` have none."""
    record = parse_json(text)
    value = _value(record.get("value")) if isinstance(record, dict) else None
    if not isinstance(value, dict):
        return []
    if value.get("type") == "FeatureCollection":
        members = value.get("features")
        return [_feature(f, str(i), i, False) for i, f in enumerate(members if isinstance(members, list) else []) if isinstance(f, dict)]
    return [_feature(value, "0", 0, value.get("type") != "Feature")]


def occurrences(text: str | None) -> list[tuple]:
    """Bridge rows of one record, children's hashes before their parents'."""
    order: list[tuple[Node, Node | None]] = [(f, None) for f in features_of(text)]
    for node, _ in order:
        order.extend((c, node) for c in node.children)
    made: dict[int, tuple[str, str]] = {}
    for node, _ in reversed(order):
        links = [f"{c.ordinal}:{c.entity}:{made[id(c)][0]}" for c in node.children]
        content = canonical({"own": node.own, "children": links} if links else {"own": node.own})
        made[id(node)] = (identity(node.entity, content), content)
    return [
        (n.entity, n.path, p.path if p else "", n.ordinal, made[id(n)][0], made[id(p)][0] if p else None, made[id(n)][1])
        for n, p in order
    ]


def _plain(text: str) -> str:
    """``text`` without lone surrogates, which no table holds."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def bridge(records: DataFrame, id_col: str = "record_id", json_col: str = "record_json") -> DataFrame:
    """Parent-child rows of all occurrences of objects: ``id_col`` and BRIDGE.

    Paths: a feature's position (``0`` for a lone one); ``.g`` its geometry and ``.i`` members of it, nested; ``.rI``
    rings; ``.lI`` legs; ``.cI`` calls. Positions count null elements, which give no row. Records that are null, empty
    or not well-formed give none. Empty objects, and empty lists as rings, are objects. Columns other than the two
    named don't matter. No shuffle: the work follows the input's partitions.
    """
    source = records.select(F.col(id_col).alias("__id"), F.col(json_col).alias("__json"))
    id_type = source.schema["__id"].dataType.simpleString()
    names = ["__id", *(c.split()[0] for c in BRIDGE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            # Records grow when shredded; so output batches are cut by rows, not by records.
            ids, rows = [], []
            for i, text in enumerate(texts):
                found = occurrences(text)
                ids.extend([i] * len(found))
                rows.extend(found)
                if len(rows) >= 10_000 or (i == len(texts) - 1 and rows):
                    entity, path, parent, ordinal, own, above, _ = zip(*rows)
                    cols = [pa.array(c, pa.int32() if c is ordinal else pa.string()) for c in (entity, path, parent, ordinal, own, above)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *cols], names=names)
                    ids, rows = [], []

    return source.mapInArrow(run, f"__id {id_type}, {BRIDGE}").withColumnRenamed("__id", id_col)


def objects(records: DataFrame, entity: str | None = None, json_col: str = "record_json") -> DataFrame:
    """Each distinct object (of one kind) once: object_id, entity, content (canonical JSON, its children as
    ``ordinal:entity:id``), n_occurrences.

    A task counts the occurrences of each object that it meets (of HELD at a time) and gives its content with the
    count, so a content moves about once for each task that has it. Equal ids have equal contents, so contents are
    grouping keys too; then rows are hashed, and no long texts are sorted.
    """
    source = records.select(F.col(json_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(i, *v) for i, v in held.items()]
            for at in range(0, len(rows), 10_000):
                own, kind, content, n = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(kind), pa.array(map(_plain, content), pa.string()), pa.array(n, pa.int64())], names=["object_id", "entity", "content", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, _, _, _, own, _, content in occurrences(text):
                    if entity is not None and kind != entity:
                        continue
                    if (known := held.get(own)) is not None:
                        known[2] += 1
                        continue
                    held[own] = [kind, content, 1]
                    size += len(content) + HELD_ROW
                    if size >= HELD:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    counted = source.mapInArrow(run, "object_id string, entity string, content string, n bigint")
    return counted.groupBy("object_id", "entity", "content").agg(F.sum("n").alias("n_occurrences"))


def flat_tables(records: DataFrame, json_col: str = "record_json") -> dict[str, DataFrame]:
    """The five tables of distinct objects, with the fields of each kind as columns; ``bridge`` links them."""
    own = lambda path: F.get_json_object("content", f"$.own.{path}")
    columns = {
        "feature": {"oid": own("properties.oID"), "event_time": own("properties.timestamp"), "operator": own("properties.operator")},
        "geometry": {"kind": own("type"), "coordinates": own("coordinates")},
        "ring": {"points": own("points")},
        "leg": {"leg": own("leg"), "mode": own("mode")},
        "call": {"site": own("site"), "arr": own("arr"), "load_in": own("load.in").try_cast("bigint"), "load_out": own("load.out").try_cast("bigint")},
    }
    return {e: objects(records, e, json_col).select("object_id", "n_occurrences", *(c.alias(k) for k, c in columns[e].items())) for e in ENTITIES}
