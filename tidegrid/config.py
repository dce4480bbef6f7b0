"""Settings of a job, from a dict, a JSON file or a YAML file, in this library's layout or in the one with numbered streams."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from tidegrid.grid import Grid
from tidegrid.operators.windowing import Windows

FORMATS = ("GeoJSON", "WKT", "CSV", "TSV")
AGGREGATES = ("ALL", "SUM", "AVG", "MIN", "MAX")
OPERATORS = ("range", "knn", "join", "tfilter", "trange", "tstats", "taggregate", "tknn", "tjoin")


@dataclass
class StreamConfig:
    topic: str
    format: str = "GeoJSON"
    date_format: str | None = "yyyy-MM-dd HH:mm:ss"
    oid_property: str = "oID"
    time_property: str = "timestamp"
    csv_attrs: list[int] = field(default_factory=lambda: [0, 1, 2, 3])
    delimiter: str = ","
    bbox: list[float] = field(default_factory=lambda: [115.5, 39.6, 117.6, 41.1])  # min x, min y, max x, max y
    n_cells: int = 100
    cell_length: float = 0.0

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"formats are {FORMATS}")
        if len(self.bbox) != 4:
            raise ValueError("a bbox has four values")
        if len(self.csv_attrs) != 4:
            raise ValueError("positions of oid, time, x and y are needed")

    def grid(self) -> Grid:
        min_x, min_y, max_x, max_y = self.bbox
        if self.cell_length > 0:
            return Grid.by_length(self.cell_length, min_x, max_x, min_y, max_y)
        return Grid.by_count(self.n_cells, min_x, max_x, min_y, max_y)


@dataclass
class QueryConfig:
    """``mode``: ``realtime`` or ``window``; there is no count-based mode but the heat map's (``count_window``).
    ``operator`` is one of OPERATORS, ``kind`` and ``query_kind`` what the stream and the query set hold."""

    operator: str = "range"
    kind: str = "pt"
    query_kind: str = "pt"
    mode: str = "window"
    radius: float = 0.1
    k: int = 10
    size_ms: int = 10_000
    slide_ms: int = 5_000
    lateness_ms: int = 1_000
    omega_ms: int = 1_000
    approximate: bool = False
    aggregate: str = "ALL"
    count_window: bool = False
    traj_ids: list[str] = field(default_factory=list)
    deletion_ms: int | None = None
    points: list[list[float]] = field(default_factory=list)
    polygons: list[list[list[float]]] = field(default_factory=list)
    lines: list[list[list[float]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"operators are {OPERATORS}")
        if self.mode not in ("realtime", "window"):
            raise ValueError("modes are realtime and window")
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"aggregates are {AGGREGATES}")
        self.traj_ids = [str(i) for i in self.traj_ids]
        for name in ("points", "polygons", "lines"):
            if isinstance(getattr(self, name), str):
                setattr(self, name, coordinates(getattr(self, name)))

    def windows(self) -> Windows:
        """Sliding windows; in realtime mode tumbling ones of the short trigger interval."""
        return Windows(self.omega_ms, None, self.lateness_ms) if self.mode == "realtime" else Windows(self.size_ms, self.slide_ms, self.lateness_ms)


@dataclass
class JobConfig:
    inputs: list[StreamConfig]
    query: QueryConfig
    brokers: str = ""
    output_topic: str = ""
    parallelism: int = 15


def coordinates(text: str) -> list:
    """Nested lists of numbers from text in brackets or parentheses: ``[116.5, 40.5], [117.6, 40.5]`` is a list of two
    pairs, and so is ``(116.5 40.5, 117.6 40.5)``, where blanks separate a pair's numbers."""
    body = text.translate(str.maketrans("()", "[]")).strip()
    if "[" not in body:
        body = f"[{body}]"
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    body = re.sub(rf"({number})\s+({number})", r"[\1, \2]", body)
    body = re.sub(r"(?<![0-9])\.(?=[0-9])", "0.", re.sub(r"\.(?![0-9])", ".0", re.sub(r"\+(?=[0-9.])", "", body)))
    found = json.loads(f"[{body}]")
    return found[0] if len(found) == 1 else found


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "[\"" and text:
        return json.loads(text.replace("\t", "\\t") if text[0] == '"' else text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in ("true", "false", "null", "~", ""):
        return {"true": True, "false": False}.get(text.lower())
    for make in (int, float):
        try:
            return make(text)
        except ValueError:
            pass
    return text


def read_yaml(text: str) -> dict:
    """The part of YAML that settings are written in: nested keys, lists of one-line items, one-line lists (as JSON),
    quoted and plain values, comments. A leading tag is passed over."""
    top: dict = {}
    path: list[tuple[int, object, object, object]] = [(-1, top, None, None)]  # indent, box, its owner and name there
    for line in text.splitlines():
        line = re.sub(r"""^((?:[^"'#]|"(?:[^"\\]|\\.)*"|'[^']*')*?)(?:(?:^|\s)#.*)$""", r"\1", line).rstrip()
        if not line.strip() or line.startswith(("!!", "---", "...")):
            continue
        indent, body = len(line) - len(line.lstrip(" ")), line.strip()
        item = body.startswith("- ")
        while indent < path[-1][0] or (indent == path[-1][0] and not item) or (indent == path[-1][0] and item and isinstance(path[-1][1], dict) and path[-1][1]):
            path.pop()
        _, box, owner, name = path[-1]
        if item:
            if not isinstance(box, list):
                box = owner[name] = []
                path[-1] = (indent, box, owner, name)
            box.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        key = str(_scalar(key))
        if value.strip():
            box[key] = _scalar(value)
        else:
            box[key] = {}
            path.append((indent, box[key], box, key))
    return top


def _stream(s: dict) -> dict:
    oid, time = (list(s.get("geoJSONSchemaAttr") or []) + ["oID", "timestamp"])[:2] if len(s.get("geoJSONSchemaAttr") or []) >= 2 else ("oID", "timestamp")
    out = {"topic": s["topicName"], "format": s.get("format"), "date_format": s.get("dateFormat"), "oid_property": oid, "time_property": time, "csv_attrs": s.get("csvTsvSchemaAttr"), "delimiter": s.get("delimiter"), "bbox": s.get("gridBBox"), "n_cells": s.get("numGridCells"), "cell_length": s.get("cellLength")}
    return {k: v for k, v in out.items() if v is not None}


def numbered(source: dict) -> dict:
    """Settings of the layout with ``inputStream1``, ``inputStream2``, ``outputStream``, ``query`` and ``window`` (times in
    seconds) in this library's. Options 1 and 2 are the range query over windows and in real time."""
    q, w = dict(source.get("query") or {}), source.get("window") or {}
    thresholds = q.get("thresholds") or {}
    query = {
        "operator": q.get("operator", "range"), "kind": q.get("kind", "pt"), "query_kind": q.get("queryKind", "pt"), "mode": "realtime" if q.get("option") == 2 else "window",
        "radius": q.get("radius"), "k": q.get("k"), "approximate": q.get("approximate"), "aggregate": q.get("aggregateFunction"), "traj_ids": q.get("trajIDs"),
        "omega_ms": _ms(q.get("omegaDuration")), "size_ms": _ms(w.get("interval")), "slide_ms": _ms(w.get("step")), "lateness_ms": _ms(thresholds.get("outOfOrderTuples")), "deletion_ms": _ms(thresholds.get("trajDeletion")),
        "count_window": str(w.get("type", "TIME")).upper() == "COUNT", "points": q.get("queryPoints"), "polygons": q.get("queryPolygons"), "lines": q.get("queryLineStrings"),
    }
    if query["count_window"]:
        query |= {"size_ms": w.get("interval"), "slide_ms": w.get("step")}
    rest = {"brokers": source.get("kafkaBootStrapServers"), "output_topic": (source.get("outputStream") or {}).get("topicName"), "parallelism": q.get("parallelism")}
    inputs = [_stream(source[k]) for k in ("inputStream1", "inputStream2") if source.get(k)]
    return {"inputs": inputs, "query": {k: v for k, v in query.items() if v is not None}} | {k: v for k, v in rest.items() if v is not None}


def _ms(seconds: float | None) -> int | None:
    return None if seconds is None else round(seconds * 1000)


def load_config(source: dict | str | Path) -> JobConfig:
    """Keys: ``inputs`` (a list), ``query``, ``brokers``, ``output_topic``, ``parallelism``; or those of ``numbered``.
    Unknown keys are an error in the former layout."""
    if not isinstance(source, dict):
        text = Path(source).read_text()
        source = read_yaml(text) if str(source).endswith((".yml", ".yaml")) else json.loads(text)
    if "inputStream1" in source:
        source = numbered(source)
    rest = {k: v for k, v in source.items() if k not in ("inputs", "query")}
    return JobConfig([StreamConfig(**s) for s in source.get("inputs", [])], QueryConfig(**source.get("query", {})), **rest)
