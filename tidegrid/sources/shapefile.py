"""ESRI shapefiles (points, polylines, polygons), read from their public format."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: its code and the shape types read.
FILE_CODE, POINT, POLYLINE, POLYGON = 9994, 1, 3, 5
_KINDS = {POINT: "pt", POLYLINE: "ls", POLYGON: "pg"}
_DDL = "file string, record_no int, kind string, x double, y double, parts array<array<struct<x:double,y:double>>>"


def shapes(data: bytes) -> Iterator[tuple[int, str, float | None, float | None, list | None]]:
    """(record number, kind, x, y, parts) of a .shp file's records. Null shapes and other types are passed over; so is
    what follows a record that is cut short."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != FILE_CODE:
        raise ValueError("no shapefile")
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        body, at = at + 8, at + 8 + 2 * words
        if at > len(data):
            return
        kind = struct.unpack_from("<i", data, body)[0]
        if kind == POINT:
            yield number, "pt", *struct.unpack_from("<dd", data, body + 4), None
        elif kind in (POLYLINE, POLYGON):
            n_parts, n_points = struct.unpack_from("<ii", data, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", data, body + 44 + 4 * n_parts)
            points = [{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(n_points)]
            yield number, _KINDS[kind], None, None, [points[a:z] for a, z in zip(starts[:-1], starts[1:])]


def write_shapes(kind: int, parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """A .shp file of one type: each record its parts (points: one part of one vertex)."""
    records = b""
    for number, record in enumerate(parts, 1):
        flat = [v for part in record for v in part]
        if kind == POINT:
            body = struct.pack("<idd", POINT, *flat[0])
        else:
            xs, ys = [p[0] for p in flat], [p[1] for p in flat]
            starts = [sum(map(len, record[:i])) for i in range(len(record))]
            body = struct.pack("<i4dii", kind, min(xs), min(ys), max(xs), max(ys), len(record), len(flat))
            body += struct.pack(f"<{len(record)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in flat)
        records += struct.pack(">ii", number, len(body) // 2) + body
    head = struct.pack(">i5ii", FILE_CODE, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8)
    return head + records


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """Records of all .shp files under ``path``: file, record_no, kind (pt, ls, pg), x, y, parts. A file is one task's
    work (the format can't be split), files are read side by side; records leave in batches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = []
                for record in shapes(bytes(content)):
                    rows.append((name, *record))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "record_no", "kind", "x", "y", "parts"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "record_no", "kind", "x", "y", "parts"])

    return files.select("path", "content").mapInPandas(run, _DDL)
