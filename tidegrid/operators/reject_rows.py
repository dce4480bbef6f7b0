"""Delimited lines split into loaded points and rejects with a reason, by structural indexing.

Each Arrow batch of lines is one byte buffer. Masks mark quotes, delimiters and record ends; the prefix parity of the
quotes tells which delimiters separate fields. A record is well quoted exactly if, cut at those delimiters, each field
either has no quote or opens with one, closes with one, and doubles all between; so the check is a test on each quote's
neighbours, done for all records at once. Counts and types are then checked field by field, as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, BLANK, CR = 0x22, 0x20, 0x0D
#: From 2000-01-01 to before 2100-01-01.
MS_FROM, MS_TO = 946684800000, 4102444800000
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Letters of date formats and how often each is written.
DATE_LETTERS = {"y": 4, "M": 2, "d": 2, "H": 2, "m": 2, "s": 2}
#: Bound of the configuration table, whose rows each task receives.
MAX_STREAMS = 10_000

RESULT = pa.schema([("row_no", pa.int64()), ("fail_reason", pa.string()), ("n_found", pa.int32()), ("oid", pa.string()), ("ts_ms", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])


def delimiter_bytes(configured: str) -> bytes:
    r"""``\t`` means TAB, ``\\t`` the two characters backslash and t; all else stands for itself."""
    return {r"\t": b"\t", r"\\t": rb"\t"}.get(configured, configured.encode())


class Index:
    """Fields of records in one buffer.

    ``quoting``: records that break the quoting rules; ``n_fields``: fields by record; ``field(rec, k)``: the k-th
    fields of the records ``rec``, blanks and outer quotes off, doubled quotes single.
    """

    def __init__(self, lines: pa.Array | list[bytes], delimiter: bytes) -> None:
        if not delimiter:
            raise ValueError("an empty delimiter separates nothing")
        if isinstance(lines, list):
            lines = pa.array(lines, pa.binary()).cast(pa.string())
        # A final CR goes. One zero byte ends each record; no mask reads it as a field's content.
        lines = pc.binary_join_element_wise(pc.replace_substring_regex(lines, "\r\\z", ""), "", "\0")
        lengths = pc.binary_length(lines).to_numpy().astype(np.int64)
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        self.bytes = b = np.frombuffer(b"".join(memoryview(c) for c in _contents(lines)), np.uint8)
        record = np.repeat(np.arange(len(lines)), lengths)
        quote = b == QUOTE
        before = np.cumsum(quote) - quote  # quotes in front of each byte
        parity = (before - before[starts][record]) & 1
        odd = ((before + quote)[ends] - before[starts]) & 1 == 1
        at = self._delimiters(b, delimiter, ends, record)
        at = at[parity[at] == 0]
        # Bounds of fields: a record's start or a delimiter's end, up to the next delimiter or the record's end.
        owner = record[at]
        self.n_fields = np.bincount(owner, minlength=len(lines)) + 1
        self.first = np.cumsum(self.n_fields) - self.n_fields
        order = np.argsort(np.concatenate([starts, at + len(delimiter)]), kind="stable")
        left = np.concatenate([starts, at + len(delimiter)])[order]
        right = np.sort(np.concatenate([at, ends]), kind="stable")
        # Blanks off: the first byte from left, and the last before right, that is no blank.
        solid = (b != BLANK) if delimiter != b" " else np.ones(len(b), bool)
        solid[ends] = True
        index = np.arange(len(b))
        ahead = np.minimum.accumulate(np.where(solid, index, len(b))[::-1])[::-1]
        back = np.maximum.accumulate(np.where(solid, index, -1))
        lo = np.minimum(ahead[left], right)
        hi = np.maximum(np.where(right > left, back[np.maximum(right - 1, 0)] + 1, right), lo)
        self.lo, self.hi = lo, hi
        # Quoting: every quote must open its field, close it, or be half of a doubled one.
        q = np.flatnonzero(quote)
        bad = odd.copy()
        if len(q):
            f = np.searchsorted(left, q, side="right") - 1
            opens, closes = q == lo[f], q == hi[f] - 1
            inside = parity[q] == 1  # an odd number of quotes in front: this one closes or begins a pair
            pair_next = np.zeros(len(q), bool)
            pair_next[:-1] = (q[1:] == q[:-1] + 1) & (f[1:] == f[:-1])
            pair_last = np.zeros(len(q), bool)
            pair_last[1:] = pair_next[:-1]
            fine = np.where(inside, closes | pair_next, opens | (pair_last & (q > lo[f] + 1)))
            # A quoted field must open with its quote, so the field of any quote must.
            fine &= b[lo[f]] == QUOTE
            np.logical_or.at(bad, record[q], ~fine)
        self.quoting = bad

    @staticmethod
    def _delimiters(b: np.ndarray, delimiter: bytes, ends: np.ndarray, record: np.ndarray) -> np.ndarray:
        hit = b[: len(b) - len(delimiter) + 1] == delimiter[0]
        for i, c in enumerate(delimiter[1:], 1):
            hit &= b[i : len(b) - len(delimiter) + 1 + i] == c
        at = np.flatnonzero(hit)
        if delimiter == b"\0":
            at = at[~np.isin(at, ends)]
        at = at[record[at] == record[at + len(delimiter) - 1]]
        if len(delimiter) > 1 and len(at) and (np.diff(at) < len(delimiter)).any():
            kept, free = [], -1
            for i in at.tolist():  # a delimiter that can overlap itself: the leftmost counts
                if i >= free:
                    kept.append(i)
                    free = i + len(delimiter)
            at = np.array(kept, np.int64)
        return at

    def field(self, rec: np.ndarray, k: int) -> pa.Array:
        lo, hi = self.lo[self.first[rec] + k], self.hi[self.first[rec] + k]
        quoted = (hi > lo) & (self.bytes[np.minimum(lo, len(self.bytes) - 1)] == QUOTE)
        size = hi - lo - 2 * quoted
        offsets = np.concatenate([[0], np.cumsum(size)])
        picked = self.bytes[np.repeat(lo + quoted - offsets[:-1], size) + np.arange(offsets[-1])]
        # Fields end at ASCII signs or whole delimiters, so they are UTF-8 as their lines are.
        values = pa.LargeStringArray.from_buffers(len(rec), pa.py_buffer(offsets), pa.py_buffer(picked))
        return pc.if_else(pa.array(quoted), pc.replace_substring(values, '""', '"'), values) if quoted.any() else values


def _contents(lines: pa.Array) -> list[pa.Buffer]:
    """The bytes of a text array, of this array's part of its buffer only."""
    lines = lines.cast(pa.large_binary())
    first, last = (int(np.frombuffer(lines.buffers()[1], np.int64)[lines.offset + i]) for i in (0, len(lines))) if len(lines) else (0, 0)
    return [lines.buffers()[2].slice(first, last - first)] if last > first else []


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def is_epoch(date_format: str | None) -> bool:
    """Whether a stream's times are epoch milliseconds, as a format of null (or its name) says."""
    return date_format is None or date_format.strip().lower() in ("", "null")


@lru_cache
def date_parts(date_format: str) -> tuple[str, tuple[slice, ...]]:
    """A date format as a pattern of the whole text, and where year, month, day, hour, minute and second are in it. Other
    letters than theirs, or one of them missing, are an error."""
    at, pattern, i = {}, "", 0
    while i < len(date_format):
        c = date_format[i]
        if c.isalpha():
            width = len(date_format[i:]) - len(date_format[i:].lstrip(c))
            if DATE_LETTERS.get(c) != width or c in at:
                raise ValueError(f"date format {date_format!r}")
            at[c], pattern, i = slice(i, i + width), pattern + f"[0-9]{{{width}}}", i + width
        else:
            pattern, i = pattern + re.escape(c), i + 1
    if len(at) != len(DATE_LETTERS):
        raise ValueError(f"date format {date_format!r}")
    return f"^{pattern}$", tuple(at[c] for c in DATE_LETTERS)


def usable_format(date_format: str | None) -> bool:
    try:
        return is_epoch(date_format) or bool(date_parts(date_format))
    except ValueError:
        return False


def times(values: pa.Array, date_format: str | None = None) -> np.ndarray:
    """Epoch milliseconds of texts in a stream's form: 13 digits (see ``is_epoch``), or real dates and times written
    exactly as ``date_format`` says (UTC); -1 for others."""
    out = np.full(len(values), -1, np.int64)
    if is_epoch(date_format):
        digits = _matches(values, "^[0-9]{13}$")
        ms = pc.cast(values.filter(pa.array(digits)), pa.int64()).to_numpy()
        out[digits] = np.where((ms >= MS_FROM) & (ms < MS_TO), ms, -1)
        return out
    pattern, places = date_parts(date_format)
    dated = np.flatnonzero(_matches(values, pattern))
    if len(dated):
        text = values.take(pa.array(dated))
        y, mo, d, h, mi, s = (pc.cast(pc.utf8_slice_codeunits(text, p.start, p.stop), pa.int64()).to_numpy() for p in places)
        month_fine = (mo >= 1) & (mo <= 12)
        month = ((y - 1970) * 12 + np.where(month_fine, mo, 1) - 1).astype("datetime64[M]")
        day0 = month.astype("datetime64[D]").astype(np.int64)
        n_days = (month + 1).astype("datetime64[D]").astype(np.int64) - day0
        real = (y >= 1) & month_fine & (d >= 1) & (d <= n_days) & (h < 24) & (mi < 60) & (s < 60)
        out[dated] = np.where(real, (((day0 + d - 1) * 24 + h) * 3600 + mi * 60 + s) * 1000, -1)
        # Dates before 1970 are real too; the marker -1 is no full second, so it stays free.
    return out


def numbers(values: pa.Array) -> np.ndarray:
    """Doubles of decimal numbers; NaN where a text is none."""
    out = np.full(len(values), np.nan)
    fine = _matches(values, NUMBER)
    texts = values.filter(pa.array(fine)).to_pylist()
    out[fine] = np.array(list(map(float, texts)), np.float64)
    return out


def check_lines(lines: pa.Array | list[bytes], delimiter: bytes, n_fields: int, attrs: list[int], date_format: str | None = None) -> dict[str, np.ndarray]:
    """Reason (None: valid), number of fields, oid, time, x and y of each line."""
    n = len(lines)
    ix = Index(lines, delimiter)
    reason = np.full(n, None, object)
    reason[ix.quoting] = "quoting"
    reason[~ix.quoting & (ix.n_fields != n_fields)] = "column_count"
    ok = np.flatnonzero(reason == None)  # noqa: E711
    oid, ts, x, y = np.full(n, None, object), np.full(n, -1, np.int64), np.full(n, np.nan), np.full(n, np.nan)

    def texts(rec: np.ndarray, k: int) -> pa.Array:
        return ix.field(rec, attrs[k])

    def narrow(rec: np.ndarray, fine: np.ndarray, name: str) -> np.ndarray:
        reason[rec[~fine]] = name
        return rec[fine]

    if len(ok):
        raw = texts(ok, 0)
        oid[ok] = raw.to_numpy(zero_copy_only=False)
        fine = np.ones(len(ok), bool)
        for i in np.flatnonzero(~_matches(raw, "[0-9A-Za-z]")).tolist():  # few have no such sign; of these the white ones go
            fine[i] = bool(oid[ok[i]].strip())
        ok = narrow(ok, fine, "oid")
    if len(ok):
        ts[ok] = times(texts(ok, 1), date_format)
        ok = narrow(ok, ts[ok] != -1, "timestamp")
    if len(ok):
        x[ok], y[ok] = numbers(texts(ok, 2)), numbers(texts(ok, 3))
        ok = narrow(ok, (np.abs(x[ok]) <= 180) & (np.abs(y[ok]) <= 90), "coordinate")
    return {"fail_reason": reason, "n_found": ix.n_fields.astype(np.int32), "oid": oid, "ts_ms": ts, "x": x, "y": y}


def parse_lines(lines: DataFrame, conf: DataFrame, line_col: str = "raw_line", stream_col: str = "stream_id") -> DataFrame:
    """``lines`` with fail_reason, n_found, oid, ts_ms, x, y added (columns of those names are replaced).

    ``conf`` gives each stream's ``input_delimiter``, ``n_fields``, ``csv_tsv_schema_attr`` (0-based positions of oid,
    time, x, y) and ``date_format``, the one form its times may have (see ``times``). Valid lines have a null fail_reason and all four values. Others have the first reason that
    applies: ``stream`` (no usable configuration), ``quoting``, ``column_count``, ``oid``, ``timestamp``,
    ``coordinate``, and null values. A null line counts as an empty one. Repeated lines each give their own row.
    Nothing is shuffled; the configuration travels with the tasks and must have at most MAX_STREAMS rows.
    """
    # A closing row count keeps a wrongly large table from being collected whole.
    rows = conf.select("stream_id", "input_delimiter", "n_fields", "csv_tsv_schema_attr", "date_format").limit(MAX_STREAMS + 1).collect()
    if len(rows) > MAX_STREAMS:
        raise ValueError(f"more than {MAX_STREAMS} stream configurations")
    streams = {}
    for r in rows:
        attrs = r["csv_tsv_schema_attr"]
        if r["input_delimiter"] and r["n_fields"] and attrs is not None and len(attrs) == 4 and all(a is not None and 0 <= a < r["n_fields"] for a in attrs):
            if usable_format(r["date_format"]):
                streams[r["stream_id"]] = (delimiter_bytes(r["input_delimiter"]), r["n_fields"], list(attrs), r["date_format"])
    added = ["fail_reason", "n_found", "oid", "ts_ms", "x", "y"]
    kept = [c for c in lines.columns if c not in added]
    source = lines.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "fail_reason string, n_found int, oid string, ts_ms bigint, x double, y double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = {name: i for i, name in enumerate(batch.schema.names)}
            raw = pc.fill_null(batch.column(at[line_col]), "")
            names = batch.column(at[stream_col]).dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            out = {"fail_reason": np.full(n, "stream", object), "n_found": np.zeros(n, np.int32), "oid": np.full(n, None, object), "ts_ms": np.full(n, -1, np.int64), "x": np.full(n, np.nan), "y": np.full(n, np.nan)}
            for c, name in enumerate(names.dictionary.to_pylist()):
                if name in streams:
                    rec = np.flatnonzero(code == c)
                    for k, v in check_lines(raw.take(pa.array(rec)), *streams[name]).items():
                        out[k][rec] = v
            bad = out["fail_reason"] != None  # noqa: E711
            new = [
                pa.array(out["fail_reason"], pa.string()), pa.array(out["n_found"], pa.int32()), pa.array(np.where(bad, None, out["oid"]), pa.string()),
                pa.array(out["ts_ms"], pa.int64(), mask=bad), pa.array(out["x"], pa.float64(), mask=bad), pa.array(out["y"], pa.float64(), mask=bad),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    return source.mapInArrow(run, schema)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fail_reason").isNotNull())


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fail_reason").isNull())
