import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import reject_rows as R


def sequential(line, delimiter, n, attrs, dated=False):
    """The rules, one character after the other."""
    d, s = delimiter.decode(), line.decode().removesuffix("\r")
    fields, i = [], 0
    while True:
        j = i
        while j < len(s) and s[j] == " ":
            j += 1
        if j < len(s) and s[j] == '"':
            value, k, closed = "", j + 1, False
            while k < len(s):
                if s[k] == '"':
                    if s[k + 1 : k + 2] == '"':
                        value, k = value + '"', k + 2
                        continue
                    closed, k = True, k + 1
                    break
                value, k = value + s[k], k + 1
            if not closed:
                return "quoting"
            while k < len(s) and s[k] == " ":
                k += 1
            fields.append(value)
            if k == len(s):
                break
            if not s.startswith(d, k):
                return "quoting"
            i = k + len(d)
        else:
            k = s.find(d, i)
            value = s[i : k if k >= 0 else len(s)].strip(" ")
            if '"' in value:
                return "quoting"
            fields.append(value)
            if k < 0:
                break
            i = k + len(d)
    if len(fields) != n:
        return "column_count"
    oid, time, x, y = (fields[a] for a in attrs)
    if not oid.strip():
        return "oid"
    if not dated:
        fine = re.fullmatch("[0-9]{13}", time) is not None and 946684800000 <= int(time) < 4102444800000
    else:
        fine = re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", time) is not None
        try:
            datetime.datetime.strptime(time, "%Y-%m-%d %H:%M:%S")
            fine = fine and int(time[17:]) < 60
        except ValueError:
            fine = False
    if not fine:
        return "timestamp"
    for v, most in ((x, 180), (y, 90)):
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v) or not abs(float(v)) <= most:
            return "coordinate"
    return None


@pytest.mark.parametrize("delimiter", [b",", b"\t", rb"\t", b"||"])
def test_random_lines(delimiter):
    rnd = random.Random(5)
    bits = ['"', '""', " ", "a", delimiter.decode(), "\n", "\r", "é", "|"]
    lines = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))).encode() for _ in range(5000)]
    got = R.check_lines(lines, delimiter, 3, [0, 0, 1, 2])["fail_reason"]
    assert [sequential(x, delimiter, 3, [0, 0, 1, 2]) for x in lines] == list(got)


def test_values():
    attrs = [0, 1, 2, 3]
    epoch = {
        "a,1704381609414,1,2": None, "a,0946684800000,1,2": None, "a,4102444800000,1,2": "timestamp", "a,1704381609414,180.1,2": "coordinate", "a,2024-02-29 23:59:59,1,2": "timestamp",
        "a,1704381609414,+1.5e1,-.5": None, "a,1704381609414,180,-90": None, "a,1704381609414,NaN,2": "coordinate", "a,1704381609414,0x7,2": "coordinate", '" ",1704381609414,1,2': "oid", "a,1704381609414,1": "column_count",
        '"a"x,1704381609414,1,2': "quoting", '"a,1704381609414,1,2': "quoting", '"a""b",1704381609414, 1 ,"2"\r': None, "": "column_count", "a,1704381609414,1_6,2": "coordinate", "\u2003,1704381609414,1,2": "oid",
    }
    dated = {
        "a,2024-02-29 23:59:59,+1.5e1,-.5": None, "a,2023-02-29 00:00:00,1,2": "timestamp", "a,2024-01-01 24:00:00,1,2": "timestamp", "a,2024-01-01T00:00:00,1,2": "timestamp", "a,1969-12-31 23:59:59,1,2": None,
        "a,1704381609414,1,2": "timestamp", '" a ""b""","2024-02-29 23:59:59",1,2': None,
    }
    for cases, form in ((epoch, "null"), (epoch, None), (dated, "yyyy-MM-dd HH:mm:ss")):
        lines = [k.encode() for k in cases]
        assert list(R.check_lines(lines, b",", 4, attrs, form)["fail_reason"]) == list(cases.values())
        assert [sequential(x, b",", 4, attrs, cases is dated) for x in lines] == list(cases.values())
    assert R.check_lines([b'" a ""b""",29/02/2024 23.59.58,1,2'], b",", 4, attrs, "dd/MM/yyyy HH.mm.ss")["oid"].tolist() == [' a "b"']
    assert R.usable_format("dd/MM/yyyy HH.mm.ss") and not R.usable_format("dd MMM yyyy") and not R.usable_format("yyyy-MM-dd")


def test_long_line():
    line = b'"' + b"x,\n" * 700_000 + b'",1704381609414,1,2'
    assert R.check_lines([line, b"a"], b",", 4, [0, 1, 2, 3])["fail_reason"].tolist() == [None, "column_count"]


def conf(spark, rows=(("s", ",", 4, [0, 1, 2, 3], "null"),)):
    return spark.createDataFrame(list(rows), "stream_id string, input_delimiter string, n_fields int, csv_tsv_schema_attr array<int>, date_format string")


def test_frame(spark):
    rows = [(1, "s", "a,1704381609414,1,2", 9), (1, "s", "a,1704381609414,1,2", 9), (2, "s", None, None), (3, "none", "a", 1), (4, None, "a", 1), (None, "s", "", 0)]
    lines = spark.createDataFrame(rows, "line_id bigint, stream_id string, raw_line string, x int")  # x clashes with a result
    got = {(r.line_id, r.fail_reason, r.oid, r.ts_ms, r.x, r.y) for r in R.parse_lines(lines, conf(spark)).collect()}
    assert got == {
        (1, None, "a", 1704381609414, 1.0, 2.0), (2, "column_count", None, None, None, None), (3, "stream", None, None, None, None), (4, "stream", None, None, None, None), (None, "column_count", None, None, None, None),
    }
    assert R.loaded(R.parse_lines(lines, conf(spark))).count() == 2
    assert R.parse_lines(lines.limit(0), conf(spark)).count() == 0
    assert R.rejects(R.parse_lines(lines, conf(spark, [("s", None, 4, None, None)]))).where(F.col("fail_reason") == "stream").count() == 6
    assert R.rejects(R.parse_lines(lines, conf(spark, [("s", ",", 4, [0, 1, 2, 3], "MMM")]))).where(F.col("fail_reason") == "stream").count() == 6
    assert R.delimiter_bytes(r"\t") == b"\t" and R.delimiter_bytes(r"\\t") == rb"\t"
