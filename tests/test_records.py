import random

import pytest

from tidegrid.sources.records import read_records


def record(rnd):
    field = lambda: rnd.choice(["a", "", "b c", '"x\ny"', '"q ""in"" \n\n z"', '"' + "long\n" * rnd.randint(0, 40) + '"', "é", '"plain"'])
    return ",".join(field() for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "\r"])


@pytest.mark.parametrize("size", [64, 300, 10**6])
def test_splits(spark, tmp_path, size):
    rnd = random.Random(size)
    want = []
    for name in ("stream=a/one.txt", "stream=a/two.txt", "stream=b/three.txt"):
        own = [record(rnd) for _ in range(150)]
        want += [(name[7], r) for r in own]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(("\n".join(own) + ("\n" if name != "stream=a/two.txt" or own[-1] == "" else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r.stream, r.raw_line) for r in read_records(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want)


def test_edges(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "open.txt").write_text('x\n"never closed\ny\nz')
    assert sorted(r.raw_line for r in read_records(spark, f"{tmp_path}/a").collect()) == ['"never closed\ny\nz', "x"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "empty.txt").write_text("")
    assert read_records(spark, f"{tmp_path}/b").count() == 0
