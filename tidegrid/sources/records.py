"""Records of delimited text files whose quoted fields may hold line breaks, found by the parity of quotes.

A line break ends a record where an even number of quotes is in front of it. Files are read in splits, side by side:
the quotes of each split are counted, and their prefix parity along the file tells each split whether it begins inside
a quoted field. With that every split finds its records' ends in one pass over its lines, as arrays; only what crosses
the border of two splits, at most two pieces of each, is shuffled and put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``raw_line`` (a record without its closing line break; CRs stay) and the partition columns of a folder.

    A file's last record needs no line break. An empty line outside quotes is an empty record. A quote that is never
    closed makes its record run on to the next quote or the end of the file, as nothing else tells where it ends.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    own = [c for c in text.columns if c != "value"]
    lines = text.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    # One row per split of the input, each of which the driver schedules anyway.
    starts = counted.select("file", "split", F.pmod(F.coalesce(before, F.lit(0)), F.lit(2)).cast("boolean").alias("inside"))
    opened = lines.join(F.broadcast(starts), ["file", "split"]).select("file", "split", "inside", *own, "value")
    kinds = ", ".join(f"`{c}` {text.schema[c].dataType.simpleString()}" for c in own)
    ddl = f"file string, split bigint, {kinds + ', ' if kinds else ''}piece int, raw_line string"
    # Pieces: 0 a whole record, 1 the end of one begun before, 2 lines inside one, 3 the begin of one. The lines are read
    # once more for the few pieces that cross borders, which is less than to keep all records in between.
    whole = opened.mapInArrow(_ends(True), ddl).select("file", *own, "raw_line")
    begun = F.sum(F.when(F.col("piece") == 3, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, 0))
    parts = opened.mapInArrow(_ends(False), ddl).withColumn("record", begun)
    joined = parts.groupBy("file", *own, "record").agg(F.array_sort(F.collect_list(F.struct("split", "piece", "raw_line"))).alias("parts"))
    return whole.unionByName(joined.select("file", *own, F.array_join(F.transform("parts", lambda p: p["raw_line"]), "\n").alias("raw_line")))


def _ends(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records, or pieces of records, of each split, whose lines come in order."""
    return lambda batches: (b for b in _cut(batches) if (b.column("piece")[0].as_py() == 0) == whole)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces, each batch of one kind."""
    key, inside, held, first = None, False, [], True  # of the split at hand; ``held``: lines of the record that is open
    meta: list = []

    def rows(of: list, pieces: list[int], texts: pa.Array | list[str]) -> pa.RecordBatch:
        n = len(pieces)
        return pa.RecordBatch.from_arrays([*(pa.array([v.as_py()], v.type).take(pa.array(np.zeros(n, np.int64))) for v in of), pa.array(pieces, pa.int32()), pa.array(texts, pa.string()) if isinstance(texts, list) else texts], names=names)

    def rest() -> Iterator[pa.RecordBatch]:
        if held:  # without an end: inside from the split's begin on, or begun in it
            yield rows(meta, [2 if first and start else 3], ["\n".join(held)])

    start = False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        names = ["file", "split", *(n for n in batch.schema.names if n not in ("file", "split", "inside", "value")), "piece", "raw_line"]
        file, split = cols["file"].dictionary_encode().indices.to_numpy(), cols["split"].to_numpy()
        edges = [0, *(np.flatnonzero((split[1:] != split[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges[:-1], edges[1:]):
            this = (cols["file"][a].as_py(), split[a])
            if this != key:
                yield from rest()
                key, held, first = this, [], True
                inside = start = cols["inside"][a].as_py()
                meta = [cols[n][a] for n in names[:-2]]
            text = cols["value"].slice(a, z - a)
            odd = pc.count_substring(text, '"').to_numpy(zero_copy_only=False) & 1
            after = (np.cumsum(odd) + inside) & 1
            inside = bool(after[-1])
            ends = np.flatnonzero(after == 0)
            # Records of one line are taken as they are; only others are put together.
            begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            single = begins == ends
            if len(ends) and held:
                single[0] = False
            if len(ends) and first and start:
                single[0] = False
            if single.any():
                yield rows(meta, [0] * int(single.sum()), text.take(pa.array(ends[single])))
            for b, e in zip(begins[~single].tolist(), ends[~single].tolist()):
                lines = [*held, *text.slice(b, e - b + 1).to_pylist()]
                yield rows(meta, [1 if first and start else 0], ["\n".join(lines)])
                held, first = [], False
            if len(ends):
                first = False
            tail = ends[-1] + 1 if len(ends) else 0
            held = [*held, *text.slice(tail).to_pylist()] if len(ends) == 0 else text.slice(tail).to_pylist()
    if key is not None:
        yield from rest()
