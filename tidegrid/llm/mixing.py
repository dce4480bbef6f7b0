"""Mixing sources to target shares of tokens, by capped water-filling.

Sources whose share would need more than their capped repeats are clamped there; what they leave is spread over the
others in proportion to their targets, until all fit. Documents are then taken a whole number of times, and once more
with the seeded chance of the fraction that is left.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.shared import written

#: The public byte-level vocabulary's file and its pattern of pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the vocabulary's pattern has it.
_BLANK = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters, and white space in a row, that the tokenizer is given at once.
BLOCK, BLANKS = 1_000_000, 2_000
#: A place where two pieces meet, whatever stands around it: a blank between what is none and a letter.
_SEAM = re.compile(f"(?<=[^{_BLANK}]) (?=[^\\W\\d_])")
#: Most target sources, whose totals are brought to the driver.
MAX_SOURCES = 10_000


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, read once by each worker."""
    import tiktoken

    ranks = {}
    for line in Path(vocabulary).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def _runs(blanks: int) -> re.Pattern:
    return re.compile(f"[{_BLANK}]{{{blanks},}}")


def count_tokens(text: str | None, vocabulary: str = VOCABULARY, block: int = BLOCK, blanks: int = BLANKS) -> int:
    """Tokens of a text; 0 for none. Long texts are counted in parts, cut where the vocabulary's pattern cuts them too, so
    the number doesn't depend on ``block`` and ``blanks``: at blanks in front of words, and round long runs of white
    space, which are pieces of their own and which the pattern can't take at once."""
    if not text:
        return 0
    own = tokenizer(vocabulary)
    if len(text) <= blanks:
        return len(own.encode_ordinary(text))
    n = start = 0
    for run in _runs(blanks).finditer(text):
        # In front of anything else than the end, the last of the run belongs to what follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += _count_parts(own, text, start, run.start(), block) + len(own._encode_single_piece(run[0][: end - run.start()]))
        start = end
    return n + _count_parts(own, text, start, len(text), block)


def _count_parts(own: object, text: str, start: int, end: int, block: int) -> int:
    """Tokens of ``text[start:end]``."""
    n = 0
    while end - start > block:
        seam = _SEAM.search(text, start + block, end)
        if seam is None:
            break
        n += len(own.encode_ordinary(text[start : seam.start()]))
        start = seam.start()
    return n + len(own.encode_ordinary(text[start:end]))


def canonical_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source (canonical), n_tokens of each row. Null texts have no tokens. No shuffle."""
    rows = documents.select(F.col(id_col).alias("doc_id"), canonical_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t.as_py(), vocabulary) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, source string, n_tokens bigint")


@dataclass
class Share:
    source: str
    target_share: float
    max_repeats: int
    available: int
    wanted: float = 0.0
    short: bool = False
    allocated: float = 0.0

    @property
    def cap(self) -> int:
        return self.available * self.max_repeats

    @property
    def epochs(self) -> float:
        return self.allocated / self.available if self.available else 0.0


def fill(shares: list[Share], budget: float) -> list[Share]:
    """Allocates ``budget`` tokens: each source its share, clamped at its cap, the excess to the rest in proportion."""
    for s in shares:
        s.wanted = s.target_share * budget
        s.short = s.cap < s.wanted
    free, left = list(shares), budget
    while free:
        weight = sum(s.target_share for s in free)
        if weight <= 0:
            break
        full = [s for s in free if s.cap <= left * s.target_share / weight]
        if not full:
            for s in free:
                s.allocated = left * s.target_share / weight
            break
        for s in full:
            s.allocated = float(s.cap)
        left -= sum(s.allocated for s in full)
        free = [s for s in free if s not in full]
    return shares


@dataclass
class Mix:
    """A plan (by source) and the sizes that it was made from."""

    sizes: DataFrame
    shares: list[Share]
    budget: float
    seed: int

    def plan(self) -> DataFrame:
        """source, target_share, max_repeats, available, wanted, short, allocated, epochs."""
        spark = self.sizes.sparkSession
        rows = [(s.source, s.target_share, s.max_repeats, s.available, s.wanted, s.short, s.allocated, s.epochs) for s in self.shares]
        return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, wanted double, short boolean, allocated double, epochs double")

    def sample(self) -> DataFrame:
        """doc_id, source, n_tokens, copies (at least 1) of the documents taken. The same seed takes the same ones."""
        plan = self.plan().where("epochs > 0").select("source", F.floor("epochs").alias("whole"), (F.col("epochs") - F.floor("epochs")).alias("part"))
        chance = F.pmod(F.xxhash64(F.lit(self.seed), "source", "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        # At most MAX_SOURCES rows are carried.
        taken = self.sizes.join(F.broadcast(plan), "source").withColumn("copies", F.col("whole") + F.when(chance < F.col("part"), 1).otherwise(0))
        return taken.where("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"))

    def report(self) -> DataFrame:
        """The plan with n_docs, taken_tokens and actual_share of the sample."""
        by = self.sample().groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"))
        total = by.agg(F.sum("taken_tokens")).first()[0] or 1
        filled = self.plan().join(by, "source", "left").fillna(0, ["n_docs", "taken_tokens"])
        return filled.withColumn("actual_share", F.col("taken_tokens") / F.lit(float(total)))


def mix_sources(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> Mix:
    """Plans a mix of ``budget`` tokens (default: as many as all documents have, of any source).

    ``targets``: source, target_share, max_repeats; sources are compared trimmed and lower-cased. Rows with a null in
    any of these are left out; of several rows for a source, shares add up and the largest cap counts. Sources without
    documents have no tokens, so they fall short unless their share is 0. Documents of a null or untargeted source
    count in the default budget and are never taken. With no documents nothing is wanted and nothing is short.
    """
    sizes = written(token_sizes(documents, vocabulary), "sizes")
    by = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    wanted = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(by, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    if budget is None:
        budget = float(sizes.agg(F.sum("n_tokens")).first()[0] or 0)
    shares = [Share(r["source"], r["target_share"], r["max_repeats"], r["available"] or 0) for r in rows]
    return Mix(sizes, fill(shares, budget), budget, seed)
