"""Repetition inside single documents, and what it says about their hosts.

Each document is measured by itself, in arrays over a batch of documents and without any shuffle. Rules on the measures
fail or pass; failures are counted by host, each host's rate is shrunk towards all hosts' by a beta prior fitted to
them, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.words import words
from tidegrid.shared import written

_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)|\n+")


@dataclass(frozen=True)
class RepetitionRules:
    """``run`` words make a run. A document fails a rule at or above its limit; a host is bad from ``bad_rate`` on."""

    run: int = 10
    max_word_share: float = 0.3
    max_line_share: float = 0.3
    max_sentence_share: float = 0.3
    bad_rate: float = 0.2


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def repeated_words(docs: list[list[str]], run: int = 10) -> np.ndarray:
    """How many words of each document lie in a run of ``run`` words that also began earlier in the same document."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(sizes.sum())
    if total < run:
        return np.zeros(len(docs), np.int64)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), sizes)
    starts = np.flatnonzero(doc[: total - run + 1] == doc[run - 1 :])
    if not len(starts):
        return np.zeros(len(docs), np.int64)
    coded = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    key = _mix(doc[starts].astype(np.uint64) + np.uint64(1))
    for j in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + coded[starts + j]
    order = np.argsort(key, kind="stable")  # equal keys keep their order, so the first of a group began first
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again, origin = starts[order[~new]], starts[first[~new]]
    same = doc[again] == doc[origin]
    for j in range(run):
        same &= ids[again + j] == ids[origin + j]
    odd = set(doc[again[~same]].tolist())  # documents in which two different runs share a key
    again = again[same]
    mark = np.bincount(again, minlength=total + run) - np.bincount(again + run, minlength=total + run)
    out = np.bincount(doc, weights=np.cumsum(mark)[:total] > 0, minlength=len(docs)).astype(np.int64)
    for d in odd:
        out[d] = _repeated_in(docs[d], run)
    return out


def _repeated_in(doc: list[str], run: int) -> int:
    seen, marked = set(), np.zeros(len(doc), bool)
    for i in range(len(doc) - run + 1):
        gram = tuple(doc[i : i + run])
        if gram in seen:
            marked[i : i + run] = True
        seen.add(gram)
    return int(marked.sum())


def _share_again(parts: list[str]) -> float:
    """Share of the characters in parts that occurred before."""
    seen, again, total = set(), 0, 0
    for p in parts:
        p = p.strip()
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def measure(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "host") -> DataFrame:
    """doc_id, host, n_words, n_repeated, word_share, line_share, sentence_share of each document (row).

    Null and empty texts have no words and shares of 0. Texts are taken whole, whatever their length; other columns
    don't matter. Repeated rows are measured each for itself.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):  # blocks of bounded size, whatever the texts' lengths
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 4_000_000):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                docs = [words(t) for t in part]
                n, again = np.array([len(d) for d in docs], np.int64), repeated_words(docs, rules.run)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(n), pa.array(again), pa.array(again / np.maximum(n, 1)),
                        pa.array([_share_again(t.split("\n")) for t in part], pa.float64()), pa.array([_share_again(_SENTENCE.split(t)) for t in part], pa.float64()),
                    ],
                    names=["doc_id", "host", "n_words", "n_repeated", "word_share", "line_share", "sentence_share"],
                )
                at = end

    return source.mapInArrow(run, f"doc_id {kind}, host string, n_words bigint, n_repeated bigint, word_share double, line_share double, sentence_share double")


def host_rates(measured: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """host, n_docs, n_failed, rate (as counted), shrunk_rate, verdict (``bad`` or ``fine``) of each non-null host.

    The beta prior's mean is the failure rate of all documents; its strength comes from how much the hosts' rates
    spread beyond what chance gives them. Two or more hosts are needed for a spread; with fewer, or none beyond chance,
    the prior is so strong that every host gets the common rate.
    """
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed(rules).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    n, f, sq, k = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(rate * rate * F.col("n_docs")), F.count("*")).first()
    strength, mean = 1e6, 0.0
    if n:
        mean = f / n
        spread, binomial = sq / n - mean * mean, mean * (1 - mean)
        # Expected weighted spread: binomial * (k - 1) / n by chance, and a binomial / (strength + 1) between hosts.
        beyond = spread - binomial * (k - 1) / n
        if k > 1 and beyond > 0:
            strength = min(max(binomial / beyond - 1, 1.0), 1e6)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), shrunk.alias("shrunk_rate"), F.when(shrunk >= rules.bad_rate, "bad").otherwise("fine").alias("verdict"))


def failed(rules: RepetitionRules):  # noqa: ANN201
    """Whether a measured document fails any rule."""
    return (F.col("word_share") >= rules.max_word_share) | (F.col("line_share") >= rules.max_line_share) | (F.col("sentence_share") >= rules.max_sentence_share)


def repetition_report(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), **columns: str) -> DataFrame:
    """``measure``'s columns with repetitive (the word rule fails), failed (any rule does), host_rate, host_verdict.

    Documents without a host have null host columns. The measures are written once to the shared folder, as hosts and
    documents both need them; so are the hosts' verdicts, whose size the engine then knows: it sends few to the
    documents, else it shuffles both by host and splits those that hold many.
    """
    measured = written(measure(documents, rules, **columns), "repetition")
    hosts = written(host_rates(measured, rules), "hosts").select("host", F.col("shrunk_rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    joined = measured.join(hosts, "host", "left")
    return joined.withColumn("repetitive", F.col("word_share") >= rules.max_word_share).withColumn("failed", failed(rules))
