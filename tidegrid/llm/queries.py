"""Queries of the text operators (problems 7 to 9), and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import leakage, mixing, repetition
from tidegrid.plans.tables import table
from tidegrid.shared import written


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = p7_leaks(spark, d)
    return leaks.where(F.col("kind") == "verbatim").select("item_id", "doc_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mix(spark, d).plan().where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(spark, d).report()


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return mix(spark, d).sample()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that fail the word rule, from the operator's report. Whether one does is its own measure; its host's
    verdict, which the report joins to it, decides no row here."""
    return repetition.repetition_report(table(spark, d, "documents")).where("repetitive").select("doc_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(repetition.repetition_report(table(spark, d, "documents")), "word_share", "line_share", "sentence_share", "host_rate")


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(repetition.host_rates(written(repetition.measure(table(spark, d, "documents")), "repetition")), "rate", "shrunk_rate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_found, p7_leaks, p8_found, p8_report, p8_sample, p9_found, p9_report, p9_hosts)}

def _folded() -> tuple[str, str]:
    """Letters that compatibility turns into one other letter, and those."""
    pairs = [(chr(p), unicodedata.normalize("NFKD", chr(p))) for p in range(0x80, 0x10000) if unicodedata.decomposition(chr(p)).startswith("<")]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and unicodedata.category(b)[0] == "L"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def sql_words(text: str) -> str:
    """The list of a text's words. Signs that stand for several letters are those that the tables have."""
    single, letter = _folded()
    several = text
    for sign in "\u2116\u2122\ufb00\ufb01\ufb02\u2026":
        several = f"replace({several}, '{sign}', '{unicodedata.normalize('NFKD', sign)}')"
    return f"regexp_extract_all(lower(strip_accents(regexp_replace(translate({several}, '{single}', '{letter}'), '[\\p{{Cf}}\\p{{M}}]', '', 'g'))), '\\p{{L}}+')"


def sql_grams(words: str, n: int) -> str:
    """Rows of ``words`` (id, w) with the ``n`` words from each place on: id, i, gram."""
    return f"SELECT id, i, array_to_string(w[i : i + {n - 1}], ' ') AS gram FROM ({words}), unnest(generate_series(1, len(w) - {n - 1})) u(i)"


_DOCS = f"SELECT doc_id AS id, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL"
_ITEMS = f"SELECT item_id AS id, {sql_words('passage')} AS w FROM eval_items WHERE passage IS NOT NULL"
#: Words of each document in runs of ten that began before: each repeated run's ten, less what the next one covers too.
_REPEATED = f"""WITH d AS MATERIALIZED ({_DOCS}), g AS ({sql_grams('SELECT * FROM d', 10)}),
again AS (SELECT id, i FROM (SELECT id, i, row_number() OVER (PARTITION BY id, gram ORDER BY i) AS nth FROM g) WHERE nth > 1),
n AS (SELECT id, CAST(sum(least(10, coalesce(nxt - i, 10))) AS BIGINT) AS n FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM again) GROUP BY id),
measured AS (SELECT doc_id, host, coalesce(len(w), 0) AS n_words, coalesce(n.n, 0) AS n_repeated, coalesce(text, '') AS text FROM documents LEFT JOIN d ON d.id = doc_id LEFT JOIN n ON n.id = doc_id)"""
_TRIM = "regexp_replace({}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g')"


def _again(parts: str, name: str) -> str:
    """Share of the characters in parts that came before, by document."""
    return f"""{name} AS (SELECT doc_id, coalesce(sum(length(part)) FILTER (WHERE nth > 1), 0) / nullif(sum(length(part)), 0) AS share FROM (
SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part) AS nth FROM (SELECT doc_id, {_TRIM.format('unnest(' + parts + ')')} AS part FROM measured)) GROUP BY doc_id)"""


_SHARES = f"""{_REPEATED}, {_again('string_split(text, chr(10))', 'line')}, {_again("regexp_split_to_array(text, '[.!?]+(?:[\\s\\p{Z}]+|$)|\\n+')", 'sentence')},
shares AS (SELECT m.doc_id, host, n_words, n_repeated, n_repeated / greatest(n_words, 1) AS word_share, coalesce(line.share, 0) AS line_share, coalesce(sentence.share, 0) AS sentence_share FROM measured m LEFT JOIN line USING (doc_id) LEFT JOIN sentence USING (doc_id)),
hosts AS (SELECT host, count(*) AS n_docs, count(*) FILTER (WHERE word_share >= 0.3 OR line_share >= 0.3 OR sentence_share >= 0.3) AS n_failed FROM shares WHERE host IS NOT NULL GROUP BY host),
fit AS (SELECT sum(n_failed) / sum(n_docs) AS mean, sum(n_failed / n_docs * n_failed / n_docs * n_docs) / sum(n_docs) AS sq, count(*) AS k, sum(n_docs) AS n FROM hosts),
prior AS (SELECT mean, CASE WHEN k > 1 AND sq - mean * mean - mean * (1 - mean) * (k - 1) / n > 0 THEN least(greatest(mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * (k - 1) / n) - 1, 1), 1e6) ELSE 1e6 END AS strength FROM fit),
rated AS (SELECT host, n_docs, n_failed, n_failed / n_docs AS rate, (n_failed + mean * strength) / (n_docs + strength) AS shrunk_rate FROM hosts, prior)"""
_VERDICT = "CASE WHEN shrunk_rate >= 0.2 THEN 'bad' ELSE 'fine' END"
#: Words stand in for tokens here: the sources that fall short are the same.
SQL: dict[str, str] = {
    "p7_found": f"WITH d AS MATERIALIZED ({_DOCS}), e AS MATERIALIZED ({_ITEMS}), dg AS ({sql_grams('SELECT * FROM d', 12)}), eg AS ({sql_grams('SELECT * FROM e', 12)}) SELECT DISTINCT eg.id AS item_id, dg.id AS doc_id FROM eg JOIN dg USING (gram)",
    "p9_found": f"{_REPEATED} SELECT doc_id FROM measured WHERE n_words > 0 AND n_repeated / n_words >= 0.3",
    "p9_report": f"{_SHARES} SELECT doc_id, s.host, n_words, n_repeated, round(word_share, 6) AS word_share, round(line_share, 6) AS line_share, round(sentence_share, 6) AS sentence_share, word_share >= 0.3 AS repetitive, word_share >= 0.3 OR line_share >= 0.3 OR sentence_share >= 0.3 AS failed, round(shrunk_rate, 6) AS host_rate, CASE WHEN r.host IS NOT NULL THEN {_VERDICT} END AS host_verdict FROM shares s LEFT JOIN rated r ON r.host = s.host",
    "p9_hosts": f"{_SHARES} SELECT host, n_docs, n_failed, round(rate, 6) AS rate, round(shrunk_rate, 6) AS shrunk_rate, {_VERDICT} AS verdict FROM rated",
    "p8_found": """
WITH sizes AS (
  SELECT lower(trim(source)) AS source, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(regexp_extract_all(text, '\\S+')) END AS n FROM documents
), by_source AS (SELECT source, sum(n) AS n FROM sizes GROUP BY source)
SELECT t.source FROM source_targets t LEFT JOIN by_source b ON b.source = lower(trim(t.source))
WHERE coalesce(b.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM sizes)
""",
}
