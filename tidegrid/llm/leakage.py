"""Evaluation passages inside training texts, also re-parameterised ones, by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words stay. Windows of a template
are hashed and joined between passages and documents; for each match the slots, that is what the placeholders stand
for, are compared. Equal words in every position are a verbatim leak; another value wherever the passage has the same
one, consistently, is the same question with new parameters.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.words import cased_words, tokens

#: Words for numbers, and for units, in English, Spanish, French and German, without marks.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho
diecinueve veinte veintiun veintiuno veintiuna veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho
veintinueve treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos doscientas trescientos
trescientas cuatrocientos cuatrocientas quinientos quinientas seiscientos seiscientas setecientos setecientas ochocientos
ochocientas novecientos novecientas mil millon millones
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante
soixante septante huitante octante nonante cent cents mille millions milliard milliards
null eins elf zwolf hundert tausend millionen milliarde milliarden""".split()
UNIT_WORDS = """mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches
g kg gram grams kilogram kilograms tonne tonnes pound pounds litre litres liter liters second seconds minute minutes hour hours
day days week weeks month months year years euro euros dollar dollars percent
metro metros kilometro kilometros milla millas pulgada pulgadas gramo gramos kilogramo kilogramos kilo kilos tonelada toneladas
libra libras litro litros segundo segundos minuto minutos hora horas dia dias semana semanas mes meses ano anos dolar dolares
gramme grammes kilogramme kilogrammes livre livres pouce pouces seconde secondes heure heures jour jours semaine semaines mois
an ans annee annees
meile meilen gramm kilogramm tonnen pfund sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate
monaten jahr jahre jahren prozent""".split()
#: What links number words to one numeral: the link's number, and the words after which it does.
LINKS = {
    "and": (1, "hundred thousand million billion trillion"), "y": (2, "treinta cuarenta cincuenta sesenta setenta ochenta noventa"),
    "et": (3, "vingt trente quarante cinquante soixante"), "und": (4, "hundert tausend million millionen"),
}
#: Articles are words of their own, but before a multiplier, or after a number that one can be added to.
ARTICLES = "a un una une ein eine".split()
MULTIPLIERS = "hundred thousand million billion trillion mil millon milliard milliarde hundert tausend".split()
BEFORE_ONE = "ciento mil cent mille vingt vingts hundert tausend".split()
_ONES = "(?:ein|eins|eine|zwei|drei|vier|funf|sechs|sieben|acht|neun)"
_GERMAN_TENS = "(?:zwanzig|drei(?:ss|\u00df)ig|vierzig|funfzig|sechzig|siebzig|achtzig|neunzig)"
_GERMAN_SMALL = f"(?:(?:{_ONES}und)?{_GERMAN_TENS}|(?:drei|vier|funf|sech|sieb|acht|neun)?zehn|elf|zwolf|{_ONES})"
_GERMAN_HUNDREDS = f"(?:{_ONES}?hundert(?:und)?{_GERMAN_SMALL}?|{_GERMAN_SMALL})"
_GERMAN = re.compile(f"(?:{_GERMAN_HUNDREDS}?tausend(?:und)?)?{_GERMAN_HUNDREDS}?")
#: Characters of the passages that a task holds at a time (their index takes about thirteen times as many bytes).
BLOCK = 4_000_000
NAME, NUMBER, UNIT = 1, 2, 3  # templates' placeholders; literal words come after


@dataclass(frozen=True)
class TemplateRules:
    """``window``: words that a match takes. A match with new parameters needs ``min_literals`` words that are the same
    on both sides, as literal words always are, in one window or in a run of consecutive consistent windows."""

    window: int = 12
    min_literals: int = 6


_NUMBERS = frozenset(NUMBER_WORDS)


@lru_cache(1 << 16)
def number_word(word: str) -> bool:
    """Whether a lower-cased word stands for a number, as German ones of any length do."""
    return word in _NUMBERS or (word not in ARTICLES and bool(word) and _GERMAN.fullmatch(word) is not None)


def _rolling(values: np.ndarray, windows: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all windows of each of the given lengths, which rise."""
    key = np.zeros(len(values) + 1, np.uint64)
    v = values.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    j = 0
    for window in windows:
        if len(values) < window:
            return
        for j in range(j, window):
            n = len(values) - j
            key = key[:n] * np.uint64(0x9E3779B97F4A7C15) + v[j:]
        j = window
        yield window, key ^ np.uint64(window * 0xD6E8FEB86659FD93 % 2**64)


class _Index:
    """Places of windows by their hashes."""

    def __init__(self, keys: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.at = at[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.last = np.append(self.first[1:], len(self.at))
        # A filter in front of the search: most windows of most documents match nothing.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def meet(self, keys: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own place, place of a window with the same hash)."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(whole & self.sieve[(keys >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[k] == keys[at]
        at, k = at[hit], k[hit]
        n = self.last[k] - self.first[k]
        return np.repeat(at, n), self.at[np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@dataclass
class _Texts:
    """Texts as words (``word_*``) and as templates, in which a numeral is one position."""

    flat: list[str]
    word_lex: np.ndarray
    word_text: np.ndarray
    template: np.ndarray
    text: np.ndarray
    value: np.ndarray  # of words, their lexicon number
    words: np.ndarray  # words in each position, which digits aren't
    first: np.ndarray  # in ``flat``; the last is the end

    def said(self, i: int) -> str:
        return " ".join(self.flat[self.first[i] : self.first[i + 1]]).lower()


def word_forms(passages: Iterator[str]) -> set[tuple[str, bool]]:
    """Words of passages, lower-cased, and whether they are written without a capital there."""
    return {(w.lower(), w == w.lower()) for p in passages for w in cased_words(p)}


class Lexicon:
    """The words of all passages with what they stand for in templates, whatever blocks the passages are in."""

    def __init__(self, forms: set[tuple[str, bool]]) -> None:
        self.common = {w for w, plain in forms if plain}
        # Names are always written with a capital. Words met only where sentences begin may be names, so they are too.
        words = sorted({w for w, _ in forms})
        names = [w for w in words if w not in self.common]
        kinds = {w: NAME for w in names} | {w: NUMBER for w in [*NUMBER_WORDS, *words] if number_word(w)} | {w: UNIT for w in UNIT_WORDS}
        self.number: dict[str, int] = {}
        for w in [*kinds, *LINKS, *ARTICLES, *words]:
            self.number.setdefault(w, len(self.number) + 1)
        n = len(self.number) + 1
        self.template = np.zeros(n, np.int64)  # by number; 0: in no passage
        for w, i in self.number.items():
            self.template[i] = kinds.get(w, i + UNIT)
        known = lambda ws: np.isin(np.arange(n), [self.number[w] for w in ws])
        self.article, self.multiplier, self.before_one = known(ARTICLES), known(MULTIPLIERS), known(BEFORE_ONE)
        self.link, self.opens = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w, (k, after) in LINKS.items():
            self.link[self.number[w]] = k
            self.opens[known(after.split())] |= 1 << k

    def read(self, texts: list[str]) -> _Texts:
        parts = [tokens(t) for t in texts]
        flat = [x for ws in parts for x in ws]
        get = self.number.get
        lex = np.fromiter((get(x.lower(), 0) for x in flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), np.array([len(ws) for ws in parts], np.int64))
        template = self.template[lex]
        digits = np.zeros(len(flat), bool)
        for i in np.flatnonzero(lex == 0).tolist():
            x = flat[i]
            if x[0] in "0123456789":
                digits[i] = True
            elif number_word(x.lower()):
                template[i] = NUMBER
            elif x[0].isupper() and x.lower() not in self.common:
                template[i] = NAME  # a capital that no passage has: it may stand where a passage has another name
        number = digits | (template == NUMBER)

        def beside(values: np.ndarray, by: int) -> np.ndarray:
            """The values ``by`` places on, nothing beyond a text's bounds."""
            out = np.zeros_like(values)
            here, there = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
            out[here] = np.where(text[here] == text[there], values[there], 0)
            return out

        before, after = beside(lex, -1), beside(lex, 1)
        link = self.link[lex]
        linked = (link > 0) & (self.opens[before] >> link & 1 > 0) & ((beside(number, 1) & ~self.multiplier[beside(lex, 2)]) | ((link > 1) & self.article[after]))
        number |= linked | (self.article[lex] & (self.before_one[before] | self.multiplier[after] | beside(linked, -1)))
        first = np.flatnonzero(~(number & beside(number, -1)))
        template[number] = NUMBER
        value = np.where(number, -1, lex)
        counted = np.concatenate([[0], np.cumsum(~digits)])
        ends = np.append(first, len(flat))
        return _Texts(flat, lex[~digits], text[~digits], template[first], text[first], value[first], np.diff(counted[ends]), ends)


class Passages:
    """Templates of a block of passages, by window."""

    def __init__(self, items: list[tuple[object, str]], rules: TemplateRules, lexicon: Lexicon) -> None:
        self.rules, self.ids = rules, [i for i, _ in items]
        own = self.own = lexicon.read([p for _, p in items])
        w = rules.window
        at = np.arange(max(0, len(own.word_lex) - w + 1))
        at = at[own.word_text[at] == own.word_text[at + w - 1]]
        keys = dict(_rolling(own.word_lex, [w])).get(w, np.empty(0, np.uint64))
        self.verbatim = _Index(keys[at], at)
        # Windows of the template hold as many words of the passage, however many positions these are.
        self.numerals: dict[str, int] = {}
        for i in np.flatnonzero(own.template == NUMBER).tolist():
            own.value[i] = self.numerals.setdefault(own.said(i), -2 - len(self.numerals))
        sums = np.concatenate([[0], np.cumsum(own.words)])
        at = np.flatnonzero(own.words)
        end = np.searchsorted(sums, sums[at] + w)
        fine = end < len(sums)
        at, end = at[fine], end[fine]
        fine = own.text[at] == own.text[end - 1]
        at, size = at[fine], (end - at)[fine]
        self.others = {n: _Index(keys[at[size == n]], at[size == n]) for n, keys in _rolling(own.template, np.unique(size).tolist())}

    def matches(self, t: _Texts) -> list[tuple[int, int, int, int, int]]:
        """Per text and passage: (text, passage, verbatim windows, words of the longest verbatim run, windows with
        other parameters)."""
        w, own, found = self.rules.window, self.own, {}
        if not len(self.verbatim.at):
            return []
        t = replace(t, value=t.value.copy())  # numerals are valued anew by each block

        def whole(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
            broken = np.concatenate([[0], np.cumsum(values == 0)])
            return (broken[n:] == broken[:-n]) & (text[: len(values) - n + 1] == text[n - 1 :])

        for _, keys in _rolling(t.word_lex, [w]):
            vd, vp = self.verbatim.meet(keys, whole(t.word_lex, t.word_text, w))
            alike = np.ones(len(vd), bool)
            for j in range(w):
                alike &= t.word_lex[vd + j] == own.word_lex[vp + j]
            vd, vp = vd[alike], vp[alike]
            order = np.lexsort((vd, vd - vp, own.word_text[vp], t.word_text[vd]))
            vd, vp = vd[order], vp[order]
            if len(vd):
                fresh = np.concatenate([[True], (np.diff(vd) != 1) | (np.diff(vp) != 1)])
                runs = np.diff(np.append(np.flatnonzero(fresh), len(vd)))
                for i, length in zip(np.flatnonzero(fresh).tolist(), runs.tolist()):
                    f = found.setdefault((int(t.word_text[vd[i]]), int(own.word_text[vp[i]])), [0, 0, 0])
                    f[0] += length
                    f[1] = max(f[1], length + w - 1)
        met = []
        for n, keys in _rolling(t.template, list(self.others)):
            d, p = self.others[n].meet(keys, whole(t.template, t.text, n))
            alike = np.ones(len(d), bool)
            for j in range(n):
                alike &= t.template[d + j] == own.template[p + j]
            d, p = d[alike], p[alike]
            same, changed = np.zeros(len(d), np.int64), np.zeros(len(d), bool)
            steps = np.arange(n)
            for a in range(0, len(d), 100_000):
                z = a + 100_000
                di, pi = d[a:z, None] + steps, p[a:z, None] + steps
                for i in np.unique(di[own.template[pi] == NUMBER]).tolist():
                    t.value[i] = self.numerals.get(t.said(i), -1)
                equal = t.value[di] == own.value[pi]
                same[a:z], changed[a:z] = (equal * own.words[pi]).sum(axis=1), ~equal.all(axis=1)
            met.append((d, p, np.full(len(d), n), same, changed))
        if met:
            for i, q in self._others(t, *(np.concatenate(c) for c in zip(*met))):
                found.setdefault((int(t.text[i]), int(own.text[q])), [0, 0, 0])[2] += 1
        return [(i, k, *f) for (i, k), f in found.items()]

    def _others(self, t: _Texts, d: np.ndarray, p: np.ndarray, n: np.ndarray, same: np.ndarray, changed: np.ndarray) -> Iterator[tuple[int, int]]:
        """Those of the windows at (``d``, ``p``), whose templates are alike, that match with other parameters. ``same``:
        words that are equal; ``changed``: whether something isn't."""
        if not changed.any():
            return
        own, least = self.own, self.rules.min_literals
        order = np.lexsort((d, d - p, own.text[p], t.text[d]))
        d, p, n, same, changed = d[order], p[order], n[order], same[order], changed[order]
        step = np.diff(p)  # windows don't start at digits
        next_one = (step == 1) | ((step == 2) & (own.words[np.minimum(p[:-1] + 1, len(own.words) - 1)] == 0))
        next_one &= (np.diff(d) == step) & (np.diff(t.text[d]) == 0) & (np.diff(own.text[p]) == 0)
        fresh = np.concatenate([[True], ~next_one])
        starts = np.flatnonzero(fresh)
        enough = np.repeat(np.add.reduceat(same, starts) >= least, np.diff(np.append(starts, len(d))))  # else no run in it has as many
        run: list[tuple[int, int, int, bool, bool]] = []

        def kept() -> Iterator[tuple[int, int]]:
            if not run:
                return
            whole = all(strong for *_, strong, _ in run)
            if not whole:
                (i, q, *_), end = run[0], max(q + n for _, q, n, *_ in run)
                whole = int(((t.value[i : i + end - q] == own.value[q:end]) * own.words[q:end]).sum()) >= least
            yield from ((i, q) for i, q, _, strong, other in run if other and (strong or whole))

        at = np.flatnonzero(enough)
        for i, q, size, s, other, new in zip(*(c[at].tolist() for c in (d, p, n, same, changed, fresh))):
            fine = not other or self._consistent(t, i, q, size)
            if new or not fine:
                yield from kept()
                run = []
            if fine:
                run.append((i, q, size, s >= least, other))
        yield from kept()

    def _consistent(self, t: _Texts, i: int, q: int, n: int) -> bool:
        """Whether one value of the passage always has one value in the text, and the other way round."""
        forth: dict[str, str] = {}
        back: dict[str, str] = {}
        for j in range(n):
            if self.own.template[q + j] <= UNIT:
                a, b = self.own.said(q + j), t.said(i + j)
                if forth.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    return False
        return True


def find_leaks(
    documents: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), item_id: str = "item_id", passage: str = "passage",
    doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Leaks: item_id, doc_id, n_verbatim (windows), longest (words of the longest verbatim run), n_other (windows with
    other parameters), kind (``verbatim`` or ``reparameterised``); one row for each pair of item row and document row.

    Null, empty and short passages leak nowhere; null and empty texts hold nothing. Repeated rows match each for
    itself. Texts are read whole. The passages travel to the documents, which never move, in blocks of about ``block``
    characters. A task reads its documents' words once and holds them against one block after the other, so its memory
    has a bound, and blocks change no answer. The passages' words travel as one table. Extra columns don't matter.
    """
    held = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where(F.col("p").isNotNull())
    kinds = {"i": held.schema["i"].dataType.simpleString(), "d": documents.schema[doc_id].dataType.simpleString()}
    ddl = f"item_id {kinds['i']}, doc_id {kinds['d']}, n_verbatim bigint, longest bigint, n_other bigint"
    source = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    context = documents.sparkSession.sparkContext

    def forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = sorted(word_forms(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in forms], pa.string()), pa.array([f for _, f in forms], pa.bool_())], names=["w", "plain"])

    lexicon = Lexicon({(r["w"], r["plain"]) for r in held.select("p").mapInArrow(forms_of, "w string, plain boolean").distinct().toLocalIterator()})
    carried_lexicon = context.broadcast(pickle.dumps(lexicon))
    carried = [context.broadcast(pickle.dumps(Passages(part, rules, lexicon))) for part in _blocks(held, block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = pickle.loads(carried_lexicon.value)
        only = pickle.loads(carried[0].value) if len(carried) == 1 else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # parts of bounded size, whatever the texts' lengths
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 4_000_000):
                    size += len(texts[end])
                    end += 1
                read = lexicon.read(texts[at:end])
                for c in carried:
                    passages = only or pickle.loads(c.value)
                    rows = passages.matches(read)
                    cols = list(zip(*rows)) if rows else [()] * 5
                    docs = batch.column(0).take(pa.array([at + i for i in cols[0]], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([passages.ids[i] for i in cols[1]]) if rows else pa.nulls(0, pa.int64()), docs, *(pa.array(c, pa.int64()) for c in cols[2:])],
                        names=["item_id", "doc_id", "n_verbatim", "longest", "n_other"],
                    )
                at = end

    return source.mapInArrow(run, ddl).withColumn("kind", F.when(F.col("n_verbatim") > 0, "verbatim").otherwise("reparameterised"))


def _blocks(held: DataFrame, block: int) -> Iterator[list[tuple[object, str]]]:
    """Passages in blocks of about ``block`` characters, one after the other; at least one block."""
    part, size, any_ = [], 0, False
    for row in held.toLocalIterator():
        if part and size + len(row["p"]) > block:
            yield part
            part, size, any_ = [], 0, True
        part.append((row["i"], row["p"]))
        size += len(row["p"])
    if part or not any_:
        yield part
