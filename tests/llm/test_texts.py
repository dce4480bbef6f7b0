import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import leakage, mixing, queries, repetition
from tidegrid.llm.words import tokens, words

DATA = "/root/testdata/sf0.001"


def plain_words(text):
    out, word = [], ""
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if kind[0] == "M" or kind == "Cf":
            continue
        if kind[0] == "L":
            word += c
        else:
            out.append(word)
            word = ""
    return [w.lower() for w in [*out, word] if w]


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_words(text):
    assert words(text) == plain_words(text)


def test_word_cases():
    assert words("Ｆｕｌｌ café naïve­ly x​y ﬁne 3rd don't") == ["full", "cafe", "naively", "xy", "fine", "rd", "don", "t"]
    assert words(None) == words("") == []


def plain_repeated(doc, run):
    seen, marked = set(), set()
    for i in range(len(doc) - run + 1):
        if tuple(doc[i : i + run]) in seen:
            marked |= set(range(i, i + run))
        seen.add(tuple(doc[i : i + run]))
    return len(marked)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_repeated_words(docs):
    assert repetition.repeated_words(docs, 4).tolist() == [plain_repeated(d, 4) for d in docs]


def test_colliding_runs(monkeypatch):
    rnd = random.Random(1)
    docs = [[rnd.choice("abc") for _ in range(40)] for _ in range(5)]
    monkeypatch.setattr(repetition, "_mix", lambda v: v * np.uint64(0))  # every run has one key
    assert repetition.repeated_words(docs, 4).tolist() == [plain_repeated(d, 4) for d in docs]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, host string, source string, n_words int, d string, i string")


def test_repetition_frame(spark):
    long = "one two three four five six seven eight nine ten eleven "
    rows = [(i, f"page {i} " + long, f"h{i % 3}", "s", 0, "", "") for i in range(12)] + [(100 + i, long * 40, "spam", "s", 0, "", "") for i in range(6)]
    rows += [(200, None, "h0", None, 0, "", ""), (201, "", None, None, 0, "", ""), (202, long * 3, None, None, 0, "", ""), (202, long * 3, None, None, 0, "", ""), (203, "x " * 400_000, "h1", None, 0, "", "")]
    got = {r.doc_id: r for r in repetition.repetition_report(documents(spark, rows)).collect()}
    assert len(got) == 22
    assert {d for d, r in got.items() if r.repetitive} == {*range(100, 106), 202, 203}
    assert got[203].n_repeated == 400_000 - 1 and abs(got[202].word_share - 22 / 33) < 1e-9
    assert got[100].host_verdict == "bad" and got[0].host_verdict == "fine" and got[202].host_verdict is None
    assert got[200].n_words == 0 and got[200].word_share == 0
    rates = {r.host: (r.rate, r.shrunk_rate) for r in repetition.host_rates(repetition.measure(documents(spark, rows))).collect()}
    assert rates["spam"][1] < rates["spam"][0] and rates["h2"][1] > rates["h2"][0] == 0
    assert repetition.repetition_report(documents(spark, [])).count() == 0


def test_hosts_beyond_broadcast(spark):
    rows = [(i, "word " * (30 * (i % 2)), f"h{i % 5}", "s", 0, "", "") for i in range(40)]
    key = lambda df: sorted((r.doc_id, r.host_verdict, r.host_rate) for r in df.collect())
    want = key(repetition.repetition_report(documents(spark, rows)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert key(repetition.repetition_report(documents(spark, rows))) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@given(st.text(alphabet=st.sampled_from(list("ab1 .\n\t\u2003é'")), max_size=80), st.integers(1, 9), st.integers(2, 5))
@settings(max_examples=400, deadline=None)
def test_tokens_of_long_texts(text, block, blanks):
    """Texts taken in parts have the tokens that they have as a whole."""
    whole = len(mixing.tokenizer(mixing.VOCABULARY).encode_ordinary(text)) if text else 0
    assert mixing.count_tokens(text, block=block, blanks=blanks) == whole


def test_tokens():
    assert mixing.count_tokens("hello world") == 2 and mixing.count_tokens(None) == 0
    assert mixing.count_tokens(" " * 100_000) == 100_000 and mixing.count_tokens("word " * 300_000) >= 300_000
    assert mixing.count_tokens("a" * 2_500_000) > 0


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 8), st.integers(0, 1000)), max_size=8), st.integers(0, 5000))
@settings(max_examples=300, deadline=None)
def test_fill(rows, budget):
    shares = mixing.fill([mixing.Share(str(i), *r) for i, r in enumerate(rows)], budget)
    total = sum(s.allocated for s in shares)
    assert all(s.allocated <= s.cap + 1e-6 for s in shares) and total <= budget + 1e-6
    free = [s for s in shares if s.allocated < s.cap - 1e-6 and s.target_share > 1e-9]
    if free:  # whoever has room gets the same multiple of its target, and the budget is used up
        level = [s.allocated / s.target_share for s in free]
        assert max(level) - min(level) <= 1e-6 * max(1, *level) and abs(total - budget) < 1e-3


def test_mixing_frame(spark):
    rows = [(i, "alpha beta gamma delta", "h", s, 0, "", "") for i, s in enumerate([" Web", "web", "WEB "] * 40 + ["wiki"] * 6 + ["other", None])] + [(999, None, "h", "wiki", 0, "", "")]
    targets = spark.createDataFrame([("web", 0.5, 1, 1), ("Wiki ", 0.4, 3, 1), ("none", 0.1, 5, 1), (None, 0.1, 5, 1), ("x", None, 5, 1)], "source string, target_share double, max_repeats int, doc_id int")
    mix = mixing.mix_sources(documents(spark, rows), targets)
    plan = {r.source: r for r in mix.plan().collect()}
    assert set(plan) == {"web", "wiki", "none"} and {s for s, r in plan.items() if r.short} == {"wiki", "none"}
    assert plan["wiki"].epochs == 3 and plan["none"].epochs == 0 and 0.9 < plan["web"].epochs <= 1
    sample = mix.sample().collect()
    assert sample == mix.sample().collect() and {r.copies for r in sample if r.source == "wiki"} == {3}
    report = {r.source: r for r in mix.report().collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["none"].n_docs == 0
    half = mixing.mix_sources(documents(spark, rows), targets, budget=100)
    assert 5 < sum(r.copies for r in half.sample().collect() if r.source == "web") < 60
    empty = mixing.mix_sources(documents(spark, []), targets)
    assert empty.plan().where("short").count() == 0 and empty.sample().count() == 0 and empty.report().count() == 3


PASSAGE = "Yesterday our Hulbra voyage joins 672 recipe beside another Fenjo museum. Our morning until Torzel connects some bakery near Torzel, but then Brahul checks the outside for three km before Torzel sleeps."


def found(spark, docs, items=((1, PASSAGE),), **how):
    items = spark.createDataFrame(list(items), "item_id bigint, passage string")
    return {(r.item_id, r.doc_id): r for r in leakage.find_leaks(documents(spark, [(i, t, "h", "s", 0, "", "") for i, t in docs]), items, **how).collect()}


def test_leaks(spark):
    other = PASSAGE.replace("Torzel", "Quator").replace("Hulbra", "Osmel").replace("Fenjo", "Lisfen").replace("Brahul", "Stawen").replace("three", "nine").replace("672", "31")
    mixed = other.replace("near Quator", "near Wenven")
    part = " ".join(PASSAGE.split()[3:18])
    docs = [(1, PASSAGE.upper()), (2, "x " + part + " y"), (3, " ".join(PASSAGE.split()[3:14])), (4, other), (5, mixed), (6, None), (7, ""), (8, "filler " * 300_000 + PASSAGE), (9, "Tor­zel")]
    got = found(spark, docs)
    kinds = {k[1]: r.kind for k, r in got.items()}
    assert kinds[1] == kinds[2] == kinds[8] == "verbatim" and kinds[4] == "reparameterised" and not {3, 6, 7, 9} & set(kinds)
    assert got[1, 1].longest == len(words(PASSAGE)) and got[1, 2].longest == len(words(part))
    assert got[1, 4].n_other > got[1, 5].n_other  # windows in which one name has two values don't count
    assert found(spark, []) == {} and found(spark, docs, [(1, None), (2, ""), (3, "too short")]) == {} and found(spark, docs, []) == {}


@pytest.mark.parametrize("block", [10**6, 1])
def test_names_at_sentence_starts(spark, block):
    passage = "Maria bought some apples near the harbour and then carried them slowly home. Later the baker gave Maria another basket of bread."
    items = [(1, passage), (2, "Maria sleeps. Only here does a sentence begin with this one word"), (3, "nobody knows whether later trains stop near a large bakery by night")]
    short = "Ulvano bought some apples near the harbour and then carried them slowly home"
    docs = [(1, passage.replace("Maria", "Peter")), (2, "so Peter bought some apples near the harbour and then carried them slowly home"), (3, short.replace("Ulvano", "Peter"))]
    got = found(spark, docs, items, block=block)
    assert {k: r.kind for k, r in got.items() if k[0] == 1} == {(1, 1): "verbatim", (1, 2): "verbatim", (1, 3): "verbatim"}
    assert got[1, 1].n_other == sum("maria" in words(passage)[i : i + 12] for i in range(11))
    only = "Ulvano bought some apples near the harbour and then carried them slowly"  # met only where a sentence begins
    assert {k: r.kind for k, r in found(spark, [(1, only.replace("Ulvano", "Peter"))], [(1, only), *items[1:]], block=block).items()} == {(1, 1): "reparameterised"}


NUMERALS = [
    ("the baker sold {} apples before noon and then walked {} streets to reach the old harbour", [("3", "950"), ("3.5", "1,200"), ("1/2", "½"), ("five", "12"), ("twenty-five", "one hundred and seven"), ("1\u202f200 000", "3 million"), ("a hundred", "2")]),
    ("el panadero vende {} manzanas antes del alba y luego camina {} calles hasta llegar al puerto", [("tres", "950"), ("treinta y cinco", "dieciséis"), ("ciento un", "2,5")]),
    ("le boulanger garde {} pommes avant midi et marche ensuite pendant {} rues vers le vieux port", [("trois", "950"), ("vingt et un", "quatre-vingt-dix"), ("mille", "1 200")]),
    ("wir sahen dort {} boote vor dem alten hafen und liefen danach noch {} gassen bis zum ufer", [("drei", "950"), ("fünfundzwanzig", "zweitausenddreihundertelf"), ("hundert und ein", "7")]),
]


def test_whole_numerals(spark):
    items = [(i, t.format(*values[0])) for i, (t, values) in enumerate(NUMERALS)]
    docs = [(100 * i + k, t.format(*v)) for i, (t, values) in enumerate(NUMERALS) for k, v in enumerate(values[1:])]
    got = found(spark, docs, items)
    assert {k for k, r in got.items() if r.n_other} == {(d // 100, d) for d, _ in docs}
    back = found(spark, items, docs)  # the other way round
    assert {k for k, r in back.items() if r.n_other and k[0] // 100 == k[1]} == {(d, d // 100) for d, _ in docs}
    t = NUMERALS[0][0]
    one = found(spark, [(1, t.format("4.5", "4.5")), (2, t.format("4", "5"))], [(1, t.format("three", "three"))])
    assert {k[1]: (r.kind, r.n_other) for k, r in one.items()} == {1: ("reparameterised", 6), 2: ("reparameterised", 2)}  # two windows hold one of the two numerals
    same = found(spark, [(1, t.format("3", "950")), (2, t.replace("{} ", ""))], items[:1])
    assert {k[1]: (r.kind, r.n_other) for k, r in same.items()} == {1: ("verbatim", 0), 2: ("verbatim", 0)}
    assert tokens("a 1.200,50 b3c ½ don't 4.") == ["a", "1.200,50", "b", "3", "c", "1/2", "don", "t", "4"]


def test_recall_of_other_parameters(spark):
    """Passages of all languages with other names and numbers, inside other text: nine in ten are found, none elsewhere."""
    rnd = random.Random(11)
    items = spark.read.parquet(f"{DATA}/eval_items.parquet").collect()
    plain = {w for i in items for w in (i.passage or "").split() if w.islower()}
    numbers = [["three", "seven", "nine", "eleven"], ["tres", "siete", "nueve", "once"], ["trois", "sept", "neuf", "onze"], ["drei", "sieben", "neun", "elf"]]
    docs, want, langs = [], set(), {}
    for item in items:
        new, out, changed = {}, [], 0
        for k, word in enumerate((item.passage or "").split()):
            bare = word.strip(".,;:!?()")
            other = bare
            if bare.isdigit():
                other = new.setdefault(bare, str(int(bare) + 17))
            elif any(bare.lower() in n for n in numbers):
                n = next(n for n in numbers if bare.lower() in n)
                other = new.setdefault(bare, n[(n.index(bare.lower()) + 1) % len(n)])
            elif k and bare[:1].isupper() and bare.lower() not in plain and bare.isalpha():
                other = new.setdefault(bare, "".join(rnd.choices("bdfglmnprstv", k=1)).upper() + "".join(rnd.choices("aeioulnr", k=6)))
            changed += other != bare
            out.append(word.replace(bare, other) if bare else word)
        if changed:
            filler = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(30))
            docs.append((item.item_id, f"{filler}. {' '.join(out)} {filler}"))
            want.add(item.item_id)
            langs[item.item_id] = item.lang
    got = found(spark, docs, [(i.item_id, i.passage) for i in items])
    hit = {d for (i, d) in got if i == d}
    assert len(want) > 100 and len({v for v in langs.values() if v}) >= 3
    for lang in set(langs.values()):
        own = {i for i in want if langs[i] == lang}
        assert len(own & hit) >= 0.9 * len(own), lang
    text = {i.item_id: i.passage for i in items}
    words_of = lambda i: set(words(text[i]))
    strange = [(i, d) for i, d in got if len(words_of(i) & words_of(d)) < 8]
    assert not strange


def test_lists_of_slots(spark):
    names = ["Torzel", "Brahul", "Hulbra", "Fenjo", "Pelgar", "Urmolis"]
    kinds = ["apples", "pears", "plums", "figs", "nuts", "beans"]
    numbers = ["three", "five", "seven", "nine", "eleven", "thirteen"]
    table = lambda ns, vs, unit: " ".join(f"{n} {v} {unit} {k}" for n, v, k in zip(ns, vs, kinds))
    roster = " ".join(f"{a}{b}" for a in names for b in ("or", "an", "il"))
    items = [(1, table(names, numbers, "kg")), (2, roster)]
    others = ["Quator", "Osmel", "Lisfen", "Stawen", "Wenven", "Droick"]
    docs = [(1, table(others, range(20, 26), "pounds")), (2, table([*others[:3], others[2], *others[3:5]], range(20, 26), "pounds")), (3, roster.replace("l", "m"))]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1)} and got[1, 1].n_other == 13 and got[1, 1].kind == "reparameterised"  # three to four of twelve words are literal
    assert found(spark, [(1, table(others[:4], range(20, 24), "pounds"))], items) == {}  # four words are the same


@pytest.mark.parametrize("block", [10**6, 300])
def test_leaks_against_all_windows(spark, block):
    rnd = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "Delta", "km", "seven", "tree", "house"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 40)))) for i in range(8)] + [(50, "alpha " * 30), (51, "alpha " * 30), (0, "alpha " * 14)]
    docs = []
    for i in range(60):
        words_ = rnd.choices(vocabulary, k=30)
        if i % 3 == 0:
            source = rnd.choice(items)[1].split()
            at = rnd.randint(0, max(0, len(source) - 12))
            words_[10:10] = source[at : at + rnd.choice([11, 12, 20])]
        docs.append((i, ", ".join(words_)))
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    want = {(i, d) for i, p in items for d, t in docs if grams(p) & grams(t)}
    assert {k for k, r in found(spark, docs, items, block=block).items() if r.kind == "verbatim"} == want and want


COLUMNS = {"p7_found": ["item_id", "doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() == df.distinct().count()


def test_found_on_tables(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    items = spark.read.parquet(f"{DATA}/eval_items.parquet").collect()
    grams = {i.item_id: {tuple(w[k : k + 12]) for w in [words(i.passage)] for k in range(len(w) - 11)} for i in items}
    held = {d: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for d, w in docs.items()}
    want = {(i, d) for i, g in grams.items() for d, h in held.items() if g & h}
    assert {tuple(r) for r in queries.p7_found(spark, DATA).collect()} == want
    want = {d for d, w in docs.items() if w and plain_repeated(w, 10) / len(w) >= 0.3}
    assert {r.doc_id for r in queries.p9_found(spark, DATA).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
