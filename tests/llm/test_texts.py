"""Tokenizer, answers, reading levels, samples and mixes."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.text import plain, source_key
from quern.llm import answers, mixing, reading, sampling, tokenizer

JSON = "/opt/tokenizers/byte_bpe_50k.json"
needs_vocab = pytest.mark.skipif(not os.path.exists(tokenizer.VOCAB), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    return tokenizer.ByteBpe(open(tokenizer.VOCAB, "rb").read())


@needs_vocab
@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("ab '\n\t  .,sS \u0085 é1٣🇳體")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoding_equals_the_public_one(text):
    from tokenizers import Tokenizer

    t = test_encoding_equals_the_public_one.__dict__.setdefault("t", Tokenizer.from_file(JSON))
    t.encode_special_tokens = True
    b = test_encoding_equals_the_public_one.__dict__.setdefault("b", tokenizer.ByteBpe(open(tokenizer.VOCAB, "rb").read()))
    ids = b.encode(text)
    assert ids == t.encode(text, add_special_tokens=False).ids and b.decode(ids) == text


@needs_vocab
def test_token_columns(spark, bpe):
    rows = [(1, "Hello  world <|endoftext|>"), (2, ""), (3, None), (4, "x" * 5000), (4, "x" * 5000), (5, " "), (6, "a \n b")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("ids", F.lit("clash"))
    got = sorted((r["k"], r["ids"]) for r in tokenizer.token_ids(df, "k", "t").collect())
    assert got == sorted((k, bpe.plain(t or "")) for k, t in rows)
    assert tokenizer.round_trip(df, "k", "t").where("not same").count() == 0
    assert {r["k"]: r["n_tokens"] for r in tokenizer.token_counts(df.select("k", "t"), "t").collect()} == {k: len(i) for k, i in got}
    assert tokenizer.token_ids(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("GP (urgent)", "GP"), ("**ED**", "ED"), ("E.D.", "ED"), ("A&E", "ED"), ("Go to ED now", "ED"), ("needed", "UNKNOWN"), ("self-care", "HOME"), ("Home - rest", "HOME"), ("N/A", "UNKNOWN"), (None, "UNKNOWN"), ("?", "UNKNOWN"),
        ("undecided", "UNKNOWN"), ("not determined", "UNKNOWN"), ("Exception: bad response", "ERROR"), ("ERR", "ERROR"), ("generation failed", "ERROR"), ("G.P.", "GP"), ("family doctor", "GP"), ("{HOME}", "HOME"), ("UNKN", "UNKNOWN"),
    ],
)
def test_categories(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(sampling.triage_category(F.col("c"))).first()[0] == want


def test_swap_repair_never_breaks_floors_or_stock():
    got = sampling.swap_repair(100, {"a": 50, "b": 40, "c": 10}, {"a": 5, "b": 5, "c": 5}, {"a": 1000, "b": 12, "c": 300})
    assert sum(got.values()) == 100 and got["b"] == 12 and all(got[x] >= 5 for x in "abc")
    exact = sampling.swap_repair(100, {"a": 50, "b": 40, "c": 10}, {}, dict.fromkeys("abc", 1000))
    assert exact == {"a": 50, "b": 40, "c": 10}
    assert sampling.swap_repair(10, {"a": 5, "b": 5}, {}, {"a": 2, "b": 1}) == {"a": 2, "b": 1}
    assert sampling.swap_repair(4, {"a": 1, "b": 3}, {"a": 9, "b": 9}, {"a": 9, "b": 9})["a"] + 0 <= 4


def test_sample(spark):
    df = spark.createDataFrame([(i, "ED" if i < 30 else "GP" if i < 900 else None) for i in range(1000)], "k int, d string")
    targets = spark.createDataFrame([("p", "ED", 0.2, 0.05, 0.5), ("p", "GP", 0.6, 0.05, 0.5), ("p", "UNKNOWN", 0.2, 0.05, 0.5), ("p", "ERROR", 0.0, 0.01, 0.5), ("q", "GP", 1.0, 0.0, 0.1)], "plan string, category string, target_share double, min_share double, sample_share double")
    cat = sampling.triage_category(F.col("d"))
    sample, report = sampling.proportional_sample(df, "k", cat, targets)
    want = {(r["plan"], r["category"]): r["taken"] for r in report.collect()}
    got = {(r["plan"], r["category"]): r["count"] for r in sample.groupBy("plan", "category").count().collect()}
    assert got == {k: v for k, v in want.items() if v} and want["p", "ED"] == 30 and sum(v for (p, _), v in want.items() if p == "p") == 500 and want["q", "GP"] == 100
    assert sample.select("plan", "k").distinct().count() == sample.count()
    short = {(r["plan"], r["category"]) for r in sampling.availability(df, cat, targets).where("falls_short").collect()}
    assert short == {("p", "ED"), ("p", "ERROR")}
    assert sampling.proportional_sample(df.limit(0), "k", cat, targets)[0].count() == 0


def test_exactly_enough_is_enough(spark):
    df = spark.createDataFrame([(i, "ED") for i in range(400)] + [(i, "GP") for i in range(19600)], "k int, d string")
    t = spark.createDataFrame([("p", "ED", 0.2, 0.05, 0.1)], "plan string, category string, target_share double, min_share double, sample_share double")
    assert sampling.availability(df, sampling.triage_category(F.col("d")), t).where("falls_short").count() == 0


def test_sainte_lague():
    assert mixing.apportion(7, {"a": 53, "b": 24, "c": 23}, dict.fromkeys("abc", 99)) == {"a": 3, "b": 2, "c": 2}
    assert mixing.apportion(10, {"a": 1, "b": 1}, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert mixing.apportion(5, {"a": 1}, {"a": 0}) == {"a": 0}


def test_found_rows_come_from_the_operators(monkeypatch, spark, small):
    from quern.llm import queries

    assert queries.p5_found(spark, small).count() and queries.p7_found(spark, small).count()
    monkeypatch.setattr(sampling, "swap_repair", lambda size, wanted, *_: dict(wanted))
    monkeypatch.setattr(mixing, "apportion", lambda blocks, weights, caps: dict.fromkeys(weights, 1))
    assert not queries.p5_found(spark, small).count() and not queries.p7_found(spark, small).count()


def test_quotas_and_what_is_left_over():
    rows = [{"mix": "m", "source": s, "source_key": s, "weight": w, "asked": 1000 * w, "capacity": c, "max_repeats": 2} for s, w, c in (("a", 0.5, 9000), ("b", 0.3, 150), ("c", 0.2, 9000))]
    q = {x["source"]: x for x in mixing.block_quotas(rows, 100)}
    assert [q[s]["quota"] for s in "abc"] == [50, 30, 20] and [q[s]["falls_short"] for s in "abc"] == [False, True, False]
    assert q["b"]["blocks"] == 15 and sum(x["blocks"] for x in q.values()) == 100 and abs(q["a"]["blocks"] - 61) <= 1
    assert mixing.shard_counts([{"source_key": "a", "docs": 10_000_000}, {"source_key": "b", "docs": 3}]) == {"a": 4096, "b": 1}


def test_lists_are_prose_and_code_is_none():
    r = reading.Reader()
    items = "\n".join(["* Wash your hands with soap", "* Sit down and rest your leg", "* The bus to the clinic is at ten", "* Drink lots of water at home"] * 4)
    assert r.read(items)[2] and r.read("Home > Topics\n\n" + items)[2] and r.read(items.replace("* ", "# "))[2]
    assert not r.read("x = {a[i] * b[j] for i in c} # {d} = [e] * f\n" * 10)[2]


def test_mix(spark):
    rows = [(i, ["A one", "a-one", "A_ONE"][i % 3], 10) for i in range(2000)] + [(3000 + i, "b", 10) for i in range(20)] + [(4000, None, 50), (4001, "b", 0)]
    df = spark.createDataFrame(rows, "k int, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a one", 0.5, 1, 0.1), ("m", "b", 0.5, 3, 0.1), ("m", "none", 0.0, 1, 0.1)], "mix string, source string, weight double, max_repeats int, size_share double")
    chosen, report = mixing.mixed(df, "k", source_key(F.col("source")), targets, source_key(F.col("source")))
    r = {x["source"]: x for x in report.collect()}
    assert r["b"]["falls_short"] and r["b"]["taken"] == 600 and not r["a one"]["falls_short"]
    assert abs(r["a one"]["taken"] + 600 - 2 * r["a one"]["asked"]) <= 20  # what "b" leaves goes to the other source
    assert chosen.where("source_key = 'b' and repeats <> 3").count() == 0 and chosen.where("k in (4000, 4001)").count() == 0
    again = mixing.mixed(df, "k", source_key(F.col("source")), targets, source_key(F.col("source")))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))


def test_defects(spark, small):
    docs = spark.createDataFrame(
        [("The patient has a sore throat and should rest at home with water and sleep " * 3, "en")] * 5 + [("El paciente tiene dolor de garganta y debe descansar en casa con agua y dormir " * 3, "es")] * 5 + [(None, None), ("x", "und")], "text string, lang string"
    )
    q = "How long has the sore throat been there and does water help with sleep?"
    good = "It has been there for two days and water does help."
    rows = [(i, "I have a sore throat and should rest at home.", q, good, "The patient should rest at home and sleep.") for i in range(20)]
    rows += [
        (100, "I have a sore throat and should rest at home.", None, "[blank]", "The patient should rest at home and"),
        (101, "I have a sore throat and should rest at home.", q, "How long has the sore throat been there? And does water help with sleep", "I'm sorry, I cannot provide medical advice."),
        (102, "I have a sore throat and should rest at home.", q, "It has been there for two days and water does", "El paciente debe descansar en casa con agua y dormir."),
        (103, None, q, "It has been there for two days and water does help", "The patient should rest at home and sle"),
        (104, "I have a sore throat and should rest at home.", q, "Not really", "The patient should rest at home…"),
        (105, "Tengo dolor de garganta y debe descansar en casa con agua.", "¿El paciente debe dormir en casa?", "No.", "El paciente debe descansar en casa con agua y dormir."),
    ]
    df = spark.createDataFrame(rows, "k int, patient_query string, clarifying_question string, patient_response string, reasoning_decision string")
    got = {(r["k"], r["field"]): r["defect"] for r in answers.defects(df, "k", docs).collect()}
    assert got == {
        (100, "clarifying_question"): "empty",
        (100, "patient_response"): "empty",
        (100, "reasoning_decision"): "truncated",
        (101, "patient_response"): "copy",
        (101, "reasoning_decision"): "refusal",
        (102, "patient_response"): "truncated",
        (102, "reasoning_decision"): "language",
        (103, "reasoning_decision"): "truncated",
        (104, "reasoning_decision"): "truncated",
    }
    assert answers.defects(df.limit(0), "k", docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("can't sleep, sorry", False), ("Sorry, I'm not able to see it from here; can you say more?", False), ("As an AI model, I must decline.", True), ("i cant answer that, sorry", True), ("The patient cannot manage stairs.", False), ("Request declined: outside my scope.", True), ("Regrettably, I don't feel comfortable responding to this.", True), ("No can do. Such questions are off limits for this assistant.", True), ("It is not possible for me to give a diagnosis.", True), ("I don't feel comfortable lying down.", False)])
def test_refusals(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(answers.refuses(plain(F.col("c")))).first()[0] is want


EASY = "The cat sat on the mat. The dog ran to the hill. Mum put ice on it. You can play in the sun. We had milk and a nap. " * 3
HARD = "Contemporary immunohistochemical characterisation of heterogeneous pathophysiological manifestations necessitates multidisciplinary interpretation, notwithstanding considerable methodological limitations of retrospective investigations. " * 4
MID = "You should see your doctor if the symptoms last longer than a week or keep coming back after you have finished the medicine. The nurse will check your blood pressure and ask about other medicines before the appointment begins. " * 4


def test_reading_levels(spark):
    rows = [(i, EASY) for i in range(40)] + [(100 + i, HARD) for i in range(40)] + [(200 + i, MID) for i in range(40)]
    rows += [(900, None), (901, ""), (902, "Too short."), (903, "x = {1: [2, 3]}; " * 40), (904, "El paciente debe descansar en casa con agua y dormir mucho por la noche. " * 8)]
    levels = reading.reading_levels(spark.createDataFrame(rows, "k int, t string").withColumn("grade", F.lit("clash")), "k", "t")
    got = {r["k"]: r for r in levels.collect()}
    assert len(got) == len(rows) and got[900]["level"] is None and got[901]["grade"] is None
    assert got[0]["level"] < got[200]["level"] < got[100]["level"]
    bands = {r["k"]: r["band"] for r in reading.bands(levels, "k").collect()}
    assert bands == {i: "easy" for i in range(40)} | {100 + i: "hard" for i in range(40)}
    assert reading.reading_levels(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


def test_held_out_levels_follow_grades(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    levels = reading.reading_levels(d).where("prose and n_words >= 40")
    assert levels.agg(F.corr("level", "grade")).first()[0] > 0.8


def test_syllables():
    assert [reading.syllables(w) for w in ("cat", "table", "make", "syllable", "the", "hypersensitivity")] == [1, 2, 1, 3, 1, 7]


@pytest.mark.parametrize("text", ["I'm sorry, I couldn't help with that.", "No answer was produced.", "As an A.I., I would leave this.", "I couldn't comment.", "As a chatbot I leave this.", "That violates the terms.", "This is out of bounds for me."])
def test_every_refusal_has_a_mark(spark, text):
    assert spark.createDataFrame([(text,)], "c string").select(answers.refuses(plain(F.col("c")))).first()[0] is True


def test_alternatives_of_refusals_have_marks():
    import itertools
    import re._parser as parser

    def texts(p):
        """Texts that the pattern matches: every branch of it, optional parts left out and put in, classes as one member."""
        parts = []
        for op, arg in p:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(arg)])
            elif op == "IN":
                parts.append([chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])])
            elif op == "BRANCH":
                parts.append([t for b in arg[1] for t in texts(b)])
            elif op == "SUBPATTERN":
                parts.append(texts(arg[3]))
            elif op == "MAX_REPEAT":
                parts.append(["", *texts(arg[2])] if arg[0] == 0 else texts(arg[2]))
            else:
                assert op == "AT", op
        return ["".join(x) for x in itertools.product(*parts)]

    for p in answers.REFUSALS:
        for t in texts(parser.parse(p)):
            assert any(m in f"{t} " or m in f" {t} " for m in answers.REFUSAL_MARKS), t


def test_repeated_question_is_a_copy(spark):
    q = "how long has the pain been there"
    rows = [(" ".join([q] * 5), q), (q, " ".join([q] * 5)), ("since monday " * 20, q)]
    got = spark.createDataFrame(rows, "a string, q string").select(answers.copies(plain(F.col("a")), plain(F.col("q")))).collect()
    assert [r[0] for r in got] == [True, True, False]
