import pytest
from pyspark.sql import functions as F

from quern.functions import parse


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "name, want",
    [("Heart_attack_diagnosis_treatment", "Heart Attack"), ("What_is_it-crohn's_disease", "Crohn'S Disease"), ("What_is_a-b-c", "What Is A-B-C"), ("Overview-Gout_(acute)", "Gout"), ("Symptoms-ear__pain_overview", "Ear Pain"), ("", ""), (None, None)],
)
def test_condition_of_file(spark, name, want):
    assert one(spark, name, parse.condition_of_file) == want


def test_names(spark):
    assert one(spark, "Heart disease mate manawa", parse.without_native_terms) == "Heart disease"
    assert one(spark, "tree_structured_agent", parse.method_type) == "structured_agent" and one(spark, "x", parse.method_type) == "other"
    assert [one(spark, m, parse.method_size) for m in ("fixed_c256_o0", "contextual", "paragraph_m50", "agent")] == [256, 1024, 768, 512]
    assert one(spark, "fixed_c512_o100", parse.method_overlap) == 100
    assert tuple(one(spark, "fam-135M_4bit", parse.model_parts)) == ("fam", "135M", "4bit")
    assert one(spark, "m", lambda c: parse.config_name(c, F.lit(True), F.lit(None).cast("string"))) == "m_Tuned_NoRAG"


REPLY = "Patient Query: my ear\nhurts\nReasoning for Triage Decision (CoT): it is mild\nNext Step for Patient:\n"


def test_sections(spark):
    assert one(spark, REPLY, lambda c: parse.section(c, "patient query")) == "my ear\nhurts"
    assert one(spark, REPLY, lambda c: parse.section(c, "Reasoning for Triage Decision")) == "it is mild"
    assert one(spark, REPLY, lambda c: parse.section(c, "Next Step for Patient")) is None and one(spark, None, lambda c: parse.section(c, "x")) is None
    assert one(spark, "Next Step: rest Reasoning: mild", lambda c: parse.captured(c, "next step")) == "rest" and one(spark, "none", lambda c: parse.captured(c, "x")) == "UNKNOWN"


def test_labels_and_scores(spark):
    assert [one(spark, t, parse.triage_exact) for t in ("<|end|>Triage decision: ed", "triage decision: maybe", "ED")] == ["ED", "UNKNOWN", "UNKNOWN"]
    assert [one(spark, t, parse.triage_spaced) for t in ("needed a doctor", "go to ed now", "triage decision:home and ed ", "zzz")] == ["GP", "ED", "HOME", "UNKNOWN"]
    assert one(spark, "Quality Score: 87.5/100", lambda c: parse.score_of(c, "Quality Score")) == 87.5 and one(spark, "no", lambda c: parse.score_of(c, "Quality Score")) == 50.0
    assert one(spark, "Recommendation: see a nurse\n\nmore", parse.next_step) == "see a nurse" and one(spark, "hm\n you should rest \nbook", parse.next_step) == "you should rest" and one(spark, "x" * 300, parse.next_step) == "x" * 200
    assert one(spark, "a\nbecause of b\nsince c", parse.reasoning) == "because of b since c"


STEPS = "Next steps: rest\nand drink\nReasoning: it is mild\nand will pass\nNext steps follow"


def test_where_labelled_texts_end(spark):
    assert one(spark, STEPS, parse.next_step) == "rest"  # a letter of any case on a new line ends a step
    assert one(spark, STEPS, parse.reasoning) == "it is mild\nand will pass"  # reasoning only ends at the next steps
    assert one(spark, "next steps: call\n2 times", parse.next_step) == "call\n2 times" and one(spark, None, parse.next_step) is None
    assert one(spark, "Quality Score: 80/100\nQuality Score Rationale: sound\nand safe\n\nmore", lambda c: parse.rationale(c, "Quality Score")) == "sound\nand safe"
    assert one(spark, "none", lambda c: parse.rationale(c, "Quality Score")) == "Could not parse evaluation response"


def test_other_dialects(spark):
    parts = lambda m: tuple(one(spark, m, parse.method_parts))
    assert [parts(m) for m in ("fixed_c512_o100", "sentence_t384_o2", "paragraph_m25", "contextual_sentence", "agent")] == [("fixed", 512, 100), ("sentence", 384, 2), ("paragraph", 25, 0), ("sentence", 1024, 0), ("unknown", 0, 0)]
    assert tuple(one(spark, "Train loss: 2\nTrain loss: 1\nVal loss: .5\nTest acc: 0.75", parse.training_metrics)) == (1.0, None, None, 0.75)
    assert one(spark, "high_capacity_safe", lambda c: parse.short_name(c, {"high_capacity": "HC", "_": " "})) == "HC safe"


def test_lists_and_logs(spark):
    assert one(spark, "3, 1 and 3", parse.numbers) == [1, 3] and one(spark, " none ", parse.numbers) == [] and one(spark, "", parse.numbers) == []
    assert one(spark, "Train loss: 2.5\nTrain loss: 1.25e-1", lambda c: parse.logged(c, "Train loss")) == 0.125 and one(spark, "x", lambda c: parse.logged(c, "Val loss")) is None
    assert one(spark, " a ", lambda c: parse.complete_dialogue(c, label=F.lit("ED"), expected=F.lit("ED"))) and not one(spark, None, lambda c: parse.complete_dialogue(c, label=F.lit("ED"), expected=F.lit("ED")))
