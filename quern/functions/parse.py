"""Reading structure out of names, generated responses and logs; Column expressions only, null in gives null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings and openings of document names, and native terms that follow an English name.
NAME_ENDINGS = ["_diagnosis_treatment", "_treatment", "_diagnosis", "_(overview)", "_overview"]
NAME_OPENINGS = ["Overview-", "Symptoms-"]
NATIVE_TERMS = [r"\s+mate\s+\w+(\s+\w+)*$", r"\s+aroreretini(\s+ki\s+ngā\s+pakeke)?$", r"\s+pokenga\s+\w+(\s+\w+)*$", r"\s+anipā\s+o\s+te\s+huringa\s+āhuarangi$"]
#: Kinds of chunking in the order in which names are searched, and their usual sizes.
METHODS = ["contextual", "sentence", "fixed", "paragraph", "structured_agent", "agent"]
METHOD_SIZES = {"contextual": 1024, "sentence": 512, "fixed": 512, "paragraph": 768}
SPECIAL_TOKENS = r"<\|[^|<>]{1,40}\|>|</?s>|\[/?INST\]"


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, all others in lower case (also after hyphens and apostrophes)."""
    marks = F.regexp_replace(F.lower(c), r"(\p{L}+)", "\u0001$1\u0001")
    return F.array_join(F.transform(F.split(marks, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def condition_of_file(c: Column) -> Column:
    """Condition that a file name stands for: one known ending and opening removed, ``What_is_X-Y`` read as Y, closing brackets dropped, title case."""
    ends = "|".join(re.escape(e) for e in NAME_ENDINGS)
    n = F.regexp_replace(c, f"({ends})$", "")
    n = F.when(n.startswith("What_is_") & (F.size(F.split(n, "-")) == 2), F.element_at(F.split(n, "-"), -1)).otherwise(n)
    for o in NAME_OPENINGS:
        n = F.when(n.startswith(o), F.substring(n, F.lit(len(o) + 1), F.length(n))).otherwise(n)
    n = F.regexp_replace(F.regexp_replace(n, "_", " "), r"\s*\([^)]*\)\s*$", "")
    return title_case(F.trim(F.regexp_replace(n, r"\s+", " ")))


def without_native_terms(c: Column) -> Column:
    """An English name without the native terms after it, blanks squeezed."""
    for p in NATIVE_TERMS:
        c = F.regexp_replace(c, f"(?iU){p}", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def section(c: Column, name: str) -> Column:
    """Text under the header ``name:`` or ``name (CoT):`` at the start of a line, up to the next header; null if missing or empty."""
    head = rf"(?is)(?:^|\n)\s*{re.escape(name)}"
    rest = r"\s*:\s*(.*?)(?=\n\s*[A-Za-z][^:\n]*:|$)"
    return F.coalesce(*(_filled(F.trim(F.regexp_replace(F.regexp_extract(c, head + tag + rest, 1), r"^\s+|\s+$", ""))) for tag in (r"\s*\(CoT\)", "")))


def captured(c: Column, label: str) -> Column:
    """Text after ``label:`` up to the next known label; UNKNOWN if there is none."""
    t = F.regexp_extract(c, rf"(?is){re.escape(label)}:\s*(.*?)(?=Reasoning:|Next Step:|Triage Decision:|$)", 1)
    return F.coalesce(_filled(F.trim(t)), F.lit("UNKNOWN"))


def triage_exact(c: Column) -> Column:
    """The word after ``Triage Decision:`` if it is one of the three labels, else UNKNOWN; special tokens are removed first."""
    said = F.upper(F.regexp_extract(F.regexp_replace(c, SPECIAL_TOKENS, ""), r"(?i)Triage Decision:\s*([A-Z]+)", 1))
    return F.when(said.isin("ED", "GP", "HOME"), said).otherwise("UNKNOWN")


def triage_spaced(c: Column) -> Column:
    """Explicit decision, else key words in the order emergency, practice, home; ``ed`` counts between blanks only."""
    t = F.lower(F.trim(c))
    out = None
    for label in ("ed", "gp", "home"):
        hit = t.contains(f"triage decision: {label}") | t.contains(f"triage decision:{label}")
        out = F.when(hit, label.upper()) if out is None else out.when(hit, label.upper())
    out = out.when(t.contains("emergency") | t.contains(" ed "), "ED").when(t.contains("gp") | t.contains("doctor"), "GP")
    return out.when(t.contains("home") | t.contains("rest"), "HOME").otherwise("UNKNOWN")


def score_of(c: Column, label: str, default: float = 50.0) -> Column:
    """Number before ``/100`` after ``label:``, or ``default``."""
    return F.coalesce(_filled(F.regexp_extract(c, rf"{re.escape(label)}:\s*(\d+(?:\.\d+)?)/100", 1)).try_cast("double"), F.lit(default))


#: Labels and marks of next steps and of reasoning, and where a labelled text ends. Letters of any case end a next step.
STEP_LABELS, STEP_MARKS, STEP_END = ["Next steps?", "Recommendation", "Action"], ["recommend", "should", "need", "book", "see", "go"], r"(?:\n\n|\n[A-Z]|$)"
REASON_LABELS, REASON_MARKS, REASON_END = ["Reasoning", "Rationale", "Explanation"], ["because", "since", "due to", "given", "considering"], r"(?:\n\n|\nNext|$)"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def advice(c: Column, labels: list[str], marks: list[str], end: str, every: bool = False) -> Column:
    """Text after the first of ``labels`` up to ``end``; else the first line (or all, if ``every``) with one of ``marks``; else the first 200 characters.

    Case does not count anywhere. A line that is blank once stripped counts as no line.
    """
    named = [_filled(_stripped(F.regexp_extract(c, rf"(?is){p}:\s*(.+?){end}", 1))) for p in labels]
    lines = F.filter(F.split(c, "\n"), lambda s: F.lower(s).rlike("|".join(marks)))
    trimmed = F.transform(lines, _stripped)
    fallback = F.array_join(trimmed, " ") if every else F.get(trimmed, F.lit(0))
    return F.coalesce(*named, _filled(fallback), F.left(c, F.lit(200)))


def next_step(c: Column) -> Column:
    return advice(c, STEP_LABELS, STEP_MARKS, STEP_END)


def reasoning(c: Column) -> Column:
    return advice(c, REASON_LABELS, REASON_MARKS, REASON_END, every=True)


def rationale(c: Column, label: str, default: str = "Could not parse evaluation response") -> Column:
    """Text after ``<first word> Rationale:`` (or with the second word of ``label`` between) up to a blank line or ``**``."""
    first, second = (*label.split(), "")[:2]
    found = F.regexp_extract(c, rf"(?s){re.escape(first)} (?:{re.escape(second)} )?Rationale:\s*(.+?)(?:\n\n|\*\*|$)", 1)
    return F.coalesce(_filled(_stripped(found)), F.lit(default))


def overall_score(steps: Column, reasons: Column) -> Column:
    """Six tenths of the score of the next steps and four of that of the reasoning."""
    return 0.6 * steps + 0.4 * reasons


def numbers(c: Column) -> Column:
    """Distinct whole numbers of a reply in order; ``NONE`` gives an empty list."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d{1,9}"), 0), lambda x: x.cast("int"))
    return F.when(F.upper(F.trim(c)) == "NONE", F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(found)))


def logged(c: Column, measure: str) -> Column:
    """Last value of ``measure:`` in a training log."""
    all_ = F.regexp_extract_all(c, F.lit(rf"{re.escape(measure)}:\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), 1)
    return F.get(all_, F.size(all_) - 1).try_cast("double")


def training_metrics(c: Column) -> Column:
    """Last ``train``, ``val`` and ``test`` loss and test ``accuracy`` (or ``acc``) of a training log; null where missing."""
    accuracy = F.coalesce(logged(c, "Test accuracy"), logged(c, "Test acc"))
    return F.struct(logged(c, "Train loss").alias("train"), logged(c, "Val loss").alias("val"), logged(c, "Test loss").alias("test"), accuracy.alias("accuracy"))


def method_parts(c: Column) -> Column:
    """The other dialect of method names: ``kind`` (fixed, sentence, paragraph, contextual, unknown), ``size`` by the kind's own letter, ``overlap``; sizes and overlaps that are missing are 0, of contextual names 1024."""
    has = lambda x: c.contains(x)
    number = lambda p: F.coalesce(_filled(F.regexp_extract(c, p, 1)).try_cast("int"), F.lit(0))
    kind = F.when(has("fixed"), "fixed").when(has("sentence"), "sentence").when(has("paragraph"), "paragraph").when(has("contextual"), "contextual").otherwise("unknown")
    contextual = F.coalesce(_filled(F.regexp_extract(c, r"c(\d+)", 1)).try_cast("int"), F.lit(1024))
    size = F.when(has("fixed_c"), number(r"c(\d+)")).when(has("sentence_t"), number(r"t(\d+)")).when(has("paragraph_m"), number(r"m(\d+)")).when(has("contextual"), contextual).otherwise(0)
    return F.struct(kind.alias("kind"), size.alias("size"), F.when(has("_o"), number(r"o(\d+)")).otherwise(0).alias("overlap"))


def short_name(c: Column, shorter: dict[str, str]) -> Column:
    """A display name: each key of ``shorter`` replaced by its value, in order."""
    for long, short in shorter.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def method_type(c: Column) -> Column:
    """Kind of chunking a method name stands for; the first of the fixed order that occurs."""
    out = None
    for m in METHODS:
        hit = F.lower(c).contains(m)
        out = F.when(hit, m) if out is None else out.when(hit, m)
    return out.otherwise("other")


def method_size(c: Column) -> Column:
    """Size in a method name (``c512``, ``t384``), else the usual one of its kind."""
    kind = F.create_map(*(F.lit(x) for kv in METHOD_SIZES.items() for x in kv))[method_type(c)]
    return F.coalesce(_filled(F.regexp_extract(F.lower(c), r"[ct](\d+)", 1)).try_cast("int"), kind, F.lit(512))


def method_overlap(c: Column) -> Column:
    """Overlap in a method name (``o100``), else 0."""
    return F.coalesce(_filled(F.regexp_extract(F.lower(c), r"_o(\d+)", 1)).try_cast("int"), F.lit(0))


def model_parts(c: Column) -> Column:
    """``family``, ``size`` and ``quantization`` of a model name such as ``fam-135M_4bit``."""
    parts = F.split(c, "-")
    return F.struct(F.get(parts, F.lit(0)).alias("family"), F.regexp_extract(F.get(parts, F.lit(1)), r"^[^_]+", 0).alias("size"), F.when(c.contains("4bit"), "4bit").otherwise("8bit").alias("quantization"))


def config_name(model: Column, tuned: Column, retrieval: Column) -> Column:
    """Model, ``_Tuned`` or ``_Base``, and the retrieval's name or ``NoRAG``."""
    return F.concat(model, F.when(tuned, "_Tuned").otherwise("_Base"), F.lit("_"), F.coalesce(retrieval, F.lit("NoRAG")))


def complete_dialogue(*sections: Column, label: Column, expected: Column) -> Column:
    """Whether all sections are filled and the label is the expected one; nulls make it false."""
    ok = F.coalesce(label == expected, F.lit(False))
    for s in sections:
        ok = ok & F.coalesce(F.length(F.trim(s)) > 0, F.lit(False))
    return ok
