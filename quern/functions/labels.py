"""Label extraction dialects as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def triage_legacy(c: Column) -> Column:
    """Explicit decision first, then bare key words, then heuristics; else UNKNOWN. Bare ``ED`` matches inside words.

    Null gives UNKNOWN.
    """
    u = F.upper(F.coalesce(c, F.lit("")))
    said = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)Triage\s+decision:\s*(ED|GP|HOME)", 1))
    return (
        F.when(said != "", said)
        .when(u.rlike("ED|EMERGENCY"), "ED")
        .when(u.rlike("HOME|SELF-CARE"), "HOME")
        .when(u.rlike("GP|GENERAL PRACTITIONER"), "GP")
        .when(u.rlike("URGENT|SEVERE|IMMEDIATE|CHEST PAIN"), "ED")
        .when(u.rlike("MILD|REST|MONITOR|OTC"), "HOME")
        .otherwise("UNKNOWN")
    )


def triage_strict(c: Column) -> Column:
    """As :func:`triage_legacy`, with whole words only."""
    u = F.upper(F.coalesce(c, F.lit("")))
    said = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)Triage\s+decision:\s*(ED|GP|HOME)\b", 1))
    return (
        F.when(said != "", said)
        .when(u.rlike(r"\b(ED|EMERGENCY)\b"), "ED")
        .when(u.rlike(r"\b(HOME|SELF-CARE)\b"), "HOME")
        .when(u.rlike(r"\b(GP|GENERAL PRACTITIONER)\b"), "GP")
        .when(u.rlike(r"\b(URGENT|SEVERE|IMMEDIATE|CHEST PAIN)\b"), "ED")
        .when(u.rlike(r"\b(MILD|REST|MONITOR|OTC)\b"), "HOME")
        .otherwise("UNKNOWN")
    )


def triage_normalised(c: Column) -> Column:
    """Label normaliser: emergency, then practice, then home; anything else keeps its upper-case text."""
    u = F.upper(F.trim(c))
    return (
        F.when(u.contains("ED") | u.contains("EMERGENCY"), "ED")
        .when(u.contains("GP") | u.contains("DOCTOR"), "GP")
        .when(u.contains("HOME"), "HOME")
        .otherwise(u)
    )
