"""Ordered classifications as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories of change types, the severity weights, and file languages by ending.
CATEGORIES = (
    ("Removals", ("removed",), ("event_removed",)),
    ("Modernization", ("deprecated", "renamed", "to_attribute", "rewrite"), ()),
    ("Signatures", ("signature", "parameter", "return_type"), ("inheritance_impact",)),
    ("Frontend", ("css", "library", "sdc", "twig"), ()),
)
SEVERITY_WEIGHTS = {"breaking": 10, "warning": 3, "deprecation": 3}
LANGUAGES = (
    ("libraries", (".libraries.yml",)),
    ("twig", (".twig",)),
    ("php", (".php", ".module", ".inc", ".install", ".profile", ".theme", ".engine")),
    ("yaml", (".yml", ".yaml")),
    ("javascript", (".js", ".mjs")),
    ("css", (".css",)),
)


def category(change_type: Column) -> Column:
    """The category of a change type; the first one that fits wins, null counts as Other."""
    out = None
    for name, parts, whole in CATEGORIES:
        fits = change_type.isin(*whole) if whole else F.lit(False)
        for part in parts:
            fits = fits | change_type.contains(part)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("Other")


def severity_score(severity: Column, n: Column | None = None) -> Column:
    """``n`` matches of a severity weighted by how urgent it is."""
    out = F.lit(1)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out * (F.lit(1) if n is None else n)




def language(path: Column, ecosystem: str = "cms") -> Column:
    """The language of a file by the ending of its name, whatever its case; null if none.

    A framework's project is scanned for files that end in .php alone.
    """
    name, out = F.lower(F.element_at(F.split(path, "/"), -1)), None
    if ecosystem == "framework":
        return F.when(name.endswith(".php"), "php")
    for lang, endings in LANGUAGES:
        fits = F.lit(False)
        for ending in endings:
            fits = fits | name.endswith(ending)
        out = F.when(fits, lang) if out is None else out.when(fits, lang)
    return out


def group_of_path(path: Column) -> Column:
    """Three leading segments under modules, themes or profiles, else the first segment."""
    parts = F.split(path, "/")
    deep = (F.size(parts) >= 3) & F.element_at(parts, 1).isin("modules", "themes", "profiles")
    return F.when(deep, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.element_at(parts, 1))


def risk(change_type: Column) -> Column:
    """Severity and confidence of a change type, the strongest rule first."""
    rules = (
        (change_type.endswith("_removed"), "breaking", 0.95),
        (change_type == "signature_changed", "breaking", 0.9),
        (change_type == "inheritance_impact", "warning", 0.7),
        (change_type.endswith("_renamed"), "breaking", 0.9),
        (change_type == "library_deprecated", "deprecation", 0.9),
        (change_type == "hook_to_attribute", "modernization", 0.9),
        (change_type.contains("deprecated"), "deprecation", 0.9),
        (change_type.contains("to_attribute"), "modernization", 0.85),
    )
    out = None
    for fits, severity, confidence in rules:
        value = F.struct(F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("severity"), F.lit(0.5).alias("confidence")))


def namespace_moved(old: Column, new: Column, separator: str = "\\") -> Column:
    """True where only the qualifier before the last segment differs."""
    last = lambda c: F.substring_index(c, separator, -1)
    return (last(old) == last(new)) & (old != new) & old.contains(separator)
