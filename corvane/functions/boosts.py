"""Adjustments of a model's probability: boosts by critical patterns, a graph risk score and bands of multipliers. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .risk import bound

#: Boosts of each finding, format calls, copies with their safe forms, and how far behind a call is looked.
BOOSTS = {"gets": 0.15, "format": 0.12, "copy": 0.10, "allocation": 0.08, "double_free": 0.15, "use_after_free": 0.15}
FORMATS = ("printf", "sprintf", "fprintf", "vprintf", "vsprintf")
COPIES = {"strcpy": "strncpy", "strcat": "strncat"}
CHECK_WITHIN, CLEAR_WITHIN, RETURN_WITHIN, USE_WITHIN = 200, 100, 50, 200
#: Patterns of single calls; {v} stands for a variable.
GETS = r"\bgets\s*\("
BARE_FORMAT = r'\b{f}\s*\(\s*([^",)]+)\s*\)'
SIZED = r"\b(?:sizeof|strlen)\s*\("
ALLOCATED = r"(\w+)\s*=\s*(?:\(?\s*\w+\s*\*?\s*\)?)\s*malloc\s*\("
CHECKED = r"\bif\s*\(\s*{v}\s*(?:==\s*NULL|!=\s*NULL|!|==\s*0|!=\s*0)"
FREED = r"\bfree\s*\(\s*(\w+)\s*\)"
ASSIGNED = r"\b{v}\s*="
CLEARED = r"{v}\s*=\s*NULL\b"
RETURNS_NULL = r"^\s*;\s*\n\s*return\s+NULL\s*;"
USED = r"\breturn\s+{v}\b|\b{v}\s*(?:\[|->)"


def _holds(text: Column, form: str, variable: Column) -> Column:
    front, *rest = form.split("{v}")
    return F.regexp_like(text, F.concat(F.lit(front), *[x for part in rest for x in (variable, F.lit(part))]))


def _calls(code: Column, call: str, within: int) -> Column:
    """(v, after) of each match: its variable, and the text behind it, which a lookahead catches."""
    form = F.lit(rf"{call}(?=([\s\S]{{0,{within}}}))")
    return F.arrays_zip(F.regexp_extract_all(code, form, F.lit(1)).alias("v"), F.regexp_extract_all(code, form, F.lit(2)).alias("after"))


def _first(name: str, hits: Column) -> Column:
    return F.transform(F.slice(hits, 1, 1), lambda v: F.concat(F.lit(f"{name}:"), v))


def _freed_again(code: Column) -> Column:
    """Variables of the frees that follow a free of the same one with no assignment in the text between the two."""

    def again(freed: Column, between: Column) -> Column:
        def hit(v: Column, k: Column) -> Column:
            last = F.array_max(F.filter(F.transform(F.slice(freed, F.lit(1), k), lambda x, i: F.when(x == v, i)), lambda i: i.isNotNull()))
            gaps = F.slice(between, last + 2, F.greatest(k - last, F.lit(0)))  # what lies behind each free up to this one
            return F.when(last.isNotNull() & ~F.exists(gaps, lambda g: _holds(g, ASSIGNED, v)), v)

        return F.filter(F.transform(freed, hit), lambda v: v.isNotNull())

    found = bound(F.struct(F.regexp_extract_all(code, F.lit(FREED), F.lit(1)).alias("v"), F.split(code, FREED).alias("gaps")), lambda s: again(s["v"], s["gaps"]))
    return F.when(F.regexp_count(code, F.lit(FREED)) > 1, found).otherwise(F.array().cast("array<string>"))


def critical_patterns(code: Column) -> Column:
    """Findings in order: each risky format call and copy once, and the first of each of the others."""
    code = F.coalesce(code, F.lit(""))
    plain = [F.when(code.rlike(GETS), F.lit("gets"))]
    plain += [F.when(code.rlike(BARE_FORMAT.replace("{f}", f)), F.lit(f"format:{f}")) for f in FORMATS]
    plain += [F.when(code.rlike(rf"\b{f}\s*\(") & ~code.rlike(rf"\b{safe}\s*\(") & ~code.rlike(SIZED), F.lit(f"copy:{f}")) for f, safe in COPIES.items()]
    unchecked = F.filter(_calls(code, ALLOCATED, CHECK_WITHIN), lambda x: ~_holds(x["after"], CHECKED, x["v"]))

    def used(x: Column) -> Column:
        near = F.substring(x["after"], 1, CLEAR_WITHIN)
        cleared = _holds(near, CLEARED, x["v"]) | _holds(near, ASSIGNED, x["v"]) | F.substring(x["after"], 1, RETURN_WITHIN).rlike(RETURNS_NULL)
        return ~cleared & _holds(x["after"], USED, x["v"])

    late = F.filter(_calls(code, FREED, USE_WITHIN), used)
    return F.concat(
        F.filter(F.array(*plain), lambda x: x.isNotNull()),
        _first("allocation", F.transform(unchecked, lambda x: x["v"])),
        _first("double_free", _freed_again(code)),
        _first("use_after_free", F.transform(late, lambda x: x["v"])),
    )


def pattern_boost(code: Column) -> Column:
    """struct(boost, findings) of each text."""
    weights = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])

    def summed(found: Column) -> Column:
        boost = F.aggregate(found, F.lit(0.0), lambda total, f: total + weights[F.substring_index(f, ":", 1)])
        return F.struct(F.round(boost, 6).alias("boost"), found.alias("findings"))

    return bound(critical_patterns(code), summed)


def graph_risk(tainted: Column, unguarded: Column, null: Column, bounds: Column) -> Column:
    return F.least(F.lit(1.0), tainted * 0.3 + unguarded * 0.2 + null * 0.1 + bounds * 0.1)


def adjusted(probability: Column, risk: Column, low: float = 0.35, high: float = 0.65) -> Column:
    """Only borderline probabilities move: by 0.85 without graph risk, and up by bands of risk."""
    factor = F.when(risk <= 0, 0.85).when(risk < 0.3, 1.05).when(risk < 0.6, 1.15).otherwise(1.2)
    return F.when(probability.between(low, high), F.least(F.lit(1.0), probability * factor)).otherwise(probability)


def softened(logit: Column, temperature: float) -> Column:
    """A logit's probability at a temperature."""
    return 1 / (1 + F.exp(-logit / temperature))
