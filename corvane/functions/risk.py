"""Risk features of C code as Catalyst expressions: counts, guards, scores and bands."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The built-in rules, category -> (functions, patterns).
DEFAULT_RULES: dict[str, tuple[list[str], list[str]]] = {
    "buffer_overflow": (["strcpy", "strcat", "gets", "sprintf", "memcpy"], [r"strcpy\s*\([^,]+,[^)]+\)", r"strcat\s*\([^,]+,[^)]+\)", r"gets\s*\([^)]+\)"]),
    "format_string": (["printf", "fprintf", "sprintf", "snprintf"], [r'printf\s*\([^"]+\)']),
    "null_pointer": ([], [r"\*\s*\w+\s*(?:=|==)\s*NULL"]),
    "use_after_free": ([], [r"free\s*\([^)]+\)"]),
    "integer_overflow": (["atoi", "atol", "strtol"], [r"atoi\s*\([^)]+\)"]),
}
#: Structural counts of the first feature set.
STRUCTURE = {
    "pointer_count": r"\b(\w+)\s*\*\s*(\w+)",
    "malloc_count": r"\b(malloc|calloc|realloc)\s*\([^)]*\)",
    "free_count": r"\bfree\s*\(\s*(\w+)\s*\)",
    "null_check_count": r"if\s*\([^)]*(?:==|!=)\s*NULL[^)]*\)",
    "array_access_count": r"\b(\w+)\s*\[\s*([^\]]+)\s*\]",
}
#: Weights of the raw risk score.
WEIGHTS = {
    "buffer_overflow_count": 5.0, "use_after_free_count": 5.0, "format_string_count": 4.0, "null_pointer_count": 3.0, "integer_overflow_count": 3.0,
    "dangerous_function_count": 2.0, "malloc_count": 0.5, "free_count": 0.5, "pointer_count": 0.3, "array_access_count": 0.2, "null_check_count": -0.5,
}


def count(code: Column, pattern: str) -> Column:
    return F.regexp_count(code, F.lit(pattern)).cast("long")


def rule_counts(code: Column, rules: Mapping[str, tuple[list[str], list[str]]] = DEFAULT_RULES) -> dict[str, Column]:
    """Matches per category over the whole text, calls of dangerous functions, and structural counts."""
    out = {}
    for name, (_, patterns) in rules.items():
        total = F.lit(0).cast("long")
        for p in patterns:
            total = total + count(code, p)
        out[f"{name}_count"] = total
    functions = sorted({f for fs, _ in rules.values() for f in fs})
    out["dangerous_function_count"] = count(code, rf"\b(?:{'|'.join(functions)})\s*\(") if functions else F.lit(0).cast("long")
    return out | {k: count(code, p) for k, p in STRUCTURE.items()}


def risk_score(counts: Mapping[str, Column]) -> Column:
    """1 - 1 / (1 + raw / 10) of the weighted sum of counts, which isn't below 0."""
    raw = F.lit(0.0)
    for k, w in WEIGHTS.items():
        if k in counts:
            raw = raw + w * counts[k]
    return F.round(1.0 - 1.0 / (1.0 + F.greatest(raw, F.lit(0.0)) * 0.1), 3)


def risk_level(score: Column) -> Column:
    """Lower-case bands of the rule score."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score > 0, "low").otherwise("none")


def risk_band(probability: Column) -> Column:
    """Upper-case bands of a model's probability."""
    bands = (("CRITICAL", 0.9), ("HIGH", 0.75), ("MEDIUM", 0.5), ("LOW", 0.25))
    out = F.when(probability >= bands[0][1], bands[0][0])
    for name, least in bands[1:]:
        out = out.when(probability >= least, name)
    return out.otherwise("NONE")


#: Counting patterns of the third feature set.
COUNTED = {
    "pointer_ops": r"\*\s*\w+|\w+\s*->\s*\w+|\w+\s*\[\s*[^\]]+\]",
    "bounds_checks": r"(?i)\b(?:if|while|for)\s*\([^)]*(?:<|<=|>|>=)\s*(?:sizeof|strlen|size|len|count|num|max|limit|capacity)",
    "null_checks": r"\b(?:if|while)\s*\([^)]*(?:==|!=)\s*NULL|\b(?:if|while)\s*\(\s*!\s*\w+\s*\)|\b(?:if|while)\s*\(\s*\w+\s*\)",
    "mallocs": r"\b(?:malloc|calloc|realloc)\s*\(",
    "frees": r"\bfree\s*\(",
    "sizeofs": r"\bsizeof\s*\(",
    "strlens": r"\bstrlen\s*\(",
    "dangerous": r"\b(?:strcpy|strcat|sprintf|gets|scanf|sscanf|fscanf|vsprintf)\s*\(",
    "safe": r"\b(?:strncpy|strncat|snprintf|fgets|memcpy_s|strcpy_s)\s*\(",
}
#: Hazards as name -> (pattern, guard or None, category, severity).
_SIZED = r"\bstrlen\s*\([^)]*\)|sizeof\s*\([^)]*\)"
HAZARDS: dict[str, tuple[str, str | None, str, float]] = {
    "unbounded_strcpy": (r"\bstrcpy\s*\(\s*([^,]+),\s*([^)]+)\)", _SIZED, "buffer_overflow", 0.9),
    "unbounded_sprintf": (r"\bsprintf\s*\(\s*([^,]+),", None, "buffer_overflow", 0.85),
    "dangerous_gets": (r"\bgets\s*\(\s*\w+\s*\)", None, "buffer_overflow", 1.0),
    "unbounded_strcat": (r"\bstrcat\s*\(\s*([^,]+),\s*([^)]+)\)", _SIZED, "buffer_overflow", 0.8),
    "unchecked_malloc": (r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\([^)]*\)", None, "null_deref", 0.7),
    "unchecked_deref": (r"\*\s*(\w+)|(\w+)\s*->\s*\w+", r"if\s*\([^)]*\b\w+\b[^)]*(?:!=|==)\s*NULL", "null_deref", 0.5),
    "unchecked_free": (r"\bfree\s*\(\s*(\w+)\s*\)", r"if\s*\(\s*\w+\s*(?:!=|==)\s*NULL", "memory", 0.4),
    "potential_double_free": (r"\bfree\s*\(\s*(\w+)\s*\)", None, "memory", 0.8),
    "unbounded_array_access": (r"(\w+)\s*\[\s*([a-zA-Z_]\w*)\s*\]", r"(?i)\b(?:if|while|for)\s*\([^)]*(?:<|<=|>|>=)\s*(?:sizeof|strlen|size|len|count|num|max)", "buffer_overflow", 0.6),
    "unchecked_multiplication": (r"(?:malloc|calloc|realloc)\s*\(\s*[^)]*\*[^)]*\)", r"(?i)(?:SIZE_MAX|UINT_MAX|INT_MAX)\s*/|overflow|check", "integer_overflow", 0.6),
    "format_string_vuln": (r'\b(?:printf|fprintf|sprintf|snprintf)\s*\(\s*(?:[^",]+,\s*)?([a-zA-Z_]\w*)\s*\)', None, "format_string", 0.9),
}
LOOKAHEAD = 15  # lines behind an allocation in which its check counts


#: The six forms of a check of {v} after its allocation.
CHECK_FORMS = (r"\b{v}\s*(?:==|!=)\s*NULL\b", r"\bNULL\s*(?:==|!=)\s*{v}\b", r"if\s*\(\s*!?\s*{v}\s*\)", r"\b{v}\s*\?", r"\b(?:assert|Assert|ASSERT|BUG_ON|WARN_ON)\s*\([^)]*{v}")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it (Catalyst shares nothing inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def of_variable(form: str, v: Column) -> Column:
    """A pattern with {v} replaced by a variable."""
    front, *rest = form.split("{v}")
    return F.concat(F.lit(front), *[x for part in rest for x in (v, F.lit(part))])


def allocation_unchecked(code: Column) -> Column:
    """Whether some ``v = malloc(...)`` has no check of ``v`` on the next 15 lines.

    The check forms name the variable, so each is a pattern built from it per match; all of it runs
    as array expressions over the text's lines, which are cut once.
    """
    allocated = r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\b"

    def any_unchecked(lines: Column) -> Column:
        found = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.regexp_extract_all(line, F.lit(allocated), F.lit(1)).alias("v"))), lambda x: F.size(x["v"]) > 0)

        def unchecked(x: Column) -> Column:
            later = F.slice(lines, x["i"] + 2, F.lit(LOOKAHEAD))
            return F.exists(x["v"], lambda v: bound(of_variable("|".join(CHECK_FORMS), v), lambda form: ~F.exists(later, lambda line: F.regexp_like(line, form))))

        return F.exists(found, unchecked)

    whole = F.regexp_count(code, F.lit(r"(?s)(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\([^)]*\)"))
    return F.when(whole > 0, bound(F.split(code, "\n"), any_unchecked)).otherwise(F.lit(False))


def freed_twice(code: Column) -> Column:
    """Whether a variable is freed again with no assignment to it on the lines strictly between."""
    free = r"\bfree\s*\(\s*(\w+)\s*\)"

    def any_again(lines: Column) -> Column:
        at = F.flatten(F.transform(lines, lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(free), F.lit(1)), lambda v: F.struct(i.alias("line"), v.alias("v")))))

        def again(frees: Column, x: Column, k: Column) -> Column:
            last = F.array_max(F.transform(F.slice(frees, F.lit(1), k), lambda y: F.when(y["v"] == x["v"], y["line"])))
            between = F.slice(lines, last + 2, F.greatest(x["line"] - last - 1, F.lit(0)))
            return last.isNotNull() & ~F.exists(between, lambda line: F.regexp_like(line, of_variable(r"\b{v}\s*=", x["v"])))

        return bound(at, lambda frees: F.exists(F.transform(frees, lambda x, k: F.coalesce(again(frees, x, k), F.lit(False))), lambda b: b))

    return F.when(F.regexp_count(code, F.lit(free)) > 1, bound(F.split(code, "\n"), any_again)).otherwise(F.lit(False))


def hazards(code: Column) -> dict[str, Column]:
    """Each hazard: present, and its guard nowhere in the text; two of them by their own rule."""
    out = {}
    for name, (pattern, guard, _, _) in HAZARDS.items():
        hit = code.rlike(pattern)
        if name == "unchecked_malloc":
            hit = hit & allocation_unchecked(code)
        elif name == "potential_double_free":
            hit = hit & freed_twice(code)
        elif guard:
            hit = hit & ~code.rlike(guard)
        out[name] = hit
    return out


def feature_columns(code: Column) -> tuple[list[Column], list[Column]]:
    """(first, second): select ``first`` (n_*, h_* helpers) from the rows, then ``second`` gives the 36 features in order."""
    blank = F.coalesce(F.length(F.trim(F.regexp_replace(code, r"\s", ""))) == 0, F.lit(True))
    first = [F.when(blank, F.lit(0)).otherwise(count(code, p)).alias(f"n_{k}") for k, p in COUNTED.items()]
    first += [F.when(blank, F.lit(False)).otherwise(h).cast("int").alias(f"h_{k}") for k, h in hazards(code).items()]
    loc = F.greatest(F.size(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != "")), F.lit(1))
    context = {"error_handling": r"(?i)\b(?:error|err|fail|errno|perror|strerror)\b", "logging": r"\b(?:log|LOG|printf|fprintf\s*\(\s*stderr)\b", "assertions": r"\b(?:assert|ASSERT|BUG_ON|WARN_ON)\s*\("}
    first += [F.coalesce(loc, F.lit(1)).alias("n_loc"), (~blank).cast("int").alias("n_present")]
    first += [F.when(blank, F.lit(0)).otherwise(code.rlike(p).cast("int")).alias(f"c_{k}") for k, p in context.items()]

    n = {k: F.col(f"n_{k}") for k in [*COUNTED, "loc", "present"]}
    h = {k: F.col(f"h_{k}") for k in HAZARDS}
    one = F.lit(1.0)
    least = lambda x: F.least(one, x)
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    defence = per(n["bounds_checks"] + n["null_checks"] + n["sizeofs"] + n["safe"], n["pointer_ops"] + n["mallocs"] + n["dangerous"])
    density = {"pointer_op_density": least(n["pointer_ops"] / n["loc"]), "malloc_density": least(n["mallocs"] / n["loc"] * 10), "dangerous_call_density": least(n["dangerous"] / n["loc"] * 10)}
    hits = sum((h[k] for k in HAZARDS), F.lit(0))
    by = lambda c: sum((h[k] for k, v in HAZARDS.items() if v[2] == c), F.lit(0))
    severity = sum((h[k] * v[3] for k, v in HAZARDS.items()), F.lit(0.0))
    most = sum(v[3] for v in HAZARDS.values())
    missing = one - least(defence)
    # the score reads two context flags before they exist, so both always count as absent
    likelihood = missing * 0.3 + density["dangerous_call_density"] * 0.2 + density["pointer_op_density"] * 0.1 + least(hits / 5) * 0.3 + h["dangerous_gets"] * 0.1 + h["unbounded_strcpy"] * 0.1 + 0.1
    named = {
        "bounds_per_pointer_op": per(n["bounds_checks"], n["pointer_ops"]), "null_checks_per_malloc": per(n["null_checks"], n["mallocs"]), "free_malloc_ratio": per(n["frees"], n["mallocs"]),
        "size_check_per_dangerous": per(n["sizeofs"] + n["strlens"], n["dangerous"]), "safe_func_ratio": per(n["safe"], n["safe"] + n["dangerous"]), "defense_ratio": defence, "missing_defense_ratio": missing,
        **density, **{f"has_{k}": h[k].cast("double") for k in HAZARDS},
        "buffer_overflow_patterns": least(by("buffer_overflow") / 3), "null_deref_patterns": least(by("null_deref") / 2), "memory_patterns": least(by("memory") / 2),
        "integer_overflow_patterns": least(by("integer_overflow").cast("double")), "format_string_patterns": least(by("format_string").cast("double")),
        "danger_score": least(severity / most * 2), "vuln_likelihood_score": least(likelihood),
        **{f"has_{k}": F.col(f"c_{k}").cast("double") for k in context},
        "pointer_op_count_norm": least(n["pointer_ops"] / 50), "malloc_count_norm": least(n["mallocs"] / 10), "dangerous_call_count_norm": least(n["dangerous"] / 10),
        "null_check_count_norm": least(n["null_checks"] / 20), "bounds_check_count_norm": least(n["bounds_checks"] / 10),
    }
    second = [F.when(n["present"] == 1, F.round(v, 6)).otherwise(F.lit(0.0)).alias(k) for k, v in named.items()]
    return first, second
