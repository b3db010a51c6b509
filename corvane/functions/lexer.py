"""Native lexing of C-like text: one ordered alternation, run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token classes in order of precedence. Characters that no class matches are skipped.
TOKEN_CLASSES = {
    "separator": r"\[SEP\]",
    "string": r'"[^"\\]*(?:\\[^\n][^"\\]*)*"',
    "char": r"'[^'\\]*(?:\\[^\n][^'\\]*)*'",
    "block_comment": r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/",
    "line_comment": r"//[^\n]*",
    "hex": r"0[xX][0-9a-fA-F]+[uUlL]*",
    "float": r"[0-9]+\.[0-9]*[fFlL]?|\.[0-9]+[fFlL]?|[0-9]+[eE][+-]?[0-9]+[fFlL]?",
    "number": r"[0-9]+[uUlL]*",
    "identifier": r"[a-zA-Z_][a-zA-Z0-9_]*",
    "operator": r"->|<<|>>|<=|>=|==|!=|&&|\|\||[+\-*/%&|^~<>=!]",
    "punctuation": r"[(){}\[\];,.:?#]",
}
LEX = "|".join(f"(?:{p})" for p in TOKEN_CLASSES.values())


def tokens(code: Column) -> Column:
    """All tokens of a text, comments among them."""
    return F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(LEX), F.lit(0))


def token_class(token: Column) -> Column:
    """The class of one token; the first that matches it whole."""
    ladder = None
    for name, pattern in TOKEN_CLASSES.items():
        hit = token.rlike(f"^(?:{pattern})$")
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder


def code_tokens(code: Column) -> Column:
    """Tokens without comments."""
    return F.filter(tokens(code), lambda t: ~(t.startswith("//") | t.startswith("/*")))


def sql_tokens(text: str) -> str:
    """The same list in DuckDB SQL."""
    pattern = LEX.replace("'", "''")
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def sql_class(token: str) -> str:
    arms = " ".join(f"WHEN regexp_full_match({token}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in TOKEN_CLASSES.items())
    return f"CASE {arms} END"
