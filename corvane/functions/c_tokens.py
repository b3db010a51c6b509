"""Stateful tokenizers of C code: identifiers by meaning, by subtokens, or by kind alone.

Each policy maps one significant token, with its neighbours, to what is emitted; the scanner and the
walk over tokens are shared. Numbering identifiers by first use is sequential within a text, so these
run as Arrow-batched pandas UDFs; texts are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import c_names as names
from .lexer import TOKEN_CLASSES

_SCAN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in TOKEN_CLASSES.items()))
_WORDS = {k: frozenset(v) for k, v in {"keyword": names.KEYWORDS, "type": names.TYPE_WORDS, "sign": names.BEFORE_SIGN, "hex": names.KEPT_HEX, "octal": names.KEPT_OCTAL, "bound": names.KEPT_BOUNDS}.items()}
_FAMILY = {f: k for k, (every, _) in names.FAMILIES.items() for f in every}
_KEPT = {f for _, kept in names.FAMILIES.values() for f in kept} | set(names.RISKY) | set(names.SAFE)
_DEFENCE = {f: k for k, fs in names.DEFENCES.items() for f in fs}
_BUCKETS = names.BUCKETS


@dataclass
class Token:
    kind: str
    text: str
    before: str = ""
    after: str = ""

    @property
    def called(self) -> bool:
        return self.after == "("

    @property
    def member(self) -> bool:
        return self.before in (".", "->")


def scan(code: str) -> list[Token]:
    """Significant tokens, each with the texts of its neighbours; comments are left out."""
    out: list[Token] = []
    for m in _SCAN.finditer(code or ""):
        if m.lastgroup.endswith("comment"):
            continue
        t = Token(m.lastgroup, m[0])
        if out:
            t.before, out[-1].after = out[-1].text, t.text
        out.append(t)
    return out


def number_word(t: Token, wide: bool = False) -> str:
    """Small, round and boundary numbers stay; others fall into classes, by bit width if ``wide``."""
    plain = re.sub("[uUlL]+$", "", t.text)
    if t.kind == "hex":
        plain = plain.lower()
        return plain if plain in _WORDS["hex"] else "NUM_HEX"
    if len(plain) > 1 and plain[0] == "0":
        return f"PERM_{plain}" if plain in _WORDS["octal"] else "NUM_OCT"
    value = int(plain)
    if value <= 16 or plain in _WORDS["bound"] or (value & (value - 1) == 0 and value <= 65536):
        return plain
    if not wide:
        return "NUM"
    return "NUM_8BIT" if value < 1 << 8 else "NUM_16BIT" if value < 1 << 16 else "NUM_32BIT" if value < 1 << 32 else "NUM_LARGE"


def name_parts(name: str) -> list[str]:
    """Lower-cased parts of snake_case and camelCase names."""
    out = []
    for part in filter(None, name.split("_")):
        found = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|\d+", part)
        out += [f.lower() for f in found] or [part.lower()]
    return out


def meaning(name: str) -> str:
    """The bucket of an identifier: a part equals one of its words, or holds one of three letters or more."""
    if name.lower() in names.LETTERS:
        return names.LETTERS[name.lower()]
    parts = name_parts(name)
    for bucket, words in _BUCKETS.items():
        if any(p == w or (len(w) > 2 and w in p) for p in parts for w in words):
            return bucket
    return "VAR"


def defence_word(name: str) -> str | None:
    if name in _DEFENCE:
        return _DEFENCE[name]
    return next((k for k, ws in names.DEFENCE_PARTS if any(w in name.lower() for w in ws)), None)


@dataclass
class Numbering:
    """Numbers names within their bucket by first use; beyond ``limit`` all share the overflow token (or the last number)."""

    limit: int = 40
    overflow: bool = True
    seen: dict[str, str] = field(default_factory=dict)
    used: dict[str, int] = field(default_factory=dict)

    def __call__(self, name: str, bucket: str) -> str:
        if name not in self.seen:
            n = self.used.get(bucket, 0)
            self.used[bucket] = n + 1
            self.seen[name] = f"{bucket}_{n}" if n < self.limit else f"{bucket}_OVF" if self.overflow else f"{bucket}_{self.limit - 1}"
        return self.seen[name]


def _is_cast(out: list[str]) -> bool:
    """The tokens end with a parenthesised type (looked for among the last ten)."""
    if len(out) < 2 or out[-1] != ")":
        return False
    depth = 1
    for i in range(len(out) - 2, max(0, len(out) - 10) - 1, -1):
        depth += (out[i] == ")") - (out[i] == "(")
        if not depth:
            return any(w in _WORDS["type"] or w.endswith("_t") for w in out[i + 1 : -1])
    return False


def _walk(code: str, word: Callable[[Token], Iterable[str]], signs: bool) -> list[str]:
    """Emit what ``word`` gives for each token; with ``signs`` a minus before 1 that is a sign becomes NEG_1."""
    out: list[str] = []
    skip = False
    for t in scan(code):
        if skip:
            skip = False
        elif signs and t.text == "-" and t.kind == "operator" and t.after == "1" and (not out or out[-1] in _WORDS["sign"] or _is_cast(out)):
            out.append("NEG_1")
            skip = True
        else:
            out.extend(word(t))
    return out


_LITERAL = {"separator": "SEP", "string": "STR", "char": "CHAR", "float": "FLOAT"}


def optimized(code: str, indexed: bool = True, limit: int = 40) -> list[str]:
    """Calls by family, variables numbered by meaning."""
    number = Numbering(limit)

    def word(t: Token) -> Iterable[str]:
        if t.kind in ("number", "hex"):
            return (number_word(t),)
        if t.kind != "identifier" or t.text in _WORDS["keyword"]:
            return (_LITERAL.get(t.kind, t.text),)
        if t.called and not t.member:
            known = t.text if t.text in _KEPT else _FAMILY.get(t.text)
            return (known or defence_word(t.text) or "FUNC",)
        bucket = meaning(t.text)
        return (number(t.text, bucket) if indexed else bucket,)

    return _walk(code, word, True)


#: The smaller set of meanings, matched anywhere in a lower-cased name.
SIMPLE_MEANINGS = {
    "BUF": ("buf", "dst", "src", "data", "str"),
    "LEN": ("len", "size", "count", "num"),
    "PTR": ("ptr", "head", "tail", "node"),
    "IDX": ("idx", "index", "pos", "off"),
    "SENS": ("pass", "secret", "token", "key"),
    "PRIV": ("admin", "root", "user", "priv"),
}


def canonical(code: str, limit: int = 32) -> list[str]:
    """Known and defensive calls kept, other calls FUNC, variables numbered by a simple meaning; numbers beyond the limit share the last."""
    number = Numbering(limit, overflow=False)

    def word(t: Token) -> Iterable[str]:
        if t.kind in ("number", "hex"):
            return ("NUM",)
        if t.kind != "identifier" or t.text in _WORDS["keyword"]:
            return (_LITERAL.get(t.kind, t.text),)
        if t.called:
            return (t.text if t.text in _FAMILY or is_defence(t.text) else "FUNC",)
        low = t.text.lower()
        bucket = names.LETTERS.get(low) or next((k for k, ws in SIMPLE_MEANINGS.items() if any(w in low for w in ws)), "VAR")
        return (number(t.text, bucket),)

    return _walk(code, word, False)


def is_defence(name: str) -> bool:
    return name in _DEFENCE or any(w in name.lower() for w in names.DEFENCE_WORDS)


def hybrid(code: str) -> list[str]:
    """Known and defensive calls kept, other calls FUNC, other identifiers ID."""

    def word(t: Token) -> Iterable[str]:
        if t.kind in ("number", "hex"):
            return ("NUM",)
        if t.kind != "identifier" or t.text in _WORDS["keyword"]:
            return (_LITERAL.get(t.kind, t.text),)
        return ((t.text if t.text in _FAMILY or is_defence(t.text) else "FUNC") if t.called else "ID",)

    return _walk(code, word, False)


#: Categories of string literals, the first that fits; "search" looks anywhere, "match" at the start.
STRING_RULES = (
    ("SQL_STR", "search", re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|FROM|WHERE|JOIN|GROUP BY|ORDER BY|LIMIT|UNION|HAVING|CREATE|ALTER|TRUNCATE)\b", re.I)),
    ("URL_STR", "match", re.compile(r"(https?|ftp|file)://|(?i:.+\.(com|net|org|io|gov|edu)(/|$))")),
    ("PATH_STR", "search", re.compile(r"[\\/]")),
    ("CRED_STR", "search", re.compile(r"pass(word)?|secret|token|key|api[_-]?key|auth", re.I)),
    ("EMAIL_STR", "match", re.compile(r"[^@]+@[^@]+\.[^@]+")),
    ("IP_STR", "match", re.compile(r"\b\d{1,3}(\.\d{1,3}){3}\b|([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}")),
    ("REGEX_STR", "long", re.compile(r"[.*+?|^$\\[\]{}()]")),
)
MACRO = re.compile(r"[A-Z][A-Z0-9_]+|(?:CONFIG_|AVERROR_|CODEC_|FF_|AV_)\w*")
_SUBTOKEN = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def string_word(literal: str) -> str:
    value = literal.strip("\"'")
    for name, how, rule in STRING_RULES:
        if rule.match(value) if how == "match" else rule.search(value) and (how == "search" or len(value) > 3):
            return name
    return "STR"


def subtokens(name: str) -> list[str]:
    """Parts of a name, lower-cased; runs of three digits or more become IDNUM."""
    parts = [s for p in name.split("_") for s in _SUBTOKEN.findall(p)] or [name]
    return ["IDNUM" if p.isdigit() and len(p) > 2 else p.lower() for p in parts]


def subtoken(code: str, most: int = 8) -> list[str]:
    """Known calls kept, all other identifiers as their parts (at most ``most``, macros in full), literals by category."""

    def word(t: Token) -> Iterable[str]:
        if t.kind in ("number", "hex"):
            return (number_word(t, wide=True),)
        if t.kind == "string":
            return (string_word(t.text),)
        if t.kind != "identifier" or t.text in _WORDS["keyword"]:
            return (_LITERAL.get(t.kind, t.text),)
        if t.called and (t.text in _FAMILY or t.text in _KEPT or t.text in _DEFENCE):
            return (t.text,)
        parts = subtokens(t.text)
        return parts if MACRO.fullmatch(t.text) else parts[:most]

    return _walk(code, word, True)


def preserve(code: str) -> list[str]:
    """Identifiers and calls as they are; literals by kind, numbers by policy."""

    def word(t: Token) -> Iterable[str]:
        return (number_word(t) if t.kind in ("number", "hex") else _LITERAL.get(t.kind, t.text),)

    return _walk(code, word, True)


def normalized(code: str) -> list[str]:
    """Keywords and library calls kept; other calls FUNC_k and other names VAR_k by first use; literals by kind."""
    number = Numbering(limit=1 << 30)

    def word(t: Token) -> Iterable[str]:
        if t.kind in ("number", "hex"):
            return ("NUM",)
        if t.kind != "identifier" or t.text in _WORDS["keyword"] or t.text in _FAMILY:
            return (_LITERAL.get(t.kind, t.text),)
        return (number(t.text, "FUNC" if t.called and not t.member else "VAR"),)

    return _walk(code, word, False)


POLICIES: dict[str, Callable[[str], list[str]]] = {f.__name__: f for f in (optimized, canonical, hybrid, subtoken, preserve, normalized)}


def tokenized(code: Column, policy: str) -> Column:
    """``array<string>`` of a policy's tokens."""
    run = POLICIES[policy]

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: run(t or ""))

    return tokens(code)
