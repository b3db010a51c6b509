"""Type ids 0 to 15 of tokens, as one ordered ladder of membership tests (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import c_names as names

#: The ids.
KINDS = (
    "PAD", "UNKNOWN", "KEYWORD", "IDENTIFIER", "TYPE", "OPERATOR", "LITERAL", "PUNCTUATION", "DANGEROUS_CALL", "SAFE_CALL", "ALLOC", "FREE", "DEREF", "ARRAY_ACCESS", "NULL_CHECK", "BOUNDS_CHECK",
)
#: Words by id, in order of precedence; those marked lower are compared in lower case too.
MEMBERS = (("DANGEROUS_CALL", True, (
    "strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "fscanf", "sscanf", "vscanf", "vfscanf", "vsscanf", "printf", "fprintf", "vprintf", "vfprintf",
    "memcpy", "memmove", "memset", "atoi", "atol", "atof", "strtok", "mktemp", "tmpnam", "tempnam", "system", "popen", "execl", "execle", "execlp", "execv",
    "execve", "execvp",
)), ("SAFE_CALL", True, (
    "strncpy", "strncat", "snprintf", "vsnprintf", "memcpy_s", "memmove_s", "memset_s", "strcpy_s", "strcat_s", "sprintf_s", "fgets", "getline", "strlcpy",
    "strlcat",
)), ("ALLOC", True, (
    "malloc", "calloc", "realloc", "aligned_alloc", "valloc", "pvalloc", "memalign", "posix_memalign", "new", "new[]", "g_malloc", "g_malloc0", "g_new",
    "g_new0", "av_malloc", "av_mallocz", "av_realloc",
)), ("FREE", True, ("free", "delete", "delete[]", "g_free", "av_free", "av_freep")), ("BOUNDS_CHECK", True, ("strlen", "sizeof", "size", "length", "len", "count", "strnlen", "wcslen", "mbslen")), ("NULL_CHECK", True, ("NULL", "null", "nullptr", "0")), ("DEREF", False, ("*", "->")), ("ARRAY_ACCESS", False, ("[", "]")))
PUNCTUATION = (";", ",", "{", "}", "(", ")", ":", ".")
OPERATORS = ("+", "-", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "&", "|", "^", "~", "<<", ">>", "++", "--")


def type_id(token: Column, known_types: bool = True) -> Column:
    """The id of one token; with ``known_types`` keywords and type words have ids of their own."""
    of = KINDS.index
    low = F.lower(token)
    out = F.when(token.isNull() | (token == ""), of("PAD"))
    for kind, lower, words in MEMBERS:
        hit = token.isin(*words) | (low.isin(*words) if lower else F.lit(False))
        out = out.when(hit, of(kind))
    if known_types:
        out = out.when(token.isin(*names.TYPE_WORDS), of("TYPE")).when(token.isin(*names.KEYWORDS), of("KEYWORD"))
    out = out.when(token.rlike(r"^[0-9]+$|^0x.") | token.startswith('"') | token.startswith("'"), of("LITERAL"))
    return out.when(token.isin(*PUNCTUATION), of("PUNCTUATION")).when(token.isin(*OPERATORS), of("OPERATOR")).otherwise(of("IDENTIFIER"))


def type_ids(tokens: Column, limit: int) -> Column:
    """Ids of the first ``limit`` tokens, padded; cut before typing, so that ids and tokens stay aligned."""
    ids = F.transform(F.slice(tokens, 1, limit), lambda t: type_id(t))
    return F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(limit) - F.size(ids), F.lit(0))))


def type_histogram(rows: DataFrame, tokens: str) -> DataFrame:
    """(type_id, kind, n, ratio) for all sixteen ids, also those that don't occur. Types are looked up once per distinct token."""
    by_token = rows.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    n = by_token.groupBy(type_id(F.col("t")).alias("type_id")).agg(F.sum("n").alias("n"))
    every = rows.sparkSession.createDataFrame(list(enumerate(KINDS)), "type_id int, kind string")
    full = every.join(n, "type_id", "left").select("type_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))
    return full.join(F.broadcast(full.agg(F.sum("n").alias("_t")))).select("type_id", "kind", "n", F.round(F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)), 6).alias("ratio"))
