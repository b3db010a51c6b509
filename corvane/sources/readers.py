"""Readers: split corpora, JSON lines, CSV, pre-sliced JSON, source files, array files and rule files."""

from __future__ import annotations

import io
import json
import subprocess
from collections.abc import Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "validation", "test")
#: The fields of a corpus row and their order.
SAMPLE = T.StructType()
for _name in ("id", "func", "func_clean", "normalized_func", "target", "project", "commit_id", "vul_lines", "lines", "label", "line_no"):
    _special = {"id": T.LongType(), "target": T.BooleanType(), "lines": T.ArrayType(T.StringType()), "label": T.ArrayType(T.IntegerType()), "line_no": T.ArrayType(T.IntegerType())}
    SAMPLE = SAMPLE.add(_name, _special.get(_name, T.StringType()))
#: File name endings of C and C++ sources.
C_SUFFIXES = (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh")
JAVA_COLUMNS = ("label", "cve_id", "method_name", "code_snippet", "filename", "commit_hash", "programming_language", "cwe_id", "repo_url", "author_date", "commit_msg")


def read_splits(spark: SparkSession, path: str, columns: list[str] | None = None, split: str | None = None) -> DataFrame:
    """All ``{split}-*.parquet`` files of a folder with the split as a column, taken from the file name."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; there are {', '.join(SPLITS)}")
    rows = spark.read.option("pathGlobFilter", f"{split}-*.parquet" if split else "*.parquet").option("mergeSchema", "true").parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([a-z]+)-", 1)
    rows = rows.withColumn("split", F.coalesce(*[F.when(name == s, s) for s in SPLITS]))
    return rows.select(*columns, "split") if columns else rows


def list_splits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def as_samples(rows: DataFrame) -> DataFrame:
    """Rows with all corpus fields: missing ones are null, numbers read as booleans, nested values may be JSON text."""
    have = {f.name: f.dataType for f in rows.schema}
    out: list[Column] = []
    for f in SAMPLE:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(have[f.name], T.StringType):
            out.append(F.from_json(f.name, f.dataType).alias(f.name))
        elif f.name == "vul_lines" and not isinstance(have[f.name], T.StringType):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*out, *[c for c in ("split",) if c in have])


def code_of(func: Column, clean: Column) -> Column:
    """The function, or its cleaned form where that is missing or empty."""
    return F.coalesce(F.nullif(func, F.lit("")), F.nullif(clean, F.lit("")), F.lit(""))


def vulnerable_lines(raw: Column) -> Column:
    """Sorted line numbers from JSON: a list, ``{"line_no": [...]}`` or ``{"<line>": code}``; anything else has none."""
    listed = F.from_json(raw, "array<int>")
    inner = F.from_json(raw, "line_no array<int>")["line_no"]
    keyed = F.transform(F.filter(F.map_keys(F.from_json(raw, "map<string,string>")), lambda k: k.rlike(r"^\d+$")), lambda k: k.cast("int"))
    found = F.when(F.ltrim(raw).startswith("["), listed).otherwise(F.coalesce(inner, keyed))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<int>")), lambda x: x.isNotNull())))


def read_json_lines(spark: SparkSession, path: str, split: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines (blank ones are skipped), perhaps of one split only."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path)
    return rows.filter(F.col("split") == split) if split is not None else rows


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By ending: parquet, csv (with a header), orc, json lines."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if ending in ("json", "jsonl"):
        return spark.read.json(path)
    if ending in ("parquet", "orc"):
        return spark.read.format(ending).load(path)
    raise ValueError(f"no reader for .{ending}")


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of a JSON array of slices, under either of their key names."""
    rows = spark.read.option("multiLine", "true").json(path)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None))
    return rows.select(pick("sliced_code", "code").cast("string").alias("code"), pick("label", "target").cast("int").alias("label"))


def read_java_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if missing := [c for c in JAVA_COLUMNS if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*JAVA_COLUMNS)


def read_sources(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = C_SUFFIXES) -> DataFrame:
    """(path, size, content) of source files, by Spark's own reader; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    wanted = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1))).isin(*suffixes)
    return files.filter(wanted).select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def changed_files(repository: str, base: str) -> list[str]:
    """Paths added, copied, modified or renamed since ``base``, for a semi-join with :func:`read_sources`."""
    if base.startswith("-"):
        raise ValueError("a base ref doesn't start with a dash")
    done = subprocess.run(["git", "-C", repository, "diff", "--name-only", "--diff-filter=ACMR", base], capture_output=True, text=True, check=True)
    return [line for line in done.stdout.splitlines() if line.lower().endswith(C_SUFFIXES)]


def read_arrays(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows of ``.npz`` files: the named two- or one-dimensional arrays, row by row; ``fields`` gives their Spark types."""
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"path": p} | {n: list(z[n]) if z[n].ndim > 1 else z[n] for n in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def read_rules(path: str) -> dict[str, tuple[list[str], list[str]]]:
    """Rules of a YAML or JSON file, category -> (functions, patterns); patterns that don't compile are left out."""
    import re

    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    out = {}
    for category, rule in (raw or {}).items():
        if not isinstance(rule, dict):
            continue
        good = []
        for p in rule.get("patterns") or []:
            try:
                re.compile(p)
                good.append(p)
            except re.error:
                pass
        out[category] = (list(rule.get("dangerous_functions") or []), good)
    return out


def rule_tables(spark: SparkSession, rules: Mapping[str, tuple[list[str], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(category, func) and (category, idx, pattern)."""
    funcs = [(c, f) for c, (fs, _) in rules.items() for f in fs]
    patterns = [(c, i, p) for c, (_, ps) in rules.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(funcs, "category string, func string"), spark.createDataFrame(patterns, "category string, idx int, pattern string")
