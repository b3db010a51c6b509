"""Writers and reports: tables, vocabularies, array files, JSON, text, annotations and SARIF."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The report format's version and schema address.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
RULE_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "NONE": "none"}


def write_table(rows: DataFrame, path: str, kind: str = "parquet", split: str | None = None, compression: str = "snappy") -> None:
    out = rows.write.mode("overwrite").format(kind)
    if kind in ("parquet", "orc", "csv", "json"):
        out = out.option("compression", compression if kind in ("parquet", "orc") else "none")
    if kind == "csv":
        out = out.option("header", "true").option("escape", '"')
    (out.partitionBy(split) if split else out).save(path)


def write_arrays(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """(file, n) of compressed array files, one for each partition, as binary rows that the caller saves.

    The bytes travel as a column, so that they reach any store Spark can write to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        frames = [b for b in batches if len(b)]
        if frames:
            whole = pd.concat(frames)
            buffer = io.BytesIO()
            np.savez_compressed(buffer, **{c: np.array(whole[c].tolist()) for c in columns})
            yield pd.DataFrame({"n": [len(whole)], "content": [buffer.getvalue()]})

    made = rows.select(*columns).mapInPandas(run, "n long, content binary")
    made.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def json_debug(rows: DataFrame, path: str, key: str, ids: str, mask_sum: str) -> None:
    """JSON lines of (key, token_ids) without padding."""
    rows.select(key, F.slice(ids, 1, F.col(mask_sum)).alias("token_ids")).write.mode("overwrite").json(path)


def fingerprint(rule: Column, path: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rule, path, line.cast("string")), 256), 1, 32)


def artifact_uri(path: Column, base: str | None = None) -> Column:
    flat = F.regexp_replace(path, r"\\", "/")
    return F.when(flat.startswith(base.rstrip("/") + "/"), F.substring(flat, len(base.rstrip("/")) + 2, 1 << 20)).otherwise(flat) if base else flat


def findings(results: DataFrame, base: str | None = None, rule: str = "VULN001") -> DataFrame:
    """A finding for each flagged (path, line, risk_level, probability, apis): rule, level, message, place and fingerprint."""
    level = None
    for name, value in RULE_LEVELS.items():
        level = F.when(F.col("risk_level") == name, value) if level is None else level.when(F.col("risk_level") == name, value)
    uri = artifact_uri(F.col("path"), base)
    said = F.concat(
        F.lit("Risk "), F.col("risk_level"), F.lit(", probability "), F.format_number("probability", 2),
        F.when(F.size("apis") > 0, F.concat(F.lit("; calls "), F.array_join(F.slice("apis", 1, 5), ", "), F.when(F.size("apis") > 5, " and others").otherwise(""))).otherwise(""),
    )
    return results.select(F.lit(rule).alias("rule_id"), level.alias("level"), said.alias("message"), uri.alias("uri"), "line", fingerprint(F.lit(rule), uri, F.col("line")).alias("fingerprint"), "related")


def sarif(found: DataFrame, tool: str = "corvane", version: str = "1.0") -> DataFrame:
    """One row with the whole report as JSON text. Findings are a report's size, not a corpus's; each names at most 20 related lines."""
    place = lambda line: F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(line, F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place(F.col("line"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"), F.transform(F.slice("related", 1, 20), place).alias("relatedLocations"),
    )
    rows = found.select("uri", "line", "rule_id", result.alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("uri", "line", "rule_id", "r"))), lambda x: x["r"])
    rules = F.transform(F.array_sort(F.collect_set("rule_id")), lambda x: F.struct(x.alias("id")))
    artifacts = F.transform(F.array_sort(F.collect_set("uri")), lambda x: F.struct(F.struct(x.alias("uri")).alias("location")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), rules.alias("rules")).alias("driver")).alias("tool"), artifacts.alias("artifacts"), ordered.alias("results"))
    return rows.agg(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def json_report(results: DataFrame) -> DataFrame:
    """One row: a summary and all results, as JSON text."""
    summary = F.struct(F.count(F.lit(1)).alias("files"), F.count_if("vulnerable").alias("vulnerable"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    whole = F.array_sort(F.collect_list(F.struct("path", *[c for c in results.columns if c != "path"])))
    return results.agg(F.to_json(F.struct(summary.alias("summary"), whole.alias("results"))).alias("report"))


def annotations(found: DataFrame) -> DataFrame:
    """Lines that a code host shows beside the code."""
    kind = F.when(F.col("level") == "error", "error").when(F.col("level") == "warning", "warning").otherwise("notice")
    return found.select(F.format_string("::%s file=%s,line=%d::%s", kind, "uri", "line", "message").alias("annotation"), "uri", "line")


def text_report(results: DataFrame) -> DataFrame:
    """(path, line_text): one line for each file, marked by its risk."""
    mark = F.when(F.col("error").isNotNull(), "[ERROR]").when(F.col("vulnerable"), F.concat(F.lit("["), F.col("risk_level"), F.lit("]"))).otherwise("[OK]")
    said = F.coalesce("error", F.format_string("p=%.3f %s", "probability", F.array_join("apis", ",")))
    return results.select("path", F.concat_ws(" ", mark, "path", said).alias("line_text"))
