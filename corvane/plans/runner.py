"""The corpus run: samples to features, slices, tokens, vocabulary and vectors, step by step with a manifest.

Each step is a table under the run's folder. A finished step has a row in the manifest and is skipped on the next
run; a failed one is marked and its error raised. All splits go through together, as a column; the vocabulary and
the feature statistics are fitted on the training split alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import c_tokens, risk, slices, token_kinds
from ..operators import quality as q
from ..operators import vocabulary as v
from ..sources import readers

SPECIALS = ("PAD", "UNK", "BOS", "EOS", "SEP")
PAD, UNK, SEP = 0, 1, 4


@dataclass
class RunConfig:
    source: str
    out: str
    tokenizer: str = "subtoken"
    min_freq: int = 5
    max_vocab: int = 15_000
    max_len: int = 512
    head: int = 192
    radius: int = 15
    max_lines: int = 100
    max_tokens: int = 480


@dataclass
class Run:
    spark: SparkSession
    config: RunConfig
    steps: dict[str, Callable[[Run], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.steps = self.steps or {"clean": clean, "features": features, "slices": sliced, "tokens": tokenized, "vocabulary": vocabulary, "vectors": vectors}

    def path(self, step: str) -> str:
        return f"{self.config.out.rstrip('/')}/{step}"

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(self.path(step))

    def manifest(self) -> DataFrame:
        """(step, status, detail, at), the latest row of each step."""
        try:
            rows = self.spark.read.schema("step string, status string, detail string, at timestamp").parquet(self.path("_manifest"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "step string, status string, detail string, at timestamp")
        return rows.groupBy("step").agg(F.max_by(F.struct("status", "detail", "at"), "at").alias("_m")).select("step", "_m.*")

    def mark(self, step: str, status: str, detail: str = "") -> None:
        row = self.spark.createDataFrame([(step, status, detail)], "step string, status string, detail string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path("_manifest"))

    def run(self, first: str | None = None, last: str | None = None, again: bool = False) -> list[str]:
        """Run the steps from ``first`` to ``last`` that aren't completed; returns those run."""
        names = list(self.steps)
        for name in (first, last):
            if name is not None and name not in names:
                raise ValueError(f"unknown step {name!r}; there are {', '.join(names)}")
        chosen = names[names.index(first) if first else 0 : names.index(last) + 1 if last else None]
        done = {r["step"] for r in self.manifest().filter("status = 'completed'").collect()}
        ran = []
        for name in chosen:
            if name in done and not again:
                continue
            try:
                self.steps[name](self).write.mode("overwrite").parquet(self.path(name))
            except Exception as e:
                self.mark(name, "failed", str(e)[:500])
                raise
            self.mark(name, "completed")
            ran.append(name)
        return ran

    def status(self) -> DataFrame:
        """Each step with its state and, if completed, its rows."""
        state = {r["step"]: r for r in self.manifest().collect()}
        rows = [(i, s, state[s]["status"] if s in state else "pending", self.table(s).count() if s in state and state[s]["status"] == "completed" else None) for i, s in enumerate(self.steps)]
        return self.spark.createDataFrame(rows, "position int, step string, status string, n_rows long")


def clean(run: Run) -> DataFrame:
    """Valid functions, the first of each within its split, without what an earlier split holds."""
    rows = readers.as_samples(readers.read_splits(run.spark, run.config.source))
    rows = rows.withColumn("code", readers.code_of(F.col("func"), F.col("func_clean"))).filter(q.is_valid_text(F.col("code")))
    rows = rows.select("id", "split", F.col("target").cast("int").alias("label"), "project", "code", readers.vulnerable_lines(F.col("vul_lines")).alias("vul_lines")).withColumn("key", F.sha2("code", 256))
    return q.leakage_removed(q.keep_first(rows, ["split", "key"], "id"), "split", "key").drop("key")


def features(run: Run) -> DataFrame:
    first, second = risk.feature_columns(F.col("code"))
    plain = run.table("clean").select("id", "split", "label", *first).select("id", "split", "label", *second)
    names = [c for c in plain.columns if c not in ("id", "split", "label")]
    return q.standardised(plain, names, F.col("split") == "train").select("id", "split", "label", *[f"{c}_z" for c in names])


def sliced(run: Run) -> DataFrame:
    """Window slices around the marked lines of a function, or the criteria found in it; conflicting labels go."""
    c = run.config
    rows = run.table("clean").withColumn("crit", F.when(F.size("vul_lines") > 0, F.col("vul_lines")).otherwise(slices.criteria(F.split("code", "\n"))))
    cut = slices.budgeted_slice(F.col("code"), F.col("crit"), c.radius, c.max_lines, c.max_tokens)
    rows = rows.select("id", "split", "label", F.coalesce(F.nullif(cut, F.lit("")), F.col("code")).alias("sliced_code"))
    return q.without_conflicts(rows.withColumn("key", F.sha2("sliced_code", 256)), "key", "label", "id").drop("key")


def tokenized(run: Run) -> DataFrame:
    return run.table("slices").select("id", "split", "label", c_tokens.tokenized(F.col("sliced_code"), run.config.tokenizer).alias("tokens"))


def vocabulary(run: Run) -> DataFrame:
    freqs = v.token_frequencies(run.table("tokens").filter("split = 'train'"))
    return v.build_vocabulary(freqs, run.config.min_freq, run.config.max_vocab, SPECIALS)


def vectors(run: Run) -> DataFrame:
    c, rows = run.config, run.table("tokens")
    ids = v.encode(rows, run.table("vocabulary"), "id")
    cut = v.truncated(F.col("ids"), c.max_len, "head_tail", c.head, SEP)
    kept = v.truncated(F.col("tokens"), c.max_len, "tail")
    both = rows.join(ids, "id").select("id", "split", "label", cut.alias("_x"), token_kinds.type_ids(kept, c.max_len).alias("token_type_ids"))
    return both.select(
        "id", "split", "label", v.padded(F.col("_x"), c.max_len).alias("input_ids"), v.attention_mask(F.col("_x"), c.max_len).alias("attention_mask"), "token_type_ids", F.size("_x").alias("length")
    )
