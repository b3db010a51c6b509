"""Program graphs as tables: nodes, blocks, edges, accesses, reaching definitions, dependences and slices.

Parsing is sequential and runs per text as an Arrow-batched map; everything derived from its rows
(reaching definitions, pointer flow, dependence edges, bounded slices, statistics) is joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import c_parser as cp

DEFS = ("def", "param", "update", "pointer_def")
WIDE = 1 << 20  # above any column


def _per_text(rows: DataFrame, key: str, code: str, fields: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    columns = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *x) for k, text in zip(b[key], b[code], strict=True) for x in make(text or "")]
            yield pd.DataFrame(out, columns=[key, *columns])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, code).mapInPandas(run, f"{key} {kind}, {fields}")


def syntax_nodes(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(node, parent, kind, depth, start_line, end_line, n_errors), in pre-order."""

    def make(text: str) -> Iterator[tuple]:
        tops, errors = cp.parse(text)
        above: list[int] = []
        k = 0
        for top in tops:
            for n, depth in top.walk():
                above[depth:] = [k]
                yield k, above[depth - 1] if depth else -1, n.kind, depth, n.start, n.end, errors
                k += 1

    return _per_text(rows, key, code, "node int, parent int, kind string, depth int, start_line int, end_line int, n_errors int", make)


def cfg_blocks(rows: DataFrame, key: str, code: str) -> DataFrame:
    return _per_text(rows, key, code, "block_id int, start_line int, end_line int, block_type string", lambda t: cp.control_flow(t).blocks)


def cfg_edges(rows: DataFrame, key: str, code: str) -> DataFrame:
    return _per_text(rows, key, code, "src int, dst int, type string", lambda t: sorted(cp.control_flow(t).edges))


def dfg_access(rows: DataFrame, key: str, code: str) -> DataFrame:
    return _per_text(rows, key, code, "idx int, var_name string, line int, col int, access_type string", lambda t: [(i, *a) for i, a in enumerate(cp.accesses(t))])


def control_edges(rows: DataFrame, key: str, code: str) -> DataFrame:
    return _per_text(rows, key, code, "src int, dst int", cp.control_scopes)


def functions_of(rows: DataFrame, key: str, code: str) -> DataFrame:
    fields = "function_name string, start_line int, end_line int, return_type string, parameters array<string>, function_code string"
    return _per_text(rows, key, code, fields, lambda t: [tuple(f.values()) for f in cp.functions(t)])


def reaching_definitions(access: DataFrame, key: str) -> DataFrame:
    """(from_idx, to_idx, edge_type): each use with the last definition of its variable strictly before it."""
    at = (F.col("line") * WIDE + F.col("col")).cast("long")
    frame = W.partitionBy(key, "var_name").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    is_def = F.col("access_type").isin(*DEFS)
    last = access.withColumn("_at", at).withColumn("from_idx", F.last(F.when(is_def, F.col("idx")), ignorenulls=True).over(frame))
    reads = ~is_def | (F.col("access_type") == "update")
    return last.filter(reads & F.col("from_idx").isNotNull()).select(key, "from_idx", F.col("idx").alias("to_idx"), F.lit("def_use").alias("edge_type"))


def pointer_flow(access: DataFrame, key: str) -> DataFrame:
    """Each address taken with every later dereference in the same text, whatever the variable."""
    a = access.filter("access_type = 'address'").select(key, F.col("idx").alias("from_idx"), F.col("line").alias("_a"))
    d = access.filter("access_type = 'deref'").select(key, F.col("idx").alias("to_idx"), F.col("line").alias("_d"))
    return a.join(d, key).filter("_d > _a").select(key, "from_idx", "to_idx", F.lit("pointer").alias("edge_type"))


def def_use_chains(access: DataFrame, key: str) -> DataFrame:
    """All pairs of a definition and a use of the same variable on the same or a later line."""
    d = access.filter(F.col("access_type").isin(*DEFS)).select(key, "var_name", F.col("idx").alias("def_idx"), F.col("line").alias("_d"))
    u = access.filter(~F.col("access_type").isin(*DEFS)).select(key, "var_name", F.col("idx").alias("use_idx"), F.col("line").alias("_u"))
    return d.join(u, [key, "var_name"]).filter("_u >= _d").select(key, "var_name", "def_idx", "use_idx")


def all_reaching(access: DataFrame, key: str) -> DataFrame:
    """(key, from_idx, to_idx): every definition of a variable on the line of a use or before it, whatever lies between."""
    return def_use_chains(access, key).select(key, F.col("def_idx").alias("from_idx"), F.col("use_idx").alias("to_idx"))


def inside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs of (key, node, start, end) and (key, block, first, last) of which the first lies within the second."""
    return inner.join(outer, key).filter("start >= first and end <= last")


def last_block(lines: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, line, block): of the blocks over a line the one with the largest id."""
    return lines.join(blocks, key).filter("line between first and last").groupBy(key, "line").agg(F.max("block").alias("block"))


def enclosing(lines: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, line, n_nodes, node): how many nodes span a line, and the smallest of them, then the one with the smallest id."""
    over = lines.join(nodes, key).filter("line between start and end")
    return over.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n_nodes"), F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "node"))["node"].alias("node"))


def nodes_in_range(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """Nodes that overlap a range of lines."""
    return nodes.filter((F.col("end") >= low) & (F.col("start") <= high))


def leaves(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes that are no node's parent."""
    return nodes.join(nodes.select(key, F.col("parent").alias("node")).distinct(), [key, "node"], "left_anti")


def neighbours(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(node, n_before, n_after): distinct nodes one edge against and along the direction."""
    e = edges if types is None else edges.filter(F.col("type").isin(*types))
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("after"), F.lit(None).cast("long").alias("before")).union(e.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("after"), F.col("src").alias("before")))
    return ends.groupBy("node").agg(F.count_distinct("before").alias("n_before"), F.count_distinct("after").alias("n_after"))


def dependence_edges(access: DataFrame, data: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """Line-level edges (src, dst, type, label): data edges without self loops, one for each pair and type with its smallest variable, and control edges."""
    lines = access.select(key, "idx", "line", "var_name")
    f = lines.select(key, F.col("idx").alias("from_idx"), F.col("line").alias("src"), F.col("var_name").alias("label"))
    t = lines.select(key, F.col("idx").alias("to_idx"), F.col("line").alias("dst"))
    d = data.join(f, [key, "from_idx"]).join(t, [key, "to_idx"]).filter("src <> dst")
    d = d.groupBy(key, "src", "dst").agg(F.min("label").alias("label")).select(key, "src", "dst", F.lit("data").alias("type"), "label")
    return d.unionByName(control.select(key, "src", "dst", F.lit("control").alias("type"), F.lit("").alias("label")).distinct())


def dependence_slice(edges: DataFrame, criteria: DataFrame, key: str, backward: int, forward: int, kinds: tuple[str, ...] = ("data", "control")) -> DataFrame:
    """(key, line): lines within ``backward`` steps against and ``forward`` steps along the edges from the criteria."""
    links = edges.filter(F.col("type").isin(*kinds)).select(key, "src", "dst").distinct()
    out = criteria.select(key, "line").distinct()

    def spread(steps: int, a: str, b: str) -> DataFrame:
        seen = frontier = criteria.select(key, "line").distinct()
        for _ in range(steps):
            step = frontier.join(links.select(key, F.col(a).alias("line"), F.col(b).alias("_to")), [key, "line"]).select(key, F.col("_to").alias("line")).distinct()
            frontier = step.join(seen, [key, "line"], "left_anti")
            seen = seen.unionByName(frontier)
        return seen

    return out.unionByName(spread(backward, "dst", "src")).unionByName(spread(forward, "src", "dst")).distinct()


def text_slice(code: str, criteria: Iterable[int], backward: int, forward: int) -> list[int]:
    """What :func:`dependence_slice` gives for one text over its data and control edges, parsed once."""
    tops = cp.parse(code)[0]
    last: dict[str, int] = {}  # line of a variable's last definition
    links = set(cp.control_scopes(code, tops))
    for name, line, _, kind in cp.accesses(code, tops):
        is_def = kind in DEFS
        if (not is_def or kind == "update") and last.get(name, line) != line:
            links.add((last[name], line))
        if is_def:
            last[name] = line
    out = set(criteria)
    for steps, edges in ((backward, [(b, a) for a, b in links]), (forward, links)):
        after: dict[int, list[int]] = {}
        for a, b in edges:
            after.setdefault(a, []).append(b)
        seen = frontier = set(criteria)
        for _ in range(steps):
            frontier = {b for a in frontier for b in after.get(a, ())} - seen
            seen = seen | frontier
        out |= seen
    return sorted(out)


def text_slices(code: Column, criteria: Column, backward: int, forward: int) -> Column:
    """Lines of each text's dependence slice, sorted and joined by commas; a text's graph never leaves its row, so nothing is shuffled."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, text_slice(t or "", [int(x) for x in c], backward, forward))) for t, c in zip(texts, lines, strict=True)])

    return cut(code, criteria)


def graph_sizes(table: DataFrame, key: str, of: DataFrame, name: str) -> DataFrame:
    """Rows of ``of`` per key, 0 where there are none."""
    n = of.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return table.select(key).join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def stripped(code: Column, keep_columns: bool = False) -> Column:
    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cp.strip_comments(t or "", keep_columns))

    return strip(code)
