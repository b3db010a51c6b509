"""Line, window, as-of and graph queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graphs as gr
from ..operators import lines as ln
from .registry import registered, table

HIT = r"(?i)([0-9]{1,3}\.){3}[0-9]{1,3}|@|licen[cs]e|password|secret"
LINES = "lines AS (SELECT doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS code FROM documents)"
CRITERIA = f"""crit AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n,
    list_filter(range(1, 1 + len(string_split(text, chr(10)))), lambda i: regexp_matches(string_split(text, chr(10))[i], '{HIT}')) AS hits FROM documents),
    picked AS (SELECT doc_id, n, CASE WHEN len(hits) > 0 THEN hits WHEN n = 1 THEN [1] ELSE [n // 2] END AS c FROM crit)"""


def criteria(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")).withColumn("n", F.size("lines"))
    hits = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("lines", i).rlike(HIT))
    middle = F.array(F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(1)))
    return docs.withColumn("hits", hits).withColumn("c", F.when(F.size("hits") > 0, F.col("hits")).otherwise(middle))


def joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@registered(f"WITH {CRITERIA} SELECT doc_id, n AS n_lines, array_to_string(c, ',') AS criteria FROM picked")
def criterion_lines(spark, sf_dir):
    return criteria(spark, sf_dir).select("doc_id", F.col("n").alias("n_lines"), joined("c").alias("criteria"))


@registered(f"""WITH {CRITERIA}, w AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, n, unnest(c) AS k FROM picked), range(-3, 4) AS d(d), LATERAL (SELECT k + d AS line) WHERE line BETWEEN 1 AND n)
    SELECT doc_id, count(*) AS n_lines, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS included FROM w GROUP BY doc_id""")
def window_slice(spark, sf_dir):
    w = criteria(spark, sf_dir).select("doc_id", ln.window_lines(F.col("n"), F.col("c"), 3).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_lines"), joined("w").alias("included"))


ISLANDS = """SELECT user_id, island, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (
    SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (
        SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 50 THEN 1 ELSE 0 END AS new FROM events))
    GROUP BY user_id, island"""


@registered(f"SELECT user_id, CAST(island AS BIGINT) AS island, n, first_event, last_event FROM ({ISLANDS})")
def criteria_clusters(spark, sf_dir):
    e = ln.islands(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50)
    return e.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@registered(f"""WITH {LINES}, k AS (SELECT doc_id, line, line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS gap FROM lines WHERE len(code) >= 40)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gap > 2) AS n_separators FROM k GROUP BY doc_id""")
def separator_gaps(spark, sf_dir):
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.length(x) >= 40, i)), lambda i: i.isNotNull())
    k = table(spark, sf_dir, "documents").select("doc_id", kept.alias("k")).filter(F.size("k") > 0)
    gaps = F.zip_with(F.slice("k", F.lit(1), F.size("k") - 1), F.slice("k", F.lit(2), F.greatest(F.size("k") - 1, F.lit(0))), lambda a, b: b - a)
    return k.select("doc_id", F.size("k").cast("long").alias("n_lines"), F.size(F.filter(gaps, lambda g: g > 2)).cast("long").alias("n_separators"))


@registered("""WITH p AS (SELECT conv_id, turn, role, role || ':' || string_split(coalesce(text, ''), ' ')[1] AS pattern FROM conversations)
    SELECT conv_id, turn, pattern FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pattern ORDER BY turn) AS r FROM p) WHERE r <= 1""")
def keep_first_k_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.split(F.coalesce("text", F.lit("")), " ")[0]).alias("pattern"))
    r = F.row_number().over(W.partitionBy("conv_id", "pattern").orderBy("turn"))
    return p.withColumn("r", r).filter("r <= 1").select("conv_id", "turn", "pattern")


@registered("""SELECT p.event_id, p.user_id, max(c.event_id) AS last_click FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.event_id < p.event_id
    WHERE p.event_type = 'purchase' GROUP BY ALL""")
def asof_last_def(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ln.last_before(e, ["user_id"], "event_id", F.col("event_type") == "click", "event_id", "last_click").filter("event_type = 'purchase'").select("event_id", "user_id", "last_click")


def accesses(spark, sf_dir):
    """Events as a text's accesses: a user is a text and a variable, signups define, clicks take an address, errors follow it, all others use."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "def").when(F.col("event_type") == "click", "address").when(F.col("event_type") == "error", "deref").otherwise("use")
    return e.select("user_id", F.col("user_id").cast("string").alias("var_name"), F.col("event_id").alias("idx"), F.col("event_id").alias("line"), F.lit(0).alias("col"), kind.alias("access_type"))


@registered("""SELECT d.event_id AS def_id, u.event_id AS use_id, d.user_id FROM events d JOIN events u ON u.user_id = d.user_id AND u.event_id >= d.event_id
    WHERE d.event_type = 'signup' AND u.event_type <> 'signup'""")
def def_use_pairs(spark, sf_dir):
    return gr.def_use_chains(accesses(spark, sf_dir), "user_id").select(F.col("def_idx").alias("def_id"), F.col("use_idx").alias("use_id"), "user_id")


@registered("""SELECT u.event_id AS use_id, count(*) AS n_definitions, min(d.event_id) AS first_definition FROM events d JOIN events u ON u.user_id = d.user_id AND d.event_id <= u.event_id
    WHERE d.event_type = 'signup' AND u.event_type <> 'signup' GROUP BY u.event_id""")
def all_reaching_definitions(spark, sf_dir):
    found = gr.all_reaching(accesses(spark, sf_dir), "user_id")
    return found.groupBy(F.col("to_idx").alias("use_id")).agg(F.count(F.lit(1)).alias("n_definitions"), F.min("from_idx").alias("first_definition"))


@registered("""SELECT user_id, max(d) AS from_id, u AS to_id FROM (SELECT u.user_id, u.event_id AS u, d.event_id AS d FROM events u JOIN events d ON d.user_id = u.user_id AND d.event_id < u.event_id
    WHERE d.event_type = 'signup' AND u.event_type <> 'signup') GROUP BY user_id, u""")
def reaching_edges(spark, sf_dir):
    found = gr.reaching_definitions(accesses(spark, sf_dir), "user_id")
    return found.select("user_id", F.col("from_idx").alias("from_id"), F.col("to_idx").alias("to_id"))


@registered("""SELECT a.event_id AS address_id, d.event_id AS deref_id FROM events a JOIN events d ON a.user_id = d.user_id AND d.event_id > a.event_id
    WHERE a.event_type = 'click' AND d.event_type = 'error'""")
def pointer_flow_theta(spark, sf_dir):
    return gr.pointer_flow(accesses(spark, sf_dir), "user_id").select(F.col("from_idx").alias("address_id"), F.col("to_idx").alias("deref_id"))


@registered("""WITH b AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id), m AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant')
    SELECT b.conv_id, lo, hi, count(m.turn) AS n_inside FROM b LEFT JOIN m ON m.conv_id = b.conv_id AND m.turn BETWEEN lo + 1 AND hi - 1 GROUP BY ALL""")
def interval_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    b = c.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    m = c.filter("role = 'assistant'").select("conv_id", "turn").distinct()
    both = b.join(m, "conv_id", "left")
    inside = F.col("turn").between(F.col("lo") + 1, F.col("hi") - 1)
    return both.groupBy("conv_id", "lo", "hi").agg(F.count_if(inside).alias("n_inside"))


#: Customers and orders share one space of numbers, so that some orders lead on to further ones.
EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders)"


def order_edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()


@registered(f"""WITH RECURSIVE {EDGES}, walk(seed, node, distance) AS (
    SELECT DISTINCT src, src, 0 FROM edges
    UNION SELECT seed, dst, distance + 1 FROM walk JOIN edges ON src = node WHERE distance < 4)
    SELECT seed, node, min(distance) AS distance FROM walk GROUP BY seed, node""")
def reachability_bounded(spark, sf_dir):
    e = order_edges(spark, sf_dir)
    return ln.reachable(e, e.select(F.col("src").alias("seed")).distinct(), 4)


@registered(f"""WITH RECURSIVE {EDGES}, walk(seed, node, distance) AS (
    SELECT DISTINCT dst, dst, 0 FROM edges
    UNION SELECT seed, src, distance + 1 FROM walk JOIN edges ON dst = node WHERE distance < 3)
    SELECT seed, node, min(distance) AS distance FROM walk WHERE node IN (SELECT dst FROM edges) AND node <> seed GROUP BY seed, node""")
def backward_walk_to_control(spark, sf_dir):
    """Against the edges, of all nodes met only those that are themselves led to (the control nodes) stay."""
    e = order_edges(spark, sf_dir)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = ln.reachable(back, back.select(F.col("src").alias("seed")).distinct(), 3).filter("node <> seed")
    return met.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("seed", "node", "distance")


@registered(f"""WITH {EDGES}, e AS (SELECT src AS node, NULL AS b, dst AS a FROM edges UNION ALL SELECT dst, src, NULL FROM edges) SELECT node, count(DISTINCT b) AS n_before, count(DISTINCT a) AS n_after FROM e GROUP BY node""")
def edge_neighbours(spark, sf_dir):
    return gr.neighbours(order_edges(spark, sf_dir))


BLOCKS = """b AS (SELECT conv_id, role, min(turn) AS first, max(turn) AS last, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS block FROM conversations GROUP BY conv_id, role)"""


def role_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).alias("block")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


@registered(f"WITH {BLOCKS}, m AS (SELECT conv_id, block, min(first) AS first, max(last) AS last FROM b GROUP BY ALL) SELECT c.conv_id, c.turn AS node, m.block FROM conversations c JOIN m ON m.conv_id = c.conv_id AND c.turn >= m.first AND c.turn <= m.last")
def contained_statements(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), F.col("turn").alias("start"), F.col("turn").alias("end"))
    return gr.inside(s, role_blocks(spark, sf_dir), "conv_id").select("conv_id", "node", "block")


@registered(f"WITH {BLOCKS}, m AS (SELECT conv_id, block, min(first) AS first, max(last) AS last FROM b GROUP BY ALL) SELECT c.conv_id, c.turn AS line, max(m.block) AS block FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN m ON m.conv_id = c.conv_id AND c.turn BETWEEN m.first AND m.last GROUP BY ALL")
def line_to_block(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line")).distinct()
    return gr.last_block(lines, role_blocks(spark, sf_dir), "conv_id")


@registered(f"""WITH {BLOCKS}, m AS (SELECT conv_id, block, min(first) AS first, max(last) AS last FROM b GROUP BY ALL), o AS (SELECT c.conv_id, c.turn, m.block, m.last - m.first AS size FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN m ON m.conv_id = c.conv_id AND c.turn BETWEEN m.first AND m.last)
    SELECT conv_id, turn AS line, count(*) AS n_nodes, (min(size * 10 + block) % 10) AS node FROM o GROUP BY ALL""")
def enclosing_nodes(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line")).distinct()
    nodes = role_blocks(spark, sf_dir).select("conv_id", F.col("block").alias("node"), F.col("first").alias("start"), F.col("last").alias("end"))
    return gr.enclosing(lines, nodes, "conv_id").select("conv_id", "line", "n_nodes", F.col("node").cast("long").alias("node"))


@registered("SELECT DISTINCT n.n_nationkey AS node FROM nation n WHERE n.n_nationkey NOT IN (SELECT n_regionkey FROM nation)")
def leaf_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("tree"), F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent"))
    return gr.leaves(n, "tree").select("node")


@registered("""SELECT o_orderkey, c_custkey, n_name, r_name, 3 AS depth FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def parent_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = o.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return up.select("o_orderkey", "c_custkey", "n_name", "r_name", F.lit(3).alias("depth"))


@registered("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, CAST(floor(value) AS BIGINT) AS dst FROM events),
    t(node) AS (SELECT DISTINCT src FROM e WHERE src < 5 UNION SELECT dst FROM t JOIN e ON src = node) SELECT node FROM t""")
def taint_fixpoint(spark, sf_dir):
    """Every event is an edge; the sources of taint are the users below 5."""
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.floor("value").cast("long").alias("dst")).distinct()
    return ln.closure(edges, edges.filter("src < 5").select(F.col("src").alias("node")))


@registered("""SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_alloc, count(*) FILTER (event_type = 'purchase') AS n_free FROM events GROUP BY user_id
    HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') = 0""")
def alloc_without_free(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("n_alloc"), F.count_if(F.col("event_type") == "purchase").alias("n_free"))
    return n.filter("n_alloc > 0 and n_free = 0")


@registered(f"""WITH {LINES}, s AS (SELECT doc_id, line, len(code) / 10.0::DOUBLE AS w FROM lines WHERE code <> ''),
    r AS (SELECT *, round(w / max(w) OVER (PARTITION BY doc_id), 6) AS importance, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, line) AS rank FROM s)
    SELECT doc_id, line, importance, rank FROM r WHERE rank <= 3 AND (importance >= 0.5 OR rank = 1)""")
def topk_lines(spark, sf_dir):
    s = ln.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text").filter("code <> ''").select("doc_id", "line", (F.length("code") / 10.0).alias("w"))
    mine = W.partitionBy("doc_id")
    r = s.withColumn("importance", F.round(F.col("w") / F.max("w").over(mine), 6)).withColumn("rank", F.row_number().over(mine.orderBy(F.desc("w"), "line")))
    return r.filter("rank <= 3 and (importance >= 0.5 or rank = 1)").select("doc_id", "line", "importance", "rank")


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
