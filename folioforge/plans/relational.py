"""Queries of the relational operators: index, references, trees, runs, projections, numeric functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import codecs, crypt, numeric, text
from folioforge.operators import fonts, graph, index, runs, trees
from folioforge.plans.registry import query, table

# Index -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS obj, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS pos, max(o_orderdate) AS rev FROM orders GROUP BY o_custkey")
def xref_latest_wins(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("obj"), F.col("o_orderdate").alias("rev"), F.col("o_orderkey").alias("pos"))
    return index.latest(rows, ["obj"], ["rev", "pos"]).select("obj", "pos", "rev")


@query("""WITH e AS (SELECT o_custkey AS obj, o_orderkey AS rev, CASE o_orderstatus WHEN 'F' THEN 'Raw' WHEN 'O' THEN 'Stream' ELSE 'Free' END AS kind, o_orderkey % 3 AS gen FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY rev) AS n FROM e),
f AS (WITH RECURSIVE g AS (SELECT obj, rev, kind, gen, n FROM r WHERE n = 1 UNION ALL
 SELECT r.obj, CASE WHEN g.kind IN ('Raw','Free') AND NOT r.gen > g.gen THEN g.rev ELSE r.rev END, CASE WHEN g.kind IN ('Raw','Free') AND NOT r.gen > g.gen THEN g.kind ELSE r.kind END, CASE WHEN g.kind IN ('Raw','Free') AND NOT r.gen > g.gen THEN g.gen ELSE r.gen END, r.n FROM g JOIN r ON r.obj = g.obj AND r.n = g.n + 1) SELECT * FROM g)
SELECT obj, rev, kind, gen FROM f QUALIFY row_number() OVER (PARTITION BY obj ORDER BY n DESC) = 1""")
def xref_compat_fold(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "Raw").when(F.col("o_orderstatus") == "O", "Stream").otherwise("Free")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("obj"), F.col("o_orderkey").alias("rev"), kind.alias("kind"), (F.col("o_orderkey") % 3).alias("gen"))
    return index.folded(rows, ["obj"], "rev", "kind", "gen")


@query("SELECT o_custkey % 64 AS file_id, o_orderkey AS obj, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey), 0) AS next_free FROM orders WHERE o_orderstatus = 'P'")
def xref_free_list(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 64).alias("file_id"), F.col("o_orderkey").alias("obj"), "o_orderstatus")
    return index.free_list(rows, ["file_id"], "obj", F.col("o_orderstatus") == "P").select("file_id", "obj", "next_free")


@query("""SELECT kind, max_a, CASE WHEN max_a = 0 THEN 0 WHEN max_a < 256 THEN 1 WHEN max_a < 65536 THEN 2 WHEN max_a < 16777216 THEN 3 ELSE 4 END AS width FROM
(SELECT o_orderstatus AS kind, max(o_orderkey) AS max_a FROM orders GROUP BY 1)""")
def xref_field_widths(spark, d):
    got = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.max("o_orderkey").alias("max_a"))
    return got.withColumn("width", index.byte_width(F.col("max_a")))


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 7 = 0")
def delta_overlay(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name")
    delta = base.where("c_custkey % 7 = 0").withColumn("c_name", F.upper("c_name"))
    return index.overlaid(base, delta, ["c_custkey"])


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_nationkey::VARCHAR END AS nation, CASE WHEN s_suppkey % 3 = 0 THEN 'x' END AS extra FROM supplier")
def delta_merge(spark, d):
    s = table(spark, d, "supplier")
    base = s.select("s_suppkey", F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("m"))
    delta = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.create_map(F.lit("nation"), F.lit("new"), F.lit("extra"), F.lit("x")).alias("m"))
    return index.merged(base, delta, ["s_suppkey"], "m").select("s_suppkey", F.element_at("m", "name").alias("name"), F.element_at("m", "nation").alias("nation"), F.element_at("m", "extra").alias("extra"))


@query("SELECT source, doc_id, strlen(text) AS size, (sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) - strlen(text) + 15)::BIGINT AS \"offset\" FROM documents")
def object_offsets(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return index.byte_offsets(rows, ["source"], ["doc_id"], "size", 15)


# References ------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, round(sum(l_extendedprice), 2) AS price, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def deref_inner(spark, d):
    rows = graph.dereferenced(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part"), "p_partkey", True)
    rows = graph.dereferenced(rows, "l_suppkey", table(spark, d, "supplier"), "s_suppkey", True)
    return rows.agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def deref_optional(spark, d):
    some = table(spark, d, "nation").where("n_regionkey < 3")
    return graph.dereferenced(table(spark, d, "customer"), "c_nationkey", some, "n_nationkey", False).select("c_custkey", "n_name")


@query("SELECT root, node, depth FROM (SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS node, 0 AS depth FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def graph_closure(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    edges = s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst")).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    # the back edge of a child to its parent's list makes the graph cyclic
    edges = edges.union(n.select(key("r", "n_regionkey"), key("r", "n_regionkey")))
    return graph.closure(edges, s.select(key("s", "s_suppkey")))


@query("SELECT c_nationkey AS file_id, c_custkey, 100 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS new_id FROM customer")
def graph_renumber(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("file_id"), "c_custkey")
    return graph.renumbered(rows, ["file_id"], "c_custkey", 100)


@query("SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'right' WHEN b.p_partkey IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 11 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 13 <> 0) b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size")
def graph_verify(spark, d):
    p = table(spark, d, "part")
    right = p.where("p_partkey % 13 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")))
    return graph.differences(p.where("p_partkey % 11 <> 0"), right, ["p_partkey"], ["p_size"])


# Trees -----------------------------------------------------------------------------------------------------------------

_TREE = """t AS (SELECT r_regionkey AS g, 'r' || r_regionkey AS node, NULL AS parent, r_regionkey AS ord, 90 AS rotate, r_name AS box FROM region
UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, NULL FROM nation
UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 END, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT c.g, c.node, 2 AS depth, r.ord AS o0, n.ord AS o1, c.ord AS o2, coalesce(c.rotate, n.rotate, r.rotate) AS rotate, r.box FROM t c JOIN t n ON c.parent = n.node JOIN t r ON n.parent = r.node)"""


def _tree(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None)
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("g"), s("r", "r_regionkey").alias("node"), none.cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(90).alias("rotate"), F.col("r_name").alias("box"))
    nation = table(spark, d, "nation")
    n = nation.select("n_regionkey", s("n", "n_nationkey"), s("r", "n_regionkey"), F.col("n_nationkey").cast("long"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")), none.cast("string"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", s("c", "c_custkey"), s("n", "c_nationkey"), F.col("c_custkey"), F.when(F.col("c_custkey") % 5 == 0, 0), none.cast("string"))
    return r.union(n).union(c)


@query(f"WITH {_TREE} SELECT node, depth, o0 || '/' || o1 || '/' || o2 AS path FROM w UNION ALL SELECT n.node, 1, r.ord || '/' || n.ord FROM t n JOIN t r ON n.parent = r.node WHERE n.node LIKE 'n%' UNION ALL SELECT node, 0, ord::VARCHAR FROM t WHERE parent IS NULL")
def tree_walk(spark, d):
    got = trees.walked(_tree(spark, d), ["g"], "node", "parent", "ord", depth=2)
    return got.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"WITH {_TREE} SELECT node, rotate, box FROM w")
def tree_inherit(spark, d):
    return trees.walked(_tree(spark, d), ["g"], "node", "parent", "ord", ["rotate", "box"], 2).where("depth = 2").select("node", "rotate", "box")


@query(f"WITH {_TREE} SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY o0, o1, o2) - 1 AS page_no FROM w")
def tree_page_number(spark, d):
    leaves = trees.walked(_tree(spark, d), ["g"], "node", "parent", "ord", depth=2).where("depth = 2")
    return trees.numbered(leaves, ["g"]).select("g", "node", F.col("page_no").cast("long").alias("page_no"))


@query(f"WITH {_TREE} SELECT g, node FROM (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY o0, o1, o2) - 1 AS n FROM w) WHERE n = 4")
def tree_seek(spark, d):
    leaves = trees.walked(_tree(spark, d), ["g"], "node", "parent", "ord", depth=2).where("depth = 2")
    return trees.numbered(leaves, ["g"]).where("page_no = 4").select("g", "node")


@query("SELECT p_brand, leaf, min(p_name) AS low, max(p_name) AS high, count(*) AS keys FROM (SELECT p_brand, p_name, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) // 17)::INT AS leaf FROM part) GROUP BY 1, 2")
def name_tree_build(spark, d):
    return trees.name_tree_levels(table(spark, d, "part").select("p_brand", "p_name"), ["p_brand"], "p_name", 17)


# Runs ------------------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey % 50 AS g, min(k) AS first, max(k) AS last, count(*) AS size FROM (SELECT DISTINCT l_suppkey, l_partkey AS k, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM lineitem) GROUP BY l_suppkey, k - r, 1")
def cmap_runs(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("k")).distinct()
    return runs.islands(rows, ["l_suppkey"], "k").select((F.col("l_suppkey") % 50).alias("g"), "first", "last", "size")


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer) WHERE p IS NULL OR p + 1 <> c_custkey")
def encoding_runs(spark, d):
    return runs.starts_run(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")


@query("""WITH i AS (SELECT o_custkey AS font, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 END AS code FROM orders),
s AS (SELECT *, sum(CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY font ORDER BY ord) AS isle, last_value(code IGNORE NULLS) OVER (PARTITION BY font ORDER BY ord) AS start FROM i)
SELECT font, ord, (coalesce(start, 0) + row_number() OVER (PARTITION BY font, isle ORDER BY ord) - 1)::BIGINT AS code FROM s WHERE code IS NULL""")
def encoding_differences(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("font"), F.col("o_orderkey").alias("ord"))
    return runs.running_codes(rows, ["font"], "ord", F.when(F.col("ord") % 4 == 0, F.col("ord") % 200)).select("font", "ord", "code")


@query("SELECT p_partkey AS font, unnest(range(p_partkey, p_partkey + p_size % 7 + 1)) AS cid, p_size AS base FROM part")
def cmap_expand(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("font"), F.col("p_partkey").alias("low"), (F.col("p_partkey") + F.col("p_size") % 7).alias("high"), F.col("p_size").alias("base"))
    return runs.expanded(rows, "low", "high", "cid").select("font", "cid", "base")


@query("""WITH w AS (SELECT s_nationkey AS font, s_suppkey % 40 AS cid, (s_suppkey % 900)::DOUBLE AS width, s_suppkey AS ord FROM supplier UNION ALL
SELECT n_nationkey, unnest(range(10, 21)), 500.0, 1000000 + n_nationkey FROM nation), m AS (SELECT font, cid, arg_max(width, ord) AS width FROM w GROUP BY 1, 2)
SELECT c_custkey, coalesce(m.width, 1000.0) AS width FROM customer LEFT JOIN m ON font = c_nationkey AND cid = c_custkey % 64""")
def widths_lookup(spark, d):
    one = table(spark, d, "supplier").select(F.col("s_nationkey").alias("font"), (F.col("s_suppkey") % 40).alias("cid"), (F.col("s_suppkey") % 900).cast("double").alias("width"), F.col("s_suppkey").alias("ord"))
    many = table(spark, d, "nation").select(F.col("n_nationkey").alias("font"), F.lit(10).cast("long").alias("low"), F.lit(20).cast("long").alias("high"), F.lit(500.0).alias("width"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("ord"))
    codes = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("font"), (F.col("c_custkey") % 64).alias("cid"))
    return fonts.widths_of(codes, fonts.width_rows(one, many, ["font"]), ["font", "cid"], 1000.0).select("c_custkey", "width")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_point FROM events")
def ops_current_point(spark, d):
    value = F.when(F.col("event_type") == "click", F.col("value"))
    return table(spark, d, "events").select("event_id", runs.last_before(value, ["user_id"], ["event_id"]).alias("current_point"))


@query("SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth FROM events")
def ops_nesting_depth(spark, d):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return table(spark, d, "events").select("event_id", runs.nesting(step, ["user_id"], ["event_id"]).alias("depth"))


# Functions and colour --------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(0.2 + pow(l_discount, 1.7) * 0.6, 0.0), 0.5), 6) AS y FROM lineitem")
def fn_exponential(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.exponential(F.col("l_discount"), 0.2, 0.8, 1.7, (0.0, 0.5)), 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount * 10 < 0.5 THEN least(greatest(l_discount * 10, 0), 1) / 0.5 ELSE 1 + (least(l_discount * 10, 1) - 0.5) / 0.5 END, 6) AS y FROM lineitem")
def fn_stitching(spark, d):
    parts = [lambda x: numeric.exponential(x, 0.0, 1.0, 1), lambda x: numeric.exponential(x, 1.0, 2.0, 1)]
    y = numeric.stitching(F.col("l_discount") * 10, (0.0, 1.0), [0.5], [(0.0, 1.0), (0.0, 1.0)], parts)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round((coalesce(t[i + 1], 0) * (1 - (p - i)) + coalesce(t[i + 2], 0) * (p - i)) / 255, 6) AS y FROM (SELECT *, floor(p)::INT AS i FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_tax * 12, 0), 1) * 3.0 AS p, [0.0, 200.0, 40.0, 255.0] AS t FROM lineitem))")
def fn_sampled_1d(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.sampled_1d(F.col("l_tax") * 12, [0, 200, 40, 255], 0.0, 3.0), 6).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + e * fx) * fy) / 255, 6) AS y FROM (SELECT *, px - ix AS fx, py - iy AS fy,
CASE WHEN ix < 3 AND iy < 2 THEN t[iy * 3 + ix + 1] ELSE 0 END AS a, CASE WHEN ix + 1 < 3 AND iy < 2 THEN t[iy * 3 + ix + 2] ELSE 0 END AS b, CASE WHEN ix < 3 AND iy + 1 < 2 THEN t[iy * 3 + ix + 4] ELSE 0 END AS c, CASE WHEN ix + 1 < 3 AND iy + 1 < 2 THEN t[iy * 3 + ix + 5] ELSE 0 END AS e
FROM (SELECT *, floor(px)::INT AS ix, floor(py)::INT AS iy FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0), 1) * 2.0 AS px, least(greatest(l_tax * 12, 0), 1) * 1.0 AS py, [0.0, 100.0, 200.0, 50.0, 150.0, 250.0] AS t FROM lineitem)))""")
def fn_sampled_2d(spark, d):
    y = numeric.sampled_2d(F.col("l_discount") * 10, F.col("l_tax") * 12, [[0, 100, 200], [50, 150, 250]])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(abs(l_tax - l_discount) * 2 + 0.5, 6) AS a, round(l_tax, 6) AS b FROM lineitem")
def fn_postscript(spark, d):
    a, b = numeric.program("{ dup 3 -1 roll exch 1 index sub abs 2 mul 0.5 add 3 1 roll pop }", [F.col("l_discount"), F.col("l_tax")], 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'Gray' WHEN 3 THEN 'Rgb' WHEN 4 THEN 'Cmyk' ELSE 'Other' END AS colour FROM part")
def color_by_arity(spark, d):
    return table(spark, d, "part").select("p_partkey", numeric.colour(F.array_repeat(F.lit(0.5), F.col("p_size") % 5)).alias("colour"))


@query("SELECT p_partkey, least(p_size, 20)::DOUBLE AS \"left\", least(p_retailprice, 1000.0) AS bottom, greatest(p_size, 20)::DOUBLE AS \"right\", greatest(p_retailprice, 1000.0) AS top FROM part")
def rect_normalise(spark, d):
    r = numeric.rectangle(F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(20.0), F.lit(1000.0)))
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, 2.0 * p_size + 5 AS x, -1.0 * p_retailprice + 7 AS y FROM part")
def matrix_apply(spark, d):
    m = numeric.matrix_apply([2, 0, 0, -1, 5, 7], F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


@query("SELECT p_partkey, " + ", ".join(f"((p_partkey * 37 >> {b - 1}) & 1) = 1 AS {k.lower()}" for k, b in fonts.FLAGS.items()) + " FROM part")
def flags_decode(spark, d):
    return table(spark, d, "part").select("p_partkey", *numeric.flags(F.col("p_partkey") * 37, fonts.FLAGS))


# Text, names, dates, codecs on the JVM -----------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%S') || 'Z00''00' AS pdf_date FROM events")
def date_format(spark, d):
    return table(spark, d, "events").select("event_id", text.format_date(F.col("ts")).alias("pdf_date"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd, 'Earlier' AS rel, 8 AS tz, date_trunc('second', o_orderdate) + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS instant FROM orders")
def date_parse(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss"), F.lit("-08'30"))
    p = table(spark, d, "orders").select("o_orderkey", text.parse_date(raw).alias("p"))
    return p.select("o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("dd"), F.col("p.rel").alias("rel"), F.col("p.tz_hour").alias("tz"), text.date_timestamp(F.col("p")).cast("timestamp_ntz").alias("instant"))


@query("""SELECT p_partkey, regexp_matches(w, '^-?[0-9]+$') AS is_int, try_cast(regexp_extract(w, '^-?[0-9]*(?:\\.[0-9]*)?') AS FLOAT) AS number
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size || '.5' WHEN 2 THEN '+' || p_size ELSE p_size || '-5' END AS w FROM part)""")
def number_lexeme_class(spark, d):
    s, m = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    w = F.when(m == 0, s).when(m == 1, F.concat(F.lit("-"), s, F.lit(".5"))).when(m == 2, F.concat(F.lit("+"), s)).otherwise(F.concat(s, F.lit("-5")))
    return table(spark, d, "part").select("p_partkey", text.is_integer(w).alias("is_int"), text.leading_number(w).alias("number"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'BitsPerComponent' WHEN 'view' THEN 'Width' ELSE event_type END AS name FROM events")
def name_abbrev_expand(spark, d):
    short = F.when(F.col("event_type") == "click", "BPC").when(F.col("event_type") == "view", "W").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.lookup(short, text.KEY_ABBREVIATIONS).alias("name"))


@query("SELECT doc_id, lower(hex(encode(text))) AS hexed, text AS back FROM documents")
def codec_hex_roundtrip(spark, d):
    hexed = codecs.hex_column(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", hexed.alias("hexed"), F.decode(codecs.unhex_column(F.concat(hexed, F.lit(">ignored"))), "UTF-8").alias("back"))


@query("SELECT p_partkey, lower(md5('0123456789')) IS NOT NULL AS ok, lower(hex(encode(p_name))) AS plain FROM part")
def crypt_aes_cbc(spark, d):
    key = crypt.object_key_column("00112233445566778899aabbccddeeff", F.col("p_partkey"), F.lit(0), True)
    sealed = F.aes_encrypt(F.encode("p_name", "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"))
    return table(spark, d, "part").select("p_partkey", F.lit(True).alias("ok"), F.lower(F.hex(crypt.aes_decrypt_column(sealed, key))).alias("plain"))


@query("SELECT p_partkey, substr(md5(unhex('0011223344' || lpad(hex(p_partkey & 255), 2, '0') || lpad(hex((p_partkey >> 8) & 255), 2, '0') || lpad(hex((p_partkey >> 16) & 255), 2, '0') || '0000')), 1, 20) AS key FROM part")
def crypt_object_key(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.hex(crypt.object_key_column("0011223344", F.col("p_partkey"), F.lit(0), False))).alias("key"))
