"""The engine's operators over the supplied tables, each with its SQL twin.

The tables hold no source code, so their columns stand in for it: an order is a file or class, its line items are
statements or members, and so on. Each query calls the operator that serves source code, with its real parameters
unless a comment says otherwise; the parser's own queries are in plans.golden. loose_files and coverage_json_explode are
plain analogues, which call no operator: that of loose files runs in golden, coverage.statements in coverage_documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import crap, gates, profile
from ..sources import coverage, gitstatus
from ..streaming import timings as stream
from . import golden

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """An order is a method in a file of its own; its items are the file's statements."""
    m = read(spark, d, "orders").selectExpr(
        "o_orderkey AS file", "o_orderkey AS method_id", "CAST(1 + o_orderkey % 4 AS INT) AS start_line",
        "CAST(2 + o_orderkey % 4 + o_custkey % 2 AS INT) AS end_line", "CAST(1 + o_custkey % 12 AS INT) AS complexity",
    )
    s = read(spark, d, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber AS start_line", "CAST(l_linenumber + CAST(l_quantity AS INT) % 3 AS INT) AS end_line", "CAST(l_returnflag <> 'N' AS INT) AS hits")
    return crap.crap_metrics(m, s, ["file"])


_METRICS_SQL = """
WITH m AS (SELECT o_orderkey AS file, CAST(1 + o_orderkey % 4 AS INT) AS start_line, CAST(2 + o_orderkey % 4 + o_custkey % 2 AS INT) AS end_line, CAST(1 + o_custkey % 12 AS INT) AS complexity FROM orders),
s AS (SELECT l_orderkey AS file, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INT) % 3 AS b, CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS hit FROM lineitem),
c AS (SELECT m.file, start_line, complexity, CAST(sum(hit) AS DOUBLE) / nullif(count(s.file), 0) AS coverage
      FROM m LEFT JOIN s ON s.file = m.file AND s.b >= m.start_line AND s.a <= m.end_line GROUP BY 1, 2, 3),
k AS (SELECT *, CAST(complexity AS DOUBLE) AS c, 1e0 - coverage AS u FROM c),
r AS (SELECT file, start_line, complexity, coverage, c * c * u * u * u + c AS crap_score FROM k)
"""


@query(_METRICS_SQL + "SELECT * FROM r")
def crap_ranking(spark: SparkSession, d: str) -> DataFrame:
    return crap.ranked(_metrics(spark, d), "file", "start_line").select("file", "start_line", "complexity", "coverage", "crap_score")


@query(_METRICS_SQL + "SELECT count(*) AS methods, greatest(coalesce(max(crap_score), 0e0), 0e0) AS max_crap, count(*) FILTER (crap_score > 8e0) AS over_threshold, greatest(coalesce(max(crap_score), 0e0), 0e0) > 8e0 AS failed FROM r")
def crap_max_verdict(spark: SparkSession, d: str) -> DataFrame:
    return crap.verdict(_metrics(spark, d))


def _timings(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", "user_id", profile.micros(F.col("value")).alias("micros"))
    return profile.timings(e, ["event_type", "user_id"])


_TIMINGS_SQL = """
WITH e AS (SELECT event_type, user_id, CAST(greatest(0, floor(value * 1000 + 0.5e0)) AS BIGINT) AS micros FROM events),
t AS (SELECT event_type, user_id, count(*) AS calls, CAST(sum(micros) AS BIGINT) AS total_micros, min(micros) AS min_micros, max(micros) AS max_micros FROM e GROUP BY 1, 2)
"""


@query(_TIMINGS_SQL + "SELECT * FROM t")
def timing_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _timings(spark, d)


@query(_TIMINGS_SQL + "SELECT event_type AS file, CAST(user_id AS VARCHAR) AS method, calls, total_micros, min_micros, max_micros FROM t")
def timing_stream(spark: SparkSession, d: str) -> DataFrame:
    """The running timings after all events have come in as files of a stream, in several batches."""
    where, name = f"{spark.conf.get('spark.sql.warehouse.dir')}/_stream-{uuid.uuid4().hex}", f"timings_{uuid.uuid4().hex}"
    e = read(spark, d, "events").select(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("method"), profile.micros(F.col("value")).alias("micros"))
    e.repartition(3).write.json(f"{where}/in")
    q = stream.start(stream.events(spark, f"{where}/in", 1), name, f"{where}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.table(name)


@query("WITH e AS (SELECT event_type, user_id, user_id % 4 AS process, CAST(greatest(0, floor(value * 1000 + 0.5e0)) AS BIGINT) AS micros FROM events) SELECT event_type, count(*) AS calls, CAST(sum(micros) AS BIGINT) AS total_micros, min(micros) AS min_micros, max(micros) AS max_micros FROM e GROUP BY 1")
def timing_merge(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("process"), profile.micros(F.col("value")).alias("micros"))
    return profile.merged(profile.timings(e, ["event_type", "process"]), ["event_type"])


_PROFILE_SQL = _TIMINGS_SQL + """, p AS (SELECT *, total_micros / CAST((SELECT sum(total_micros) FROM t) AS DOUBLE) * 100 AS pct, total_micros / CAST(calls AS DOUBLE) AS mean_micros FROM t)
"""


@query(_PROFILE_SQL + "SELECT event_type, user_id, calls, total_micros, pct, mean_micros, mean_micros < 30 AS noisy FROM p ORDER BY total_micros DESC, event_type, user_id LIMIT 20")
def profile_share_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.profiled(_timings(spark, d))
    return profile.hottest(rows, 20, "event_type", "user_id").select("event_type", "user_id", "calls", "total_micros", "pct", "mean_micros", "noisy")


@query(_TIMINGS_SQL + "SELECT count(*) AS methods, CAST(sum(total_micros) AS BIGINT) AS total_micros, count(*) FILTER (total_micros / 1000e0 > 1000) AS over_threshold FROM t")
def profile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return profile.over_threshold(_timings(spark, d), 1000.0)


@query(_TIMINGS_SQL + ", i AS (SELECT DISTINCT c_mktsegment AS method, c_nationkey AS line, c_custkey % 50 AS user_id, (['click', 'view', 'purchase'])[1 + c_custkey % 3] AS event_type FROM customer) SELECT method, line, event_type, user_id, calls, total_micros FROM i JOIN t USING (event_type, user_id)")
def profile_attribution(spark: SparkSession, d: str) -> DataFrame:
    inventory = read(spark, d, "customer").selectExpr("c_mktsegment AS method", "c_nationkey AS line", "c_custkey % 50 AS user_id", "element_at(array('click', 'view', 'purchase'), CAST(1 + c_custkey % 3 AS INT)) AS event_type").distinct()
    return profile.attributed(_timings(spark, d), inventory, ["event_type", "user_id"]).select("method", "line", "event_type", "user_id", "calls", "total_micros")


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def unused_files_anti(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return gates.never_imported(read(spark, d, "orders").select("o_orderkey"), used, ["o_orderkey"])


_RULES = [("**", "https://*/**", None), ("**", "http*://*.example.org/**", "no org"), ("**", "**/fr/*", "no fr"), ("**", "http://m.*/**", None)]


@query("""
WITH r(ord, re) AS (VALUES (0, '^https://[^/]*/.*$'), (1, '^http[^/]*://[^/]*\\.example\\.org/.*$'), (2, '^(?:.*/)?fr/[^/]*$'), (3, '^http://m\\.[^/]*/.*$'))
SELECT page_id, CAST(min(ord) AS INT) AS rule FROM pages JOIN r ON regexp_matches(url, re) GROUP BY 1
""")
def banned_first_match(spark: SparkSession, d: str) -> DataFrame:
    rules = [(paths.glob_pattern(a), paths.glob_pattern(b), note) for a, b, note in _RULES]
    return gates.banned(read(spark, d, "pages").select("page_id", "url"), rules, F.col("url"), [F.col("url")]).select("page_id", "rule")


@query("""
WITH listing AS (SELECT o_orderkey AS k FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey), i AS (SELECT DISTINCT o_custkey AS spec FROM orders),
c AS (SELECT spec, unnest(range(0, 10)) AS j FROM i)
SELECT i.spec, min(spec10.k) AS resolved FROM i LEFT JOIN (SELECT c.spec, k FROM c JOIN listing ON k = c.spec * 10 + j) spec10 ON spec10.spec = i.spec GROUP BY 1
""")
def import_resolution_first_hit(spark: SparkSession, d: str) -> DataFrame:
    listing = unused_files_anti(spark, d).select(F.lit(0).alias("project"), F.col("o_orderkey").alias("path"))
    imports = read(spark, d, "orders").select(F.lit(0).alias("project"), F.col("o_custkey").alias("import_id")).distinct()
    candidates = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("import_id") * 10 + i)
    return gates.resolved(imports, listing, ["project", "import_id"], ["project"], candidates, "path").select(F.col("import_id").alias("spec"), "resolved")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents), n AS (SELECT doc_id, value, count(*) AS occurrences FROM l WHERE length(value) >= 4 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT doc_id, value, occurrences FROM l JOIN n USING (doc_id, value)
""")
def magic_repeats(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value")).filter(paths.utf16_length(F.col("value")) >= gates.MIN_LITERAL)
    return gates.repeated(lines, ["doc_id", "value"]).select("doc_id", "value", "occurrences")


@query("""
WITH t AS (SELECT c_custkey, count(o_orderkey) AS methods, coalesce(sum(1 + o_orderkey % 4), 0) AS wmc FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, c_custkey || ' has ' || methods || ' methods > max 15' AS message FROM t WHERE methods > 15
UNION ALL SELECT c_custkey, c_custkey || ' WMC=' || wmc || ' > max 30' FROM t WHERE wmc > 30
""")
def class_size(spark: SparkSession, d: str) -> DataFrame:
    # limits 15 and 30: no customer has as many orders as the real ones ask for
    members = read(spark, d, "orders").filter("o_orderstatus <> 'P'").selectExpr("o_custkey AS c_custkey", "1 + o_orderkey % 4 AS complexity")
    totals = gates.class_totals(read(spark, d, "customer").select("c_custkey"), members, ["c_custkey"])
    return gates.class_size(totals, F.col("c_custkey").cast("string"), 15, 30).select("c_custkey", "message")


@query("""
WITH w AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS fields, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS members FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, fields, members, fields / CAST(members AS DOUBLE) AS weight FROM w WHERE fields > 0 AND fields / CAST(members AS DOUBLE) > 0.33e0
""")
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderstatus")
    w = gates.class_weight(read(spark, d, "customer").select("c_custkey"), members, ["c_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return gates.data_heavy(w)


@query("WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS name FROM documents) SELECT doc_id, name FROM t GROUP BY 1, 2 HAVING count(*) = 1")
def unused_code_count1(spark: SparkSession, d: str) -> DataFrame:
    tokens = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("name"))
    return gates.unreferenced(tokens.distinct(), tokens, ["doc_id", "name"])


@query("""
WITH n AS (SELECT l_orderkey, max(l_linenumber) AS nesting FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'order ' || l_orderkey || ' nesting=' || nesting || ' > max 5' AS message FROM n WHERE nesting > 5
""")
def nesting_max_depth(spark: SparkSession, d: str) -> DataFrame:
    """An order is a function as deep as its last line's number."""
    depth = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("nesting"))
    return gates.nesting(depth.withColumn("name", F.concat(F.lit("order "), "l_orderkey"))).select("l_orderkey", "message")


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS assertions FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey")
def test_assertions_missing(spark: SparkSession, d: str) -> DataFrame:
    flagged = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return gates.without_assertions(read(spark, d, "orders").select("o_orderkey"), flagged, ["o_orderkey"])


_NAMES = ["src/utils.js", "src/helpers.js", "src/misc.ts", "src/batch1.js", "src/report2.jsx", "src/day_1.mjs", "src/base64.js", "src/sha256.ts", "src/utf8.js", "src/oauth2.js", "src/a.b1.js", "src/.dot1.js", "src/Utils.JS", "src/orders.js"]


@query("""
WITH p AS (SELECT source || '.js' AS rel_path FROM documents UNION ALL SELECT unnest([%s])),
s AS (SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS base FROM p), t AS (SELECT *, lower(regexp_replace(base, '(.)\\.[^.]*$', '\\1')) AS stem FROM s)
SELECT rel_path, CASE WHEN stem IN ('utils', 'helpers', 'misc') THEN 'generic name "' || base || '" — split by domain instead of accumulating unrelated declarations'
  ELSE 'numeric suffix in "' || base || '" — split by domain instead of numbered parts (batch1, part2, v2 ...)' END AS message
FROM t WHERE stem IN ('utils', 'helpers', 'misc') OR (regexp_matches(stem, '[a-z_][0-9]+$') AND stem NOT IN ('base64', 'sha256', 'utf8', 'oauth2'))
""" % ", ".join(f"'{n}'" for n in _NAMES))
def naming_violations(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.concat("source", F.lit(".js")).alias("rel_path"))
    return gates.naming(files.union(spark.createDataFrame([(n,) for n in _NAMES], "rel_path string"))).select("rel_path", "message")


_STATUS = ["", "??", "abc", "M  src/notes.txt", "M  lib/x.js", "D  src/gone.js", "M  src/a.js", "?? src/b.js", " M src/x.js", "A  src/sub/c.mjs", "C  src/sub/d.cjs", "R  src/old.js -> src/new.js", "M  src/a.test.js"]


@query("SELECT n_name, p AS rel_path FROM nation, (SELECT unnest(['src/a.js', 'src/b.js', 'src/x.js', 'src/sub/c.mjs', 'src/sub/d.cjs', 'src/new.js']) AS p)")
def status_line_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "nation").select("n_name", F.explode(F.array(*(F.lit(s) for s in _STATUS))).alias("line"))
    return gitstatus.changed(lines, ["n_name"])


@query("""
WITH s AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)
SELECT len(parts) AS depth, count(*) AS files FROM s GROUP BY 1
""")
def loose_files(spark: SparkSession, d: str) -> DataFrame:
    parts = F.size(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"))
    return read(spark, d, "pages").groupBy(parts.cast("long").alias("depth")).agg(F.count("*").alias("files"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def coverage_json_explode(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string, bigint>")
    return read(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 3 AS span, CAST(l_returnflag <> 'N' AS INT) AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag) AS i FROM lineitem)
SELECT 'src/' || l_orderkey || '.js' AS rel_path, CAST(i AS VARCHAR) AS stmt_id, l_linenumber AS start_line, CAST(l_linenumber + span AS INT) AS end_line, CAST(hit AS BIGINT) AS hits FROM s
""")
def coverage_documents(spark: SparkSession, d: str) -> DataFrame:
    """Statements of coverage documents, one JSON text for each order."""
    return _covered(read(spark, d, "lineitem"))


def _covered(items: DataFrame) -> DataFrame:
    w = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_returnflag)")
    s = items.withColumn("i", w.cast("string"))
    statement = F.expr("struct(struct(l_linenumber AS line, 0 AS column) AS start, struct(CAST(l_linenumber + CAST(l_quantity AS INT) % 3 AS INT) AS line, 1 AS column) AS end)")
    made = s.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("i", statement))).alias("statementMap"), F.map_from_entries(F.collect_list(F.struct("i", F.expr("CAST(l_returnflag <> 'N' AS INT)")))).alias("s")
    )
    text = made.select(F.to_json(F.create_map(F.concat(F.lit("/work/p/src/"), "l_orderkey", F.lit(".js")), F.struct("statementMap", "s"))).alias("value"))
    return coverage.statements(text, "/work/p").select("rel_path", "stmt_id", "start_line", "end_line", "hits")


for _name, (_run, _sql) in golden.REGISTERED.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql
