"""The engine's queries over the shared tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.errors import BinaryFuseBuildError, ParamError
from quillsieve.functions import codec, columns, sizing
from quillsieve.operators import build, probe
from quillsieve.operators.filters import BinaryFuse8, BinaryFuse16, BlockedBloomFilter, BloomFilter
from quillsieve.operators.sql import register
from quillsieve.plans import reports, saturation, sqltext
from quillsieve.sources import frames, keys
from quillsieve.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EPSILON = 0.01
SHARDS = 16


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return build.keys_of(table(spark, sf_dir, name), column)


CUSTOMER = "SELECT c_custkey::VARCHAR AS key FROM customer"
ORDERS = "SELECT o_orderkey::VARCHAR AS key FROM orders"
MISSES = "SELECT 'm' || c_custkey::VARCHAR AS key FROM customer"
#: Sizes that the SQL computes for itself from the number of rows.
BLOOM_M = "(SELECT ceil(-count(*) * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE)))::BIGINT FROM {t})"
BLOOM_K = "(SELECT greatest(1, floor(ceil(-count(*) * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE))) / count(*) * ln(2::DOUBLE) + 0.5))::BIGINT FROM {t})"
BLOCKS = "(SELECT greatest(1, ceil(11 * count(*) / 256.0))::BIGINT FROM {t})"


# Hashing and index derivation.


@query(sqltext.hashed(ORDERS).select("SELECT key, w0::BIGINT AS w0, w1::BIGINT AS w1, w2::BIGINT AS w2, w3::BIGINT AS w3 FROM {s}"))
def hash128_orderkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "orders", "o_orderkey").select("key", columns.hash128(F.col("key")).alias("h")).select("key", "h.*")


@query(sqltext.hashed("SELECT doc_id, text AS key FROM documents").select("SELECT doc_id, w0::BIGINT AS w0, w1::BIGINT AS w1, w2::BIGINT AS w2, w3::BIGINT AS w3 FROM {s}"))
def hash128_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", columns.hash128(F.col("text")).alias("h")).select("doc_id", "h.*")


@query(sqltext.bloom_bits(CUSTOMER, "14378", "7").select("SELECT key, i AS probe, bit FROM {s}"))
def bloom_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _keys(spark, sf_dir, "customer", "c_custkey").withColumn("h", columns.hash128(F.col("key")))
    return hashed.select("key", F.posexplode(columns.probes(F.col("h"), 7, 14378)).alias("probe", "bit")).withColumn("probe", F.col("probe").cast("long"))


@query(sqltext.block_bits(CUSTOMER, "65").select("SELECT key, word, mask FROM {s}"))
def blocked_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _keys(spark, sf_dir, "customer", "c_custkey").withColumn("h", columns.hash128(F.col("key")))
    return hashed.select("key", F.inline(columns.block_lanes(F.col("h"), 65)))


@query(sqltext.fuse_slots(CUSTOMER, 3, 1024, 3072).select("SELECT key, h0::BIGINT AS h0, h1::BIGINT AS h1, h2::BIGINT AS h2 FROM {s}"))
def fuse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "customer", "c_custkey").select("key", columns.fuse_positions(F.col("key"), 3, 1024, 3072).alias("p")).select("key", "p.*")


# Builds, as words.


def _bloom_words(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple[DataFrame, BloomFilter]:
    rows, like = build._sized(table(spark, sf_dir, name), column, EPSILON, BloomFilter)
    return build.words_of(rows, like), like


def _blocked_words(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple[DataFrame, BlockedBloomFilter]:
    rows, like = build._sized(table(spark, sf_dir, name), column, EPSILON, BlockedBloomFilter)
    return build.words_of(rows, like), like


UNITED = "SELECT word, bit_or(mask) AS mask FROM {s} GROUP BY word"
BLOOM_ORDERS = sqltext.bloom_bits(ORDERS, BLOOM_M.format(t="orders"), BLOOM_K.format(t="orders"))
BLOCKED_ORDERS = sqltext.block_bits(ORDERS, BLOCKS.format(t="orders"))


@query(BLOOM_ORDERS.select(UNITED))
def bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom_words(spark, sf_dir, "orders", "o_orderkey")[0]


@query(BLOCKED_ORDERS.select(UNITED))
def blocked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked_words(spark, sf_dir, "orders", "o_orderkey")[0]


@query(
    sqltext.bloom_bits(
        "SELECT o_orderkey::VARCHAR AS key, o_orderstatus, m, k, n FROM orders JOIN (SELECT o_orderstatus, n, m, greatest(1, floor(m / n * ln(2::DOUBLE) + 0.5))::BIGINT AS k FROM "
        "(SELECT o_orderstatus, count(*) AS n, ceil(-count(*) * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE)))::BIGINT AS m FROM orders GROUP BY 1)) USING (o_orderstatus)",
        "m",
        "k",
    ).select("SELECT o_orderstatus, m, k, n, word, bit_or(mask) AS mask FROM {s} GROUP BY ALL")
)
def bloom_words_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.bloom_words_by(table(spark, sf_dir, "orders"), "o_orderkey", ("o_orderstatus",), EPSILON)


@query(BLOOM_ORDERS.select("SELECT sum(bit_count(mask))::BIGINT AS bits_set, pow(sum(bit_count(mask)) / " + BLOOM_M.format(t="orders") + "::DOUBLE, " + BLOOM_K.format(t="orders") + ") AS rate, " + BLOOM_M.format(t="orders") + " / (SELECT count(*) FROM orders)::DOUBLE AS bits_per_key FROM (SELECT word, bit_or(mask) AS mask FROM {s} GROUP BY word)"))
def bloom_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturation.stats(*_bloom_words(spark, sf_dir, "orders", "o_orderkey"))


@query(BLOCKED_ORDERS.select("SELECT sum(bit_count(mask))::BIGINT AS bits_set, pow(sum(bit_count(mask)) / (" + BLOCKS.format(t="orders") + " * 256)::DOUBLE, 8) AS rate, " + BLOCKS.format(t="orders") + " * 256 / (SELECT count(*) FROM orders)::DOUBLE AS bits_per_key FROM (SELECT word, bit_or(mask) AS mask FROM {s} GROUP BY word)"))
def blocked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturation.stats(*_blocked_words(spark, sf_dir, "orders", "o_orderkey"))


# Members: no key is ever missing.


def _members(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _keys(spark, sf_dir, "orders", "o_orderkey")
        return probe.membership(rows, rows, "key", kind, EPSILON).agg(F.count("*").alias("keys"), F.count_if("found").alias("found"))

    return run


for _kind in reports.KINDS:
    query("SELECT count(*) AS keys, count(*) AS found FROM orders", f"{_kind}_members")(_members(_kind))


@query("SELECT count(*) AS keys, count(*) AS found FROM (SELECT DISTINCT o_orderkey FROM orders)")
def sharded_fuse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir, "orders", "o_orderkey").distinct()
    shards = max(SHARDS, build.shards_for(rows.count()))
    found = probe.probe_shards(rows, build.sharded_fuse(rows, "key", shards), shards)
    return found.agg(F.count("*").alias("keys"), F.count_if("found").alias("found"))


@query("SELECT count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS found FROM orders")
def relational_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, like = _bloom_words(spark, sf_dir, "orders", "o_custkey")
    found = probe.probe_words(_keys(spark, sf_dir, "orders", "o_custkey"), words, like)
    return found.agg(F.count("*").alias("keys"), F.count_if("found").alias("found"))


# False positives, bit for bit.


def _false_positives(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("key"))
        return probe.membership(asked, table(spark, sf_dir, "orders"), "o_orderkey", kind, EPSILON).where("found").select("key")

    return run


def _false_positive_sql(members: sqltext.Steps, asked: sqltext.Steps) -> str:
    held = members.select(UNITED)
    return f"WITH held AS ({held}), asked AS ({asked.select('SELECT key, word, mask FROM {s}')}) SELECT key FROM asked LEFT JOIN held USING (word) GROUP BY key HAVING bool_and(coalesce(held.mask & asked.mask = asked.mask, false))"


query(_false_positive_sql(BLOOM_ORDERS, sqltext.bloom_bits(MISSES, BLOOM_M.format(t="orders"), BLOOM_K.format(t="orders"))), "bloom_false_positives")(_false_positives("bloom"))
query(_false_positive_sql(BLOCKED_ORDERS, sqltext.block_bits(MISSES, BLOCKS.format(t="orders"))), "blocked_false_positives")(_false_positives("blocked"))
query(name="fuse8_false_positives")(_false_positives("fuse8"))
query(name="fuse16_false_positives")(_false_positives("fuse16"))


# Union.


def _union(kind: type) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        rows, like = build._sized(orders, "o_orderkey", EPSILON, kind)
        by_status = [build.words_of(build.keys_of(orders.where(cond), "o_orderkey"), like) for cond in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus not in ('F', 'O')")]
        return build.united(*by_status)

    return run


query(BLOOM_ORDERS.select(UNITED), "bloom_union_eq_single")(_union(BloomFilter))
query(BLOCKED_ORDERS.select(UNITED), "blocked_union_eq_single")(_union(BlockedBloomFilter))


@query("SELECT true AS same_frame, (SELECT count(*) FROM orders) AS n, 0::BIGINT AS missing")
def dense_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of two halves, built apart and united as values, against one build."""
    orders = table(spark, sf_dir, "orders")
    rows, like = build._sized(orders, "o_orderkey", EPSILON, BloomFilter)
    halves = [build.collect_words(build.words_of(build.keys_of(orders.where(c), "o_orderkey"), like), like._empty()) for c in ("o_custkey % 2 = 0", "o_custkey % 2 <> 0")]
    whole, both = build.bloom(orders, "o_orderkey", EPSILON), halves[0].union(halves[1])
    hit = probe.might_contain(spark, both, F.col("key"))
    return rows.select(hit.alias("hit")).agg(F.lit(whole.equals(both)).alias("same_frame"), F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("missing"))


# Joins: filters in front of exact ones.

URGENT = "o_orderpriority = '1-URGENT'"


def _urgent_lines(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        urgent = table(spark, sf_dir, "orders").where(URGENT).select(F.col("o_orderkey").alias("l_orderkey"))
        lines = probe.semi_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), urgent, "l_orderkey", kind, EPSILON)
        return lines.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))

    return run


for _kind in reports.KINDS:
    query(f"SELECT l_returnflag, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {URGENT}) GROUP BY 1", f"{_kind}_semi_join")(_urgent_lines(_kind))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def bloom_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return probe.anti_join(left, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def bloom_anti_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return probe.anti_join(left, table(spark, sf_dir, "orders").where(URGENT).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "blocked")


for _kind in ("bloom", "fuse16"):

    @query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", f"{_kind}_anti_join_tabled")
    def _anti_join_tabled(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        """The filter stays a table, of words or of shards."""
        left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        return probe.anti_join(left, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", kind, tabled=True)


#: Types in which the two sides of a join hold the same numbers.
TYPE_PAIRS = [("bigint", "double"), ("double", "decimal(20,2)"), ("decimal(18,1)", "bigint"), ("int", "bigint"), ("float", "double"), ("string", "bigint")]


@query(
    " UNION ALL ".join(f"SELECT '{a}' AS left_type, '{b}' AS right_type, count(*) FILTER (hit) AS semi, count(*) FILTER (NOT hit) AS anti FROM x" for a, b in TYPE_PAIRS).replace("FROM x", f"FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AS hit FROM orders WHERE {URGENT})")
)
def joins_of_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins whose keys are equal as numbers, not as texts."""
    parts = []
    for a, b in TYPE_PAIRS:
        left = table(spark, sf_dir, "orders").where(URGENT).select(F.col("o_custkey").cast(a).alias("k"))
        right = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast(b).alias("k"))
        semi, anti = (f(left, right, "k").agg(F.count("*").alias(f.__name__)) for f in (probe.semi_join, probe.anti_join))
        both = semi.select(F.lit(a).alias("left_type"), F.lit(b).alias("right_type"), F.col("semi_join").alias("semi"))
        parts.append(both.join(F.broadcast(anti.select(F.lit(a).alias("left_type"), F.col("anti_join").alias("anti"))), "left_type"))  # one row each
    return reduce(DataFrame.unionByName, parts)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)")
def stream_dedup_exact_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    seen = events.where("event_type = 'purchase' and value > 200").select("user_id")
    return live.distinct_exactly(events.where("event_type = 'click'").select("user_id"), seen, "user_id")


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders")
def fuse_distinct_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that fuse filters know, summed over shards, as one of many keys has."""

    def size(name: str, key: str, kind: type) -> int:
        rows = _keys(spark, sf_dir, name, key)
        frames_ = build.sharded_fuse(rows, "key", build.shards_for(rows.count()), kind)
        return frames.parse_frames(frames_).agg(F.sum("n")).first()[0] or 0

    users, orders = size("events", "user_id", BinaryFuse8), size("lineitem", "l_orderkey", BinaryFuse16)
    return spark.range(1).select(F.lit(users).cast("long").alias("users"), F.lit(orders).cast("long").alias("orders"))


@query("SELECT count(DISTINCT url) AS keys, (SELECT count(*) FROM pages) AS found FROM pages")
def url_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    found = probe.membership(pages, pages, "key", "fuse16")
    return found.agg(F.count_distinct("key").alias("keys"), F.count_if("found").alias("found"))


GRAMS = "SELECT DISTINCT {id} AS id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT {id}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {id}, string_split(text, ' ') AS w FROM {t}))"


@query(f"SELECT id AS doc_id, count(*) AS shared FROM ({GRAMS.format(id='doc_id', t='documents')}) WHERE gram IN (SELECT gram FROM ({GRAMS.format(id='item_id', t='benchmark')})) GROUP BY id")
def contamination_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share runs of eight words with the benchmark.

    Runs are 64-bit hashes as long as most are ruled out by a filter of the
    benchmark's; a run's words are put together only if its hash is there.
    """

    def runs(w: Column, of: Callable[[Column, Column], Column], kind: str) -> Column:
        return F.when(F.size(w) >= 8, F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: of(w, i))).otherwise(F.array().cast(f"array<{kind}>"))

    def gram(w: Column, i: Column) -> Column:
        return F.array_join(F.slice(w, i, 8), " ")

    known = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w")).select(F.explode(runs(F.col("w"), gram, "string")).alias("gram")).distinct()
    known = known.withColumn("h", F.xxhash64(F.split("gram", " ")))
    places = runs(F.col("w"), lambda w, i: F.struct(F.xxhash64(F.slice(w, i, 8)).alias("h"), i.alias("i")), "struct<h:bigint,i:int>")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    asked = docs.select("doc_id", F.explode(places).alias("p")).select("doc_id", "p.h", "p.i")
    hits = probe.semi_join(asked, known.select("h"), "h", "bloom", 0.001)
    found = docs.join(hits, "doc_id").select("doc_id", gram(F.col("w"), F.col("i")).alias("gram"))
    return found.join(known.select("gram"), "gram", "left_semi").distinct().groupBy("doc_id").agg(F.count("*").alias("shared"))


# Sizing.

GRID = [(n, e) for n in (1, 3, 1000, 100_000, 1_000_000, 100_000_000) for e in (0.05, 0.01, 0.003, 1e-4, 3e-5, 1e-5, 1e-6, 1e-8)]


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "capacity long, epsilon double").coalesce(1)


GRID_SQL = "(VALUES " + ", ".join(f"({n}::BIGINT, {e!r}::DOUBLE)" for n, e in GRID) + ") AS g(capacity, epsilon)"
LN2 = "ln(2::DOUBLE)"
M_SQL = f"ceil(-capacity * ln(epsilon) / ({LN2} * {LN2}))"
MODEL_SQL = """RECURSIVE p(b, lam, j, mass, total) AS (
  SELECT b, 256.0::DOUBLE / b, 0, exp(-256.0::DOUBLE / b), 0.0::DOUBLE FROM (SELECT unnest(range(1, 129)) AS b)
  UNION ALL SELECT b, lam, j + 1, mass * lam / (j + 1), total + mass * lam / (j + 1) * pow(1 - pow(31.0::DOUBLE / 32, j + 1), 8) FROM p WHERE NOT (j > lam AND mass < 1e-15)
), model AS (SELECT b, max(total) AS rate FROM p GROUP BY b)"""
SEGMENT_SQL = "least(pow(2::DOUBLE, floor(ln(capacity::DOUBLE) / ln(3.33::DOUBLE) + 2.25)), 262144)::BIGINT"
FUSE_SQL = f"""fuse AS (SELECT capacity, epsilon, segment, greatest(1, (slots + segment - 1) // segment - 2) AS segments FROM (
  SELECT *, {SEGMENT_SQL} AS segment, floor(capacity * greatest(1.125::DOUBLE, 0.875::DOUBLE + 0.25::DOUBLE * ln(1e6::DOUBLE) / ln(greatest(capacity, 2)::DOUBLE)) + 0.5)::BIGINT AS slots FROM {GRID_SQL}))"""


@query(f"SELECT capacity, epsilon, {M_SQL}::BIGINT AS m, greatest(1, floor({M_SQL} / capacity * {LN2} + 0.5))::BIGINT AS k FROM {GRID_SQL}")
def bloom_sizing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = sizing.bloom_size_columns(F.col("capacity"), F.col("epsilon"))
    return _grid(spark).select("capacity", "epsilon", m.cast("long").alias("m"), k.cast("long").alias("k"))


@query(f"WITH {MODEL_SQL} SELECT capacity, epsilon, (SELECT min(b) FROM model WHERE rate <= epsilon) AS bits_per_key FROM {GRID_SQL}")
def blocked_sizing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.sizing_report(_grid(spark))
    return report.select("capacity", "epsilon", F.col("blocked_bits_per_key").alias("bits_per_key"))


@query(f"WITH {FUSE_SQL} SELECT capacity, epsilon, segment, segments * segment AS segment_count_length, (segments + 2) * segment AS array_length FROM fuse")
def fuse_sizing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = sizing.fuse_geometry_columns(F.col("capacity"))
    return _grid(spark).select("capacity", "epsilon", a.alias("segment"), b.alias("segment_count_length"), c.alias("array_length"))


@query(
    f"""WITH {MODEL_SQL}, {FUSE_SQL}, x AS (SELECT *, {M_SQL}::BIGINT AS m, (SELECT min(b) FROM model WHERE rate <= epsilon) AS b, (segments + 2) * segment AS slots FROM fuse)
    SELECT capacity, epsilon, m / capacity::DOUBLE AS bloom_bits_per_key, ceil(m / 8.0)::BIGINT AS bloom_bytes, b AS blocked_bits_per_key, ceil(b * capacity / 8.0)::BIGINT AS blocked_bytes,
      slots * 8 / capacity::DOUBLE AS fuse8_bits_per_key, slots * 2 AS fuse16_bytes, coalesce(b >= 1.5 * (m / capacity::DOUBLE), false) AS blocked_is_dear FROM x"""
)
def sizing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sizing_report(_grid(spark)).select("capacity", "epsilon", "bloom_bits_per_key", "bloom_bytes", "blocked_bits_per_key", "blocked_bytes", "fuse8_bits_per_key", "fuse16_bytes", "blocked_is_dear")


@query(
    f"SELECT capacity, epsilon, pow(1 - exp(-k * capacity / m), k) AS bloom_rate, -log2(epsilon) AS floor_bits_per_key FROM "
    f"(SELECT capacity, epsilon, {M_SQL} AS m, greatest(1, floor({M_SQL} / capacity * {LN2} + 0.5)) AS k FROM {GRID_SQL})"
)
def modelled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = sizing.bloom_size_columns(F.col("capacity"), F.col("epsilon"))
    return _grid(spark).select("capacity", "epsilon", sizing.bloom_rate_column(m, k, F.col("capacity")).alias("bloom_rate"), (-F.log2("epsilon")).alias("floor_bits_per_key"))


WORKLOADS = [(e, s, d, u, t) for e in (0.01, 1e-6) for s in (False, True) for d in (False, True) for u in (False, True) for t in (False, True)]
_WORKLOAD_SQL = "(VALUES " + ", ".join(f"({e!r}::DOUBLE, {s}, {d}, {u}, {t})" for e, s, d, u, t in WORKLOADS) + ") AS w(epsilon, static, deletes, unbounded, space_tight)"


@query(
    "SELECT *, CASE WHEN deletes OR unbounded THEN NULL WHEN static AND epsilon < 0.00390625 THEN 'fuse16' WHEN static THEN 'fuse8' "
    f"WHEN space_tight OR epsilon < 0.00001 THEN 'bloom' ELSE 'blocked' END AS structure FROM {_WORKLOAD_SQL}"
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*w, reports.recommend(*w)) for w in WORKLOADS]
    return spark.createDataFrame(rows, "epsilon double, static boolean, deletes boolean, unbounded boolean, space_tight boolean, structure string")


ODD_SIZES = [(0.0, 0.01), (1.5, 0.01), (1e13, 0.01), (1000.0, 0.0), (1000.0, 1.0), (1000.0, 0.01), (1000.0, 3e-5), (1000.0, 1e-8)]


@query(
    f"""WITH {MODEL_SQL}, v AS (SELECT *, CASE WHEN NOT (capacity >= 1 AND capacity <= 1e12 AND floor(capacity) = capacity) THEN 'capacity' WHEN NOT (epsilon > 0 AND epsilon < 1) THEN 'epsilon' END AS bad_input
    FROM (VALUES {", ".join(f"({n!r}::DOUBLE, {e!r}::DOUBLE)" for n, e in ODD_SIZES)}) AS o(capacity, epsilon)),
    x AS (SELECT *, (SELECT min(b) FROM model WHERE rate <= epsilon) AS b, CASE WHEN bad_input IS NULL THEN ceil(-capacity * ln(epsilon) / ({LN2} * {LN2})) / capacity END AS bits FROM v)
    SELECT capacity, epsilon, bad_input, CASE WHEN bad_input = 'capacity' THEN 'The capacity must be a whole number from 1 to 1000000000000.' WHEN bad_input = 'epsilon' THEN 'The rate must lie strictly between 0 and 1.'
    WHEN b IS NULL THEN 'No blocked filter of up to 128 bits a key is that exact.'
    WHEN b >= 1.5 * bits THEN 'A blocked filter takes ' || b::VARCHAR || ' bits a key for this rate, a classic one ' || floor(bits + 0.5)::BIGINT::VARCHAR || '.' END AS message FROM x"""
)
def sizing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(ODD_SIZES, "capacity double, epsilon double").coalesce(1)
    return reports.sizing_report(asked).select("capacity", "epsilon", "bad_input", "message")


# The playground.

PLAYED = 10_000


@query(
    "SELECT structure, 10000::BIGINT AS held_keys, 0::BIGINT AS missing, false_positives FROM (SELECT 'bloom' AS structure, count(*) AS false_positives FROM ("
    + _false_positive_sql(sqltext.bloom_bits("SELECT 'key-' || i::VARCHAR AS key FROM range(10000) AS r(i)", "95851", "7"), sqltext.bloom_bits("SELECT 'miss-' || i::VARCHAR AS key FROM range(20000) AS r(i)", "95851", "7"))
    + ") UNION ALL SELECT 'blocked', count(*) FROM ("
    + _false_positive_sql(sqltext.block_bits("SELECT 'key-' || i::VARCHAR AS key FROM range(10000) AS r(i)", "430"), sqltext.block_bits("SELECT 'miss-' || i::VARCHAR AS key FROM range(20000) AS r(i)", "430"))
    + "))"
)
def playground_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.Playground(spark, PLAYED, EPSILON).report().where("structure <> 'fuse8'").select("structure", "held_keys", "missing", "false_positives")


@query(name="playground_fuse")
def playground_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.Playground(spark, PLAYED, EPSILON).report().where("structure = 'fuse8'")


@query(
    "SELECT * FROM (VALUES ('key-5', true, 'member', 'member', 'member'), ('miss-0', false, 'absent', 'absent', 'absent'), ('miss-22', false, 'false positive', 'absent', 'absent'), "
    "('late-key', true, 'member', 'member', 'added after build')) AS v(key, inserted, bloom, blocked, fuse8)"
)
def lookup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = reports.Playground(spark, PLAYED, EPSILON)
    played.insert("late-key")
    asked = spark.createDataFrame([(k,) for k in ("key-5", "miss-0", "miss-22", "late-key")], "key string")
    return played.lookup(asked)


def _accuracy_sql(n: int) -> str:
    """Rows of Bloom and blocked filters of n keys, measured over a million others."""
    held, asked = (f"SELECT '{p}:' || i::VARCHAR AS key FROM range({k}) AS r(i)" for p, k in (("0", n), ("1", PROBES)))
    size, blocks = sizing.bloom_size(n, EPSILON), sizing.blocked_count(11, n)
    rows = [
        ("bloom", _false_positive_sql(sqltext.bloom_bits(held, str(size.m), str(size.k)), sqltext.bloom_bits(asked, str(size.m), str(size.k))), f"{size.m}::DOUBLE / {n}"),
        ("blocked", _false_positive_sql(sqltext.block_bits(held, str(blocks)), sqltext.block_bits(asked, str(blocks))), f"{blocks}::DOUBLE * 256 / {n}"),
    ]
    return " UNION ALL ".join(f"SELECT '{kind}' AS structure, {n}::BIGINT AS n, {EPSILON}::DOUBLE AS target_rate, count(*)::DOUBLE / {PROBES} AS measured_rate, {bits} AS bits_per_key FROM ({sql})" for kind, sql, bits in rows)


PROBES = 1_000_000
ACCURACY = (100_000, 1_000_000)


@query(" UNION ALL ".join(map(_accuracy_sql, ACCURACY)))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accuracy_report(spark, ACCURACY, EPSILON, PROBES, ("bloom", "blocked"))


@query()
def accuracy_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accuracy_report(spark, ACCURACY, EPSILON, PROBES, ("fuse8", "fuse16"))


@query()
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison_report(spark, (10_000, 100_000))


LATE = ("late-key", "miss-22", "miss-77")
_HELD = "SELECT 'key-' || i::VARCHAR AS key FROM range(10000) AS r(i) UNION ALL SELECT unnest(['late-key', 'miss-22', 'miss-77'])"
_ASKED = "SELECT 'miss-' || i::VARCHAR AS key FROM range(20000) AS r(i) WHERE i NOT IN (22, 77)"


@query(
    "SELECT structure, 10003::BIGINT AS held_keys, 0::BIGINT AS missing, false_positives FROM (SELECT 'bloom' AS structure, count(*) AS false_positives FROM ("
    + _false_positive_sql(sqltext.bloom_bits(_HELD, "95851", "7"), sqltext.bloom_bits(_ASKED, "95851", "7"))
    + ") UNION ALL SELECT 'blocked', count(*) FROM ("
    + _false_positive_sql(sqltext.block_bits(_HELD, "430"), sqltext.block_bits(_ASKED, "430"))
    + "))"
)
def playground_late_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that came late are held, and no longer count as misses."""
    played = reports.Playground(spark, PLAYED, EPSILON)
    for key in LATE:
        played.insert(key)
    return played.report().where("structure <> 'fuse8'").select("structure", "held_keys", "missing", "false_positives")


@query("SELECT sum(w0::BIGINT)::BIGINT AS w0, count(*) FILTER (hit) AS found FROM (" + sqltext.hashed(CUSTOMER).select("SELECT w0, true AS hit FROM {s}") + ")")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, on a frame that is a column."""
    register(spark)
    rows = _keys(spark, sf_dir, "customer", "c_custkey")
    frame = F.lit(build.blocked(rows, "key", EPSILON).to_bytes())
    return rows.select("key", frame.alias("frame")).selectExpr("amq_hash128(key).w0 AS w0", "amq_might_contain(frame, key) AS hit").agg(F.sum("w0").alias("w0"), F.count_if("hit").alias("found"))


# Frames and envelopes. Frames of ten names, to which all builds must agree.

NAMES = "alice bob carol dave erin frank grace heidi ivan judy".split()
GOLDEN = {
    "bloom": "QU1RRgMBAABgAAAABwAAAAAACgAAAOretaMm0wnRmeSt8J97N1o=",
    "blocked": "QU1RRgMCAAABAAAAAAAAAAoAAAAheAAkosAAJXBAEFYC6soAIYgJmI0MUBABeSAJLiYAARVUrjY=",
    "fuse8": "QU1RRgMDAAAAAAAAEAAAABAAAAAKAAAAAAAAAAAAAADLAAAAawAAAAAAAAAAAAAAAACVAAAABgAAAAAAAAAAAAkAGRo6AH11s1/nYw==",
    "fuse16": "QU1RRgMEAAAAAAAAEAAAABAAAAAKAAAAAAAAAAAAAAAAAAAAAAAAAMu5AAAAAAAAa+cAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAJXeAAAAAAAABmgAAAAAAAAAAAAAAAAAAAAAAAAJkAAAGcoaezopAAB9jnWFFH39bg==",
    "old": "QU1RRgIBAAAdAAAABwAAAAAAAwAAAKIj5ROWWZ+f",
}


def _golden(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(GOLDEN.items()), "name string, text string").coalesce(1)
    return rows.withColumn("frame", codec.unbase64_column(F.col("text")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GOLDEN.items() if k != "old") + ") AS v(name, frame)")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh distributed builds, written as frames."""
    df = spark.createDataFrame([(x,) for x in NAMES], "key string").repartition(3)
    built = [(kind, bytearray(build.build(df, "key", kind, EPSILON).to_bytes())) for kind in reports.KINDS]
    return spark.createDataFrame(built, "name string, frame binary").select("name", codec.base64_column(F.col("frame")).alias("frame"))


@query(
    "SELECT * FROM (VALUES ('bloom', 1, 10::BIGINT, NULL), ('blocked', 2, 10, NULL), ('fuse8', 3, 10, NULL), ('fuse16', 4, 10, NULL), ('old', NULL, NULL, 'UnknownVersionError'), "
    "('short', NULL, NULL, 'TruncatedError'), ('magic', NULL, NULL, 'BadMagicError'), ('flipped', NULL, NULL, 'ChecksumError')) AS v(name, kind, n, error)"
)
def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _golden(spark).select("name", "frame")
    bloom = good.where("name = 'bloom'").select("frame")
    bad = bloom.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), x.alias("frame")) for n, x in (
        ("short", F.substring("frame", 1, 11)),
        ("magic", F.concat(F.lit(b"XMQF"), F.substr("frame", F.lit(5), F.octet_length("frame") - 4))),
        ("flipped", F.concat(F.substring("frame", 1, 25), F.lit(b"\xff"), F.substr("frame", F.lit(27), F.octet_length("frame") - 26))),
    )])))
    return frames.parse_frames(good.unionByName(bad)).select("name", "kind", "n", "error")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GOLDEN.items()) + ") AS v(name, frame)")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, error = codec.from_envelope_column(F.col("envelope"))
    sent = _golden(spark).withColumn("envelope", codec.envelope_column(F.col("frame")))
    return sent.where(error.isNull()).select("name", codec.base64_column(frame).alias("frame"))


def _fuse_slot(slots: str, at: str, width: int) -> str:
    n = width // 4
    text = f"substr({slots}, (({at}) * {n} + 1)::BIGINT, {n})"
    return f"('0x' || {text})::UBIGINT" if width == 8 else f"('0x' || substr({text}, 3, 2) || substr({text}, 1, 2))::UBIGINT"


def _fuse_probe_sql(kind: str, width: int) -> str:
    """Which of the keys asked a golden fuse frame may hold, read from the frame in SQL."""
    asked = "SELECT key, hex(from_base64('" + GOLDEN[kind] + "')) AS frame FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in NAMES) + "]) AS key UNION ALL SELECT c_name FROM customer)"
    probed = sqltext.fuse_slots(asked, 0, 16, 16)
    probed.add(body="substr(frame, 49)", fp=f"(xor(x, x >> 32) & {(1 << width) - 1}::UBIGINT)")
    slots = [_fuse_slot("body", h, width) for h in ("h0", "h1", "h2")]
    return probed.select(f"SELECT '{kind}' AS structure, key FROM {{s}} WHERE fp = xor(xor({slots[0]}, {slots[1]}), {slots[2]})")


@query(f"SELECT * FROM ({_fuse_probe_sql('fuse8', 8)}) UNION ALL SELECT * FROM ({_fuse_probe_sql('fuse16', 16)})")
def fuse_frame_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that fuse filters read from frames may hold: the ten names, and false positives among customers."""
    names = spark.createDataFrame([(x,) for x in NAMES], "key string")
    asked = names.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")))
    held = {kind: build.FUSES[kind].from_bytes(codec.from_base64(GOLDEN[kind])) for kind in ("fuse8", "fuse16")}
    parts = [asked.where(probe.might_contain(spark, f, F.col("key"))).select(F.lit(kind).alias("structure"), "key") for kind, f in held.items()]
    return parts[0].unionByName(parts[1])


def _outcome(run: Callable[[], object]) -> str:
    """The name of the error that a call raises, else what it returns."""
    try:
        return str(run())
    except Exception as e:
        return type(e).__name__


def _edge_cases() -> list[tuple[str, str]]:
    frame = {kind: codec.from_base64(text) for kind, text in GOLDEN.items()}
    again = lambda kind, at, new: codec.write_frame(frame[kind][5], frame[kind][8:at] + new + frame[kind][at + len(new) : -4], frame[kind][6])
    bloom, small = BloomFilter.from_keys(["a", "b"], EPSILON), BloomFilter.create(1, EPSILON)
    read = lambda cls, data: lambda: cls.from_bytes(data).n if hasattr(cls, "words") else cls.from_bytes(data).kind
    return [
        ("parameter: n of 0", _outcome(lambda: BloomFilter.create(0, EPSILON))),
        ("parameter: n of a half", _outcome(lambda: BloomFilter.create(0.5, EPSILON))),
        ("parameter: rate of 1", _outcome(lambda: BloomFilter.create(5, 1.0))),
        ("parameter: k above 65535", _outcome(lambda: BloomFilter(100, 1 << 16))),
        ("parameter: capacity above 32 bits", _outcome(lambda: BlockedBloomFilter(8, 1 << 32))),
        ("parameter: bits and capacity", _outcome(lambda: BlockedBloomFilter(16, 1000).blocks)),
        ("parameter: m and k", _outcome(lambda: (BloomFilter(1000, 7).m, BloomFilter(1000, 7).k, BloomFilter(1000, 7).n))),
        ("parameter: too exact for blocked", _outcome(lambda: BlockedBloomFilter.create(5, 1e-30))),
        ("union: other size", _outcome(lambda: bloom.union(small))),
        ("union: other blocks", _outcome(lambda: BlockedBloomFilter(16, 100).union(BlockedBloomFilter(16, 1000)))),
        ("fuse: no seed does", _outcome(lambda: BinaryFuse8.from_hashes(np.arange(9, dtype=np.uint64), attempts=0))),
        ("E1: wrong kind before length", _outcome(read(BlockedBloomFilter, codec.write_frame(1, b"")))),
        ("E1: hash variant before length", _outcome(read(BloomFilter, codec.write_frame(1, b"", 1)))),
        ("E1: length", _outcome(read(BloomFilter, codec.write_frame(1, b"")))),
        ("E2: m of 0", _outcome(read(BloomFilter, codec.write_frame(1, bytes(14))))),
        ("E3: Bloom n of 0", _outcome(lambda: BloomFilter.from_bytes(again("bloom", 18, bytes(4))).bits_per_key)),
        ("E3: blocked n of 0", _outcome(read(BlockedBloomFilter, again("blocked", 16, bytes(4))))),
        ("E4: high flags", _outcome(lambda: BloomFilter.from_bytes(codec.write_frame(1, frame["bloom"][8:-4], 0xF0)).m)),
        ("E5: empty Bloom", _outcome(lambda: (BloomFilter.from_keys([], EPSILON).n, BloomFilter.from_keys([], EPSILON).has("a")))),
        ("E5: empty fuse", _outcome(lambda: (BinaryFuse8.from_keys([]).size, BinaryFuse8.from_keys([]).seed, BinaryFuse8.from_keys([]).has("a")))),
        ("E6: empty fuse reads back", _outcome(lambda: BinaryFuse16.from_bytes(BinaryFuse16.from_keys([]).to_bytes()).geometry[:2])),
        ("E7: segment of 3", _outcome(read(BinaryFuse8, again("fuse8", 12, (3).to_bytes(4, "little"))))),
        ("E8: equal bits of unlike n", _outcome(lambda: BloomFilter(100, 3, n=5).equals(BloomFilter(100, 3, n=6)))),
        ("E9: equal hashes count once", _outcome(lambda: BinaryFuse8.from_keys(["a", "a", "b"]).size)),
        ("E11: bits beyond memory", _outcome(lambda: BlockedBloomFilter(1e9, (1 << 32) - 1))),
        ("E12: blocked rate of 1", _outcome(lambda: sizing.blocked_bits_per_key(1.0))),
        ("E13: seed", _outcome(lambda: BinaryFuse16.from_keys(NAMES).seed)),
        ("base64: space", _outcome(lambda: codec.from_base64("QU 1R"))),
        ("envelope: no object", _outcome(lambda: codec.from_envelope([1]))),
        ("envelope: other tag", _outcome(lambda: codec.from_envelope({"$": "x", "v": 1, "data": ""}))),
        ("message: parameter", _outcome(lambda: bool(reports.explain_error(ParamError("what"))))),
        ("message: fuse", _outcome(lambda: bool(reports.explain_error(BinaryFuseBuildError("x"))))),
        ("message: other", _outcome(lambda: reports.explain_error(KeyError("x")))),
        ("count", reports.human_count(25_000)),
        ("rate", reports.human_rate(2_500_000)),
        ("bytes", reports.human_bytes(1536)),
    ]


#: What the cases give by the format's rules.
EDGES = {
    "parameter: n of 0": "ParamError",
    "parameter: n of a half": "ParamError",
    "parameter: rate of 1": "ParamError",
    "parameter: k above 65535": "ParamError",
    "parameter: capacity above 32 bits": "ParamError",
    "parameter: bits and capacity": "63",
    "parameter: m and k": "(1000, 7, 99)",
    "parameter: too exact for blocked": "ParamError",
    "union: other size": "BloomParamMismatchError",
    "union: other blocks": "BlockedBloomParamMismatchError",
    "fuse: no seed does": "BinaryFuseBuildError",
    "E1: wrong kind before length": "SerializationError",
    "E1: hash variant before length": "UnknownHashVariantError",
    "E1: length": "TruncatedError",
    "E2: m of 0": "ParamError",
    "E3: Bloom n of 0": "inf",
    "E3: blocked n of 0": "SerializationError",
    "E4: high flags": "96",
    "E5: empty Bloom": "(1, False)",
    "E5: empty fuse": "(0, 0, False)",
    "E6: empty fuse reads back": "(1, 1)",
    "E7: segment of 3": "SerializationError",
    "E8: equal bits of unlike n": "False",
    "E9: equal hashes count once": "2",
    "E11: bits beyond memory": "BitSetRangeError",
    "E12: blocked rate of 1": "1",
    "E13: seed": "0",
    "base64: space": "ValueError",
    "envelope: no object": "SerializationError",
    "envelope: other tag": "SerializationError",
    "message: parameter": "True",
    "message: fuse": "True",
    "message: other": "KeyError",
    "count": "25k",
    "rate": "2.50 M ops/s",
    "bytes": "1.50 KiB",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EDGES.items()) + ") AS v(edge, outcome)")
def edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, frames and errors at their edges."""
    return spark.createDataFrame(_edge_cases(), "edge string, outcome string").coalesce(1)


@query(sqltext.hashed("SELECT unnest(['a', 'abc', 'abcd']) AS key").select("SELECT key, (w1 = w2 AND w2 = w3) AS same FROM {s}"))
def short_key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of four bytes at most have three equal words (E10)."""
    asked = spark.createDataFrame([("a",), ("abc",), ("abcd",)], "key string").withColumn("h", columns.hash128(F.col("key")))
    return asked.select("key", F.expr("h.w1 = h.w2 and h.w2 = h.w3").alias("same"))


# Streaming.


def _home(spark: SparkSession, what: str) -> str:
    """A folder of its own below the session's shared one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ParamError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    return f"{shared or spark.conf.get('spark.sql.warehouse.dir')}/{what}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, rows: DataFrame, home: str) -> DataFrame:
    """The rows as a stream of their files."""
    rows.write.parquet(f"{home}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")


def _live_orders(spark: SparkSession, sf_dir: str) -> live.LiveFilter:
    """The orders as a stream, absorbed by a live filter."""
    orders, home = table(spark, sf_dir, "orders").select("o_orderkey"), _home(spark, "live")
    held = live.LiveFilter(spark, f"{home}/filter", BloomFilter.create(max(1, orders.count()), EPSILON))
    live.absorbing(_streamed(spark, orders, home), held, f"{home}/progress", "o_orderkey").trigger(availableNow=True).start().awaitTermination()
    return held


@query(BLOOM_ORDERS.select(UNITED))
def stream_bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a filter that took a stream are those of one build."""
    return _live_orders(spark, sf_dir).words()


@query(BLOOM_ORDERS.select("SELECT sum(bit_count(mask))::BIGINT AS bits_set, pow(sum(bit_count(mask)) / " + BLOOM_M.format(t="orders") + "::DOUBLE, " + BLOOM_K.format(t="orders") + ") AS rate FROM (SELECT word, bit_or(mask) AS mask FROM {s} GROUP BY word)"))
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that a live filter has come to, as its log tells batch by batch."""
    return _live_orders(spark, sf_dir).drift().agg(F.max("bits_set").alias("bits_set"), F.max("rate").alias("rate"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each user of a stream, exactly, within a watermark that covers them all."""
    events, home = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), _home(spark, "first-within")
    first = live.first_within(_streamed(spark, events, home), ["user_id"], "ts", "3650 days")
    first.writeStream.option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).format("parquet").start(f"{home}/out").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{home}/out").select("user_id")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each user of a stream, by a live filter and an exact look-up of what it may have seen."""
    events, home = table(spark, sf_dir, "events").select("user_id", "event_type"), _home(spark, "first-ever")
    held = live.LiveFilter(spark, f"{home}/filter", BloomFilter.create(max(1, events.count()), EPSILON))
    live.first_ever(_streamed(spark, events, home), held, "user_id", f"{home}/out", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{home}/out/batch=*").select("user_id")
