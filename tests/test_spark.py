from __future__ import annotations

import json
import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsieve import errors
from quillsieve.functions import codec, columns, kernels, sizing
from quillsieve.operators import build, probe
from quillsieve.operators.filters import BinaryFuse8, BinaryFuse16, BlockedBloomFilter, BloomFilter
from quillsieve.plans import queries, reports, saturation
from quillsieve.sources import frames, keys
from quillsieve.streaming.live import LiveFilter, absorbing, new_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    """A table's rows as sorted texts, numbers to ten digits."""
    show = lambda x: "" if x is None or pd.isna(x) else f"{float(x):.10g}" if isinstance(x, numbers.Number) else str(x)
    return sorted(tuple(map(show, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got[cols]) == plain(want[cols])


@pytest.mark.parametrize("kind", reports.KINDS)
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_builds_do_not_depend_on_partitions(spark, kind, parts):
    own = [f"k{i}" for i in range(400)]
    df = spark.createDataFrame([(k,) for k in own], "key string").repartition(parts, F.rand(parts))
    local = {"bloom": BloomFilter, "blocked": BlockedBloomFilter}.get(kind)
    want = local.from_keys(own, 0.01) if local else build.fuse(df.coalesce(1), "key", BinaryFuse16 if kind == "fuse16" else build.BinaryFuse8)
    assert build.build(df, "key", kind, 0.01).equals(want)


def test_values_are_built_in_pieces(spark):
    own = [f"k{i}" for i in range(20_000)]
    df = spark.createDataFrame([(k,) for k in own], "key string").repartition(5)
    for want in (BloomFilter.from_keys(own, 1e-6), BlockedBloomFilter.from_keys(own, 1e-4)):
        assert len(want.words) > 2 * build.PIECE and build.dense(df, want._empty()).equals(want)
    none = build.dense(df.where("key is null"), BloomFilter.create(1, 0.01))
    assert none.length == 0


def test_nulls_duplicates_and_types(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (22,)], "k int")
    held = build.bloom(df, "k", 0.01)
    assert held.n == 3 and held.has_all(["1", "22"]).all()
    asked = spark.createDataFrame([("1",), (None,)], "key string")
    assert [r[0] for r in asked.select(probe.might_contain(spark, held, F.col("key"))).collect()] == [True, None]
    assert build.fuse(df, "k").size == 2
    assert build.bloom(df.where("k is null"), "k", 0.01).length == 0
    with pytest.raises(errors.ParamError):
        build.build(df, "k", "cuckoo")


def test_columns_agree_with_kernels(spark):
    df = keys.numbered(spark, 200, "user:").withColumn("h", columns.hash128(F.col("key"), 9))
    got = df.select("key", "h.*", columns.probes(F.col("h"), 5, 2**32 - 2).alias("p"), columns.block_lanes(F.col("h"), 12345).alias("b")).toPandas()
    import pyarrow as pa

    words = kernels.murmur128(pa.array(got["key"]), 9)
    assert (got[["w0", "w1", "w2", "w3"]].to_numpy() == words).all()
    assert [list(x) for x in got["p"]] == kernels.probes(words, 5, 2**32 - 2).tolist()
    index, mask = kernels.block_lanes(words, 12345)
    assert [[(y["word"], y["mask"]) for y in x] for x in got["b"]] == [list(zip(i, m, strict=True)) for i, m in zip(index.tolist(), mask.tolist(), strict=True)]


def test_dense_and_words_agree(spark):
    members, asked = keys.numbered(spark, 3000, "0:"), keys.numbered(spark, 5000, "1:").union(keys.numbered(spark, 100, "0:"))
    for like in (BloomFilter.create(3000, 0.05), BlockedBloomFilter.create(3000, 0.05)):
        words = build.words_of(members, like)
        held = build.collect_words(words, like._empty())
        want = {r["key"]: r["x"] for r in asked.select("key", probe.might_contain(spark, held, F.col("key")).alias("x")).collect()}
        assert {r["key"]: r["found"] for r in probe.probe_words(asked, words, like).collect()} == want
        one = saturation.stats(words, like).first()
        assert one["bits_set"] == held.length and one["rate"] == pytest.approx(held.rate())


def test_sharded_fuse(spark):
    members = keys.numbered(spark, 2000, "0:")
    parts = build.sharded_fuse(members, "key", 7)
    assert probe.probe_shards(members, parts, 7).where("not found").count() == 0
    assert probe.probe_shards(keys.numbered(spark, 5000, "1:"), parts, 7).where("found").count() <= 5


def test_joins_equal_plain_ones(spark):
    left = spark.createDataFrame([(i % 70 if i % 11 else None, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(i * 3,) for i in range(20)] + [(None,)], "k long")
    for kind in reports.KINDS:
        assert plain(probe.semi_join(left, right, "k", kind).toPandas()) == plain(left.join(right, "k", "left_semi").toPandas())
        assert plain(probe.anti_join(left, right, "k", kind).toPandas()) == plain(left.join(right, "k", "left_anti").toPandas())


@pytest.mark.parametrize("kind", ["bloom", "fuse8"])
@pytest.mark.parametrize("tabled", [False, True])
def test_joins_beyond_a_value(spark, monkeypatch, kind, tabled):
    monkeypatch.setattr(build, "DENSE_BYTES", 1)
    monkeypatch.setattr(build, "FUSE_KEYS", 10)
    left = spark.createDataFrame([(i % 70 if i % 11 else None, i) for i in range(300)], "k long, _key long")
    right = spark.createDataFrame([(i * 3,) for i in range(20)] + [(None,)], "k long")
    assert plain(probe.semi_join(left, right, "k", kind, tabled=tabled).toPandas()) == plain(left.join(right, "k", "left_semi").toPandas())
    assert plain(probe.anti_join(left, right, "k", kind, tabled=tabled).toPandas()) == plain(left.join(right, "k", "left_anti").toPandas())
    found = probe.membership(left.select(F.col("k").cast("string").alias("key")), right, "k", kind)
    assert found.count() == left.where("k is not null").count() and found.where("key % 3 = 0 and key < 60 and not found").count() == 0


NUMBERS = ["smallint", "bigint", "float", "double", "decimal(10,2)", "decimal(38,0)", "string"]
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]] + [("date", "timestamp"), ("timestamp_ntz", "timestamp"), ("date", "string"), ("binary", "string")]


def test_joins_of_all_types_equal_plain_ones(spark):
    """Equal keys of unlike types have equal texts, as the plain join has them equal."""
    number = lambda i, kind: f"cast({i} as {kind})"
    for a, b in PAIRS:
        times = "date" in a or "timestamp" in a
        one = (lambda i, kind: f"cast(timestamp'2024-03-0{i} 00:00:00' as {kind})") if times else (lambda i, kind: f"cast(cast({i} as string) as {kind})") if a == "binary" else number
        left = spark.sql("SELECT " + one(1, a) + " AS k, 1 AS v UNION ALL SELECT " + one(2, a) + ", 2 UNION ALL SELECT " + one(5, a) + ", 3 UNION ALL SELECT NULL, 4").coalesce(1)
        right = spark.sql("SELECT " + one(2, "date" if times and b == "string" else b) + (" || ''" if times and b == "string" else "") + " AS k UNION ALL SELECT " + one(1, "date" if times and b == "string" else b) + (" || ''" if times and b == "string" else "")).coalesce(1)
        like = probe.common_type(left, right, "k")
        texts = [{r[0] for r in df.select(probe.key_text(F.col("k"), like)).collect()} for df in (left, right)]
        assert len(texts[0] & texts[1]) == 2, (a, b)
        assert plain(left.join(right, "k", "left_semi").toPandas()[["v"]]) == [("1",), ("2",)]


def test_zeros_and_nans_join_as_spark_joins_them(spark):
    left = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (1.5, 4), (None, 5)], "k double, v int")
    right = spark.createDataFrame([(-0.0,), (float("nan"),), (2.5,)], "k float")
    for f, how in ((probe.semi_join, "left_semi"), (probe.anti_join, "left_anti")):
        assert sorted(r["v"] for r in f(left, right, "k").collect()) == sorted(r["v"] for r in left.join(right, "k", how).collect())


def test_keys_that_cannot_be_compared_are_refused(spark):
    one = spark.sql("SELECT 1 AS k, array(1) AS a, true AS b, 'x' COLLATE UTF8_LCASE AS c")
    for left, right in (("k", "b"), ("a", "a"), ("c", "c")):
        with pytest.raises(errors.ParamError):
            probe.semi_join(one.select(F.col(left).alias("k")), one.select(F.col(right).alias("k")), "k")


def test_too_large_for_a_value(spark, monkeypatch):
    monkeypatch.setattr(build, "DENSE_BYTES", 16)
    with pytest.raises(errors.ParamError):
        build.bloom(keys.members(spark, 1000), "key", 0.01)
    with pytest.raises(errors.ParamError):
        probe.might_contain(spark, BloomFilter.create(1000, 0.01), F.col("key"))
    monkeypatch.setattr(build, "FUSE_KEYS", 10)
    with pytest.raises(errors.ParamError):
        build.fuse(keys.members(spark, 11), "key")
    with pytest.raises(errors.ParamError):
        build.sharded_fuse(keys.members(spark, 110), "key", 2)
    monkeypatch.setattr(build, "FUSE_KEYS", 1000)
    assert build.sharded_fuse(keys.members(spark, 5000), "key", build.shards_for(5000)).count() == 10


def test_frames_in_storage(spark, tmp_path):
    held = {"a": BloomFilter.from_keys(["x"], 0.1), "b": BinaryFuse16.from_keys(["x", "y"])}
    frames.write_frames(spark, str(tmp_path / "f"), held)
    assert {k: v.to_bytes() for k, v in frames.read_frames(spark, str(tmp_path / "f")).items()} == {k: v.to_bytes() for k, v in held.items()}
    table = spark.read.parquet(str(tmp_path / "f"))
    frames.write_envelopes(spark, str(tmp_path / "j"), table, tag="other")
    assert frames.read_envelopes(spark, str(tmp_path / "j"), tag="other").where("error is null").count() == 2
    assert {r["error"] for r in frames.read_envelopes(spark, str(tmp_path / "j")).collect()} == {"SerializationError"}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.amq").write_bytes(held["a"].to_bytes())
    assert bytes(frames.frame_files(spark, str(tmp_path / "raw")).first()["frame"]) == held["a"].to_bytes()
    assert table.select(frames.checked(F.col("frame")).alias("x")).where("x is not null").count() == 2


def test_base64_and_frame_columns(spark):
    df = spark.createDataFrame([(x,) for x in ("Zg", "Zg==", "Zg=", "!!!!", "A", "Zm 9v", "Z\ng", "", "x" * 200)], "t string")
    got = {r["t"]: None if r["b"] is None else bytes(r["b"]) for r in df.select("t", codec.unbase64_column(F.col("t")).alias("b")).collect()}
    for t, b in got.items():
        try:
            assert codec.from_base64(t) == b
        except ValueError:
            assert b is None
    good = codec.write_frame(1, b"abc")
    cases = {good: None, good[:5]: "TruncatedError", b"X" + good[1:]: "BadMagicError", good[:4] + b"\2" + good[5:]: "UnknownVersionError", good[:-1] + b"\0": "ChecksumError"}
    df = spark.createDataFrame([(bytearray(x),) for x in cases], "f binary").select("f", codec.frame_error_column(F.col("f")).alias("e"))
    assert {bytes(r["f"]): r["e"] for r in df.collect()} == cases
    values = [json.dumps(x) for x in ({"$": codec.TAG, "v": 3, "data": "Zg=="}, {"$": "x", "v": 3, "data": ""}, {"$": codec.TAG, "v": 2, "data": ""}, {"$": codec.TAG, "v": 3}, {"$": codec.TAG, "v": 3, "data": "!"}, 5, [1])] + ["nonsense"]
    frame, error = codec.from_envelope_column(F.col("v"))
    got = [r["e"] for r in spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(frame.alias("f"), error.alias("e")).collect()]
    assert got == [None, "SerializationError", "UnknownVersionError", "SerializationError", "SerializationError", "SerializationError", "SerializationError", "SerializationError"]


def test_stream_is_safe_to_repeat(spark, tmp_path):
    live = LiveFilter(spark, str(tmp_path / "live"), BloomFilter.create(500, 0.01))
    assert live.value().length == 0
    batch = keys.numbered(spark, 250, "a:")
    live.absorb(batch, 0)
    live.absorb(batch, 0)
    live.absorb(keys.numbered(spark, 250, "b:"), 1)
    want = BloomFilter.create(500, 0.01)
    want.add_all([f"{p}:{i}" for p in "ab" for i in range(250)])
    assert live.value().equals(want)
    rate = [r["rate"] for r in live.drift().collect()]
    assert len(rate) == 2 and rate[0] < rate[1] < 0.02
    assert new_rows(batch, live, "key").where("not seen").count() == 0
    batch.write.parquet(str(tmp_path / "in"))
    other = LiveFilter(spark, str(tmp_path / "other"), BloomFilter.create(500, 0.01))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    absorbing(stream, other, str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert other.value().has_all([f"a:{i}" for i in range(250)]).all()
    for k in range(2, 5):
        live.absorb(batch, k)
    assert live.value().equals(want) and len(list((tmp_path / "live" / "words").iterdir())) == 2  # older states are removed


def test_playground(spark):
    played = reports.Playground(spark, "1000", 0.01)
    assert "1000" in played.insert("miss-3") and played.insert("key-5") and played.late == ["miss-3"]
    report = {r["structure"]: r for r in played.report().collect()}
    assert {k: (r["held_keys"], r["missing"]) for k, r in report.items()} == {"bloom": (1001, 0), "blocked": (1001, 0), "fuse8": (1000, 0)}
    assert report["bloom"]["measured_rate"] < 0.03
    for bad in (0, 100_001, 2.5, "abc", None):
        with pytest.raises(errors.ParamError):
            reports.Playground(spark, bad, 0.01)
    with pytest.raises(errors.ParamError):
        reports.Playground(spark, 10, "abc")
    assert reports.as_markdown(played.report()).count("\n") == 4


def test_sizing_report(spark):
    grid = spark.createDataFrame([(1e8, 0.01), (0.0, 0.01), (1.5, 0.01), (1e15, 0.01), (10.0, 0.0), (10.0, 1.0), (float("nan"), 0.5), (1e6, 3e-5), (1e6, 1e-8)], "capacity double, epsilon double")
    got = reports.sizing_report(grid).collect()
    assert got[0]["bloom_bits_per_key"] == pytest.approx(9.58505838, rel=1e-8) and got[0]["bloom_bytes"] == 119813230 and got[0]["fuse8_bits_per_key"] == pytest.approx(9.00726784)
    assert [r["bad_input"] for r in got] == [None, "capacity", "capacity", "capacity", "epsilon", "epsilon", "capacity", None, None]
    assert got[7]["blocked_is_dear"] and got[8]["blocked_bits_per_key"] is None and not got[0]["blocked_is_dear"]
    model = {r["bits_per_key"]: r["rate"] for r in sizing.blocked_rates(spark).collect()}
    assert all(model[b] == pytest.approx(sizing.blocked_rate(b), rel=1e-9) for b in (1, 8, 11, 27, 128))


def test_helpers():
    assert [reports.recommend(0.01, static=True), reports.recommend(1e-4, static=True), reports.recommend(0.01), reports.recommend(0.01, space_tight=True), reports.recommend(1e-6), reports.recommend(0.01, deletes=True)] == ["fuse8", "fuse16", "blocked", "bloom", "bloom", None]
    assert reports.to_number(" 5 ") == 5 and reports.to_number("") != reports.to_number("")
    assert (reports.human_count(1e6), reports.human_bytes(2048), reports.human_rate(22.06e6)) == ("1M", "2.00 KiB", "22.06 M ops/s")
    assert "another number" in reports.explain_error(errors.BinaryFuseBuildError("x"))
    with pytest.raises(KeyError):
        reports.explain_error(KeyError("x"))


def test_sql_names(spark):
    from quillsieve.operators.sql import register

    register(spark)
    a, b = BloomFilter.from_keys(["x"], 0.001), BinaryFuse16.from_keys(["y", "z"])
    df = spark.createDataFrame([(bytearray(a.to_bytes()), "x"), (bytearray(b.to_bytes()), "y"), (bytearray(b.to_bytes()), "q"), (None, "x"), (bytearray(a.to_bytes()), None), (bytearray(b"AMQF"), "x")], "frame binary, key string").coalesce(1)
    df.createOrReplaceTempView("held")
    good = spark.sql("SELECT amq_might_contain(frame, key) AS hit, amq_parse(frame).kind AS kind FROM held WHERE frame IS NULL OR octet_length(frame) > 4").collect()
    assert [r["hit"] for r in good] == [True, True, False, None, None] and [r["kind"] for r in good] == [1, 4, 4, None, 1]
    assert [r[0] for r in spark.sql("SELECT amq_parse(frame).error FROM held WHERE octet_length(frame) = 4").collect()] == ["TruncatedError"]
    assert spark.sql("SELECT amq_hash128('abc').w0").first()[0] == 0x75CDC6D1


def test_sql_probe_reads_large_frames_in_place(spark):
    from quillsieve.operators import sql

    sql.register(spark)
    own, asked = [f"k{i}" for i in range(3000)], [f"k{i}" for i in range(2000, 9000)]
    rows = spark.createDataFrame([(k,) for k in asked], "key string").coalesce(1)
    for held in (BloomFilter.from_keys(own, 0.01), BlockedBloomFilter.from_keys(own, 0.01), BinaryFuse8.from_keys(own), BinaryFuse16.from_keys(own), BinaryFuse16.from_keys([])):
        framed = rows.select("key", F.lit(held.to_bytes()).alias("frame")).selectExpr("amq_might_contain(frame, key) AS hit")
        assert [r["hit"] for r in framed.collect()] == held.has_all(asked).tolist()
    big = BloomFilter.from_keys(own, 1e-6).to_bytes()
    sent = rows.select("key", F.lit(big).alias("frame")).selectExpr("amq_might_contain(frame, key)")._jdf.queryExecution().executedPlan().toString()
    assert all(len(line) < len(big) for line in sent.splitlines() if "ArrowEvalPython" in line)  # not a whole frame for each row
    for bad in (big[:-1] + b"?", big[:9] + b"?" + big[10:], b"AMQF"):
        with pytest.raises(Exception, match="Error"):
            rows.select("key", F.lit(bad).alias("frame")).selectExpr("amq_might_contain(frame, key)").collect()


def test_accuracy(spark):
    got = {(r["structure"], r["n"]): r for r in reports.accuracy_report(spark, (2000, 5000), 0.01, 50_000).collect()}
    assert len(got) == 8 and all(0.004 < got[k, n]["measured_rate"] < 0.013 for k in ("bloom", "blocked") for n in (2000, 5000))
    assert got["fuse16", 5000]["measured_rate"] < 0.001
    both = {r["structure"]: r for r in reports.comparison_report(spark, (5000,), 0.01, 20_000).collect()}
    assert set(both) == {*reports.KINDS, "spark"}
    assert both["bloom"]["bits_per_key"] == pytest.approx(9.59, abs=0.01) and 0.003 < both["spark"]["measured_rate"] < 0.03
