"""Reports: sizing, accuracy, and the playground of generated keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.errors import BinaryFuseBuildError, ParamError
from quillsieve.functions import sizing
from quillsieve.operators import build, probe
from quillsieve.operators.filters import Filter
from quillsieve.sources import keys

KINDS = ("bloom", "blocked", "fuse8", "fuse16")
MOST_CAPACITY = 10**12
PROBES, MOST_KEYS = 20_000, 100_000
PENALTY = 1.5


def to_number(value: object) -> float:
    """Numbers as they are, texts that are numbers as numbers, anything else NaN."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value
    try:
        return float(value) if isinstance(value, str) and value.strip() else math.nan
    except ValueError:
        return math.nan


def sizing_report(requirements: DataFrame) -> DataFrame:
    """requirements(capacity, epsilon) with bits a key and bytes of all four structures, and a warning.

    bad_input says which input is out of range: the capacity must be a whole
    number from 1 to 1e12, epsilon strictly between 0 and 1. blocked is null
    where 128 bits a key do not meet epsilon. The warning is given where a
    blocked filter takes half as much again as a classic one, or more; message
    says any of these in words.
    """
    rates = [sizing.blocked_rate(b) for b in range(1, sizing.MOST_BLOCKED_BITS + 1)]
    n, eps = F.col("capacity").cast("double"), F.col("epsilon").cast("double")
    ok_n = (n >= 1) & (n <= MOST_CAPACITY) & (F.floor(n) == n) & ~F.isnan(n)
    ok_eps = (eps > 0) & (eps < 1) & ~F.isnan(eps)
    bad = F.when(~F.coalesce(ok_n, F.lit(False)), "capacity").when(~F.coalesce(ok_eps, F.lit(False)), "epsilon")
    base = requirements.withColumn("bad_input", bad).withColumn("_n", F.when(bad.isNull(), n)).withColumn("_e", F.when(bad.isNull(), eps))
    m, k = sizing.bloom_size_columns(F.col("_n"), F.col("_e"))
    too_high = F.size(F.filter(F.array(*map(F.lit, rates)), lambda r: r > F.col("_e")))  # the rates fall with the bits
    blocked = F.when(too_high < len(rates), too_high.cast("long") + 1)
    _, _, slots = sizing.fuse_geometry_columns(F.col("_n").cast("long"))
    out = base.withColumn("bloom_m", m.cast("long")).withColumn("bloom_k", k.cast("int")).withColumn("blocked_bits_per_key", blocked).withColumn("fuse_slots", slots)
    bloom_bits = F.col("bloom_m") / F.col("_n")
    warn = F.coalesce(F.col("blocked_bits_per_key") >= PENALTY * bloom_bits, F.lit(False))
    message = (
        F.when(bad == "capacity", f"The capacity must be a whole number from 1 to {MOST_CAPACITY}.")
        .when(bad == "epsilon", "The rate must lie strictly between 0 and 1.")
        .when(F.col("blocked_bits_per_key").isNull(), f"No blocked filter of up to {sizing.MOST_BLOCKED_BITS} bits a key is that exact.")
        .when(warn, F.concat(F.lit("A blocked filter takes "), F.col("blocked_bits_per_key").cast("string"), F.lit(" bits a key for this rate, a classic one "), F.round(bloom_bits).cast("long").cast("string"), F.lit(".")))
    )
    return out.select(
        "capacity",
        "epsilon",
        "bad_input",
        bloom_bits.alias("bloom_bits_per_key"),
        F.ceil(F.col("bloom_m") / 8).alias("bloom_bytes"),
        "bloom_k",
        "blocked_bits_per_key",
        F.ceil(F.col("blocked_bits_per_key") * F.col("_n") / 8).alias("blocked_bytes"),
        (F.col("fuse_slots") * 8 / F.col("_n")).alias("fuse8_bits_per_key"),
        F.col("fuse_slots").alias("fuse8_bytes"),
        (F.col("fuse_slots") * 16 / F.col("_n")).alias("fuse16_bits_per_key"),
        (F.col("fuse_slots") * 2).alias("fuse16_bytes"),
        warn.alias("blocked_is_dear"),
        message.alias("message"),
    )


def recommend(epsilon: float, static: bool = False, deletes: bool = False, unbounded: bool = False, space_tight: bool = False) -> str | None:
    """The structure for a workload; None where none of these serves it."""
    if deletes or unbounded:
        return None
    if static:
        return "fuse16" if epsilon < 2**-8 else "fuse8"
    return "bloom" if space_tight or epsilon < 1e-5 else "blocked"


def explain_error(error: Exception) -> str:
    """What a reader can do about an error of a build; other errors are raised again."""
    if isinstance(error, ParamError):
        return str(error)
    if isinstance(error, BinaryFuseBuildError):
        return "The fuse filter's keys could not be arranged. The same keys always fail alike, so try another number of keys."
    raise error


def _filters(df: DataFrame, epsilon: float, kinds: tuple[str, ...] = KINDS) -> dict[str, Filter]:
    wide = [kind for kind in kinds if kind in build.FUSES]
    held = dict(zip(wide, build.fuses(df, "key", *[build.FUSES[kind] for kind in wide]), strict=True)) if wide else {}
    return {kind: held[kind] if kind in held else build.build(df, "key", kind, epsilon) for kind in kinds}


def accuracy_report(spark: SparkSession, sizes: tuple[int, ...], epsilon: float = 0.01, probes: int = 1_000_000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """For each size and structure: target, measured rate over keys that are not held, and bits a key."""
    targets = {"bloom": epsilon, "blocked": epsilon, "fuse8": 2.0**-8, "fuse16": 2.0**-16}
    parts = []
    for n in sizes:
        held = _filters(keys.numbered(spark, n, "0:"), epsilon, kinds)
        hits = keys.numbered(spark, probes, "1:").select(*[probe.might_contain(spark, f, F.col("key")).alias(kind) for kind, f in held.items()])
        rates = hits.agg(*[F.avg(F.col(kind).cast("double")).alias(kind) for kind in held])
        row = lambda kind, f, n=n: F.struct(F.lit(kind).alias("structure"), F.lit(n).cast("long").alias("n"), F.lit(targets[kind]).alias("target_rate"), F.col(kind).alias("measured_rate"), F.lit(float(f.bits_per_key)).alias("bits_per_key"))
        parts.append(rates.select(F.inline(F.array(*[row(kind, f) for kind, f in held.items()]))))
    return reduce(DataFrame.unionByName, parts)


def comparison_report(spark: SparkSession, sizes: tuple[int, ...], epsilon: float = 0.01, probes: int = 100_000) -> DataFrame:
    """At each size and the same rate: all four structures beside the filter that Spark's own aggregation builds (of longs), with measured rates and bits a key."""
    parts = []
    for n in sizes:
        parts.append(accuracy_report(spark, (n,), epsilon, probes).select("structure", "n", "measured_rate", "bits_per_key"))
        built = spark.range(n)._jdf.stat().bloomFilter("id", n, epsilon)
        asked = min(probes, 20_000)
        wrong = sum(built.mightContainLong(n + i) for i in range(asked))  # a bounded number of calls
        parts.append(spark.createDataFrame([("spark", n, wrong / asked, built.bitSize() / n)], "structure string, n long, measured_rate double, bits_per_key double"))
    return reduce(DataFrame.unionByName, parts)


class Playground:
    """Three filters of generated keys, which take late keys, answer for single keys, and report."""

    def __init__(self, spark: SparkSession, key_count: object, target: object) -> None:
        n = to_number(key_count)
        if not (n == n and math.isfinite(n) and n == int(n) and 1 <= n <= MOST_KEYS):
            raise ParamError(f"the number of keys is a whole number from 1 to {MOST_KEYS}")
        if math.isnan(to_number(target)):
            raise ParamError("the target rate is a number")
        self.spark, self.n, self.target = spark, int(n), to_number(target)
        self.filters = _filters(keys.members(spark, self.n), self.target, ("bloom", "blocked", "fuse8"))
        self.late: list[str] = []

    def insert(self, key: str) -> str:
        """Add a key to both Bloom filters; says why the fuse filter takes none. A key that is there already changes nothing."""
        built = key.startswith("key-") and key[4:].isdigit() and str(int(key[4:])) == key[4:] and int(key[4:]) < self.n
        if not built and key not in self.late:
            self.late.append(key)
            for kind in ("bloom", "blocked"):
                self.filters[kind].add(key)
        return f"A fuse filter is built once, here from {self.n} keys, and takes no more: build it anew to include this one."

    def _known(self, asked: DataFrame) -> DataFrame:
        """asked(key) with inserted and late."""
        number = F.regexp_extract("key", r"^key-(0|[1-9][0-9]*)$", 1)
        built = (F.length(number).between(1, 9)) & (F.coalesce(number.try_cast("long"), F.lit(-1)) < self.n)
        late = F.col("key").isin(self.late)
        return asked.select("key", (built | late).alias("inserted"), late.alias("late"))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked(key) with inserted and the verdict of each structure."""
        known = self._known(asked)
        each = {kind: probe.verdicts(self.spark, known, f, static=kind == "fuse8") for kind, f in self.filters.items()}
        return known.select("key", "inserted", *[v.alias(kind) for kind, v in each.items()])

    def report(self) -> DataFrame:
        """A row a structure: keys held, held but missing, bits a key, bytes, false positives and measured rate."""
        held = keys.members(self.spark, self.n).withColumn("in_build", F.lit(True)).withColumn("probe", F.lit(False))
        more = self.spark.createDataFrame([(k,) for k in self.late], "key string").select("key", F.lit(False).alias("in_build"), F.lit(False).alias("probe"))
        asked = keys.misses(self.spark, PROBES).where(~F.col("key").isin(self.late)).select("key", F.lit(False).alias("in_build"), F.lit(True).alias("probe"))
        hits = held.unionByName(more).unionByName(asked).select("in_build", "probe", *[probe.might_contain(self.spark, f, F.col("key")).alias(kind) for kind, f in self.filters.items()])

        def row(kind: str, f: Filter) -> Column:
            mine = F.col("in_build") if kind == "fuse8" else ~F.col("probe")
            wrong = F.count_if(F.col("probe") & F.col(kind))
            return F.struct(
                F.lit(kind).alias("structure"),
                F.count_if(mine).alias("held_keys"),
                F.count_if(mine & ~F.col(kind)).alias("missing"),
                F.lit(float(f.bits_per_key)).alias("bits_per_key"),
                F.lit(math.ceil(f.bits_per_key * self.n / 8)).cast("long").alias("total_bytes"),
                wrong.alias("false_positives"),
                (wrong / F.count_if("probe")).alias("measured_rate"),
            )

        return hits.agg(F.array(*[row(kind, f) for kind, f in self.filters.items()]).alias("rows")).select(F.inline("rows"))


def as_markdown(report: DataFrame) -> str:
    """A small report as a Markdown table."""
    rows = report.collect()
    show = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    lines = [report.columns, ["---"] * len(report.columns), *[[show(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def human_count(n: float) -> str:
    """1000 as 1k, 1000000 as 1M."""
    return f"{n / 1e6:g}M" if n >= 1e6 else f"{n / 1e3:g}k" if n >= 1e3 else f"{n:g}"


def human_rate(per_second: float) -> str:
    """Operations a second, with two digits behind the point."""
    return f"{per_second / 1e6:.2f} M ops/s" if per_second >= 1e6 else f"{per_second / 1e3:.2f} k ops/s" if per_second >= 1e3 else f"{per_second:.0f} ops/s"


def human_bytes(n: float) -> str:
    """Bytes with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TiB"
