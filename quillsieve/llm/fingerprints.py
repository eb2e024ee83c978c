"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's shingles of five words (a text of fewer words is one shingle; one
without words has none). Sketches of parts merge into the sketch of the whole,
and estimate distinct shingles, resemblance and containment. All of it is
built-in column arithmetic.

Edge cases: a null text is empty; two empty sketches resemble each other fully,
an empty and a full one not at all; equal texts have equal sketches; rows that
repeat a doc_id follow each other in the order of their texts' hashes; null ids
come last (rows of one id, or without one, lie in one range); an empty table gives an empty result; doc_id may be of any type that
can be ordered and written as text; texts of any length are read whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.llm.common import as_array, let, null_to_empty, range_cuts, range_of, words

K = 128
SHINGLE = 5
ROWS_A_RANGE = 8192


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text column: array<long>, ascending."""
    hashes = let(
        words(text),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        ),
    )
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both."""
    both = let(merged(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k of them."""
    share = (F.element_at(a, k).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    found = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(found, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """A sketch as one string, 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(df: DataFrame, key: str, name: str, k: int = K, fan_in: int = 256) -> DataFrame:
    """One sketch for each key from any number of partial ones.

    A tree: rounds of groups of about fan_in sketches, dealt by the sketches'
    own hashes, so a key with a third of all rows is still merged in parallel.
    """
    rows = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    level = df.select(F.col(key), F.col(name), F.monotonically_increasing_id().alias("_n"))
    fold = F.aggregate(F.collect_list(name), F.array().cast("array<bigint>"), lambda s, x: merged(s, x, k)).alias(name)
    while rows > fan_in:
        parts = -(-rows // fan_in)
        level = level.groupBy(key, F.pmod(F.xxhash64("_n"), F.lit(parts)).alias("_n")).agg(fold)
        rows = parts
    return level.groupBy(key).agg(fold)


def fingerprint_edits(documents: DataFrame, k: int = K) -> DataFrame:
    """Every text of documents(doc_id, text), its edited text, and the sketches of both.

    The edited text is the text without its last quarter of code points, then
    as many code points (or all) from the head of the next document's text, in
    ascending doc_id; the last document is followed by the first. Documents are
    dealt by ranges of doc_id that start at known ids, and the first of each
    range is sent to the one before it as well: one shuffle of the texts, and no
    task that sees more than a range. The number of ranges grows with that of the
    documents.
    """
    spark = documents.sparkSession
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), documents.count() // ROWS_A_RANGE)
    cuts, kind = range_cuts(documents, "doc_id", parts), documents.schema["doc_id"].dataType.simpleString()
    doc = documents.select("doc_id", null_to_empty("text").alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    n = max(1, len(cuts))
    starts = F.get(as_array(cuts, kind), F.col("_part")) == F.col("doc_id") if cuts else F.lit(True)
    before = F.pmod(F.col("_part") - 1, F.lit(n))
    doc = doc.withColumn("_part", range_of(F.col("doc_id"), cuts, kind)).withColumn("_starts", F.coalesce(starts, F.lit(False)))
    places = F.when(F.col("_starts"), F.array(F.struct(F.lit(0).alias("ghost"), F.col("_part").alias("part")), F.struct(F.lit(1).alias("ghost"), before.alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).alias("ghost"), F.col("_part").alias("part")))
    )
    dealt = doc.select("doc_id", "text", "sketch", F.explode(places).alias("_at")).select("doc_id", "text", "sketch", "_at.ghost", "_at.part")
    order = W.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    paired = dealt.select("*", F.lead(F.struct("text", "sketch")).over(order).alias("next")).where("ghost = 0")
    n_chars = F.length("text")
    cut = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n_chars - cut), F.substr(F.coalesce("next.text", "text"), F.lit(1), cut))
    return paired.select("doc_id", "text", "sketch", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), F.coalesce("next.sketch", "sketch").alias("next_sketch")).withColumn("edited_sketch", sketch(F.col("edited"), k))
