"""Mixing sources to target weights by Pareto order sampling.

Each source's target divided by its size is the expected number of copies of
its documents. The whole part is allocated to every document as certain
copies; the fraction is the inclusion probability of one more copy. Documents
are ranked by their random odds divided by their inclusion odds, and each
source takes the head of the ranking that fills the rest of its target. One
closing document, the one whose size is nearest to the gap that is left,
brings the source as near to its target as whole documents can.

Inclusion odds differ from source to source, and are the same for the documents
of one source, as a mix wants no other preference among them. Every source is a
stratum with a ranking of its own, fixed in size (in words), since one ranking
of all would meet the targets only on average; within a stratum the rank is
therefore a rising function of the random number alone.

No source is ever gathered in one task: the cut in the ranking is found by two
histograms of 4096 bins for each source and a window over the one bin pair in
which the cut lies. Random numbers come from a hash of doc_id and text, so
reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; rows that repeat both doc_id and text tie, and as many of them are taken as
the target asks for, which ones does not matter; sources that tie in size over
weight get equal shares of it; an empty table gives an empty result; other
columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.llm.common import WORD, as_row, broadcast_if_small, cut_lineage

BINS = 4096
HASH_BITS = 52


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """sizes(source, source_size) with the weight and target of each source.

    Sources take the weights in code-point order, null last, repeating. They
    share the total size by weight; no target is above max_copies times its
    source's size, the excess going to the others by weight. That level is
    found in closed form: in order of cap / weight, the first source that the
    level of the remaining weight does not cap. One row a source, so the
    windows over all sources hold that many rows.
    """
    everything = W.partitionBy()
    k = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    in_order = by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)
    level = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("place"),
        ((F.sum("source_size").over(everything) - (F.sum("cap").over(in_order) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(in_order) - F.col("weight")))).alias("level"),
    )
    # of sources that tie in cap / weight only the first one's level counts all of them as open
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    return level.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * first["level"], F.col("cap"))).alias("target"))


def _first_over(binned: DataFrame, bin_name: str) -> DataFrame:
    """The first bin of each source in which the running size passes the rest, with what came before it as base."""
    running = F.sum("bin_size").over(W.partitionBy("source").orderBy(bin_name))
    return (
        binned.withColumn("before", F.col("base") + running - F.col("bin_size"))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        .groupBy("source")
        .agg(F.min_by(F.struct(bin_name, "before"), bin_name).alias("x"))
        .select("source", F.col(f"x.{bin_name}").alias(bin_name), F.col("x.before").alias("base"))
    )


def _with_plan(df: DataFrame, plan: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """df joined to rows of the sources' plan, null sources included."""
    plan = broadcast_if_small(plan.withColumnRenamed("source", "_source"), rows)
    return df.join(plan, df["source"].eqNullSafe(plan["_source"]), how).drop("_source")


def _random(seed: str) -> Column:
    """A number in [0, 2^52) from the hash of doc_id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _fine_bin() -> Column:
    """The bin, of BINS squared, of a document's rank: random odds divided by inclusion odds."""
    share = F.least(F.greatest(F.col("share"), F.lit(1e-12)), F.lit(1 - 1e-12))
    chance = (F.col("u") + 0.5) / float(2**HASH_BITS)
    rank = (chance / (1 - chance)) / (share / (1 - share))
    place = rank / (1 + rank)  # the same order within (0, 1)
    return F.least(F.floor(place * (BINS * BINS)), F.lit(BINS * BINS - 1))


def _me() -> Column:
    return F.struct("u", "doc_id")


def _is(name: str) -> Column:
    """Whether the row is of the tie (rows of one u and doc_id) that the plan's column `name` names."""
    return F.coalesce((F.col("u") == F.col(f"{name}.u")) & F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id")), F.lit(False))


def _before_cut() -> Column:
    """Whether the rank is in the head of its source's ranking, before the tie in which the cut lies."""
    return F.coalesce((F.col("share") > 0) & ((F.col("fine") < F.col("edge")) | ((F.col("fine") == F.col("edge")) & (_me() < F.col("cut")))), F.lit(False))


def mixing_plan(keyed: DataFrame, weights: tuple[int, ...], max_copies: int) -> tuple[DataFrame, int, bool]:
    """One row for each source of keyed(doc_id, source, size, u), their number, and whether any tie is split.

    A row has the source's target and certain copies; where its ranking is cut:
    the fine bin (edge), the tie in it (cut) and how many rows of that are drawn
    (from_cut); and the tie of its closing document (close).
    """
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("share", ratio - F.floor(ratio))
    plan = cut_lineage(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n = plan.count()
    rests = plan.where("share > 0").select("source", "rest")
    ranked = _with_plan(keyed, plan.where("share > 0").select("source", "share", "rest"), n).withColumn("fine", _fine_bin())
    coarse_bin = F.floor(F.col("fine") / BINS)
    coarse = ranked.groupBy("source", coarse_bin.alias("coarse")).agg(F.sum("size").alias("bin_size"))
    edge1 = _first_over(_with_plan(coarse, rests, n).withColumn("base", F.lit(0)), "coarse")
    inside = _with_plan(ranked, edge1, n).where(coarse_bin == F.col("coarse"))
    bins2 = inside.groupBy("source", "fine", "base", "rest").agg(F.sum("size").alias("bin_size"))
    edge2 = cut_lineage(_first_over(bins2, "fine").withColumnRenamed("fine", "edge"))
    ties = _with_plan(ranked, edge2, n).where("fine = edge").groupBy("source", "u", "doc_id", "size", "base", "rest").agg(F.count("*").alias("rows"))
    in_order = W.partitionBy("source").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(F.col("size") * F.col("rows")).over(in_order)
    upto = ties.withColumn("before", F.col("base") + total - F.col("size") * F.col("rows"))
    crossing = upto.where(F.col("before") + F.col("size") * F.col("rows") > F.col("rest"))
    first = crossing.groupBy("source").agg(F.min(F.struct(_me().alias("cut"), "size", "rows", "before", "rest")).alias("x"))
    drawn = F.floor((F.col("x.rest") - F.col("x.before")) / F.col("x.size"))
    cuts = first.select("source", "x.cut", drawn.alias("from_cut"), F.col("x.rows").alias("in_cut"), (F.col("x.before") + drawn * F.col("x.size")).alias("filled"))
    placed = _with_plan(edge2.select("source", "edge"), cuts, n, "left")
    cut = cut_lineage(_with_plan(plan, placed, n, "left").withColumn("gap", F.col("rest") - F.col("filled")))
    miss = F.abs(F.col("size") - F.col("gap"))
    open_rows = ~_before_cut() & ~(_is("cut") & (F.col("from_cut") >= F.col("in_cut")))
    rest_of = _with_plan(keyed, cut, n).withColumn("fine", _fine_bin()).where(open_rows & (F.col("size") > 0) & (F.col("share") > 0) & (miss < F.col("gap")))
    by_tie = rest_of.groupBy("source", miss.alias("miss"), _me().alias("tie")).agg(F.count("*").alias("rows"))
    closing = by_tie.groupBy("source").agg(F.min(F.struct("miss", "tie", "rows")).alias("x")).select("source", F.col("x.tie").alias("close"), F.col("x.rows").alias("in_close"))
    whole = cut_lineage(_with_plan(cut, closing, n, "left").drop("weight", "rest", "filled", "gap"))
    split = whole.where("in_cut > 1 or in_close > 1").select("source").take(1)
    return whole.drop("in_cut", "in_close"), n, bool(split)


def with_copies(df: DataFrame, plan: DataFrame, rows: int, split: bool = True) -> DataFrame:
    """df(doc_id, source, u, ...) with its source's plan and the copies that the mix takes of each row.

    split: whether rows of a tie may get unlike copies. Only the two ties of each
    source of which some rows are taken are then numbered.
    """
    marked = _with_plan(df, plan, rows, "left").withColumn("fine", _fine_bin())
    more = F.when(_is("cut"), F.coalesce("from_cut", F.lit(0))).otherwise(0) + _is("close").cast("long")
    number = F.row_number().over(W.partitionBy("source", "u", "doc_id").orderBy(F.lit(0)))
    copies = lambda k: (F.col("whole") + _before_cut().cast("long") + F.when(more >= k, 1).otherwise(0)).cast("long")
    if not split:
        return marked.withColumn("copies", copies(F.lit(1)))
    special = _is("cut") | _is("close")
    numbered = marked.where(special).withColumn("_k", number)
    return marked.where(~special).withColumn("copies", copies(F.lit(1))).unionByName(numbered.withColumn("copies", copies(F.col("_k"))).drop("_k"))


def _keyed(documents: DataFrame, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut_lineage(documents.select("doc_id", "source", size.alias("size"), _random(seed).alias("u")))


def pareto_mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """Every document of documents(doc_id, text, source) with the copies that the mix takes of it.

    Returns doc_id, source, size, source_size, target, copies, taken
    (copies * size). taken never exceeds max_copies times size.
    """
    keyed = _keyed(documents, seed)
    plan, n, split = mixing_plan(keyed, weights, max_copies)
    return with_copies(keyed, plan, n, split).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of documents, each as often as it is taken, columns unchanged. The texts are not shuffled, but for those of ties that are split."""
    plan, n, split = mixing_plan(_keyed(documents, seed), weights, max_copies)
    rows = documents.select(as_row(documents), "doc_id", "source", _random(seed).alias("u"))
    copies = with_copies(rows, plan, n, split).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("row.*")


#: The same rows by one window a source, for a machine that holds them all.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[(k % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
         (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS lev
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), v AS (
  SELECT arg_min(lev, place) AS lev FROM l WHERE lev * weight <= cap
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * v.lev, cap)) AS target FROM l, v
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS share FROM p
), c AS (
  SELECT d.doc_id, d.size, d.u, r.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS total
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), m AS (
  SELECT *, share > 0 AND total <= rest AS drawn FROM c
), g AS (
  SELECT *, rest - coalesce(max(CASE WHEN drawn THEN total END) OVER (PARTITION BY source), 0) AS gap FROM m
), f AS (
  SELECT *, CASE WHEN NOT drawn AND size > 0 AND share > 0 AND abs(size - gap) < gap THEN row_number() OVER (
           PARTITION BY source, NOT drawn AND size > 0 AND share > 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), u, doc_id) ELSE 0 END AS n FROM g
)
SELECT doc_id, size, source_size, target, (size * (whole + drawn::INT + (n = 1)::INT))::BIGINT AS taken FROM f
"""
