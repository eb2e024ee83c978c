"""URL filters: rules first, then a character language-model ratio.

URLs that a rule decides train two smoothed variable-order Markov models, one
of the accepted and one of the rejected URLs: Witten-Bell interpolation over
contexts of up to three characters, with back-off to the longest context that
was seen. A URL that no rule fits is scored by the difference of its
log-likelihoods divided by its length, and allowed at or above a threshold
calibrated on a quarter of the labelled URLs that the models do not learn from.
Counting covers every labelled URL; all of it is built-in column arithmetic.

No gram or context is left out. As long as there are at most `most` of either,
the model travels in the plan as two arrays of numbers, in buckets by the hash of
a gram or context. A larger one stays a table: each distinct gram of ORDER
characters of the URLs is given its log-ratio by joins, and a URL's score is the
sum over its grams. Both count in whole thousandths, so their scores are equal.

Edge cases: null URLs and those without :// have an empty host and path and no
rule; the empty URL has score 0; without labelled URLs of both kinds every
verdict of the method is allow, and without such to calibrate with the threshold
is 0; of rules equally long block wins; scores equal to the threshold are allowed;
URLs of any length are read whole, and rows that repeat one are judged each, and
count each where models learn; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.llm.common import cut_lineage, let

ORDER = 4
MOST = 1 << 16  # grams, and contexts, of a model that travels in the plan
HOT = 1 << 14  # grams that are joined by broadcast
BITS, HALF = 24, 1 << 23
ALPHABET = 256
PAD = "^" * (ORDER - 1)
STEP = 0.01  # of the calibrating histogram, which spans -10 to 10


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Columns host (A-Z lower-cased) and path of url."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_of(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _chars(url: Column) -> Column:
    return F.split(F.concat(F.lit(PAD), F.lower(F.coalesce(url, F.lit("")))), "")


def _gram(chars: Column, at: Column, n: int) -> Column:
    """The gram of n characters that ends at character `at` of the URL, counted from 0."""
    return F.concat(*[F.get(chars, at + (ORDER - n + k)) for k in range(n)])


def _ends(chars: Column) -> Column:
    """Every place in the URL at which a gram ends."""
    return F.when(F.size(chars) >= ORDER, F.sequence(F.lit(0), F.size(chars) - ORDER)).otherwise(F.array().cast("array<int>"))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """gram, accepted, rejected: how often grams of 1 to ORDER characters occur in labelled(url, accepted) of either kind."""
    grams = let(_chars(F.col("url")), lambda c: F.flatten(F.transform(_ends(c), lambda i: F.array(*[_gram(c, i, n) for n in range(1, ORDER + 1)]))))
    rows = labelled.select("accepted", F.explode(grams).alias("gram"))
    return rows.groupBy("gram").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n, v): log-ratio of the smoothed probabilities of each seen gram's last character;
    (context, n, v): log-ratio of the weights with which each context backs off."""
    both = ("accepted", "rejected")
    rows = counts.select("*", F.length("gram").alias("o"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("suffix"))
    stats = rows.groupBy("context").agg(F.first("o").alias("o"), *[e for k in both for e in (F.sum(k).alias(f"n_{k}"), F.count_if(F.col(k) > 0).alias(f"t_{k}"))])
    weight = {k: F.when(F.col(f"n_{k}") > 0, F.col(f"t_{k}") / (F.col(f"n_{k}") + F.col(f"t_{k}"))).otherwise(1.0) for k in both}
    stats = stats.withColumns({f"w_{k}": weight[k] for k in both})
    levels, lower = [], None
    for o in range(1, ORDER + 1):
        level = rows.where(F.col("o") == o).join(stats.drop("o"), "context")
        if lower is None:
            p = {k: F.lit(1 / ALPHABET) for k in both}
        else:
            level = level.join(lower.select(F.col("gram").alias("suffix"), *[F.col(f"p_{k}").alias(f"q_{k}") for k in both]), "suffix")
            p = {k: F.col(f"q_{k}") for k in both}
        seen = {k: F.when(F.col(f"n_{k}") > 0, F.col(k) / (F.col(f"n_{k}") + F.col(f"t_{k}"))).otherwise(0.0) for k in both}
        lower = cut_lineage(level.select("gram", (F.col("accepted") + F.col("rejected")).alias("n"), *[(seen[k] + F.col(f"w_{k}") * p[k]).alias(f"p_{k}") for k in both]))
        levels.append(lower.select("gram", "n", F.log(F.col("p_accepted") / F.col("p_rejected")).alias("v")))
    grams = levels[0]
    for x in levels[1:]:
        grams = grams.unionByName(x)
    backoff = stats.select("context", (F.col("n_accepted") + F.col("n_rejected")).alias("n"), F.log(F.col("w_accepted") / F.col("w_rejected")).alias("v"))
    return grams, backoff


def _thousandths(value: Column) -> Column:
    return F.greatest(F.least(F.round(value * 1000), F.lit(HALF - 1)), F.lit(1 - HALF)).cast("long")


def _entry(gram: Column, value: Column) -> Column:
    """A gram's check bits (40 of its hash) and its value in thousandths (24), in one long."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(gram), BITS), BITS).bitwiseOR(_thousandths(value) + HALF)


def _packed(values: DataFrame, key: str, n: int) -> tuple[str, int]:
    """(JSON of an array of buckets of entries, number of buckets) of all n values."""
    buckets = 1 << max(0, n - 1).bit_length()
    slot = F.pmod(F.xxhash64(key), F.lit(buckets))
    full = values.groupBy(slot.alias("id")).agg(F.sort_array(F.collect_list(_entry(F.col(key), F.col("v")))).alias("b"))
    dense = values.sparkSession.range(buckets).join(full, "id", "left").select("id", F.coalesce("b", F.array().cast("array<bigint>")).alias("b"))
    one = dense.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("a"))  # at most as many entries as grams are kept
    return one.select(F.to_json(F.transform("a", lambda x: x["b"]))).first()[0], buckets


def _found(model: Column, gram: Column, buckets: int) -> Column:
    """The gram's value in a packed model, in thousandths, or null."""
    h = F.xxhash64(gram)
    own = F.filter(F.get(model, F.pmod(h, F.lit(buckets)).cast("int")), lambda e: F.shiftrightunsigned(e, BITS) == F.shiftrightunsigned(h, BITS))
    return (F.get(own, F.lit(0)).bitwiseAND((1 << BITS) - 1) - HALF)


def _mean(thousandths: Column, length: Column) -> Column:
    return thousandths / 1000.0 / F.greatest(length, F.lit(1))


def score(url: Column, grams: tuple[str, int], backoff: tuple[str, int]) -> Column:
    """Length-normalised log-likelihood difference: above 0 if the accepted model fits better."""
    # bound once, so that the plan holds each array once
    kind = "array<array<bigint>>"
    model = F.struct(F.from_json(F.lit(grams[0]), kind).alias("value"), F.from_json(F.lit(backoff[0]), kind).alias("weight"))

    def at(m: Column, chars: Column, i: Column) -> Column:
        found = F.lit(0).cast("long")
        for n in range(1, ORDER + 1):
            context = F.concat(*[F.get(chars, i + (ORDER - n + k)) for k in range(n - 1)]) if n > 1 else F.lit("")
            found = F.coalesce(_found(m["weight"], context, backoff[1]), F.lit(0)) + found
            found = F.coalesce(_found(m["value"], _gram(chars, i, n), grams[1]), found)
        return found

    def total(m: Column, c: Column) -> Column:
        return _mean(F.aggregate(_ends(c), F.lit(0).cast("long"), lambda acc, i: acc + at(m, c, i)), F.size(c) - (ORDER - 1))

    return F.when(F.coalesce(url, F.lit("")) == "", 0.0).otherwise(let(model, lambda m: let(_chars(url), lambda c: total(m, c))))


def scores(urls: DataFrame, grams: DataFrame, backoff: DataFrame) -> DataFrame:
    """url and score of the distinct URLs of urls(url) that are not empty: as score(), by joins with the whole model.

    The most frequent grams are met by a broadcast join, as every URL may have
    them; the others by a shuffle join.
    """
    own = cut_lineage(urls.select("url").where("url <> ''").distinct().withColumn("_id", F.monotonically_increasing_id()))
    chars = _chars(F.col("url"))
    ends = own.select("_id", F.explode(let(chars, lambda c: F.transform(_ends(c), lambda i: _gram(c, i, ORDER)))).alias("full"))
    asked = cut_lineage(ends.groupBy("full").agg(F.count("*").alias("often")))
    held, found = asked, F.lit(0).cast("long")
    for n in range(1, ORDER + 1):
        # of the gram's last n characters, and of those without the last one
        tail, context = F.substring("full", ORDER - n + 1, n), F.substring("full", ORDER - n + 1, n - 1)
        held = held.withColumn("_g", tail).join(grams.select(F.col("gram").alias("_g"), _thousandths(F.col("v")).alias(f"_v{n}")), "_g", "left").drop("_g")
        held = held.withColumn("_c", context).join(backoff.select(F.col("context").alias("_c"), _thousandths(F.col("v")).alias(f"_w{n}")), "_c", "left").drop("_c")
        found = F.coalesce(F.col(f"_v{n}"), F.coalesce(F.col(f"_w{n}"), F.lit(0)) + found)
    valued = cut_lineage(held.select("full", "often", found.alias("v")))
    often = cut_lineage(valued.orderBy(F.desc("often"), "full").limit(HOT).select("full", F.col("v").alias("hot")))
    met = ends.join(F.broadcast(often), "full", "left")
    rest = met.where("hot is null").select("_id", "full").join(valued.select("full", "v"), "full").select("_id", "v")
    total = met.where("hot is not null").select("_id", F.col("hot").alias("v")).unionByName(rest).groupBy("_id").agg(F.sum("v").alias("total"))
    return own.join(total, "_id").select("url", _mean(F.col("total"), F.size(chars) - (ORDER - 1)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score at which accepted(boolean) of scored(score, accepted) parts best: least mean of both error rates. 0 unless there are rows of both kinds."""
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-1000)), F.lit(1000))
    bins = scored.groupBy(step.alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # 2001 bins at most
    everything = W.partitionBy()
    share = lambda k: F.try_divide(F.coalesce(F.sum(k).over(below), F.lit(0)), F.sum(k).over(everything))
    best = bins.select((F.col("bin") * STEP).alias("t"), (share("a") + 1 - share("r")).alias("loss")).where("loss is not null").orderBy("loss", F.abs("t"), "t").first()
    return 0.0 if best is None else best["t"]


def filter_urls(pages: DataFrame, rules: list[Rule], most: int = MOST) -> DataFrame:
    """pages(page_id, url) with host, path, rule, score (null where a rule decides) and verdict."""
    parsed = with_host_and_path(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules))
    labelled = parsed.where("_rule is not null").select("url", (F.col("_rule.verdict") == "allow").alias("accepted"))
    calibrating = F.crc32(F.col("url").cast("binary")) % 4 == 2
    counts = cut_lineage(gram_counts(labelled.where(~calibrating)))
    grams, backoff = log_ratios(counts)
    kinds = counts.where("length(gram) = 1").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    found, limit = F.lit(0.0), 0.0
    if kinds["a"] and kinds["r"]:
        n_grams, n_contexts = grams.count(), backoff.count()
        if max(n_grams, n_contexts) <= most:
            found = score(F.col("url"), _packed(grams, "gram", n_grams), _packed(backoff, "context", n_contexts))
            limit = threshold(labelled.where(calibrating).withColumn("score", found))
        else:
            asked = parsed.where("_rule is null").select("url").union(labelled.where(calibrating).select("url"))
            known = cut_lineage(scores(asked, grams, cut_lineage(backoff)))
            found = F.coalesce("score", F.lit(0.0))
            limit = threshold(labelled.where(calibrating).join(known, "url", "left").withColumn("score", found))
            parsed = parsed.join(known, "url", "left")
    open_rows = parsed.withColumn("score", F.when(F.col("_rule").isNull(), found))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return open_rows.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), "score", verdict.alias("verdict"))
