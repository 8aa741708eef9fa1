"""Mixing sources to target weights by Poisson replication.

A document is repeated a Poisson-distributed number of times whose mean brings its source to its target share. The
draw inverts the distribution at a uniform value hashed from the document id, so it does not depend on partitions,
retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A larger mean is drawn as the sum of several draws of at most this mean, which keeps exp(-mean) far from zero.
PART_MEAN = 64.0
#: Up to so many sources their rates are sent to every task; beyond that they are joined by a shuffle.
SENT_SOURCES = 10_000
UNIT = float(1 << 52)


def hash_uniform(*parts: Column) -> Column:
    """A value in [0, 1) from the md5 of the parts: the same in any engine that has md5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(UNIT)


def source_rates(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, total_chars: float | None = None,
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(source_key, rate, parts, cdf): each source's mean number of repetitions and its distribution function.

    The rate is weight / sum of weights x total / characters of the source; the total is that of the input unless
    given. Sources without a weight take the default; null is a source of its own. A source without any characters
    cannot reach a share: its weight is left out and its documents stay once each (rate 1).
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    source = F.col(source_col).alias("source_key")
    sizes = docs.groupBy(source).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("chars"))
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("source_key") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    sums = sizes.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars"))
    whole = F.col("all_chars") if total_chars is None else F.lit(float(total_chars))
    rate = F.when(F.col("chars") == 0, F.lit(1.0)).when(F.col("weights") == 0, F.lit(0.0)).otherwise(
        F.col("weight") / F.col("weights") * whole / F.col("chars")
    )
    rates = sizes.crossJoin(F.broadcast(sums)).select("source_key", rate.alias("rate"))  # one row of sums
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    return rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to a k beyond which less than one hash value in 2**52 remains."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(at, k):
        p = at["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(at["cdf"], F.array(F.element_at(at["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]


def mix(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, total_chars: float | None = None,
    seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The input's columns and `copy_number` (from 1), in globally shuffled order.

    Every document gets its own draw; rows that share an id share the draw. A null id counts as the text "null".
    Empty input gives no rows. Columns named like the work columns are no hindrance, as the input travels in one struct.

    The rates are sums per source (combined before the shuffle). Documents are then exploded in place and dealt out
    once by the hash of (id, copy), each partition sorted by it: a random permutation without a sampling pass, in
    which copies of one document or source cannot gather.
    """
    rates = source_rates(docs, weights, default_weight, total_chars, source_col, text_col)
    if rates.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(source_col).alias("own_source"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"),
    )
    joined = rows.join(rates, F.col("own_source").eqNullSafe(F.col("source_key")))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda j: F.size(F.filter("cdf", lambda x: x <= hash_uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))),
    )
    number = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    copies = joined.select("row", "key", number.alias("number")).where("number > 0").select(
        "row", "key", F.explode(F.sequence(F.lit(1), F.col("number"))).alias("copy_number")
    )
    place = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.col("key"), F.col("copy_number").cast("string")))
    dealt = copies.withColumn("place", place).drop("key").repartition("place").sortWithinPartitions("place")
    return dealt.select("row.*", "copy_number")


def mix_sql(weights: dict[str, float], default_weight: float = 1.0, seed: int = 7) -> str:
    """The same draw in DuckDB over `documents`."""
    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)!r}" for k, v in sorted(weights.items()))
    return f"""
    WITH RECURSIVE sizes AS (
      SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source
    ), weighed AS (
      SELECT *, CASE WHEN chars > 0 THEN (CASE {cases} ELSE {float(default_weight)!r} END)::DOUBLE ELSE 0.0 END AS weight
      FROM sizes
    ), rates AS (
      SELECT source, CASE WHEN chars = 0 THEN 1.0 WHEN (SELECT sum(weight) FROM weighed) = 0 THEN 0.0
        ELSE weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(chars) FROM weighed) / chars END::DOUBLE AS rate
      FROM weighed
    ), parted AS (
      SELECT source, rate, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts,
        rate / greatest(ceil(rate / {PART_MEAN}), 1)::INT AS mean FROM rates
    ), cdf(source, k, p, c) AS (
      SELECT source, 0, exp(-mean), exp(-mean) FROM parted
      UNION ALL
      SELECT cdf.source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
      FROM cdf JOIN parted ON cdf.source IS NOT DISTINCT FROM parted.source
      WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
    ), tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
    drawn AS (
      SELECT d.*, list_sum([len(list_filter(cs, lambda x: x <= ('0x' || substr(md5('{seed}:' || d.doc_id || ':' || j), 1, 13))
        ::BIGINT::DOUBLE / {UNIT!r})) FOR j IN range(1, parts + 1)])::INT AS number
      FROM documents d JOIN parted ON d.source IS NOT DISTINCT FROM parted.source
      JOIN tables ON d.source IS NOT DISTINCT FROM tables.source
    )
    SELECT doc_id, text, lang, source, n_chars, unnest(range(1, number + 1))::INT AS copy_number FROM drawn
    """
