"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwarden.session import materialize

BROADCAST_SOURCES = 20_000
PART = 64.0  # rates above are drawn as a sum of parts, so exp(-rate) never underflows


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below the resolution of a double."""
    first = F.exp(-rate)
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("c"))
    steps = F.sequence(F.lit(1), F.ceil(rate + 8 * F.sqrt(rate) + 20).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(F.concat(acc["cdf"], F.array(c)).alias("cdf"), p.alias("p"), c.alias("c"))

    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def repetition_rates(
    docs: DataFrame, source: str = "source", weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, total: float | None = None
) -> DataFrame:
    """(_source, _rate, _parts, _cdf): the mean number of copies that gives each source its share.

    The share of a source is its weight over the sum of all weights of sources that have rows;
    without ``weights`` it is rows ** ``alpha``. ``total`` rows come out on average, as many as go
    in if it is None. A source without a weight gets none. A null source is a source of its own.
    """
    n = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        w = F.pow(F.col("_n").cast("double"), F.lit(float(alpha)))
    else:
        if any(x < 0 for x in weights.values()):
            raise ValueError("weights must not be negative")
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
    n = materialize(n.withColumn("_w", w), "sources")
    sums = n.agg(F.sum("_n").alias("rows"), F.sum("_w").alias("w")).first()
    rows = float(sums["rows"] or 0) if total is None else float(total)
    rate = F.col("_w") * rows / (sums["w"] or 1.0) / F.col("_n")
    rated = n.withColumn("_rate", rate).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int"))
    return rated.select("_source", "_rate", "_parts", _poisson_cdf(F.col("_rate") / F.col("_parts")).alias("_cdf"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """The rows, each repeated a Poisson number of times, in a random order over all partitions.

    The number of copies is the inverse Poisson distribution at a uniform number hashed from
    ``seed`` and the document's id, so it does not depend on partitioning or retries. Adds
    ``replica`` (from 0) and ``shuffle_key``; rows are dealt to partitions by a hash of this key and
    sorted by it. Columns of these names are replaced, others pass through. Rows with equal
    ids (or null ids) draw the same number. A document of a source whose rate is below one may
    have no copy: that is the target weight, not a filter on content.
    """
    rates = materialize(repetition_rates(docs, source, weights, alpha, total), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # at most 20,000 short arrays; beyond, a join that splits hot sources
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("replica", "shuffle_key")]
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    row = docs.select(F.struct(*keep).alias("_row"), F.col(source).alias("_of"), key.alias("_key"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter("_cdf", lambda c: c <= _uniform(F.lit(f"{seed}|draw"), i.cast("string"), F.col("_key")))),
    )
    counted = row.join(rates, F.col("_of").eqNullSafe(F.col("_source"))).withColumn("_copies", drawn).filter("_copies > 0")
    copies = counted.select("_row", "_key", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("replica"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), F.col("replica").cast("string"), F.col("_key")))
    keyed = copies.select("_row.*", "replica", F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(alpha: float = 0.5, seed: int = 0) -> str:
    """DuckDB SQL with the rows of ``mix`` over documents, for rates up to 64."""
    return f"""WITH RECURSIVE
n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {float(alpha)}::DOUBLE) AS w FROM documents GROUP BY source),
s AS (SELECT sum(n)::DOUBLE AS total, sum(w) AS w FROM n),
r AS (SELECT n.source, n.w * s.total / s.w / n.n AS rate FROM n, s),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 8 * sqrt(rate) + 20)),
lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
u AS (SELECT d.*, coalesce(d.doc_id::VARCHAR, '') AS id FROM documents d),
counted AS (
  SELECT u.*, len(list_filter(cs, lambda c: c <= ('0x' || left(md5('{seed}|draw|1|' || id), 13))::BIGINT / 4503599627370496.0)) AS copies
  FROM u JOIN lists l ON u.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT *, unnest(range(copies)) AS replica FROM counted)
SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica,
  ('0x' || left(md5('{seed}|order|' || replica || '|' || id), 15))::BIGINT AS shuffle_key
FROM copies"""
