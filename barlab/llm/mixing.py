"""Mixing sources to target weights by Poisson replication.

Every named source has a target share of the mixture's characters; all other sources together
get what remains. A source's mean repetition rate is its target mass over its present mass. Each
document draws its number of copies from a Poisson distribution of that mean, by inverting the
distribution at a number that is hashed from the seed and the document's id, so any executor can
rebuild the draw. Copies are exploded and dealt over the whole result by another hash.

Defined cases: a null source belongs to the remainder; a null text has no mass but draws copies
like any other; rows with equal ids draw equal counts; a group without mass has rate 0 (there is
nothing to repeat), so a corpus of empty texts, like an empty table, gives an empty result; named
sources that do not occur leave their share unfilled. Input columns named like an output column
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, text_of, unit_hash

SEED = 42
TARGETS = {"src0": 0.2, "src1": 0.15, "src2": 0.05}
PIECE = 200.0       # a larger mean is drawn as a sum of pieces, which keeps exp(-mean) in range
KEY_BITS = 60


def rates(docs: DataFrame, targets: dict[str, float], total: float, source: str, text: str) -> DataFrame:
    """grp, rate: one row per named source and one for the rest."""
    if not all(w >= 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares are at least 0 and add up to at most 1")
    share = {**targets, "": max(0.0, 1.0 - sum(targets.values()))}
    mass = (docs.select(group_of(source, targets).alias("grp"), F.length(text_of(text)).cast("long").alias("mass"))
            .groupBy("grp").agg(F.sum("mass").alias("mass")))
    shares = docs.sparkSession.createDataFrame(sorted(share.items()), "grp string, share double")
    mass = mass.withColumn("whole", F.sum("mass").over(Window.partitionBy()))     # a row per group: few
    return (shares.join(F.broadcast(mass), "grp")
            .select("grp", F.when(F.col("mass") > 0, F.col("share") * total * F.col("whole") / F.col("mass"))
                    .otherwise(0.0).alias("rate")))


def group_of(source: str, targets: dict[str, float]) -> Column:
    name = quoted(source)
    return F.when(name.isin(list(targets)), name).otherwise("") if targets else F.lit("")


def with_thresholds(rate: DataFrame) -> DataFrame:
    """Adds the number of pieces and the distribution function of one piece up to its last step below 1."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    mean = F.col("rate") / F.col("pieces")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.exp(-mean)
    step = lambda acc, k: F.struct(
        F.concat(acc["cdf"], F.array(acc["sum"] + acc["p"] * mean / k)).alias("cdf"),
        (acc["sum"] + acc["p"] * mean / k).alias("sum"), (acc["p"] * mean / k).alias("p"))
    first = F.struct(F.array(start).alias("cdf"), start.alias("sum"), start.alias("p"))
    return (rate.withColumn("pieces", pieces)
            .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["cdf"])
            .select("grp", "rate", "pieces", "cdf"))


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, total: float = 1.0, seed: int = SEED,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture, globally shuffled: the input's columns with ``copy`` (from 1), ``n_copies``
    and ``shuffle_key``. Reading in the order of (shuffle_key, id, copy) is the shuffled order,
    and the partitions hold it. ``total`` is the mixture's mass over the input's.
    """
    own = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "shuffle_key")]
    table = with_thresholds(rates(docs, targets, total, source, text))
    key = quoted(doc_id)
    below = lambda j: F.size(F.filter(F.col("__m.cdf"), lambda t: t <= unit_hash(F.lit(seed), key, j)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__m.pieces")), F.lit(0), lambda n, j: n + below(j))
    one = F.size(F.filter(F.col("__m.cdf"), lambda t: t <= F.col("__u")))
    copies = F.when(F.col("__m.pieces") == 1, one).otherwise(count)
    model = table.select(F.col("grp").alias("__grp"), F.struct("pieces", "cdf").alias("__m"))
    drawn = (docs.select(*[quoted(c) for c in own], group_of(source, targets).alias("__grp"),
                         unit_hash(F.lit(seed), key, F.lit(1)).alias("__u"))
             .join(F.broadcast(model), "__grp")       # as many rows as there are targets, and one
             .withColumn("n_copies", copies).drop("__m", "__u", "__grp").filter("n_copies > 0"))
    exploded = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(key.cast("string"), F.lit("null")), F.col("copy")))
    keyed = exploded.withColumn("shuffle_key", F.conv(F.substring(order, 1, KEY_BITS // 4), 16, 10).cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.col("shuffle_key") / float(1 << KEY_BITS) * parts).cast("int")
    return keyed.repartitionById(parts, F.least(at, F.lit(parts - 1))).sortWithinPartitions("shuffle_key", key, "copy")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


def sql(targets: dict[str, float] = TARGETS, seed: int = SEED, table: str = "documents") -> str:
    """DuckDB's form of ``mix`` for rates up to PIECE; the steps of the distribution are added in the same order."""
    names = ", ".join(f"'{t}'" for t in targets)
    values = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in {**targets, "": max(0.0, 1.0 - sum(targets.values()))}.items())
    grp = f"CASE WHEN source IN ({names}) THEN source ELSE '' END"
    hashed = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"
    u = hashed.format(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'", 13)
    key = hashed.format(f"'{seed}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy", KEY_BITS // 4)
    return f"""
WITH RECURSIVE mass AS (
  SELECT {grp} AS grp, sum(length(coalesce(text, ''))) AS mass FROM {table} GROUP BY 1),
rate AS (
  SELECT grp, CASE WHEN mass > 0 THEN share * 1.0::DOUBLE * (SELECT sum(mass) FROM mass)::DOUBLE / mass::DOUBLE ELSE 0 END AS rate
  FROM (VALUES {values}) s(grp, share) JOIN mass USING (grp)),
cdf AS (
  SELECT grp, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rate
  UNION ALL
  SELECT grp, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.grp = d.grp AND cdf.c <= d.u) AS n
  FROM (SELECT doc_id, text, lang, source, n_chars, {grp} AS grp, {u} / {float(1 << 52)!r}::DOUBLE AS u FROM {table}) d),
copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
  {key} AS shuffle_key
FROM copies"""
