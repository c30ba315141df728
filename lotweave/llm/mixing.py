"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

A source's target repetition rate is its target number of documents over its own number.  Every
document gets a Poisson count with that rate as mean, by inverting the distribution at a uniform
number that a seed and the document give, so a run can be repeated anywhere.  Documents are exploded
by their counts and dealt in the order of another hashed uniform number: a global shuffle whose
partitions are slices of [0, 1), without a sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import stored, uniform

SEED = "mix"
#: Relative target weights of the registered query; sources not named have DEFAULT_WEIGHT.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
DRAW_RATE = 8.0  # a larger rate is a sum of draws with at most this rate each
TERMS = 64  # of the distribution: beyond these, less than 2**-52 is left at DRAW_RATE
SALTS = 32  # parts in which a source's documents meet its rate where rates are too many to broadcast


def rates(docs: DataFrame, weights: dict[str, float], default: float = DEFAULT_WEIGHT) -> DataFrame:
    """source (null as empty), rate, draws and the distribution of one draw, per source.

    Shares are of documents, and the expected number of all copies is that of all documents.
    Sources of weight 0 get rate 0.
    """
    if default < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights are zero or more")
    weight = F.lit(float(default))
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    counts = docs.select(F.coalesce("source", F.lit("")).alias("mix_source")).groupBy("mix_source").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("w", weight), "source-counts")
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("w") > 0, F.col("all_n") * F.col("w") / (F.col("all_w") * F.col("n"))).otherwise(F.lit(0.0))
    # one row of sums beside the sources
    rated = counts.join(F.broadcast(total)).select("mix_source", rate.alias("rate"))
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_RATE), F.lit(1)).cast("int")
    return stored(rated.withColumn("draws", draws).withColumn("below", distribution(F.col("rate") / F.col("draws"))), "rates")


def distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0 .. TERMS - 1 of a Poisson distribution, each term from the one before."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("below"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        at = state["sum"] + p
        return F.struct(p.alias("p"), at.alias("sum"), F.concat(state["below"], F.array(at)).alias("below"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["below"])


def identity() -> Column:
    """What a document's draws hang on: doc_id, or its text where that is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, seed: str = SEED
) -> DataFrame:
    """All columns of `docs`, and mix_rate, mix_copy (from 0) and mix_key, once per copy, in random order.

    Rows are in order of mix_key, across partitions too.  A null source counts as the source ''.
    Rows that repeat a doc_id draw alike; null ids draw by their text.  Null and empty texts are
    copied like others.  An empty table gives none.  Columns named mix_* must not be there before.
    """
    if clash := [c for c in docs.columns if c.startswith("mix_")]:
        raise ValueError(f"columns {clash} are in the way")
    of = rates(docs, WEIGHTS if weights is None else weights, default)
    salted = of.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = docs.withColumns({
        "mix_source": F.coalesce("source", F.lit("")),
        "mix_salt": F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"),
    })
    drawn = F.transform(F.sequence(F.lit(0), F.col("draws") - 1), lambda d: uniform(seed, identity(), d))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("below", lambda b: b <= u)))
    copies = (
        keyed.join(salted, ["mix_source", "mix_salt"])
        .withColumn("mix_count", count)
        .filter("mix_count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)))
        .withColumn("mix_key", uniform(seed + "-order", identity(), F.col("mix_copy")))
        .withColumnRenamed("rate", "mix_rate")
        .select(*docs.columns, "mix_rate", "mix_copy", "mix_key")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_ = F.least(F.floor(F.col("mix_key") * parts), F.lit(parts - 1)).cast("int")
    return copies.repartitionById(parts, slice_).sortWithinPartitions("mix_key", "doc_id", "mix_copy")


def _weight_sql() -> str:
    cases = " ".join(f"WHEN '{name}' THEN {w}" for name, w in sorted(WEIGHTS.items()))
    return f"CASE coalesce(source, '') {cases} ELSE {DEFAULT_WEIGHT} END"


def _uniform_sql(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / {2**52}.0::DOUBLE)"


_IDENTITY_SQL = "coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))"
#: The registered query's rows: the same draws from DuckDB's md5 and exp.
ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, max(CAST({_weight_sql()} AS DOUBLE)) AS w FROM documents GROUP BY 1
), rated AS (
  SELECT s, (SELECT sum(n) FROM counts)::BIGINT * w / ((SELECT sum(w) FROM counts) * n) AS rate FROM counts
), drawing AS (
  SELECT s, rate, CAST(greatest(ceil(rate / {DRAW_RATE}), 1) AS INTEGER) AS draws FROM rated
), terms AS (
  SELECT s, rate, draws, rate / draws AS r, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS below FROM drawing
  UNION ALL
  SELECT s, rate, draws, r, k + 1, p * r / (k + 1), below + p * r / (k + 1) FROM terms WHERE k < {TERMS - 1}
), tables AS (
  SELECT s, rate, draws, list(below ORDER BY k) AS below FROM terms GROUP BY s, rate, draws
), drawn AS (
  SELECT d.*, t.rate, t.below, g.d AS draw FROM documents d JOIN tables t ON t.s = coalesce(d.source, ''),
  LATERAL (SELECT unnest(range(t.draws)) AS d) g
), counted AS (
  SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(rate) AS rate,
         sum(len(list_filter(below, lambda b: b <= {_uniform_sql(SEED, _IDENTITY_SQL, 'draw')})))::BIGINT AS copies
  FROM drawn GROUP BY doc_id
), copied AS (
  SELECT *, unnest(range(copies)) AS mix_copy FROM counted
)
SELECT doc_id, source, text, rate AS mix_rate, CAST(mix_copy AS INTEGER) AS mix_copy,
       {_uniform_sql(SEED + '-order', _IDENTITY_SQL, 'mix_copy')} AS mix_key
FROM copied
"""
