"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean number of copies per document that brings its share of the
text to its target.  A document's own number of copies is drawn from the Poisson
distribution with that mean: a hash of the seed and the id gives a uniform number,
and the distribution is inverted at it.  Copies are then dealt out by another hash.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import table
from roomtrace.plans.scratch import materialize

#: Rows of one source meet its rate under so many keys, so that a source with a third of all rows is not one key.
SALTS = 32
#: Larger means are drawn as sums of draws with means up to this one, as exp(-mean) must not vanish.
LARGEST_MEAN = 256.0


def free_name(name: str, columns: list[str]) -> str:
    """The name itself, or with underscores behind it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) with 52 bits from the md5 of the joined parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_sums(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below what ``uniform`` can tell from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["sums"])


def mean_copies(docs: DataFrame, weights: dict[str, float], default_weight: float, source_column: str, text_column: str) -> DataFrame:
    """(source, mean): one row per source with text and a positive weight, written once.

    The means keep the total length of the text: mean = weight * all text / (all weights * text of the source).
    """
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    chars = F.coalesce(F.length(F.col(text_column).cast("string")), F.lit(0))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = docs.select(source.alias("source"), chars.cast("long").alias("chars")).groupBy("source").agg(F.sum("chars").alias("size"))
    sizes = materialize(sizes.withColumn("weight", weight).filter((F.col("weight") > 0) & (F.col("size") > 0)), "sources")
    whole, all_weights = sizes.agg(F.sum("size"), F.sum("weight")).first()
    mean = F.col("weight") * F.lit(float(whole or 0)) / (F.lit(float(all_weights or 1)) * F.col("size"))
    return sizes.select("source", mean.alias("mean"))


def mix_to_weights(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: str = "mix",
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", copy_column: str = "copy",
) -> DataFrame:
    """Each row as often as drawn, in a random order, with the number of the copy (from 1).

    Shares are measured in characters of text.  ``weights`` are relative; sources that it does not name get
    ``default_weight``, sources of weight 0 go.  A null source is the source with the empty name.  Null and empty texts add
    nothing to their source's size and are drawn with its mean; a source without any text has no mean and goes.  Rows with
    the same id are drawn alike; a null id counts as the empty text.  All columns are kept; the copy number takes a free
    name if ``copy_column`` is taken.  An empty table gives no rows.
    """
    copy = free_name(copy_column, docs.columns)
    names = {k: free_name(f"mix_{k}", docs.columns + [copy]) for k in ("source", "salt", "mean", "sums", "parts", "order")}
    means = mean_copies(docs, weights, default_weight, source_column, text_column)
    parts = F.ceil(F.col("mean") / LARGEST_MEAN).cast("int")
    rates = means.select(
        F.col("source").alias(names["source"]), parts.alias(names["parts"]), poisson_sums(F.col("mean") / parts).alias(names["sums"]),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(names["salt"]),
    )
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    keyed = docs.withColumn(names["source"], F.coalesce(F.col(source_column).cast("string"), F.lit("")))
    keyed = keyed.withColumn(names["salt"], F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
    draw = lambda part: F.size(F.filter(F.col(names["sums"]), lambda s: s < uniform(F.lit(seed), part.cast("string"), ident)))
    times = F.aggregate(F.sequence(F.lit(0), F.col(names["parts"]) - 1), F.lit(0), lambda total, part: total + draw(part))
    drawn = keyed.join(rates, [names["source"], names["salt"]]).withColumn(names["mean"], times).filter(F.col(names["mean"]) > 0)
    copies = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(names["mean"]))).alias(copy))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col(copy).cast("string")).cast("binary"))
    dealt = copies.withColumn(names["order"], order).repartition(names["order"]).sortWithinPartitions(names["order"])
    return dealt.drop(names["order"])


# Production targets: the one very large source gets four shares, every other source one.
TARGETS = {"src0": 4.0}


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(table(spark, sf_dir, "documents"), TARGETS)


OP3_SQL = """
WITH sized AS (
    SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY 1
), weighted AS (
    SELECT *, CASE WHEN source = 'src0' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sized WHERE size > 0
), rates AS (
    SELECT source, weight * (SELECT sum(size) FROM weighted)::DOUBLE / ((SELECT sum(weight) FROM weighted) * size) AS mean FROM weighted
), terms AS (
    SELECT source, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1.0)) END AS p
    FROM rates, range(0, 400) AS r(k) WHERE k <= ceil(mean + 12 * sqrt(mean) + 40)
), sums AS (
    SELECT source, list(s ORDER BY k) AS sums FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms) GROUP BY source
), drawn AS (
    SELECT d.*, len(list_filter(sums, lambda s: s < (('0x' || substr(md5('mix:0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS times
    FROM documents d JOIN sums ON coalesce(d.source, '') = sums.source
)
SELECT * EXCLUDE (times), unnest(range(1, times + 1))::INTEGER AS copy FROM drawn WHERE times > 0
"""
