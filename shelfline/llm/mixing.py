"""Mixing sources to target weights.

Each source's share of the tokens is raised to an exponent and normalised
(temperature mixing).  The exponent is found by bisection, so that the weights
have a wanted entropy, or flatten the mix as far as a limit on repetition
allows.  The weights are then realised: every source's documents lie in
blocks, each epoch permutes the blocks and the documents in them, and a source
is read in that order until its token budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.llm.common import free_names, stored

#: Documents a block holds on average in a source that has all of them.
BLOCK_DOCS = 1000
#: Levels of the bisection decided by one Spark job.
LEVELS = 6


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _bisect(totals: DataFrame, measures: list[Column], too_low, steps: int = 30) -> float:
    """Bisects [0, 1]: ``measures(a)`` are aggregated over the sources for all
    midpoints of the next LEVELS levels at once."""
    low, high = 0.0, 1.0
    for _ in range(0, steps, LEVELS):
        points = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        row = totals.agg(*[m(a).alias(f"m{k}_{j}") for k, a in enumerate(points) for j, m in enumerate(measures)]).first()
        for _ in range(LEVELS):
            middle = (low + high) / 2
            k = min(range(len(points)), key=lambda k: abs(points[k] - middle))
            if too_low(points[k], *[row[f"m{k}_{j}"] for j in range(len(measures))]):
                low = middle
            else:
                high = middle
    return high


def exponent(totals: DataFrame, max_epochs: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for ``totals`` (source, tokens > 0).

    ``entropy``: the weights have this entropy in nats (0: all sources alike
    has the most; 1, the plain shares, the least it will give).  Otherwise
    ``max_epochs``: the flattest mix in which, when every source is read at
    least once, none is read more often than that.  No source at all: 1.
    """
    tokens = F.col("tokens").cast("double")
    least, most, n = totals.agg(F.min(tokens), F.max(tokens), F.count("*")).first()
    if not n:
        return 1.0
    share = tokens / F.lit(float(most))
    if entropy is not None:
        import math

        # H = log Z - a * sum(p^a log p) / Z, falling in a
        measures = [lambda a: F.sum(F.pow(share, F.lit(a))), lambda a: F.sum(F.pow(share, F.lit(a)) * F.log(share))]
        return _bisect(totals, measures, lambda a, z, s: math.log(z) - a * s / z > entropy)
    # weight / share is (1 / p)^(1 - a) up to a factor; its spread is the epochs of the scarcest source
    spread = [lambda a: F.max(F.pow(share, F.lit(a - 1))) / F.min(F.pow(share, F.lit(a - 1)))]
    return _bisect(totals, spread, lambda a, s: s > (max_epochs or 1.0))


def weights(totals: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """source, tokens, weight, quota (tokens) and epochs of each source.

    Without ``budget`` it is the least that reads every source at least once.
    """
    tokens = F.col("tokens").cast("double")
    top = totals.agg(F.max(tokens)).first()[0]
    raised = F.pow(tokens / F.lit(float(top or 1)), F.lit(alpha))
    z, need = totals.agg(F.sum(raised), F.max(tokens / raised)).first()
    weight = raised / F.lit(z or 1.0)
    total = F.lit(float(budget)) if budget is not None else F.lit(float(need or 0.0)) * F.lit(z or 1.0)
    out = totals.select("source", "tokens", weight.alias("weight")).withColumn("quota", F.col("weight") * total)
    return out.withColumn("epochs", F.greatest(F.col("quota") / F.col("tokens"), F.lit(1.0) if budget is None else F.lit(0.0)))


def _before(column: str, order) -> Column:
    """The sum over the rows before, in a window's order."""
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(
    docs: DataFrame, max_epochs: float | None = 1.5, entropy: float | None = None, budget: float | None = None,
    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per use of a document: doc_id, source, epoch (from 0),
    n_tokens (of all rows with that id and source), same_rows (how many these
    are), mix_key (double in [0, 1): reading by mix_key interleaves the sources by their
    weights) and weight.

    Tokens are words; an empty or null text counts one token, so that it has a
    place.  A null source counts as the empty name.  Rows that share id and
    source are used together.  Without ``budget`` every document is used at
    least once; with one, a source stops with the document that reaches its
    quota.  Ties in the permutation go to the smaller id.  An empty table
    gives none.  Other columns of ``docs`` play no part.
    """
    sized = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.greatest(n_words(F.col(text_col)), F.lit(1)).alias("n_tokens"))
        .groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("same_rows")),
        "mix-documents",
    )
    totals = stored(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    plan = stored(weights(totals, exponent(totals, max_epochs, entropy), budget), "mix-weights")
    n_blocks = max(1, (totals.agg(F.sum("docs")).first()[0] or 0) // BLOCK_DOCS)
    block = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(n_blocks))
    by_block = sized.withColumn("block", block)
    # Epochs of a block, permuted; a source has n_blocks of them at most, however many documents it has.
    epochs = by_block.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")).join(plan, "source")
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.round("epochs", 9)).cast("int") - 1, F.lit(0)))))
    # The permutation in two levels, so that no task has all blocks of a source: 4096 ranges of its hash, then the blocks of a range.
    epochs = epochs.withColumn("at", F.xxhash64(F.lit(seed), "epoch", "source", "block")).withColumn("range", F.shiftright("at", 52))
    ranges = epochs.groupBy("source", "epoch", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.withColumn("range_start", _before("range_tokens", Window.partitionBy("source", "epoch").orderBy("range"))).drop("range_tokens")
    epochs = epochs.join(ranges, ["source", "epoch", "range"])
    before = F.col("range_start") + _before("block_tokens", Window.partitionBy("source", "epoch", "range").orderBy("at", "block"))
    reach = (F.col("tokens") * F.col("epochs")).cast("double")
    epochs = epochs.withColumn("block_start", F.col("epoch") * F.col("tokens") + before).where(F.col("block_start") < reach - F.lit(1e-6))
    inside = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "doc_id"), "doc_id")
    used = by_block.join(epochs.select("source", "block", "epoch", "block_start", "tokens", "epochs", "weight"), ["source", "block"])
    start = F.col("block_start") + _before("n_tokens", inside)
    return (
        used.withColumn("start", start).where(F.col("start") < reach - F.lit(1e-6))
        .select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens", "same_rows", (F.col("start") / reach).alias("mix_key"), "weight")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` uses it (columns as they
    are).  Rows of a source beyond its budget go; without a budget none do."""
    own_id, own_source, uses_of, use = free_names(docs, "id", "of_source", "uses", "use")
    uses = mix(docs, id_col=id_col, source_col=source_col, **options).groupBy("doc_id", "source").agg(F.count("*").cast("int").alias(uses_of))
    uses = stored(uses.withColumnsRenamed({"doc_id": own_id, "source": own_source}), "mix-uses")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col(own_source))
    # The same way at every size: the uses grow with the documents.
    used = docs.join(uses.hint("merge"), same).withColumn(use, F.explode(F.sequence(F.lit(1), F.col(uses_of))))
    return used.select(*[F.col(f"`{c}`") for c in docs.columns])
