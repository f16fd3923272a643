"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a hash. A source with target T takes the documents whose hash lies under a threshold, so mixes
for smaller budgets are subsets of mixes for larger ones. The threshold comes from histograms: words summed by
source and hash digit, then again by the next digit inside the one bucket that holds the threshold, until that bucket
holds one document. No sort of documents, and no driver-side data.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, ordered last; rows
with equal ids share a hash and, where they meet the threshold, its words in proportion to size; an empty table
gives an empty result. Further columns of the input are left alone: the result carries its own names only, beside
the id column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import fresh, small, staged, table

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash digit, and digits in a hash of 63 bits.
DIGIT, LEVELS = 9, 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """Target words of each source from ``sizes`` (source, source_size), one row per source.

    Shares are in proportion to weight, none above ``cap`` times the source's size; what is cut off is shared again by
    weight. That is min(cap * size, level * weight) for the one level at which the targets sum to the budget.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = sizes.withColumn("weight", pick).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    full = full.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    full = full.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("total"),
        F.sum("ceiling").over(upto).alias("_below"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto)).alias("_open"),
    ).withColumn("_full", F.col("_below") + F.col("ratio") * F.col("_open") <= F.col("total"))
    rest = F.col("total") - F.sum(F.when(F.col("_full"), F.col("ceiling")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("_full"), F.col("ceiling")).otherwise(F.least("ceiling", rest * F.col("weight") / open_weight))
    return full.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    cap: float = 2.0,
    cut: bool = True,
) -> DataFrame:
    """Words that the mix takes from each document.

    ``docs`` has doc_id, text, source. Sources in code point order, null last, get ``weights`` in turn; together they
    take ``budget`` times all words, none over ``cap`` times its own. Returns doc_id, size, source_size, target,
    taken. ``taken`` is whole passes over the document and, in the last pass, all or nothing by hash; the one document
    at the threshold gives its leading words up to the target, or with ``cut=False`` nothing.
    """
    base = staged(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit("mix"), "doc_id").bitwiseAND(F.lit(2**63 - 1)).alias("h")
        ),
        "mix-sizes",
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = staged(
        targets.withColumn("passes", passes.cast("long"))
        .withColumn("left", F.floor(F.col("target") + 1e-6).cast("long") - F.col("passes") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("bucket_size", F.col("source_size"))
        .withColumn("bucket_rows", F.lit(2).cast("long")),
        "mix-state",
    )
    few = small(state)
    hint = F.broadcast if few else (lambda df: df)
    level = 0
    while level < LEVELS:
        level += 1
        low = 63 - DIGIT * level
        digit = F.shiftright("h", low)
        open_rows = state.filter("left > 0 AND bucket_rows > 1").select(F.col("source").alias("s"), "prefix", "left")
        inside = base.join(
            hint(open_rows), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", low + DIGIT) == F.col("prefix"))
        )
        hist = inside.groupBy("source", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("left").alias("left")
        )
        run = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        edge = (
            hist.withColumn("run", run)
            .withColumn("before", F.col("run") - F.col("words"))
            .filter("before <= left AND run > left")
            .groupBy(F.col("source").alias("s"))
            .agg(F.min(F.struct("digit", "before", "words", "rows")).alias("edge"))
        )
        state = staged(
            state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "source_size",
                "target",
                "passes",
                # a source that runs out before its target keeps everything: nothing is left to refine
                F.when(F.col("edge").isNotNull(), F.col("left") - F.col("edge.before")).otherwise(F.col("left")).alias("left"),
                F.when(F.col("edge").isNotNull(), F.shiftleft("edge.digit", low))
                .when((F.col("bucket_rows") > 1) & (F.col("left") > 0), F.lit(2**63 - 1))
                .otherwise(F.shiftleft("prefix", low + DIGIT) if level == 1 else F.col("low"))
                .alias("low"),
                F.when(F.col("edge").isNotNull(), F.shiftleft("edge.digit", low) + F.lit(2**low - 1))
                .when((F.col("bucket_rows") > 1) & (F.col("left") > 0), F.lit(2**63 - 1))
                .otherwise(F.lit(0) if level == 1 else F.col("high"))
                .alias("high"),
                F.coalesce("edge.digit", F.lit(-1)).alias("prefix"),
                F.coalesce("edge.words", "bucket_size").alias("bucket_size"),
                F.coalesce("edge.rows", F.lit(1)).cast("long").alias("bucket_rows"),
            ),
            "mix-state",
        )
        if state.filter("left > 0 AND bucket_rows > 1").isEmpty():
            break
    bounds = state.withColumnRenamed("source", "s")
    part = F.floor(F.col("left").cast("decimal(20,0)") * F.col("size") / F.greatest("bucket_size", F.lit(1))).cast("long") if cut else F.lit(0)
    extra = F.when(F.col("h") < F.col("low"), F.col("size")).when(F.col("h") <= F.col("high"), F.least(part, "size")).otherwise(0)
    return base.join(hint(bounds), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: whole documents, each as often as it is taken."""
    taken = mix(docs, weights, budget, cap, cut=False).filter("taken > 0")
    own, times, copy = (fresh(docs, c) for c in ("_id", "_times", "_copy"))
    taken = taken.groupBy(F.col("doc_id").alias(own)).agg(F.max(F.floor(F.col("taken") / F.col("size"))).cast("int").alias(times))
    joined = docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(F.col(own)))
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*docs.columns)


def op1_mix_sources(spark, sf_dir):
    """All ``documents`` mixed: sources weigh 3, 1, 2 in turn and share 150 % of all words, at most twice their own."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE_SQL: dict[str, str] = {}
