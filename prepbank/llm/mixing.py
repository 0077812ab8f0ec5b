"""Mixing sources to target weights by entropy balancing."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prepbank.llm.common import MAX_BUCKETS, free_name
from prepbank.operators.ordering import number_rows
from prepbank.session import materialize

# Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
# A source's target and a document's copies stop at this multiple.
CAP = 3
# Rows of one (source, size) class that are ranked together.
CLASS_ROWS = 256
ROUNDS = 60
# Single copies added or taken off in each source after rounding.
TOUCHES = 4
# Newton iterations to a job, and the relative error that ends them.
STEPS = 3
TOLERANCE = 1e-9

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null counts as ''. The pieces between runs of white space, without an empty one at either end."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("bigint")


def source_targets(classes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, docs, source_size, target) from classes (source, size, n).

    The sources share the sum of all sizes by weight; a target that would pass ``cap`` times its source's size stops
    there, and the excess is shared anew by weight among the rest, until no target is above. Each round moves two
    sums to the driver.
    """
    sizes = classes.groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).cast("bigint").alias("source_size")
    )
    ranked = number_rows(sizes, [], [F.asc_nulls_last("source")], "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = materialize(ranked.drop("_rank"), "sources")
    limit, level = F.lit(float(cap)) * F.col("source_size"), 0.0
    capped = F.lit(False)
    total = ranked.agg(F.sum("source_size")).head()[0] or 0
    while True:
        held, free = ranked.agg(
            F.sum(F.when(capped, F.lit(cap) * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))
        ).head()
        if not free:
            break
        new = (total - held) / free
        if new <= level:
            break
        level, capped = new, F.lit(new) * F.col("_w") >= limit
    return ranked.select(
        "source", "docs", "source_size", F.when(capped, limit).otherwise(F.lit(level) * F.col("_w")).alias("target")
    )


def tilts(classes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows (source, tilt): the multiplier of each source's token constraint in the convex dual.

    Of all rates r <= cap, those closest in entropy to one copy a document that meet the source's target are
    r = min(cap, exp(tilt * size / mean size)). The taken tokens grow with the tilt; Newton steps, kept inside a
    bracket, find it. Each iteration is one join and one pre-aggregated sum over the classes (source, size, n), for
    all sources at once; only the largest error and the largest open bracket come back to the driver.
    """
    mean = F.col("source_size") / F.col("docs")
    # At tilt 0 every document is taken once. exp(tilt * z) passes any bound for the class with the largest z.
    state = targets.where((F.col("source_size") > 0)).select(
        F.col("source").alias("_s"), mean.alias("_mean"), F.col("target").cast("double").alias("_target"),
        (F.lit(float(cap)) * F.col("source_size")).alias("_most"),
        F.lit(0.0).alias("_tilt"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"),
        F.lit(1.0).alias("_err"),
    )
    columns = state.columns
    for _ in range(ROUNDS // STEPS):
        for _ in range(STEPS):
            z = F.col("size") / F.col("_mean")
            rate = F.least(F.exp(F.least(F.col("_tilt") * z, F.lit(50.0))), F.lit(float(cap)))
            inside = F.when(rate < cap, rate).otherwise(0.0)
            sums = (
                classes.join(state, F.col("source").eqNullSafe(F.col("_s")))
                .groupBy(*columns)
                .agg(
                    F.sum(F.col("n") * F.col("size") * rate).alias("_f"),
                    F.sum(F.col("n") * F.col("size") * z * inside).alias("_d"),
                )
            )
            low = F.col("_f") < F.col("_target")
            lo = F.when(low, F.col("_tilt")).otherwise(F.col("_lo"))
            hi = F.when(low, F.col("_hi")).otherwise(F.col("_tilt"))
            step = F.col("_tilt") - (F.col("_f") - F.col("_target")) / F.when(F.col("_d") > 0, F.col("_d"))
            # Without a bound on one side the step may go at most 4 further; inside the bracket, else its middle.
            inner = F.when(step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)), step)
            middle = F.when(lo.isNull(), hi - 4).when(hi.isNull(), lo + 4).otherwise((lo + hi) / 2)
            inner = F.coalesce(inner, middle)
            inner = F.when(lo.isNull(), F.greatest(inner, hi - 4)).when(hi.isNull(), F.least(inner, lo + 4)).otherwise(inner)
            err = F.abs(F.col("_f") - F.col("_target")) / F.greatest(F.col("_target"), F.lit(1.0))
            done = (err <= TOLERANCE) | (F.col("_target") >= F.col("_most")) | (hi - lo <= 1e-13)
            state = sums.select(
                "_s", "_mean", "_target", "_most", F.when(done, F.col("_tilt")).otherwise(inner).alias("_tilt"),
                lo.alias("_lo"), hi.alias("_hi"), F.when(done, 0.0).otherwise(err).alias("_err"),
            )
        state = materialize(state, "tilts")
        if not state.where(F.col("_err") > TOLERANCE).head(1):
            break
    # Rounded, so that the order in which sums were added does not show in the copies.
    return state.select(
        F.col("_s").alias("source"),
        F.when(F.col("_target") >= F.col("_most"), F.lit(None)).otherwise(F.round("_tilt", 9)).alias("tilt"),
        F.col("_mean").alias("mean"),
    )


def _touch_up(rated: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of the size nearest to what a source still misses or has too much, if that comes nearer."""
    of_source = W.partitionBy("source")
    rest = F.col("target") - F.sum(F.col("share") * F.col("size")).over(of_source)
    rated = rated.withColumn("_rest", rest)
    room = F.when(F.col("_rest") > 0, F.col("share") < F.col("n") * cap).otherwise(F.col("share") > 0)
    off = F.abs(F.abs("_rest") - F.col("size"))
    usable = room & (F.col("size") > 0) & (off < F.abs("_rest"))
    rated = rated.withColumn("_best", F.min(F.when(usable, F.struct(off.alias("off"), F.col("size").alias("size")))).over(of_source))
    change = F.when(usable & (F.col("size") == F.col("_best")["size"]), F.signum("_rest").cast("bigint")).otherwise(F.lit(0))
    return rated.withColumn("share", F.col("share") + F.coalesce(change, F.lit(0))).drop("_rest", "_best")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """One row per input row: id, crc (of the text), source, size, source_size, target, rate, copies, taken.

    Rates are exponentially tilted by size (see ``tilts``) and rounded to whole copies: along the sizes of a source
    the running sum of rates is rounded, so the taken words of a source miss its target by less than the size of its
    longest document; then a few single copies are added or taken off to come nearer. Documents of one source and size share its copies; those that get one more are the first by
    (hash, id, crc). The ranks come from windows over (source, size, bucket) of about ``class_rows`` rows, so neither
    a hot source nor a large group of copies meets in one task. Reruns agree.

    A null text has size 0 and null sources form one source, last in order; repeated rows each get their share; a
    source without words has target 0; documents without words are taken once; an empty table gives an empty result;
    other columns take no part.
    """
    slim = docs.select(
        F.col(id_col).alias("id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
        F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
    )
    slim = materialize(slim, "sizes")
    classes = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    targets = materialize(source_targets(classes, weights, cap), "targets")
    tilted = tilts(classes, targets, cap)

    t = targets.select(F.col("source").alias("_ts"), "source_size", "target")
    u = tilted.select(F.col("source").alias("_us"), "tilt", "mean")
    rated = (
        classes.join(t, F.col("source").eqNullSafe(F.col("_ts")))
        .join(u, F.col("source").eqNullSafe(F.col("_us")), "left")
        .withColumn(
            "rate",
            F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(cap))
            .otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))),
        )
    )
    along = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    end = F.floor(F.sum(F.col("n") * F.col("rate")).over(along) + 0.5)
    rated = rated.withColumn("_end", end).withColumn(
        "share", F.col("_end") - F.coalesce(F.lag("_end").over(W.partitionBy("source").orderBy("size")), F.lit(0))
    )
    rated = rated.withColumn("share", F.least(F.greatest("share", F.lit(0)), F.col("n") * cap)).drop("_end", "tilt", "mean", "_ts", "_us")
    for _ in range(TOUCHES):
        rated = _touch_up(rated, cap)
    rated = materialize(rated, "rates")

    # More buckets for larger classes; the number of classes' buckets is what the offsets are summed over.
    r = rated.select(F.col("source").alias("_cs"), F.col("size").alias("_cz"), "n", "rate", "share", "source_size", "target")
    wide = slim.join(r, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("size") == F.col("_cz"))).drop("_cs", "_cz")
    n_buckets = F.least(F.ceil(F.col("n") / class_rows), F.lit(MAX_BUCKETS))
    wide = wide.withColumn("bucket", F.pmod(F.xxhash64("id"), n_buckets))
    # A bucket gets the copies between the rounded ends of its run of rows, as a class does between its own.
    buckets = wide.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("_n"), F.first("n").alias("_all"), F.first("share").alias("_share"))
    upto = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    at = F.sum("_n").over(upto)
    extra = F.pmod(F.col("_share"), F.col("_all"))
    buckets = buckets.select(
        F.col("source").alias("_bs"), F.col("size").alias("_bz"), F.col("bucket").alias("_b"),
        (F.floor(at * extra / F.col("_all")) - F.floor((at - F.col("_n")) * extra / F.col("_all"))).alias("_extra"),
    )
    ranked = wide.withColumn("_at", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("id", "crc")))
    out = ranked.join(
        buckets, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("size") == F.col("_bz")) & (F.col("bucket") == F.col("_b"))
    )
    copies = (F.floor(F.col("share") / F.col("n")) + (F.col("_at") <= F.col("_extra")).cast("int")).cast("bigint")
    return out.select(
        F.col("id").alias(id_col), "crc", F.col("source").alias(source_col), "size", "source_size",
        F.col("target").cast("double").alias("target"), "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as often as the mix takes them, in their own columns.

    Rows of one id and text are exchangeable: their copies are summed and dealt out as evenly as they can be, by a
    rank among those rows.
    """
    n, crc, total, rows, at = (free_name(docs, x) for x in ("copies", "crc", "all_copies", "all_rows", "at"))
    keyed = docs.withColumn(crc, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    given = mixed.groupBy(F.col(id_col).alias("_id"), F.col("crc").alias("_crc")).agg(
        F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)
    )
    joined = keyed.join(given, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(crc) == F.col("_crc")))
    same_row = W.partitionBy(id_col, crc).orderBy(F.lit(1))
    single, many = joined.where(F.col(rows) == 1), joined.where(F.col(rows) > 1)
    many = many.withColumn(at, F.row_number().over(same_row))
    share = F.floor(F.col(total) / F.col(rows)) + (F.col(at) <= F.pmod(F.col(total), F.col(rows))).cast("int")
    both = single.withColumn(n, F.col(total).cast("int")).unionByName(many.withColumn(n, share.cast("int")).drop(at))
    return both.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
