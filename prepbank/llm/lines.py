"""Line dedup by a line's frequency within its site."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepbank.llm.common import free_name
from prepbank.session import materialize

# A line on more than this share of a host's different pages is boilerplate.
RATIO = 0.02
# A line on fewer different pages is none, however small the host.
LEAST = 3


def _key(line: Column) -> Column:
    """128 bits that stand for a line: two hashes of different seeds."""
    return F.struct(F.xxhash64(line), F.xxhash64(F.lit("line"), line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(
    pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """Rows (host, n_pages, keys): the keys of the lines that occur on more than ``ratio`` of a host's different pages, and on ``least`` at least.

    Equal pages of a host count once, so a page that was merely copied is no evidence. Lines are compared without
    spaces, tabs and carriage returns at their ends; blank lines are never boilerplate. A host has at most (lines of
    its average page) / ratio such lines, so ``keys`` stays short however large the host. Copies and frequent lines
    are pre-aggregated by hash ahead of each shuffle; texts are not shuffled.
    """
    slim = pages.where(F.col(text_col).isNotNull()).select(
        F.col(host_col).alias("host"), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("text")
    )
    totals = (
        slim.groupBy("host", "page").agg(F.lit(1).alias("one"))
        .groupBy("host").agg(F.count("one").alias("n_pages"))
    )
    named = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""), _key))
    counts = (
        slim.select("host", "page", F.explode(named).alias("line"))
        .groupBy("host", "page", "line").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("one").alias("n"))
        .where(F.col("n") >= least)
    )
    t = totals.select(F.col("host").alias("__h"), "n_pages")
    frequent = counts.join(t, F.col("host").eqNullSafe(F.col("__h"))).where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return frequent.groupBy("host", "n_pages").agg(F.collect_list("line").alias("keys"))


def drop_boilerplate(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
    dropped_col: str | None = None,
) -> DataFrame:
    """The pages with boilerplate lines taken out of their texts; every row and column stays.

    ``dropped_col`` adds the number of lines taken out. The short key lists of the hosts are joined to the pages by
    host, broadcast while they are small and by a skew-splitting sort-merge join beyond that.

    A null text stays null and an empty one empty; pages without host form one host; repeated rows are all kept and
    count as one page; an empty table gives an empty result; columns of any other name pass through.
    """
    # Written first, so that its size is known when the join is planned.
    found = materialize(boilerplate_lines(pages, host_col, text_col, ratio, least), "boilerplate")
    host, keys = free_name(pages, "host_key"), free_name(pages, "bad_keys")
    joined = pages.join(
        found.select(F.col("host").alias(host), F.col("keys").alias(keys)),
        F.col(host_col).eqNullSafe(F.col(host)),
        "left",
    )
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(keys), _key(_trimmed(x))))
    cleaned = F.when(F.col(keys).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    if dropped_col:
        n = F.when(F.col(keys).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
        out.append(F.coalesce(F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n), F.lit(0)).cast("bigint").alias(dropped_col))
    return joined.select(*out)
