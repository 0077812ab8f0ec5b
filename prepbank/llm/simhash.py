"""Near-duplicate documents by SimHash fingerprints and an index over their byte positions."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.llm.common import free_name, restored
from prepbank.llm.components import components
from prepbank.session import materialize

WORDS = 3
SEED = 42
BYTES = 8
MAX_BITS = 3
# A pair with at most MAX_BITS differing bits shares at least this many positional bytes.
MIN_SHARED = BYTES - MAX_BITS
# Any five of eight positions hold three of one half, so the triples within the halves meet every such pair.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
# A list of a triple with more fingerprints is cut into lists over two further positions.
MAX_LIST = 1024
# Bytes of text that a worker turns into shingles at a time.
SLICE_BYTES = 1 << 20

_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def _shingle_hashes(text: str, words: int) -> list[int]:
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if len(tokens) <= words:
        return [xxh64_intdigest(b" ".join(tokens), SEED)] if tokens else []
    join = b" ".join
    return [xxh64_intdigest(join(t), SEED) for t in zip(*[tokens[i:] for i in range(words)], strict=False)]


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of documents given as their shingles' hashes: a bit is 1 if set in over half of them."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.array([x for h in hashes for x in h], np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes) * 256
    out = np.zeros(len(hashes), np.uint64)
    for position in range(BYTES):
        value = ((flat >> np.uint64(8 * position)) & np.uint64(255)).astype(np.int64)
        tally = np.bincount(owner + value, minlength=256 * len(hashes)).reshape(len(hashes), 256)
        ones = (2 * (tally @ _BITS) > sizes[:, None]).astype(np.uint64)
        for bit in range(8):
            out |= ones[:, bit] << np.uint64(8 * position + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (id, text_hash, fp): each document's 64-bit fingerprint, as a signed bigint, and a hash of its text.

    Shingles are ``words`` words of the lower-cased (A-Z) text joined by spaces, repeats included; a text with fewer
    words is one shingle, one without words has fingerprint 0. Whole texts are read, in slices of a bounded size.
    """
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())
    ])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, waiting, size = [], [], 0
            for text in batch["text"]:
                waiting.append(_shingle_hashes(text, words))
                size += len(text)
                if size >= SLICE_BYTES or len(waiting) >= 1000:
                    found.append(_majority(waiting))
                    waiting, size = [], 0
            if waiting:
                found.append(_majority(waiting))
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pd.DataFrame({"id": batch["id"], "text_hash": batch["text_hash"], "fp": fp})

    slim = docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return restored(slim.mapInPandas(sign, schema), docs, id_col)


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _list_key(number: int, positions) -> F.Column:
    """Key of an inverted list: which positions it is about and their bytes."""
    key = F.lit(number).cast("bigint")
    for position in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
    return key


def _link_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within each list (rows of one key, sorted by key) as stars: every fingerprint that links to another one
    of its list comes out once, with the smallest it can reach inside the list.

    Pairs of a list are met by their distance in it; those with too few shared positional bytes are left out, the
    others verified by their differing bits.
    """
    rest = None
    for batch in batches:
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
        if rest is not None:
            key, fp = np.concatenate([rest[0], key]), np.concatenate([rest[1], fp])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = (key[cut:], fp[cut:])
        yield _stars(key[:cut], fp[:cut])
    if rest is not None:
        yield _stars(*rest)


def _stars(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    left, right = [], []
    near = np.arange(len(key))
    step = 1
    while len(near := near[near + step < len(key)]):
        near = near[key[near] == key[near + step]]
        differ = fp[near] ^ fp[near + step]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) if len(differ) else np.zeros(0)
        linked = near[(shared >= MIN_SHARED) & (np.bitwise_count(differ.view(np.uint64)) <= MAX_BITS)]
        left.append(linked)
        right.append(linked + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    hung = np.flatnonzero(root != np.arange(len(key)))
    return pd.DataFrame({"a": fp[hung], "b": fp[root[hung]]})


def links(distinct_fps: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, each once) which differ in at most three bits.

    Such a pair differs in at most three of its eight bytes, so the inverted lists by (position, byte) count at least
    five matches for it. Of a plain list the pairs would be too many; as five positions hold three of one half, the
    lists of the eight triples within the halves already meet every such pair, and the count is made up over the
    other positions. A list longer than ``max_list`` is cut anew over each two of the other five positions, of which a
    pair must share two; these lists hold fingerprints that differ in three bytes alone. Links inside a list
    come out as stars, one row for a fingerprint at most.
    """
    postings = distinct_fps.select("fp", F.explode(F.array(*[_list_key(i, t) for i, t in enumerate(TRIPLES)])).alias("key"))
    postings = materialize(postings, "postings")
    sizes = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "lists")
    short = postings.join(sizes.where(F.col("n") <= max_list).select("key"), "key", "left_semi")
    long = postings.join(sizes.where(F.col("n") > max_list).select("key"), "key", "left_semi")
    # The number of the triple is in the key's fourth byte; the finer key is (triple, pair, five bytes).
    finer = []
    for i, triple in enumerate(TRIPLES):
        others = [p for p in range(BYTES) if p not in triple]
        keys = F.array(*[_list_key(16 * i + 16 + j, (*triple, *two)) for j, two in enumerate(combinations(others, 2))])
        finer.append(F.when(F.shiftright("key", 24) == i, keys))
    # Keys of triples are below 2^27, those of five positions above 2^43.
    cut = long.select("fp", F.explode(F.coalesce(*finer)).alias("key"))
    both = short.select("fp", "key").unionByName(cut)
    n = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = both.repartition(n, "key").sortWithinPartitions("key", "fp")
    return lists.mapInPandas(_link_lists, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_list: int = MAX_LIST) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Documents of one fingerprint form a class first, so a group of copies counts as one fingerprint in the index; only
    classes are linked. The classes come back to the documents by a join on the fingerprint that splits hot ones.

    Null and empty texts have fingerprint 0, linked like any other; a null id never names a component unless its
    documents have no other id; repeated rows fall into one class; an empty table gives an empty result; other
    columns take no part.
    """
    signed, heads = _classes(docs, id_col, text_col, words, max_list)
    return signed.join(heads, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, max_list: int = MAX_LIST) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and rows (fp, root, best): the component of each, by its smallest fingerprint, and its smallest id."""
    signed = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(signed.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    return signed, heads_of(classes, links(classes.select("fp"), max_list))


def heads_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (fp, root, best) of the classes (fp, first): their component over the edges, and its smallest id."""
    found = components(edges).select(F.col("node").alias("fp"), "component")
    rooted = classes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    best = rooted.where(F.col("root") != F.col("fp")).select("root").distinct().join(rooted, "root")
    best = best.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(best, "root", "left").select("fp", "root", F.coalesce("best", "first").alias("best"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; no other row.

    Rows without an id give way to any that has one. Among rows of one id and component one text stays, and of rows
    equal in id and text one row; rows of one id in different components are different documents.
    """
    return keep_heads(docs, *_classes(docs, id_col, text_col, words), id_col, text_col)


def keep_heads(docs: DataFrame, signed: DataFrame, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that stay, given each one's class (id, text_hash, fp) and the classes' components (fp, root, best)."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    chosen = signed.join(heads, "fp").groupBy("root").agg(F.min(order).alias("first"))
    keep = chosen.select(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    mark = free_name(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__hash"))
    rows = marked.join(keep, same, "left_semi")
    twice = signed.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    twice = twice.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
    single, many = rows.join(twice, same, "left_anti"), rows.join(twice, same, "left_semi")
    return single.drop(mark).unionByName(_one_of_each(many, id_col, mark).drop(mark))


def _one_of_each(rows: DataFrame, id_col: str, mark: str) -> DataFrame:
    """One row of each id and text."""
    at, text = free_name(rows, "at_id"), free_name(rows, "at_text")
    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = rows.select(F.col(id_col).alias(at), F.col(mark).alias(text), packed.alias("row")).groupBy(at, text)
    return first.agg(F.min("row").alias("row")).select("row.*")
