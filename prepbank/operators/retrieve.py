"""Nearest questions: text to vectors, exact filtered top-k, seeded shuffle and pick.

The top-k join works on blocks of vectors (``blocks``), each different vector of a role once. A large bank is put into a tree of cells
(``tree``), built for the call or stored beforehand, and searched through it where that rules cells out; where it does not, all vectors of
a role are scanned in slots of bounded size. The result is exact either way.
"""

from collections.abc import Callable, Sequence

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions.jsons import let
from prepbank.functions.text import md_bullets
from prepbank.operators import tree
from prepbank.operators.blocks import best_rows, pack, scan
from prepbank.operators.ordering import MAX_GROUP_ROWS, find_hot_keys, first_rows, lookup, number_rows, split_hot
from prepbank.session import fresh_path, materialize
from prepbank.sources.text_store import TextStore

EMBEDDING_DIMS = 384
# A vector with more copies than this in a role counts as much copied.
COPIES = 128
# Largest rows found for the different vectors of requests that are broadcast to the requests, and ids of shown rows to the bank, in bytes of a row
# with long ids.
BROADCAST_BYTES = 16 << 20
FOUND_BYTES = 32
# Number of a different vector of the requests.
NO = "_no"


def embed(
    df: DataFrame,
    text_col: str = "text",
    fn: Callable[[Column], Column] | None = None,
    out: str = "embedding",
    dims: int = EMBEDDING_DIMS,
) -> DataFrame:
    """Add a unit vector of the text: hashed word counts, or what ``fn`` (say a pandas UDF) makes of the column."""
    if fn is not None:
        return df.withColumn(out, fn(F.col(text_col)))
    filled = df.withColumn("_text", F.coalesce(text_col, F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(filled)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_text", "_words", "_counts", "_unit")


def hashed_words(dims: int) -> Callable[[Column], Column]:
    """Function for ``embed``: how often words fall on each of ``dims`` places, by the first 16 bits of their MD5.

    Words are what whitespace leaves, in lower case. Built-in expressions only, and plain to state in SQL.
    """

    def counts(c: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \t\n\x0b\f\r]+"), lambda w: w != "")
        place = F.transform(words, lambda w: F.conv(F.substr(F.md5(w), F.lit(1), F.lit(4)), 16, 10).cast("int") % dims)
        places = F.sequence(F.lit(0), F.lit(dims - 1))
        return let(place, lambda p: F.transform(places, lambda d: F.size(F.filter(p, lambda x: x == d)).cast("float")))

    return counts


def filter_role(df: DataFrame, role: str) -> DataFrame:
    """Rows of one role; prunes partitions on an index written by role."""
    return df.where(F.col("role") == F.lit(role))


def clamp_k(k, total) -> Column:
    """``k``, but no more than the size of the whole bank, and at least 1 of it."""
    k = F.lit(k) if isinstance(k, int) else k
    total = F.lit(total) if isinstance(total, int) else total
    return F.least(k, F.greatest(F.lit(1), total))


def unmatched(requests: DataFrame, bank: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Requests whose role has no bank rows, with the message for them."""
    without = lookup(requests, bank.select("role").distinct(), ["role"], "left_anti", max_group_rows)
    return without.withColumn("message", F.lit(fixed.NO_QUESTIONS))


# ---- nearest rows --------------------------------------------------------------------------------


def bank_vectors(df: DataFrame, id_col: str, out: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """Rows ``role, <out>, v`` that have a role and a vector; of unit length for the cosine."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    v = F.col(vector).cast("array<double>")
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        v = F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))
    picked = df.where(F.col("role").isNotNull() & F.col(vector).isNotNull())
    return picked.select("role", F.col(id_col).alias(out), v.alias("v"))


def _keep_copies(rows: DataFrame, bid: str, k: int) -> DataFrame:
    """Of equal vectors in a role only the k first ids can reach any top-k; of much copied ones drop the others.

    Copies are counted by hash, so that only the rows of the most copied vectors move.
    """
    keys = ["role", "_hash"]
    hashed = rows.withColumn("_hash", F.xxhash64("v"))
    hot = find_hot_keys(hashed, keys, max(k, COPIES))
    if hot is None:
        return rows
    cold, rest = split_hot(hashed, keys, hot)
    return cold.unionByName(first_rows(rest, [*keys, "v"], [F.asc(bid)], k, "_copy").drop("_copy")).drop("_hash")


def _pack_copies(rows: DataFrame, bid: str, k: int) -> DataFrame:
    """Blocks of the different vectors of each role, with the first k ids of each."""
    ids = F.slice(F.array_sort(F.collect_list(F.struct(bid))), 1, k)
    each = rows.groupBy("role", "v").agg(F.transform(ids, lambda x: x[bid]).alias(bid))
    return pack(each.withColumns({"cell": F.lit(0).cast("bigint"), "d": F.lit(0.0)}), bid, gather=False)


def scan_whole(asked: DataFrame, blocks: DataFrame, bid: str, k: int) -> DataFrame:
    """The k nearest rows of requests ``role, _no, v`` out of blocks that are one cell for each role."""
    flat = asked.withColumns({"cell": F.lit(0).cast("bigint"), "d": F.lit(0.0)})
    blocks = blocks.join(asked.select("role").distinct(), "role", "left_semi")
    return best_rows(scan(flat, blocks, NO, bid, k, gather=False), NO, bid, k)


class Asked:
    """Requests ``role, <request_id>, v``: their different vectors (``vectors``: role, _no, v), and the way back from the rows found for these."""

    def __init__(self, rows: DataFrame, request_id: str, max_group_rows: int | None):
        self.rid, self.max_group_rows = request_id, max_group_rows
        rows = materialize(rows.withColumn("_hash", F.xxhash64("v")), "asked")
        each = rows.select("role", "_hash", "v").groupBy("role", "_hash", "v").agg(F.count(F.lit(1)).alias("_n"))
        self.each = materialize(each.withColumn(NO, F.monotonically_increasing_id()), "vectors")
        # Vectors that share a hash, if there ever are some, are told apart by themselves.
        self.keys = ["role", "_hash"] + (["v"] if find_hot_keys(self.each, ["role", "_hash"], 1) else [])
        self.rows = rows.select(request_id, *self.keys)
        self.vectors = self.each.select("role", NO, "v")

    def answered(self, best: DataFrame, bid: str, k: int, metric: str) -> DataFrame:
        """Rows ``<request_id>, <bid>, distance, rank`` of all requests, from those of the different vectors."""
        distance = F.col("distance") / 2 if metric == "cosine" else F.col("distance")
        best = materialize(best.withColumn("distance", distance), "best")
        small = best.count() * FOUND_BYTES <= BROADCAST_BYTES
        columns = [self.rid, bid, "distance", "rank"]

        def found(rows):
            numbered = lookup(rows, self.each.select(*self.keys, NO), self.keys, "inner", self.max_group_rows).select(self.rid, NO)
            met = numbered.join(F.broadcast(best), NO) if small else lookup(numbered, best, [NO], "inner", self.max_group_rows)
            return met.select(*columns)

        # An id that comes more than once gets the nearest rows of all its vectors.
        again = find_hot_keys(self.rows, [self.rid], 1)
        if again is None:
            return found(self.rows)
        once, more = split_hot(self.rows, [self.rid], again)
        return found(once).unionByName(best_rows(found(more).drop("rank"), self.rid, bid, k).select(*columns))


def knn(
    requests: DataFrame,
    bank: DataFrame,
    k: int = fixed.RETRIEVED,
    request_id: str = "session_id",
    bank_id: str = "id",
    vector: str = "embedding",
    metric: str = "l2",
    cell_rows: int = tree.CELL_ROWS,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    fanout: int = tree.FANOUT,
) -> DataFrame:
    """The k nearest bank rows of the same role for every request, nearest first, ties by id.

    ``distance`` is the squared Euclidean one, or 1 - cosine. ``k`` is clamped by the size of the whole bank. A bank of more than
    ``cell_rows`` rows is put into a search tree for this one call, unless a sample shows that its cells would rule nothing out;
    ``load_vectors`` stores one for many.
    """
    bid = f"b_{bank_id}" if bank_id == request_id else bank_id
    # Either side is read more than once below; its vectors may come from a caller's function.
    asked = Asked(bank_vectors(requests, request_id, request_id, vector, metric), request_id, max_group_rows)
    rows = materialize(bank_vectors(bank, bank_id, bid, vector, metric), "rows")
    # rows without a role or a vector are nobody's, so they are not counted
    total = rows.count()
    k = min(k, max(1, total))
    rows = _keep_copies(rows, bid, k)
    blocks = materialize(_pack_copies(rows, bid, k), "blocks")
    few = total > cell_rows and tree.may_open_few(
        asked.vectors, blocks, lambda some: scan_whole(some, blocks, bid, k), k, NO, cell_rows, fanout
    )
    if few:
        path = fresh_path(bank.sparkSession, "tree")
        tree.build_tree(rows, path, bid, cell_rows, fanout)
        few = tree.opens_few(asked.vectors, path, k, NO, bid)
    if few:
        best = tree.search_tree(asked.vectors, path, k, NO, bid)
    else:
        best = scan_whole(asked.vectors, blocks, bid, k)
    return asked.answered(best, bid, k, metric)


def load_vectors(
    bank: DataFrame, path: str, bank_id: str = "id", vector: str = "embedding", metric: str = "l2", cell_rows: int = tree.CELL_ROWS,
    fanout: int = tree.FANOUT,
) -> None:
    """Store the vectors of a bank in the form that ``nearest`` searches, for that ``metric``."""
    rows = materialize(bank_vectors(bank, bank_id, bank_id, vector, metric), "rows")
    tree.build_tree(rows, path, bank_id, cell_rows, fanout)


def nearest(
    requests: DataFrame, path: str, k: int = fixed.RETRIEVED, request_id: str = "session_id", bank_id: str = "id",
    vector: str = "embedding", metric: str = "l2", max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``knn`` against stored vectors: the bank is not read, only the parts of the tree that requests open."""
    asked = Asked(bank_vectors(requests, request_id, request_id, vector, metric), request_id, max_group_rows)
    bid = f"b_{bank_id}" if bank_id == request_id else bank_id
    if tree.opens_few(asked.vectors, path, k, NO, bank_id):
        best = tree.search_tree(asked.vectors, path, k, NO, bank_id)
    else:
        best = scan_whole(asked.vectors, tree.all_blocks(requests.sparkSession, path), bank_id, k)
    return asked.answered(best.withColumnRenamed(bank_id, bid), bid, k, metric)


def with_bank_rows(
    nearest: DataFrame, bank: DataFrame, bank_id: str = "id", max_group_rows: int | None = MAX_GROUP_ROWS,
    columns: Sequence[str] = ("question", "model_answer"),
) -> DataFrame:
    """Attach the bank's question and answer; a question that is near to very many requests is a hot key.

    ``nearest`` is read more than once: give it materialized where it is dear.
    """
    rows = bank.select(bank_id, *columns)
    return lookup(nearest, rows, [bank_id], "inner", max_group_rows)


# ---- shuffle and pick -------------------------------------------------------------------------------


def shuffle_key(seed: int, *parts: Column) -> Column:
    """Text to sort by for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffle_rows(
    df: DataFrame, key: str = "session_id", id_col: str = "id", seed: int = 0, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Give the rows of each key a place in a seeded random order."""
    order = [shuffle_key(seed, F.col(key), F.col(id_col)), F.col(id_col)]
    return number_rows(df, [key], order, "place", max_group_rows=max_group_rows)


def first_places(df: DataFrame, n: int, key: str = "session_id", id_col: str = "id", seed: int = 0) -> DataFrame:
    """The rows at the first n places of each key's shuffle, with no numbering of the rest."""
    order = [shuffle_key(seed, F.col(key), F.col(id_col)), F.col(id_col)]
    return first_rows(df, [key], order, n, "place")


def pick_one(df: DataFrame, key: str = "session_id", id_col: str = "id", seed: int = 0) -> DataFrame:
    return first_places(df, 1, key, id_col, seed).drop("place")


def reference_block(
    retrieved: DataFrame, n: int = fixed.REFERENCES, key: str = "session_id", id_col: str = "id", seed: int = 0,
    bank: DataFrame | None = None, max_group_rows: int | None = MAX_GROUP_ROWS, onto: DataFrame | None = None,
) -> DataFrame:
    """First n questions of each key's shuffle as ``- question`` lines. With a ``bank``, ``retrieved`` needs no texts: only those of the rows
    that are shown are fetched, at the end; until then handles of a ``TextStore`` stand for them. ``onto`` gives rows of the keys to which
    the lines are added, ahead of that; those without lines go."""
    few = first_places(retrieved if bank is None else retrieved.select(key, id_col), n, key, id_col, seed)
    store = None
    if bank is not None:
        few, texts = materialize(few, "places"), bank.select(id_col, "question")
        store = TextStore.new(bank.sparkSession)
        if store is not None:
            shown = few.select(id_col).distinct()
            if shown.count() * FOUND_BYTES <= BROADCAST_BYTES:
                texts = texts.join(F.broadcast(shown), id_col, "left_semi")
            texts = store.put(texts, "question")
        few = with_bank_rows(few, texts, id_col, max_group_rows, ["question"])
    listed = few.groupBy(key).agg(F.collect_list(F.struct("place", "question")).alias("_few"))
    columns = [key]
    if onto is not None:
        listed, columns = onto.join(listed, key), onto.columns
    if store is not None:
        listed = store.get(listed, F.transform("_few", lambda x: x["question"]), "_texts")
        listed = listed.withColumn("_few", F.zip_with("_few", "_texts", lambda x, text: F.struct(x["place"].alias("place"), text.alias("question"))))
    lines = md_bullets(F.transform(F.array_sort("_few"), lambda x: x["question"]), "-")
    return listed.select(*columns, lines.alias("reference_questions"))
