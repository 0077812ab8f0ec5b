"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound the overlap from above, exact intersection of sorted arrays.

All pairs of a size band would be too many, so a tile (the texts whose larger partner lies in one band) is first cut without loss.
Two sets of the tile that link differ in at most D shingles. The hash space is cut into more than D parts, of which D differing
shingles reach at most D; so linked sets hold exactly the same shingles in some part, and only texts that agree in a whole part meet.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prepbank.llm.common import restored
from prepbank.llm.components import components
from prepbank.operators.ordering import find_hot_keys, join_small, number_rows, split_hot
from prepbank.session import materialize

WORDS = 4
SEED = 42
# Two sets link from this share of their union on, in hundredths.
PERCENT = 85
# Each band's sizes are up to so much larger than its first: a quarter.
GROWTH = 4
# Chance that a set has more empty parts than a tile's spare ones, where these can be chosen freely.
RARE = 1e-3
# Buckets of hashes by which texts that nobody asks for are told ahead of a shuffle (8 MB).
BUCKETS = 1 << 20
# One class in so many is looked at to find the keys of very many classes; such a key is seen this often.
SPARSE = 64
OFTEN = 64
# Pairs that a tile may pass on for each of its rows; where the bitmaps leave more, its rows meet once more, with their sets.
DENSE = 4
# Rows and shingles of a block of a long list; two blocks make a tile's task.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each value."""
    x = x + _U(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles; the whole sequence where it has fewer words, none without words."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, _U)
    join = b" ".join
    grams = {join(t) for t in zip(*[tokens[i:] for i in range(words)], strict=False)} or {join(tokens)}
    return np.sort(np.array([xxh64_intdigest(g, SEED) for g in grams], _U))


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Shared elements that sets of a and b elements need in order to link."""
    return -(-percent * (a + b) // (100 + percent))


@lru_cache(maxsize=None)
def _bands(percent: int) -> list[int]:
    """First size of each band, for sizes up to 2^40."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + max(1, edges[-1] // GROWTH))
    return edges


@lru_cache(maxsize=None)
def _parts(band: int, percent: int) -> tuple[int, int]:
    """(parts, spare) of the tile whose larger sets lie in a band: linked ones differ in fewer elements than parts less spare.

    A set with at most ``spare`` empty parts shares one that isn't empty with every set it links to.
    """
    low, high = _bands(percent)[band], _bands(percent)[band + 1] - 1
    most = 2 * high * (100 - percent) // (100 + percent)
    if most == 0:
        return 0, 0
    for spare in range(1, (most + 1) // 2 + 2):
        parts = most + 1 + spare
        mean = parts * exp(-percent * low / 100 / parts)
        tail, term = 1.0, exp(-mean)
        for i in range(spare + 1):
            tail -= term
            term *= mean / (i + 1)
        if tail < RARE:
            break
    return parts, spare


@lru_cache(maxsize=1024)
def _cuts(parts: int) -> np.ndarray:
    """Boundaries of the parts, in the upper half of the hash."""
    return np.array([-(-(i << 32) // parts) for i in range(parts + 1)], _U)


def part_keys(shingles: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, own): what a set is looked up by in its own tile and in the next one. Linked sets share a key, own for one of them.

    A key stands for tile, part and the shingles in the part. Equal sets aren't told apart here; sizes at which only these link have
    no keys.
    """
    n = len(shingles)
    keys, own = [], []
    if n:
        edges = _bands(percent)
        band = int(np.searchsorted(edges, n, side="right")) - 1
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(shingles, 1))])
        for tile in (band, band + 1):
            parts, spare = _parts(tile, percent)
            if not parts or 100 * n < percent * edges[tile]:
                continue
            at = np.searchsorted(shingles >> _U(32), _cuts(parts))
            total, full = sums[at[1:]] - sums[at[:-1]], at[1:] > at[:-1]
            found = _mix(total + _mix(np.arange(parts, dtype=_U) + _U(tile << 40), 2), 3)
            # Empty parts only count between sets that both have too many of them.
            used = full if parts - full.sum() <= spare else np.ones(parts, bool)
            keys.append(found[used])
            own.append(np.full(int(used.sum()), tile == band))
    return (np.concatenate(keys), np.concatenate(own)) if keys else (np.zeros(0, _U), np.zeros(0, bool))


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of a set: four to eight for each element."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """One hashed bit for each element, as words of 64."""
    at = _mix(shingles, 4) & _U(bits - 1)
    out = np.zeros(bits, np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(_U)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same set at fewer bits."""
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def overlap_bound(a: np.ndarray, n_a, b: np.ndarray, n_b) -> np.ndarray:
    """Upper bound of shared elements: a bit that only one side has stands for at least one element that only it has."""
    only_a, only_b = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def shingle_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each different text (null counts as empty): id (its smallest), t1 and t2 (hashes of the text), n (size of its set), h1
    and h2 (hashes of the set), bits, keys and own. Of copies each task passes on one text."""
    fields = [
        ("id", T.StringType()), ("t1", T.LongType()), ("t2", T.LongType()), ("n", T.LongType()), ("h1", T.LongType()),
        ("h2", T.LongType()), ("bits", T.BinaryType()), ("keys", T.ArrayType(T.LongType())), ("own", T.ArrayType(T.BooleanType())),
    ]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t1, t2, text in zip(batch["id"], batch["t1"], batch["t2"], batch["text"], strict=True):
                s = shingle_set(text, words)
                keys, own = part_keys(s, percent)
                h1, h2 = (int(_mix(s, seed).sum(dtype=_U).view(np.int64)) for seed in (5, 6))
                out.append((key, t1, t2, len(s), h1, h2, bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else b"", keys.view(np.int64), own))
            yield pd.DataFrame(out, columns=schema.names)

    keyed = docs.select(F.col(id_col).alias("id"), *_text_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = keyed.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    slim = texts.select(F.col("id").cast("string").alias("id"), "t1", "t2", "text")
    return restored(slim.mapInPandas(rows, schema), docs, id_col)


def _text_key(text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """Rows (cid, shingles) of classes (cid, t1, t2), from their texts. Texts whose hash is in no bucket of a wanted one stay where they are:
    a list of at most ``BUCKETS`` numbers goes to every task."""
    bucket = F.pmod("t1", F.lit(BUCKETS)).alias("bucket")
    some = F.broadcast(wanted.select(bucket).distinct())
    keyed = docs.where(F.col(text_col).isNotNull()).select(*_text_key(text_col), F.col(text_col).alias("text"))
    near = keyed.withColumn("bucket", bucket).join(some, "bucket", "left_semi")
    texts = near.groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cid": batch["cid"], "shingles": [shingle_set(t, words).tobytes() for t in batch["text"]]})

    return wanted.join(texts, ["t1", "t2"]).select("cid", "text").mapInPandas(rows, "cid bigint, shingles binary")


def _passing(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link; rows (a, b, n_a, n_b, bits_a, bits_b)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n_a, n_b, bits_a, bits_b in zip(batch["n_a"], batch["n_b"], batch["bits_a"], batch["bits_b"], strict=True):
                a, b = np.frombuffer(bits_a, _U), np.frombuffer(bits_b, _U)
                bits = 64 * min(len(a), len(b))
                keep.append(overlap_bound(folded(a, bits), n_a, folded(b, bits), n_b) >= least_overlap(n_a, n_b, percent))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.where(fit).mapInPandas(check, "a bigint, b bigint")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, set_a, set_b) that link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for set_a, set_b in zip(batch["set_a"], batch["set_b"], strict=True):
                a, b = np.frombuffer(set_a, _U), np.frombuffer(set_b, _U)
                keep.append(overlap(a, b) >= least_overlap(len(a), len(b), percent))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(check, "a bigint, b bigint")


def tile_candidates(
    root: np.ndarray, n: np.ndarray, own: np.ndarray, bits: list[bytes], percent: int = PERCENT, dense: int = DENSE
) -> tuple[np.ndarray, list[tuple[int, int]] | None]:
    """Which rows of a tile could link to a row of another component, by size and by the bound of the bitmaps; and the pairs, if these are no
    more than ``dense`` a row."""
    order = np.argsort(n, kind="stable")
    root, own, n = root[order], own[order], n[order]
    width = min(len(b) for b in bits)
    maps = np.stack([folded(np.frombuffer(bits[i], _U), 8 * width) for i in order])
    hit = np.zeros(len(n), bool)
    pairs: list[tuple[int, int]] | None = []
    for i in range(len(n)):
        near = _partners(i, n, root, own, percent)
        if len(near):
            near = near[overlap_bound(maps[i], n[i], maps[near], n[near]) >= -(-percent * (n[i] + n[near]) // (100 + percent))]
            hit[near] = True
            hit[i] |= len(near) > 0
            if pairs is not None:
                pairs = None if len(pairs) + len(near) > dense * len(n) else pairs + [(int(order[i]), int(order[j])) for j in near]
    out = np.zeros(len(n), bool)
    out[order] = hit
    return out, pairs


def _partners(i: int, n: np.ndarray, root: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Later rows, sizes rising, that are small enough to link to row i, in another component, one of the two of the tile's own band."""
    near = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // percent, side="right")))
    return near[(root[near] != root[i]) & (own[near] | own[i])]


def tile_links(cid: np.ndarray, root: np.ndarray, sets: list[np.ndarray], own: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the rows of a tile that join different components; those inside one component are not looked for.

    ``own`` tells the rows of the tile's own band: two rows of the band below meet in its tile.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    cid, root, own, sets = cid[order], root[order].copy(), own[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    bits = bitmap_bits(int(n.max(initial=1)))
    maps = np.stack([bitmap(s, bits) for s in sets])
    out = []
    for i in range(len(cid)):
        near = _partners(i, n, root, own, percent)
        if not len(near):
            continue
        need = -(-percent * (n[i] + n[near]) // (100 + percent))
        near = near[overlap_bound(maps[i], n[i], maps[near], n[near]) >= need]
        for j in near:
            if root[j] != root[i] and overlap(sets[i], sets[j]) >= least_overlap(n[i], n[j], percent):
                out.append((int(cid[i]), int(cid[j])))
                root[root == root[j]] = root[i]
    return out


def _tile_rows(rows: DataFrame, block_rows: int, block_shingles: int, percent: int) -> DataFrame:
    """Rows (key, cid, root, n, own) of lists, dealt to tiles (column tile): a list of one block is one tile, a longer one is a tile for each two
    blocks whose sizes can link."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"))
    width = F.least(F.lit(block_rows), F.greatest(F.lit(16), F.floor(F.lit(block_shingles) / F.col("most"))))
    sizes = materialize(sizes.select("key", "rows", width.alias("width")), "list-sizes")
    long = sizes.where(F.col("rows") > F.col("width"))
    short = rows.join(sizes.where(F.col("rows") <= F.col("width")).select("key"), "key")
    short = short.withColumn("tile", F.xxhash64("key"))
    if not long.head(1):
        return short
    numbered = number_rows(rows.join(long.select("key", "width"), "key"), ["key"], [F.asc("n"), F.asc("cid")], "no")
    blocks = materialize(numbered.withColumn("block", F.floor((F.col("no") - 1) / F.col("width"))).drop("no", "width"), "blocks")
    ends = blocks.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (ends.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")]) for side in "ab")
    met = left.join(right, "key").where((F.col("block_a") <= F.col("block_b")) & (100 * F.col("high_a") >= percent * F.col("low_b")))
    tile = F.xxhash64("key", "block_a", "block_b").alias("tile")
    sides = met.select("key", tile, F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    return short.unionByName(blocks.join(sides, ["key", "block"]).select(*short.columns))


def _lists(posted: DataFrame) -> DataFrame:
    """Rows (key, cid, own, lead) of the keys of several classes, the first one of the tile's own band leading.

    One window over each key. Keys that a sample of the classes finds very often are no window: their first class is a pre-aggregated
    minimum, joined.
    """
    seen = posted.where(F.pmod(F.xxhash64("cid"), F.lit(SPARSE)) == 0)
    hot = find_hot_keys(seen, ["key"], OFTEN)
    cold, rest = (posted, None) if hot is None else split_hot(posted, ["key"], hot)
    w = W.partitionBy("key").orderBy(F.desc("own"), F.asc("cid"))
    placed = cold.select("*", F.first("own").over(w).alias("led"), F.first("cid").over(w).alias("lead"), F.lead("cid").over(w).alias("next"))
    found = placed.where(F.col("led") & ((F.col("cid") != F.col("lead")) | F.col("next").isNotNull())).select("key", "cid", "own", "lead")
    if rest is None:
        return found
    leads = rest.where("own").groupBy("key").agg(F.min("cid").alias("lead"))
    return found.unionByName(join_small(rest, leads, ["key"], hot.few).select(*found.columns))


def links(
    docs: DataFrame, classes: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Rows (node, component): the components of the classes (cid, t1, t2, n, h1, h2, bits, keys, own) over all links between them.

    Every row of a list of equal keys is first held against the list's first one: by size, then by the bound of the bitmaps, the sets
    being fetched for those that pass. What this joins needs no further look. Lists that still hold several components are
    gone through in tiles, without the pairs inside a component: by the bitmaps, then by the sets of the rows that have a
    partner left. Equal lists are taken once.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = classes.select("cid", F.explode(F.arrays_zip("keys", "own")).alias("k"))
    posted = posted.select(F.col("k.keys").alias("key"), "cid", F.col("k.own").alias("own"))
    rows = materialize(_lists(posted), "list-rows")
    pairs = materialize(rows.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")

    bits = classes.select("cid", "n", "bits")
    a, b = (bits.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    passed = materialize(_passing(pairs.join(a, "a").join(b, "b"), percent), "passed")

    def sets_of(cids, label):
        wanted = materialize(classes.select("cid", "t1", "t2").join(cids.distinct(), "cid"), "wanted")
        return materialize(_sets(docs, wanted, text_col, words), label)

    sets = sets_of(passed.select(F.explode(F.array("a", "b")).alias("cid")), "sets")
    a, b = (sets.select(F.col("cid").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    linked = _linked(passed.join(a, "a").join(b, "b"), percent)
    # Texts of equal sets, whose sizes may be too small for any key.
    same = classes.groupBy("h1", "h2").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    same = classes.select("h1", "h2", F.col("cid").alias("a")).join(same, ["h1", "h2"]).where("a <> b").select("a", "b")
    edges = materialize(linked.unionByName(same), "edges")
    found = materialize(components(edges), "components")

    rows = rows.join(classes.select("cid", "n"), "cid")
    rooted = rows.join(found.select(F.col("node").alias("cid"), F.col("component").alias("root")), "cid", "left")
    rooted = materialize(rooted.select("key", "cid", "n", "own", F.coalesce("root", "cid").alias("root")), "rooted")
    open_ = rooted.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("cid", "own")).alias("x"), F.sum(F.xxhash64("own", "cid").cast("decimal(38,0)")).alias("s"),
    )
    open_ = open_.where("rows > 2 and low < high").groupBy("rows", "x", "s").agg(F.min("key").alias("key")).select("key")
    left = materialize(rooted.join(open_, "key"), "open-rows")
    if not left.head(1):
        return found
    tiles = materialize(_tile_rows(left, block_rows, block_shingles, percent).select("tile", "cid", "root", "n", "own"), "tiles")

    def candidates(one: pd.DataFrame) -> pd.DataFrame:
        hit, pairs = tile_candidates(one["root"].to_numpy(), one["n"].to_numpy(), one["own"].to_numpy(bool), one["bits"].tolist(), percent)
        if pairs is None:
            return one.loc[hit, ["tile", "cid", "root", "own"]].rename(columns={"cid": "a"}).assign(b=None)[["tile", "a", "b", "root", "own"]]
        cid = one["cid"].to_numpy()
        both = [sorted((cid[i], cid[j])) for i, j in pairs]
        return pd.DataFrame({"tile": None, "a": [x for x, _ in both], "b": [x for _, x in both], "root": None, "own": None})

    def compared(one: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(s, _U) for s in one["shingles"]]
        return pd.DataFrame(tile_links(one["cid"].to_numpy(), one["root"].to_numpy(), held, one["own"].to_numpy(bool), percent), columns=["a", "b"], dtype="int64")

    def by_tile(df: DataFrame, use, schema: str) -> DataFrame:
        dealt = df.repartition(count, "tile").sortWithinPartitions("tile")
        return dealt.mapInPandas(lambda batches: _whole_tiles(batches, use), schema)

    slim = tiles.join(classes.select("cid", "bits"), "cid")
    asked = materialize(by_tile(slim, candidates, "tile bigint, a bigint, b bigint, root bigint, own boolean"), "candidates")
    if not asked.head(1):
        return found
    sparse = materialize(asked.where("tile is null").select("a", "b").distinct(), "more-pairs")
    dense = asked.where("tile is not null").select("tile", F.col("a").alias("cid"), "root", "own")
    sets = sets_of(sparse.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(dense.select("cid")), "more-sets")
    a, b = (sets.select(F.col("cid").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    more = _linked(sparse.join(a, "a").join(b, "b"), percent)
    more = materialize(more.unionByName(by_tile(dense.join(sets, "cid"), compared, "a bigint, b bigint")).distinct(), "more-edges")
    stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(more)) if more.head(1) else found


def _whole_tiles(batches: Iterator[pd.DataFrame], use) -> Iterator[pd.DataFrame]:
    """``use`` of each tile's rows, which come one after the other."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        tile = batch["tile"].to_numpy()
        cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        rest = batch.iloc[cut:]
        for _, one in batch.iloc[:cut].groupby("tile", sort=False):
            yield use(one)
    if rest is not None and len(rest):
        yield use(rest)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set of ``words``-word shingles) and component_id, the smallest id reachable over links.

    Texts are lower-cased (A-Z); a text with fewer words is one shingle. Two texts link if their sets share ``percent`` hundredths of their
    union. Copies are one class ahead of everything else, so a group of them counts once.

    A null, empty or blank text has no shingles and links with nothing, so its component is its own id; a null id never
    names a component unless its class and all linked ones have no other; repeated rows are one class; texts of any length are
    taken whole; an empty table gives an empty result; other columns take no part.
    """
    texts = shingle_rows(docs, id_col, text_col, words, percent)
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("cid"), "*"), "texts")
    classes = texts.where("n > 0")
    found = materialize(links(docs, classes, text_col, words, percent, block_rows, block_shingles), "components")
    linked = classes.select("cid", "id").join(found.select(F.col("node").alias("cid"), "component"), "cid")
    best = linked.groupBy("component").agg(F.min("id").alias("best"))
    best = linked.join(best, "component").select("cid", "best")
    heads = texts.select("cid", "t1", "t2", "n", "id").join(best, "cid", "left").select("t1", "t2", "n", F.coalesce("best", "id").alias("best"))
    joined = docs.select(F.col(id_col).alias("id"), *_text_key(text_col)).join(heads, ["t1", "t2"])
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best")).otherwise(F.col("id")).alias("component_id")
    )
