"""Scoring of texts by context-tree weighting over bytes, and by a unigram base.

The model is the context tree of the training texts: a byte is eight binary decisions, each with a tree of its own over the last
DEPTH bytes, and in every node the Krichevsky-Trofimov estimate of the node competes with the mixture of its children. What a text needs
of it are the probabilities of its distinct (context, byte) strings, called grams, so the corpus is reduced to counted grams and
words, the trees are worked out where the grams of a subtree meet, and the probabilities travel back to the texts.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.llm.common import restored
from prepbank.session import materialize

# At most 6, so that a gram and a flag fit in 64 bits.
DEPTH = 6
# Subtrees below contexts of this many bytes are worked out apart; the trees above have at most 256^2 contexts.
TOP = 2
# Normalized bytes of the texts that are tallied together, and positions that are sorted at a time.
CHUNK_BYTES = 32 << 20
SLICE = 1 << 20
END = 10
SMOOTHING = 0.1

# A word's hash: the sum of its bytes' values, each times a power of an odd number, modulo 2^64.
_MULTIPLIER = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


# Packed arrays -----------------------------------------------------------------------------------------------------------


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of an array, grouped by place, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else b""
    return zstandard.ZstdCompressor(level=3).compress(bytes(planes))


def _spread(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data, np.uint64), dtype=np.uint64)


# Texts, grams and words --------------------------------------------------------------------------------------------------


def normalized(text: str) -> bytes:
    """The tokens that are scored: lower-cased words with one space between them."""
    return b" ".join(text.encode().lower().split())


class _Layout:
    """Texts of a chunk behind one another, each with the bytes ahead of it that stand for its empty context."""

    def __init__(self, texts: list[bytes], held: np.ndarray):
        fill = bytes([END]) * DEPTH
        self.buffer = np.frombuffer(fill + fill.join(texts) + bytes([END]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        # Start of each text and, one past its end mark, its end in the buffer.
        self.ends = np.cumsum(sizes + DEPTH - 1) + 1
        self.starts = self.ends - sizes
        self.held = held

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of whole texts (from, to), of about SLICE bytes or one long text."""
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + SLICE, side="right")))
            yield first, last
            first = last

    def grams(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(grams, owning text) at each scored position of the texts."""
        at, end = int(self.starts[first]), int(self.ends[last - 1])
        keys = np.zeros(end - at, np.uint64)
        for i in range(DEPTH, -1, -1):
            keys <<= np.uint64(8)
            keys |= self.buffer[at - i : end - i]
        owner = np.repeat(np.arange(first, last), self.ends[first:last] - self.starts[first:last] + DEPTH - 1)[: len(keys)]
        scored = np.ones(len(keys), bool)
        for i in range(DEPTH - 1):
            gap = self.ends[first : last - 1] - at + i
            scored[gap] = False
        return keys[scored], owner[scored]

    def words(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, owning text) of each word of the texts."""
        at, end = int(self.starts[first]), int(self.ends[last - 1])
        piece = self.buffer[at:end]
        white = (piece == 32) | (piece == END)
        edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1, append=1))
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = int((stop - start).max())
        hashed = np.zeros(len(start), np.uint64)
        live = np.arange(len(start))
        power = 1
        for i in range(n):
            live = live[start[live] + i < stop[live]]
            hashed[live] += _VALUES[piece[start[live] + i]] * np.uint64(power)
            power = power * _MULTIPLIER % 2**64
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
        owner = first + np.searchsorted(self.ends[first:last] - at, start, side="right")
        return hashed >> np.uint64(1), owner

    def tally(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams or words of the chunk, sorted, and how often they occur in its training texts."""
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, most = 0, 2 * SLICE
        for first, last in self.slices():
            keys, owner = getattr(self, kind)(first, last)
            both = (keys << np.uint64(1)) | self.held[owner].astype(np.uint64)
            del keys, owner
            both.sort()
            cut = np.flatnonzero(np.diff(both, prepend=both[:1] + np.uint64(1))) if len(both) else np.zeros(0, np.int64)
            found.append(both[cut] >> np.uint64(1))
            counts.append(np.diff(cut, append=len(both)) * (both[cut] & np.uint64(1) == 0))
            size += len(cut)
            if size > most:
                merged = _merge(found, counts)
                found, counts, size = [merged[0]], [merged[1]], len(merged[0])
                most = max(most, 2 * size)
        return _merge(found, counts)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[cut], np.add.reduceat(n, cut) if len(cut) else n


def _home(kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """Part that a key belongs to: all grams with the same last TOP + 1 context bytes have one."""
    base = (keys >> np.uint64(8)) & np.uint64((1 << 8 * (TOP + 1)) - 1) if kind == "grams" else keys
    return ((base * np.uint64(_MULTIPLIER)) >> np.uint64(33)) % np.uint64(parts)


def _shares(kind: str, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    home = _home(kind, keys, parts)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(parts + 1))
    for part in range(parts):
        if cuts[part] < cuts[part + 1]:
            yield part, order[cuts[part] : cuts[part + 1]]


# Trees -------------------------------------------------------------------------------------------------------------------

_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 16) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, (1 << 16) + 1)))])


def _log_rising(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """Log of the product of the first n numbers shift, shift + 1, ...: a table, and Stirling's series beyond it."""
    last = len(table) - 1
    x = np.maximum(n, last) + shift
    x0 = last + shift
    series = lambda v: (v - 0.5) * np.log(v) - v + 1 / (12 * v)
    return np.where(n <= last, table[np.minimum(n, last)], table[last] + series(x) - series(x0))


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    return _log_rising(zeros, _HALVES, 0.5) + _log_rising(ones, _HALVES, 0.5) - _log_rising(zeros + ones, _WHOLES, 1.0)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, own weight) of inner nodes from their counts and their children's summed logs."""
    own = kt_log(zeros, ones)
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def subtrees(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """The trees below contexts of TOP bytes, of grams that hold all of their subtrees.

    Returns, for each gram and each of its eight decisions, the probability of the decision taken by the mixture
    from depth DEPTH up to TOP + 1; and rows (context, node, zeros, ones, below) for the nodes at depth TOP.
    """
    byte = (grams & np.uint64(255)).astype(np.int64)
    steps = np.arange(8)
    node = ((1 << steps)[None, :] | (byte[:, None] >> (8 - steps)[None, :])).ravel().astype(np.uint64)
    bit = ((byte[:, None] >> (7 - steps)[None, :]) & 1).ravel()
    n = np.repeat(counts, 8)
    # Start at the deepest nodes: (context, node of the byte's own tree).
    context = np.repeat(grams >> np.uint64(8), 8)
    keys, at = _grouped(context << np.uint64(8) | node)
    ones = np.bincount(at, n * bit, len(keys)).astype(np.int64)
    zeros = np.bincount(at, n, len(keys)).astype(np.int64) - ones
    log_weighted = kt_log(zeros, ones)
    chance = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros + ones + 1)[at]
    up = at
    for depth in range(DEPTH - 1, TOP - 1, -1):
        mask = np.uint64((1 << 8 * depth) - 1)
        parents, to = _grouped((keys >> np.uint64(8) & mask) << np.uint64(8) | keys & np.uint64(255))
        zeros, ones = (np.bincount(to, x, len(parents)).astype(np.int64) for x in (zeros, ones))
        below = np.bincount(to, log_weighted, len(parents))
        up, keys = to[up], parents
        if depth == TOP:
            break
        log_weighted, own = weigh(zeros, ones, below)
        estimate = (np.where(bit == 1, ones[up], zeros[up]) + 0.5) / (zeros + ones + 1)[up]
        chance = own[up] * estimate + (1 - own[up]) * chance
    rows = pd.DataFrame({
        "context": (keys >> np.uint64(8)).astype(np.int64), "node": (keys & np.uint64(255)).astype(np.int64),
        "zeros": zeros, "ones": ones, "below": below,
    })
    return chance.reshape(-1, 8), rows


def _crown(group: pd.DataFrame) -> pd.DataFrame:
    """Nodes at depth TOP that share the last byte (at most 256^(TOP - 1) contexts): their weights, and the node above.

    Rows (context, node, zeros, ones, own, below, depth): own weight for depth TOP and 1, logs to be summed for depth 0.
    """
    group = group.sort_values(["context", "node"])
    out = []
    keys, zeros, ones, below = (group[c].to_numpy() for c in ("context", "zeros", "ones", "below"))
    node = group["node"].to_numpy()
    for depth in range(TOP, 0, -1):
        log_weighted, own = weigh(zeros, ones, below)
        out.append(pd.DataFrame({"context": keys, "node": node, "zeros": zeros, "ones": ones, "own": own, "depth": depth, "log": log_weighted}))
        above, to = np.unique((keys & ((1 << 8 * (depth - 1)) - 1)) << 8 | node, return_inverse=True)
        zeros, ones = (np.bincount(to, x, len(above)).astype(np.int64) for x in (zeros, ones))
        below = np.bincount(to, log_weighted, len(above))
        keys, node = above >> 8, above & 255
    return pd.concat(out, ignore_index=True)


CROWN = "context bigint, node bigint, zeros bigint, ones bigint, own double, depth bigint, log double"


def top_mixture(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a, b): a decision for 1 at (context of TOP bytes, node) has probability a + b * (that of the tree below)."""
    ends = nodes[nodes["depth"] == 1].groupby("node", as_index=False)[["zeros", "ones", "log"]].sum()
    _, own0 = weigh(ends["zeros"].to_numpy(), ends["ones"].to_numpy(), ends["log"].to_numpy())
    one0 = (ends["ones"] + 0.5) / (ends["zeros"] + ends["ones"] + 1)
    state = pd.DataFrame({"context": 0, "node": ends["node"], "a": own0 * one0, "b": 1 - own0})
    for depth in range(1, TOP + 1):
        level = nodes[nodes["depth"] == depth].copy()
        level["above"] = level["context"] & ((1 << 8 * (depth - 1)) - 1)
        level = level.merge(state.rename(columns={"context": "above"}), on=["above", "node"])
        one = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        state = pd.DataFrame({
            "context": level["context"], "node": level["node"],
            "a": level["a"] + level["b"] * level["own"] * one, "b": level["b"] * (1 - level["own"]),
        })
    keys = (state["context"] * 256 + state["node"]).to_numpy()
    order = np.argsort(keys)
    return keys[order], state["a"].to_numpy()[order], state["b"].to_numpy()[order]


def gram_logs(grams: np.ndarray, chance: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each gram's byte given its context, from its chances below TOP and the mixture above."""
    byte = (grams & np.uint64(255)).astype(np.int64)
    context = ((grams >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1)).astype(np.int64)
    keys, a, b = top
    total = np.zeros(len(grams))
    for step in range(8):
        at = np.searchsorted(keys, context << 8 | (1 << step) | (byte >> (8 - step)))
        taken = (byte >> (7 - step)) & 1
        total += np.log10(np.where(taken == 1, a[at], 1 - b[at] - a[at]) + b[at] * chance[:, step])
    return total


# Jobs --------------------------------------------------------------------------------------------------------------------


def _chunks(parts: int, chunk_bytes: int):
    """mapInPandas function: rows of texts to a row per chunk and a row per chunk, kind and part."""
    names = ["chunk", "kind", "part", "keys", "counts", "texts", "ids", "tokens"]

    def emit(ids: list, texts: list[bytes], held: list[bool]) -> Iterator[pd.DataFrame]:
        import pickle

        import zstandard

        chunk = uuid.uuid4().hex
        flags = np.array(held, bool)
        layout = _Layout(texts, flags)
        rows = []
        for kind in ("grams", "words"):
            keys, counts = layout.tally(kind)
            for part, share in _shares(kind, keys, parts):
                rows.append((chunk, kind, part, _pack_keys(keys[share]), _squeeze(counts[share]), None, None, 0))
        tokens = sum((t.count(b" ") + 1 if t else 0) + 1 for t, h in zip(texts, held, strict=True) if not h)
        blob = zstandard.ZstdCompressor(level=6).compress(b"\n".join(texts))
        rows.append((chunk, "texts", -1, None, None, blob, pickle.dumps((ids, held)), tokens))
        yield pd.DataFrame(rows, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held, size = [], [], [], 0
        for batch in batches:
            for key, text, flag in zip(batch["id"], batch["text"], batch["held"], strict=True):
                data = normalized(text)
                if texts and size + len(data) > chunk_bytes:
                    yield from emit(ids, texts, held)
                    ids, texts, held, size = [], [], [], 0
                ids.append(key)
                texts.append(data)
                held.append(bool(flag))
                size += len(data) + DEPTH
        if texts:
            yield from emit(ids, texts, held)

    return run


CHUNKS = "chunk string, kind string, part int, keys binary, counts binary, texts binary, ids binary, tokens bigint"


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a part, sorted by kind and part, to its merged keys; for grams also the chances and the nodes above.

    What has come in is merged whenever it holds twice the distinct keys, so memory follows these and not the chunks.
    """
    current, keys, counts, size, least = None, [], [], 0, 1 << 20

    def close():
        kind, part = current
        k, n = _merge(keys, counts)
        row = {"kind": kind, "part": part, "keys": _pack_keys(k), "known": int((n > 0).sum())}
        if kind == "words":
            yield pd.DataFrame([row | {"values": _squeeze(n)}])
        else:
            chance, nodes = subtrees(k, n)
            yield pd.DataFrame([row | {"values": _squeeze(chance.astype(np.float32).ravel())}])
            yield nodes.assign(kind="nodes", part=part)

    def shaped(found):
        return found.reindex(columns=["kind", "part", "keys", "known", "values", "context", "node", "zeros", "ones", "below"])

    for batch in batches:
        for kind, part, k, n in batch[["kind", "part", "keys", "counts"]].itertuples(index=False):
            if current != (kind, part):
                if current is not None:
                    yield from map(shaped, close())
                current, keys, counts, size, least = (kind, part), [], [], 0, 1 << 20
            keys.append(_unpack_keys(k))
            counts.append(_spread(n, np.int64))
            size += len(keys[-1])
            if size > least:
                merged = _merge(keys, counts)
                keys, counts, size = [merged[0]], [merged[1]], len(merged[0])
                least = max(least, 2 * size)
    if current is not None:
        yield from map(shaped, close())


GATHERED = (
    "kind string, part int, keys binary, known bigint, values binary, context bigint, node bigint, zeros bigint, "
    "ones bigint, below double"
)


def _answer(top):
    """mapInPandas function: a part's merged row and, after it, the rows of the chunks, to each chunk's values.

    The values of grams are their log10 probabilities, those of words their counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, values = None, None
        for batch in batches:
            rows = []
            for kind, part, chunk, keys, data in batch[["kind", "part", "chunk", "keys", "values"]].itertuples(index=False):
                if data is not None:
                    known = _unpack_keys(keys)
                    if kind == "words":
                        values = _spread(data, np.int64)
                    else:
                        values = gram_logs(known, _spread(data, np.float32).reshape(-1, 8).astype(float), top).astype(np.float32)
                else:
                    rows.append((chunk, kind, part, _squeeze(values[np.searchsorted(known, _unpack_keys(keys))])))
            yield pd.DataFrame(rows, columns=["chunk", "kind", "part", "values"])

    return run


def _score(parts: int, total: int, distinct: int, ends: int, names: list[str]):
    """mapInPandas function: values of a chunk's grams and words and, after them, its texts, to a row for each text."""

    def doc_sums(layout: _Layout, kind: str, shares: dict[int, np.ndarray], *values) -> list[np.ndarray]:
        keys, _ = layout.tally(kind)
        found = np.zeros(len(keys))
        for part, at in _shares(kind, keys, parts):
            found[at] = shares[part]
        sums = [np.zeros(len(layout.starts)) for _ in values]
        for first, last in layout.slices():
            k, owner = getattr(layout, kind)(first, last)
            # Equal keys next to each other make the search local; sums go back to the owners.
            order = np.argsort(k, kind="stable")
            got = found[np.searchsorted(keys, k[order])]
            for total_of, value in zip(sums, values, strict=True):
                total_of += np.bincount(owner[order], value(got), len(layout.starts))
        return sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        import zstandard

        shares: dict[str, dict[int, np.ndarray]] = {"grams": {}, "words": {}}
        scale = np.log10(total + SMOOTHING * (distinct + 1))
        for batch in batches:
            for kind, part, values, texts, ids in batch[["kind", "part", "values", "texts", "ids"]].itertuples(index=False):
                if kind != "texts":
                    shares[kind][part] = _spread(values, np.float32 if kind == "grams" else np.int64)
                    continue
                names_of, held = pickle.loads(ids)
                parts_of = zstandard.ZstdDecompressor().decompress(texts).split(b"\n")
                layout = _Layout(parts_of, np.array(held, bool))
                (score,) = doc_sums(layout, "grams", shares["grams"], lambda x: x)
                base, known, n = doc_sums(
                    layout, "words", shares["words"], lambda c: np.log10(c + SMOOTHING) - scale, lambda c: c > 0, np.ones_like
                )
                shares = {"grams": {}, "words": {}}
                yield pd.DataFrame({
                    names[0]: pd.Series(names_of, dtype=object), "held_out": held, "n_tokens": n.astype(np.int64) + 1,
                    "n_known": known.astype(np.int64) + (ends > 0), "train_tokens": total,
                    "base_score": base + np.log10(ends + SMOOTHING) - scale, "score": score,
                })

    return run


def score_texts(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column; the other rows are learned from. A text is its words, lower-cased (A-Z), with one space between
    them and an end mark. ``score`` is the log10 probability of these bytes by the context trees, each text from an
    empty context; ``base_score`` that of its tokens by smoothed unigram counts.

    Texts are tallied in chunks; a chunk sends its distinct grams and words, counted, to parts by hash, and gets as many values back.
    All grams below a context of three bytes meet in one part as merged counts, however frequent they are. The upper nodes (at
    most 256^2 contexts) go to the driver and back, which bounds them whatever the corpus.

    A null text counts as empty, its only token is the end; null ids are kept; repeated rows are learned from each
    time; without training rows all estimates are at their start (score -log10 2 a bit); an empty table gives an
    empty result; other columns take no part.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held")
    )
    chunks = materialize(slim.mapInPandas(_chunks(parts, chunk_bytes), CHUNKS), "chunks")
    tallied = chunks.where("kind != 'texts'").select("kind", "part", "chunk", "keys", "counts")
    gathered = tallied.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part").mapInPandas(_gather, GATHERED)
    gathered = materialize(gathered, "gathered")
    totals = chunks.where("kind = 'texts'").agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    ends = slim.where(~F.col("held")).count()
    distinct = gathered.where("kind = 'words'").agg(F.coalesce(F.sum("known"), F.lit(0))).head()[0] + (ends > 0)
    nodes = gathered.where("kind = 'nodes'").groupBy("context", "node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")
    )
    crown = nodes.groupBy(F.pmod("context", F.lit(256)).alias("last")).applyInPandas(lambda g: _crown(g), CROWN).toPandas()
    top = top_mixture(crown)

    merged = gathered.where("kind != 'nodes'").select("kind", "part", F.lit("").alias("chunk"), "keys", "values")
    asked = tallied.select("kind", "part", "chunk", "keys", F.lit(None).cast("binary").alias("values"))
    meeting = merged.unionByName(asked).repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", "chunk")
    answers = meeting.mapInPandas(_answer(top), "chunk string, kind string, part int, values binary")
    blobs = chunks.where("kind = 'texts'").select("chunk", "kind", "part", "texts", "ids")
    none = F.lit(None).cast("binary")
    both = answers.select("chunk", "kind", "part", "values", none.alias("texts"), none.alias("ids")).unionByName(
        blobs.select("chunk", "kind", "part", none.alias("values"), "texts", "ids")
    )
    both = both.repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("texts").isNotNull())
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    scored = both.mapInPandas(_score(parts, totals, distinct, ends, schema.names), schema)
    return restored(scored, docs, id_col).withColumnRenamed("id", id_col)
