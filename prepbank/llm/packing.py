"""Best-fit packing of tokenized documents into sequences, after Martello-Toth dominance reduction."""

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.llm.common import MAX_BUCKETS, number_in_buckets, restored
from prepbank.session import materialize

CAPACITY = 4096
END_ID = 1
# Rows to a bucket of the numbering, over all lengths together.
BUCKET_ROWS = 8192
# Most words a worker keeps the ids of; the memory is emptied beyond.
MAX_WORDS = 1_000_000

# Punctuation that may end a word on the short path, and the separators that Python's split takes for white space and
# the vocabulary does not.
TAIL = ".,;:!?"
SEPARATORS = re.compile("[\x1c-\x1f]|<\\|")
# Below this code point lower case is a matter of single letters.
LATIN_END = "\u0250"
DOTTED_I = "\u0130"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words:
    """A worker's tokenizer, and the ids of the words that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, word: str) -> bytes:
        """Ids of a new word: letters with closing punctuation go to the model piece by piece, all else through the tokenizer."""
        core = word.rstrip(TAIL)
        if core.isalpha() and max(core) < LATIN_END and DOTTED_I not in core:
            found = self._part(core.lower())
            if len(core) < len(word):
                found += self._part(word[len(core) :])
        else:
            found = self.whole(word)
        self.known[word] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            written = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            tokens = [t.id for t in self.model.tokenize(written)]
            found = self.known[part] = struct.pack(f"<{len(tokens)}I", *tokens)
        return found

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers.

        The vocabulary drops white space and never joins across it, so the ids of a text are those of its words one
        after the other. Texts with a special token's string or an odd separator are encoded in one go.
        """
        if SEPARATORS.search(text):
            return self.whole(text)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        get, learn = self.known.get, self.learn
        return b"".join([get(w) or learn(w) for w in text.split()])


def _words(path: str) -> _Words:
    """One for each worker process and tokenizer; functions are sent anew with each task, so it hangs on the library."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_words_by_path", {})
    if path not in kept:
        kept[path] = _Words(path)
    return kept[path]


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids and an end id, cut only beyond ``capacity``.

    ``ids`` adds the ids themselves, as little-endian unsigned 32-bit integers. A null text counts as empty.
    """
    fields = [T.StructField("id", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("piece", "start", "length", "ids_crc32")]]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = _words(tokenizer_path).ids
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                data = ids_of(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] * ids)))
            yield pd.DataFrame(rows, columns=schema.names)

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return restored(slim.mapInPandas(cut, schema), docs, id_col)


class _Plan:
    """Patterns of bins over a histogram of sizes; its size depends on the capacity, not on the number of items."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.bins = 0

    def use(self, size: int, n: int) -> int:
        """Take the next n items of a size; the rank of the first."""
        first = self.taken[size]
        self.taken[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first

    def put(self, size: int, copies: int, base: int, bins: int, offset: int) -> None:
        """``copies`` items of a size into each of ``bins`` bins from ``base`` on, at ``offset``."""
        first = self.use(size, copies * bins)
        self.rows.append((size, first, first + copies * bins, base, offset, copies))

    def fix(self, sizes: list[int], bins: int) -> None:
        """``bins`` bins that hold one item of each of the sizes, for good."""
        offset = 0
        for size in sizes:
            self.put(size, 1, self.bins, bins, offset)
            offset += size
        self.bins += bins


def _times(left: dict[int, int], sizes: list[int]) -> int:
    """How often the set of sizes can be taken."""
    return min(left.get(s, 0) // sizes.count(s) for s in set(sizes))


def _dominating(plan: _Plan, j: int, capacity: int) -> list[int] | None:
    """A set with one item of size j that dominates every other feasible set with it, of at most three items, or None.

    A set dominates another if the other's items can be split into groups that each fit under an item of the set.
    """
    left, sizes = plan.left, plan.sizes
    room = capacity - j

    def largest(limit: int, *used: int) -> int | None:
        """Largest size up to the limit of which an item is left besides j and those used."""
        at = bisect.bisect_right(sizes, limit) - 1
        while at >= 0 and left[sizes[at]] <= (sizes[at] == j) + used.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else None

    a = largest(room)
    if a is None:
        return [j]
    if a == room:
        return [j, a]
    small = []
    for s in sizes:
        small += [s] * min(left[s] - (s == j), 3 - len(small))
        if len(small) >= 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return [j, a]
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two more items fit. The best pair under a room has its larger item at most a.
    best, lesser = 0, 0
    at = bisect.bisect_right(sizes, a) - 1
    while at >= 0 and 2 * sizes[at] > best:
        x = sizes[at]
        at -= 1
        if left[x] <= (x == j):
            continue
        y = largest(min(x, room - x), x)
        if y is not None:
            best, lesser = max(best, x + y), max(lesser, y)
    if a >= best:
        return [j, a]
    b = largest(min(a, room - a), a)
    if b is not None and b >= lesser:
        return [j, a, b]
    return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows (size, from_rank, to_rank, base, offset, copies) and the number of bins.

    Item of rank r of a size, from_rank <= r < to_rank, goes to bin base + (r - from_rank) div copies, at
    offset + size * ((r - from_rank) mod copies). First, sets that provably dominate all others with their largest
    item are fixed, as often as they can be, until none is left (Martello and Toth's reduction); then the
    rest goes by best fit, sizes descending. All steps work on counts, so they do not grow with the items.
    """
    plan = _Plan(counts)
    while True:
        fixed = False
        for j in sorted(plan.left, reverse=True):
            while j in plan.left:
                found = _dominating(plan, j, capacity)
                if found is None:
                    break
                plan.fix(found, _times(plan.left, found))
                fixed = True
        if not fixed:
            break
    # Open bins by the room left in them: room -> list of (base, bins).
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, base: int, bins: int) -> None:
        if room and bins:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((base, bins))

    for size in sorted(plan.left, reverse=True):
        while (n := plan.left.get(size, 0)):
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                base, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, base = capacity, plan.bins
                bins = -(-n // (capacity // size))
                plan.bins += bins
            copies = room // size
            full = min(bins, n // copies)
            if full:
                plan.put(size, copies, base, full, capacity - room)
                leave(room - copies * size, base, full)
            rest = n - full * copies
            if full < bins and 0 < rest < copies:
                plan.put(size, rest, base + full, 1, capacity - room)
                leave(room - rest * size, base + full, 1)
                full += 1
            leave(room, base + full, bins - full)
    return plan.rows, plan.bins


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Only the histogram of lengths, at most ``capacity`` rows, comes to the driver, and the plan sent back is of a size
    that the capacity bounds. Pieces are numbered within their length over buckets, so a length that many pieces
    share meets in no single task.

    A null or empty text is a piece with the end id alone; null ids are kept; repeated rows are packed each; a text
    of any length is cut into pieces of ``capacity``; an empty table gives an empty result; other columns take no part.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, id_col, text_col, ids), "pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(rows, "p_length bigint, lo bigint, hi bigint, base bigint, at bigint, copies bigint")
    buckets = F.lit(min(MAX_BUCKETS, max(1, -(-sum(histogram.values()) // bucket_rows))))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), buckets))
    ranked = number_in_buckets(spread, ["length"], "bucket", ["id", "piece", "ids_crc32"], "rank")
    found = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(plan), found)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(nth / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
        *(["ids"] * ids),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids) from a packing with ids: each sequence's ids as little-endian unsigned 32-bit integers.

    A sequence holds at most the capacity's ids, so its group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["ids"]), "")).alias("ids"))
