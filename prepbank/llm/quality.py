"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks against bands by length."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.llm.common import restored

# (from bytes, lowest ratio, highest ratio) of a whole document; shorter ones say nothing. Ratios fall with the length.
BANDS = (
    (64, 0.30, 1.60),
    (256, 0.48, 0.82),
    (512, 0.46, 0.75),
    (1024, 0.43, 0.66),
    (4096, 0.40, 0.58),
    (16384, 0.38, 0.55),
    (65536, 0.35, 0.55),
)
# Bytes of a chunk (the last one is up to twice that, so no byte is left out) and the band of a chunk's ratio.
CHUNK = 1024
CHUNK_BAND = (0.40, 0.64)
# A document goes if more than this share of its chunks' bytes lies outside the band.
CHUNK_SHARE = 0.15
LEVEL = 3
MIN_WORDS = 50

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    w = np.fromiter((codes.setdefault(x, len(codes)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(codes) + w[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(codes) + w[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(twice)] |= twice
    return int(inside.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its UTF-8 bytes."""
    words = data.split()
    white = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(words)


def band_of(n: int, bands=BANDS) -> tuple[float, float]:
    """Lowest and highest ratio of a whole document of n bytes."""
    return next(((low, high) for least, low, high in reversed(bands) if n >= least), (0.0, float("inf")))


def chunk_share(data: bytes, compressed, chunk: int, band: tuple[float, float]) -> float:
    """Share of the chunks' bytes whose own ratio lies outside the band; 0 for a document shorter than a chunk.

    What is left behind the last whole chunk is judged together with it.
    """
    outside = 0
    for i in range(len(data) // chunk):
        part = data[i * chunk : (i + 1) * chunk] if (i + 2) * chunk <= len(data) else data[i * chunk :]
        outside += len(part) * (not band[0] <= len(compressed(part)) / len(part) <= band[1])
    return outside / len(data) if len(data) >= chunk else 0.0


FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("ratio", T.DoubleType()),
    ("outside_share", T.DoubleType()), ("kept", T.BooleanType()), ("rejected_by", T.StringType()),
)


def compression_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands=BANDS,
    chunk: int = CHUNK,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    share: float = CHUNK_SHARE,
) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, ratio, outside_share, kept and rejected_by (the first rule that a
    document fails: ``base``, ``low ratio``, ``high ratio`` or ``chunks``; null if it is kept).

    A document fails the base if it has under 50 words or over half of them lie in repeated 3-word windows. Of the
    others those are kept whose whole text compresses within the band of its length, and of which not more than
    ``share`` lies in chunks outside the chunks' band. There is no shuffle; a task holds one Arrow batch.

    A null or empty text has no words, ratio null and fails the base; null ids and repeated rows are kept as they
    are; texts of any length are read whole; an empty table gives an empty result; other columns take no part.
    """
    schema = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(*f) for f in FIELDS]])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressed = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                data = text.encode()
                counts = base_counts(text, data)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
                ratio = len(compressed(data)) / len(data) if data else None
                outside = chunk_share(data, compressed, chunk, chunk_band)
                low, high = band_of(len(data), bands)
                rule = "base" if failed else "low ratio" if ratio < low else "high ratio" if ratio > high else "chunks" if outside > share else None
                rows.append((key, *counts, failed, ratio, outside, rule is None, rule))
            yield pd.DataFrame(rows, columns=schema.names)

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return restored(slim.mapInPandas(judge, schema), docs, id_col).withColumnRenamed("id", id_col)
