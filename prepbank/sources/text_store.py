"""Long texts by handle: written once to the shared folder, and read again where they are shown.

A text that many rows show would go through each shuffle of these rows, once for every one of them. A handle (file, place in it, bytes
there, bytes of the text) goes in its stead. Tasks write and read files through ``pyarrow.fs`` by the URI of the shared folder (file, hdfs,
s3, gs). A task that is run again writes a file of its own; only files named by the handles that were kept are ever read.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.session import fresh_path, materialize

HANDLE = T.StructType([
    T.StructField("file", T.LongType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType()), T.StructField("raw", T.LongType())
])
# Bytes of texts that a task fills in, and that it holds at a time.
TASK_BYTES = 64 << 20
HELD_BYTES = 16 << 20
# Most partitions of rows to fill in.
MAX_PARTS = 100_000
# Texts of a file that lie no further apart are read together, up to so many bytes; files that a task keeps open.
GAP_BYTES = 16 << 10
SPAN_BYTES = 4 << 20
OPEN_FILES = 256


def _filesystem(uri: str):
    from pyarrow import fs

    # Hadoop writes local paths with one slash, and not encoded
    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


class TextStore:
    """A folder of texts (``folder``, a full URI)."""

    def __init__(self, folder: str):
        self.folder = folder

    @classmethod
    def new(cls, spark: SparkSession) -> "TextStore | None":
        """A store in the shared folder, or None where that is of a kind that only Spark reads."""
        path = spark._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "texts"))
        uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        try:
            filesystem, at = _filesystem(uri)
            filesystem.create_dir(at)
        except (pa.ArrowException, OSError):
            return None
        return cls(uri)

    def put(self, rows: DataFrame, text: str) -> DataFrame:
        """The rows with handles in place of the texts; null for null."""
        folder = self.folder
        rows = rows.withColumn(text, F.col(text).cast("string"))
        place = rows.columns.index(text)
        schema = T.StructType([T.StructField(text, HANDLE) if f.name == text else f for f in rows.schema])

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filesystem, at = _filesystem(folder)
            file, end, codec, out = TaskContext.get().taskAttemptId(), 0, _codec(), None
            try:
                for batch in batches:
                    handles = []
                    for x in batch.column(place).cast(pa.large_binary()):
                        if not x.is_valid:
                            handles.append(None)
                            continue
                        raw = x.as_buffer()
                        packed = codec.compress(raw)
                        out = out or filesystem.open_output_stream(f"{at}/{file}", buffer_size=1 << 20)
                        out.write(packed)
                        handles.append({"file": file, "at": end, "size": packed.size, "raw": raw.size})
                        end += packed.size
                    columns = batch.columns
                    columns[place] = pa.array(handles, pa.struct([(f.name, pa.int64()) for f in HANDLE]))
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            finally:
                if out is not None:
                    out.close()

        return materialize(rows.mapInArrow(written, schema), "handles")

    def get(self, rows: DataFrame, handles: Column, out: str) -> DataFrame:
        """The rows with an array ``out`` of the texts that an array of handles stands for, null for null.

        Rows go to as many tasks as their texts take, and a task holds a bounded part of these.
        """
        folder = self.folder
        rows = materialize(rows.withColumn(out, handles), "shown")
        total = rows.select(F.aggregate(out, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["raw"], F.lit(0))).alias("raw")).agg(F.sum("raw")).head()[0]
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(MAX_PARTS, -(-(total or 0) // TASK_BYTES)))
        place = rows.columns.index(out)
        schema = T.StructType([*rows.schema[:place], T.StructField(out, T.ArrayType(T.StringType()))])

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filesystem, at = _filesystem(folder)
            opened = lru_cache(OPEN_FILES)(lambda file: filesystem.open_input_file(f"{at}/{file}"))
            codec = _codec()
            for batch in batches:
                for some in _held(batch, place):
                    listed = some.column(place)
                    texts = _read(listed.flatten(), opened, codec)
                    columns = some.columns
                    columns[place] = _lists(listed, texts)
                    yield pa.RecordBatch.from_arrays(columns, names=some.schema.names)

        return rows.repartition(parts).mapInArrow(filled, schema)


def _held(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are of HELD_BYTES together, or one row of more."""
    listed = batch.column(place)
    each = _numbers(listed.flatten(), "raw")
    ends = np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
    ahead = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends]).astype(np.int64)]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ahead, ahead[start] + HELD_BYTES, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _numbers(handles: pa.StructArray, name: str) -> np.ndarray:
    return pc.fill_null(pc.struct_field(handles, name), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _read(handles: pa.StructArray, opened, codec: pa.Codec) -> pa.Array:
    """The texts of handles; each of them is read once, neighbours together."""
    file, at, size, raw = (_numbers(handles, f.name) for f in HANDLE)
    known = np.flatnonzero(pc.is_valid(pc.struct_field(handles, "file")).to_numpy(zero_copy_only=False))
    order = known[np.lexsort((at[known], file[known]))]
    placed = list(zip(order.tolist(), *(x[order].tolist() for x in (file, at, size, raw)), strict=True))
    texts: list[bytes | None] = [None] * len(handles)
    low = 0
    while low < len(placed):
        _, number, begin, length, _ = placed[low]
        end, high = begin + length, low + 1
        while high < len(placed):
            _, other, place, length, _ = placed[high]
            if other != number or place > end + GAP_BYTES or place + length > begin + SPAN_BYTES:
                break
            end, high = max(end, place + length), high + 1
        data = memoryview(opened(number).read_at(end - begin, begin))
        last, text = None, None
        for x, _, place, length, whole in placed[low:high]:
            if place != last:
                last, text = place, codec.decompress(data[place - begin : place - begin + length], whole, asbytes=True)
            texts[x] = text
        low = high
    # a view takes the bytes as they are
    return pa.array(texts, pa.binary()).view(pa.string())


def _lists(listed: pa.ListArray, texts: pa.Array) -> pa.ListArray:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    none = pc.is_null(listed)
    return pa.ListArray.from_arrays(offsets, texts, mask=none) if none.true_count else pa.ListArray.from_arrays(offsets, texts)
