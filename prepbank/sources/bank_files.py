"""Bank files, retrieval index, page scans, file listings and JSON output."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prepbank import fixed
from prepbank.functions.jsons import is_object, parse_json, text_field
from prepbank.functions.text import file_kind, strip
from prepbank.operators.ordering import MAX_GROUP_BYTES, MAX_GROUP_ROWS, attach, number_rows, text_parts
from prepbank.sources.ledger import Files, Ledger, new_batch

# Errors that say that nothing was written at a path yet.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# ---- JSON lines -------------------------------------------------------------------------------


def line_ids(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their physical number from 0, in the order of file name and position.

    Lines keep the split they were read in; only the splits' line counts are summed up, one row per split,
    a table no longer than the list of splits that the driver holds anyway.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = lines.groupBy("_file", "_split").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    ahead = W.orderBy("_file", "_split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_file", "_split", "_from", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    # Every line has its split, once: where the numbers are not read, Spark leaves out the join and with it the count.
    joined = lines.join(F.broadcast(splits.dropDuplicates(["_file", "_split"])), ["_file", "_split"], "left")
    return joined.select((F.col("_ahead") + F.col("_at") - F.col("_from")).alias("line_no"), "value")


def _bank_fields(v: Column) -> list[Column]:
    defaults = {"role": "", "type": fixed.DEFAULT_TYPE, "question": "", "model_answer": ""}
    given = [F.coalesce(text_field(v, name), F.lit(value)).alias(name) for name, value in defaults.items()]
    optional = [text_field(v, n).alias(n) for n in ("category", "answer_strategy", "difficulty", "experience")]
    return [*given, *optional, F.try_variant_get(v, "$.tags", "array<string>").alias("tags")]


def parse_bank(lines: DataFrame) -> DataFrame:
    """Bank rows of numbered JSON lines; blank and malformed lines (no JSON object) are left out.

    Other lines go in the explode, so every line is parsed once, not in a filter and again after it.
    """
    objects = F.filter(F.array(parse_json(F.col("value"))), is_object)
    good = lines.where(F.length(strip(F.col("value"))) > 0).select("line_no", F.explode(objects).alias("_v"))
    row_id = F.concat(F.lit("q_"), F.col("line_no").cast("string"))
    return good.select(row_id.alias("id"), "line_no", *_bank_fields(F.col("_v")))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Bank rows of a JSONL file or folder, ids ``q_<line number>``."""
    return parse_bank(line_ids(spark, path))


def write_bank(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def append_bank(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append rows to a bank folder. ``batch`` names the append: one that is there already returns False and adds nothing.

    Rows are written beside the bank, unseen by its readers, and moved into it as one folder. Appends are numbered in the order in
    which they are claimed, so their lines, and the ids that follow from these, come after those of the appends before.
    """
    spark = df.sparkSession
    batch = new_batch() if batch is None else batch
    files = Files(spark, path)
    no = Ledger(spark, f"{path.rstrip('/')}/_ledger").claim(batch, 1)
    name = f"part-append-{no:012d}"
    if files.exists(name):
        return False
    draft = f"_draft-{new_batch()}"
    df.write.option("encoding", "UTF-8").json(f"{path.rstrip('/')}/{draft}")
    return files.move(draft, name)


# ---- index ---------------------------------------------------------------------------------------


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None only where there is no such path, or an empty folder."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ABSENT:
            raise
        return None


def load_index(rows: DataFrame | None, path: str, max_records_per_file: int = 1_000_000) -> bool:
    """Write the index once, by role; False and no change when it already holds rows or there are none to load.

    A role's rows are gathered before the write, a hot role over several tasks, so files stay few and even. They are written beside the
    path and moved to it in one step, so an index is there whole or not at all.
    """
    if rows is None:
        return False
    found = _existing(rows.sparkSession, path)
    if found is not None and not found.isEmpty():
        return False
    spread = rows.hint("rebalance", "role")
    parent, _, name = path.rstrip("/").rpartition("/")
    draft, files = f"_draft-{new_batch()}", Files(rows.sparkSession, parent)
    spread.write.partitionBy("role").option("maxRecordsPerFile", max_records_per_file).parquet(f"{parent}/{draft}")
    if found is not None or files.exists(name):
        files.drop(name)
    return files.move(draft, name)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with its roles as written: texts, '' where a row has none. Filters on the role prune folders."""
    stored = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "role" else f.dataType) for f in stored])
    return spark.read.schema(schema).parquet(path).withColumn("role", F.coalesce("role", F.lit("")))


def bank_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a bank file, or None when there is no such file."""
    try:
        return read_bank(spark, path)
    except AnalysisException as error:
        if error.getCondition() not in ABSENT:
            raise
        return None


# ---- pages, uploads, output ---------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of uploaded files, routed by extension. File contents are not read."""
    return route_files(spark.read.format("binaryFile").load(path).select("path", "length"))


def route_files(files: DataFrame) -> DataFrame:
    kind = file_kind(F.col("path"))
    message = F.when(kind == "unsupported", fixed.UNSUPPORTED_FILE)
    return files.withColumn("kind", kind).withColumn("message", message)


def text_lines(
    parts: DataFrame, key: str, order: str, text: str, max_group_rows: int | None = MAX_GROUP_ROWS,
    max_group_bytes: int = MAX_GROUP_BYTES,
) -> DataFrame:
    """Text of each key as rows ``<key>, line_no, <text>``, one per part: joined with newlines they are its parts in order,
    a newline after each, stripped as a whole."""
    kept = _stripped(parts, key, order, text, max_group_bytes)
    numbered = number_rows(kept, [key], [F.col(order)], "line_no", max_group_rows=max_group_rows)
    return numbered.select(key, "line_no", text)


def assemble_text(
    parts: DataFrame, key: str, order: str, text: str, part_bytes: int, max_group_bytes: int = MAX_GROUP_BYTES
) -> DataFrame:
    """``text_lines`` joined to texts, in pieces of about ``part_bytes``: the pieces by ``part_no``, joined with newlines,
    are the whole text."""
    kept = _stripped(parts, key, order, text, max_group_bytes)
    return text_parts(kept, [key], [F.col(order)], text, part_bytes, max_group_bytes).drop("_first", "_last")


def _stripped(parts, key, order, text, max_group_bytes):
    parts = parts.select(key, order, F.coalesce(text, F.lit("")).alias(text))
    filled = F.when(F.length(strip(F.col(text))) > 0, F.col(order))
    span = {"_begin": F.min(filled), "_end": F.max(filled), "_least": F.min(order)}
    kept = attach(parts, [key], span, max_group_bytes, F.octet_length(text).cast("bigint") + 1)
    kept = kept.withColumns({n: F.coalesce(n, "_least") for n in ("_begin", "_end")})
    # blank parts at either end vanish in the strip
    kept = kept.where(F.col(order).between(F.col("_begin"), F.col("_end")))
    white = F.lit(fixed.WHITESPACE)
    trimmed = F.when(F.col(order) == F.col("_begin"), F.ltrim(F.col(text), white)).otherwise(F.col(text))
    trimmed = F.when(F.col(order) == F.col("_end"), F.rtrim(trimmed, white)).otherwise(trimmed)
    return kept.select(key, order, trimmed.alias(text))


def to_payload(df: DataFrame, *keep: str, out: str = "payload") -> DataFrame:
    """Rows as JSON objects of all columns but ``keep``, which stay beside them."""
    fields = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*fields)).alias(out))
