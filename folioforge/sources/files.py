"""Reading and writing document files: Markdown, page JSON, chunk JSON lines, binary files; filters by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import text as X
from folioforge.runtime import ship

PAGES = T.ArrayType(T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))
CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])
#: Suffix of a loader, and the format it reads; longer suffixes are looked for first.
LOADERS = {".pages.json": "pages_json", ".md": "markdown"}


def loader_for(path: str) -> str:
    """Format of a path by its suffix."""
    for suffix in sorted(LOADERS, key=len, reverse=True):
        if path.endswith(suffix):
            return LOADERS[suffix]
    raise ValueError(f"no loader for {path}")


def _whole(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, source_path, format) of every .md file below a folder."""
    return _whole(spark, folder, "*.md").select(X.stem(F.col("source_path")).alias("name"), F.col("value").alias("content"), "source_path", F.lit("markdown").alias("format"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(name, source_path, page_number, text) of every .pages.json file; unreadable files have no rows."""
    parsed = _whole(spark, folder, "*.pages.json").select("source_path", F.explode(F.from_json("value", PAGES)).alias("p"))
    name = F.regexp_replace(X.file_name(F.col("source_path")), r"\.pages\.json$", "")
    return parsed.select(name.alias("name"), "source_path", "p.page_number", "p.text")


def page_documents(pages_frame: DataFrame) -> DataFrame:
    """Documents of pages: texts that aren't empty, in page order, parted by blank lines."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t"))))
    filled = F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != "")
    return pages_frame.groupBy("name", "source_path").agg(F.array_join(filled, "\n\n").alias("content"), F.lit("pages_json").alias("format"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents below a folder; where a name exists in both formats, the pages win."""
    both = markdown(spark, folder).unionByName(page_documents(pages(spark, folder)))
    order = Window.partitionBy("name").orderBy(F.desc("format"), "source_path")
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of JSON lines; a line that can't be read is kept in _corrupt_record."""
    return spark.read.schema(CHUNK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size_bytes) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def parsed(spark: SparkSession, folder: str, pattern: str, parser, schema: str) -> DataFrame:
    """Pages of binary files by a parser: (path, bytes) -> rows of the schema; the seam for PDF and other formats.

    A file that fails gives one row with its error, so the schema needs path and error.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    fields = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows += [{"path": path, "error": None, **page} for page in parser(path, content)]
                except Exception as error:  # noqa: BLE001
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def within(frame: DataFrame, sources: DataFrame, column: str = "source_path") -> DataFrame:
    """Rows whose source is in a list."""
    return frame.join(sources.select(column).distinct(), column, "left_semi")


def write(frame: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None) -> None:
    """Write a table; partitions named in ``by`` are replaced one by one."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).format(format).save(path)
