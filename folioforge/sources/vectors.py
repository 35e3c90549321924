"""A vector collection as a table: create, upsert, delete and count by source, info."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.runtime import cut


class Collection:
    """Rows (chunk_id, source, text, embedding) in folders of one version each; the newest version is current.

    Writers make a new version from the last and then name it, so readers never see half of one.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the newest whole version, 0 without any."""
        system, path = self._files()
        if not system.exists(path):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(path) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self) -> DataFrame | None:
        """Current rows, or None if the collection doesn't exist."""
        now = self.version()
        return self.spark.read.parquet(f"{self.folder}/v{now}") if now else None

    def _write(self, frame: DataFrame) -> int:
        version = self.version() + 1
        frame.write.parquet(f"{self.folder}/v{version}")
        return version

    def create(self, rows: DataFrame, recreate: bool = False) -> int:
        """First version; an existing collection is kept unless it is to be made anew."""
        if self.version() and not recreate:
            raise ValueError("the collection exists")
        return self._write(rows)

    def upsert(self, rows: DataFrame) -> int:
        """Add rows; those with a known chunk_id replace it."""
        now = self.read()
        if now is None:
            return self._write(rows)
        both = now.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        latest = Window.partitionBy("chunk_id").orderBy(F.desc("_new"))
        return self._write(both.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_new"))

    def delete_source(self, source: str) -> int:
        """Remove the rows of a source."""
        now = self.read()
        return self.version() if now is None else self._write(now.where(~F.col("source").eqNullSafe(source)))

    def replace_source(self, source: str, rows: DataFrame) -> int:
        """Remove the rows of a source and add others in one version."""
        now = self.read()
        return self._write(rows if now is None else now.where(~F.col("source").eqNullSafe(source)).unionByName(rows))

    def scroll(self, source: str, after: str | None = None, limit: int = 100) -> list:
        """The next rows of a source in the order of their chunk_id, at most ``limit``, after the one named."""
        now = self.read()
        if now is None:
            return []
        own = now.where(F.col("source") == source)
        own = own if after is None else own.where(F.col("chunk_id") > after)
        return own.orderBy("chunk_id").limit(limit).collect()

    def index(self, chunks: DataFrame, embed) -> int:
        """Write chunks with the vectors that ``embed`` gives them; refused if any chunk has none."""
        rows = cut(embed(chunks))
        if rows.where(F.col("embedding").isNotNull()).count() != chunks.count():
            raise ValueError("chunks and vectors differ in number")
        return self.upsert(rows)

    def count(self, source: str | None = None) -> int:
        """Rows, of one source if named."""
        now = self.read()
        return 0 if now is None else (now if source is None else now.where(F.col("source") == source)).count()

    def info(self) -> dict | None:
        """Number of points and status, or None."""
        return {"points": self.count(), "version": self.version(), "status": "ready"} if self.version() else None


class KeyedTable(Collection):
    """A small table by key in versions: sessions, experiences, pointers from names to folders."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        super().__init__(spark, folder)
        self.key, self.schema = key, schema

    def put(self, rows: list[tuple]) -> int:
        """Add rows; those with a known key replace it."""
        new = self.spark.createDataFrame(rows, self.schema)
        now = self.read()
        return self._write(new if now is None else now.join(new, self.key, "left_anti").select(*new.columns).unionByName(new))

    def get(self, key):
        """The row of a key, or None."""
        now = self.read()
        return None if now is None else now.where(F.col(self.key) == key).first()

    def remove(self, key) -> int:
        """Drop the row of a key."""
        now = self.read()
        return self.version() if now is None else self._write(now.where(~F.col(self.key).eqNullSafe(key)))


class Pointers(KeyedTable):
    """Names that stand for folders; a name whose folder is gone resolves to None."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder, "name", "name string, path string")

    def resolve(self, name: str) -> str | None:
        """The folder of a name if it exists."""
        row = self.get(name)
        if row is None:
            return None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        return row["path"] if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else None
