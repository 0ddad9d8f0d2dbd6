"""Refresh of the index as a stream of new or changed documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lawloom.operators.index import HashEmbedder, embed_chunks, upsert
from lawloom.operators.validate import check


class IndexTable:
    """An index kept as numbered Parquet versions below one path; the newest whole version counts."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(base):
            return []
        found = [f.getPath() for f in system.listStatus(base)]
        done = [p for p in found if p.getName().startswith("v") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def read_all(self) -> DataFrame | None:
        """The rows of all versions, for a table that only grows (see ``append``)."""
        versions = self._versions()
        return self.spark.read.parquet(*[f"{self.path}/v{v}" for v in versions]) if versions else None

    def append(self, rows: DataFrame, version: int) -> None:
        """Add rows as a version of their own; writing the same version again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def next_version(self) -> int:
        versions = self._versions()
        return versions[-1] + 1 if versions else 0

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self.next_version()}")

    def clear(self) -> None:
        """Begin anew with an empty version; older ones stay on disk but no longer count."""
        found = self.read()
        if found is not None:
            self.write(found.limit(0))


def refresh(documents: DataFrame, build: Callable[[DataFrame], DataFrame], table: IndexTable, checkpoint: str, embedder: HashEmbedder | None = None) -> StreamingQuery:
    """Each batch of documents becomes chunks (``build``), is checked, embedded where its texts are new, and merged.

    Runs over what is there and ends. A batch that fails the check stops the query before the index is touched.
    """
    own = embedder or HashEmbedder()
    cache = IndexTable(table.spark, f"{table.path}-vectors")

    def merge(batch: DataFrame, number: int) -> None:
        chunks = build(batch)
        check(chunks)
        known = cache.read_all()
        known = known if known is not None else batch.sparkSession.createDataFrame([], "h string, v array<float>")
        embedded, new = embed_chunks(chunks, known, own)
        # Only new vectors are written, before the index that needs them.
        cache.append(new, number)
        index = table.read()
        table.write(embedded if index is None else upsert(index, embedded))

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
