"""What a run keeps between its steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..sources import io


class Job:
    """Owns the tables that several steps of a run read, in a folder of its own within the session's shared one.

    Nothing is written before a step asks for it. Each step has a name; a job that is given the ``folder`` of one that was
    broken off goes on after the last step that had ended. close(), or the end of a ``with`` block that ends well, deletes
    the folder; whatever is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.steps = spark, []
        #: Of each step that was measured, what was asked of its rows.
        self.sizes: dict[str, dict] = {}
        self.folder = folder or f"{io.shared_folder(spark)}/job-{uuid.uuid4().hex}"
        if folder is None:
            io.delete_on_exit(spark, self.folder)

    def kept(self, name: str, table: DataFrame, **measures: Column) -> DataFrame:
        """``table``, written once for all steps that read it; ``measures`` are aggregates taken on the way, for ``sizes``."""
        if name in self.steps:
            raise ValueError(f"a step {name} has been made already")
        path = f"{self.folder}/{name}"
        if not io.exists(self.spark, f"{path}/_SUCCESS"):
            seen = Observation(name)
            measured = table.observe(seen, *(c.alias(k) for k, c in measures.items())) if measures else table
            measured.write.mode("overwrite").parquet(path)
            if measures:
                self.sizes[name] = seen.get
        self.steps.append(name)
        return self.spark.read.schema(table.schema).parquet(path)

    def result(self, table: DataFrame) -> DataFrame:
        """``table`` written by itself, for whoever reads it after the job's end; it goes when the application ends."""
        return io.stored(table)

    def close(self) -> None:
        io.delete(self.spark, self.folder)

    def __enter__(self) -> Job:
        return self

    def __exit__(self, kind: type | None, *error: object) -> None:
        if kind is None:
            self.close()
