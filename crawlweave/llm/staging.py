"""Tables written to the shared folder: they cut the lineage and outlive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlweave.durability import shared_folder


#: Has Spark remove a query's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that a Python function gets at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, purpose: str, arrow_rows: int | None = None) -> DataFrame:
    """Write df as Parquet below spark.checkpoint.dir and read it back; nothing else uses the shuffle files of the write.

    With `arrow_rows` its Python functions get that many rows at a time, so that whole texts take little memory on both sides.
    """
    path, conf = shared_folder(df.sparkSession, purpose), df.sparkSession.conf
    wanted = {CLEANUP: "true"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {key: conf.get(key) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have yet, whatever their case."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
