"""``materialize``: write an intermediate result once, read it many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="logloom-")
    return _own_folder[app]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for each use; the scratch folder's owner cleans up."""
    return f"{scratch_folder(spark)}/logloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The same rows read back from a written table.

    Unlike ``checkpoint()`` the table is columnar, so later reads take only the
    columns they need; like it, lineage ends here and lost executors cost a
    re-read instead of a recomputation.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
