"""The folder that all executors share, tables written there to cut lineage, and the workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of each application on a single machine.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one on a single machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="granary-shared-")
        path = _own[app]
    return path.rstrip("/")


class Scratch:
    """Paths of intermediate tables, and which of them a result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, *tables: DataFrame) -> None:
        """These written tables stay when the scratch ends."""
        self.kept.update(t.granary_path for t in tables)


_open: list[Scratch] = []
#: Tables that results handed out still read; :func:`sweep` removes them.
_left: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end, after an error too, but for those that are kept.

    Kept ones go to the scratch around this one, or else stay until :func:`sweep`.
    """
    own = Scratch(spark)
    _open.append(own)
    done = False
    try:
        yield own
        done = True
    finally:
        _open.remove(own)
        for path in own.paths:
            if done and path in own.kept:
                (_open[-1].paths if _open else _left).append(path)
            else:
                remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Remove the intermediate tables of all results handed out so far, which cannot be read any more then."""
    while _left:
        remove(spark, _left.pop())


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an intermediate table."""
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    (_open[-1].paths if _open else _left).append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor depend on one executor."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.granary_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def on_workers_path(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder that the driver runs it from, if they see that folder.

    On a cluster the package is installed on the executors and this changes nothing.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *([path] if path else [])])
