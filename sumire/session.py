"""Session helpers: table access, input parallelism and materialised intermediate tables."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores ahead of a CPU-bound step when the input has fewer splits than the cluster has cores.

    Inputs with enough splits pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine gets a temporary folder, kept in its settings; on a cluster, where
    executors would each see a folder of their own, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sumire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written intermediate tables of one operator call, in the shared folder.

    Writing a table cuts the lineage: a lost executor costs at most the stage that is running. A table written
    under a name replaces the one before it, whose files are deleted once the new one is complete.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """The table written under a name; `by` names columns whose values get folders of their own."""
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def address(self) -> str:
        """The call's folder as a full address, for workers that open files of their own in it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        whole = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return whole if not whole.startswith("file:/") else "file:///" + whole[5:].lstrip("/")

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_work(spark: SparkSession) -> None:
    """Delete every intermediate table in the shared folder, once no result that reads them is still needed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "work-*")) or []:
        fs.delete(status.getPath(), True)


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker of the session, wherever it was started from.

    The package goes as one archive through Spark's own file server, once per session.
    """
    context = spark.sparkContext
    if getattr(context, "_sumire_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="sumire-code-")) / "sumire.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sumire_shipped = True
