"""Work tables that cut lineage through the shared folder of the cluster.

Iterative operators and operators that use one intermediate result several times
write it as Parquet below ``spark.checkpoint.dir`` and read it back.  Such a table
survives the loss of executors, is compact, and tells the optimizer its size.
``cached`` keeps a table by the fingerprint of its parameters and input files, so
queries of one session build it once.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []
_CACHED: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine, where that is unset, one of our own.

    A cluster needs the setting: a folder of our own would be another one on every machine,
    and tables read back from it would lack rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="spark-pairlens-")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _drop_left() -> None:
    for spark, path in _LEFT:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass


class WorkTables:
    """Work tables of one operator run, each in a folder of its own.

    ``save`` replaces a frame by its written copy; ``drop`` deletes a copy that no later
    step reads.  Whatever is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pairlens-{purpose}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _LEFT.append((spark, self.root))

    def save(self, df: DataFrame, name: str = "t", dictionary: bool = True) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written copy.

        Without ``dictionary`` values are written as they are: arrays of floats have few equal
        ones, and looking each up costs many times the rest of the writing.
        """
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        copy = self.spark.read.schema(df.schema).parquet(path)
        copy._work_path = path
        return copy

    def drop(self, df: DataFrame) -> None:
        """Delete a copy made by ``save``."""
        path = getattr(df, "_work_path", None)
        if path:
            _delete(self.spark, path)

    def clear(self) -> None:
        """Delete all copies that were saved so far."""
        _delete(self.spark, self.root)

    def free(self) -> None:
        """Have Spark delete the shuffle files of frames that nothing refers to any more.

        It does so only once the driver's garbage is collected, which may be long after.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def fingerprint(spark: SparkSession, name: str, inputs: Sequence[str], **parameters) -> str:
    """Hash of a name, all parameters, and every input file's path, length and time of change.

    The files are listed and hashed by Spark without being read; one row reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    state = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return hashlib.sha256(json.dumps([name, list(inputs), state["n"], state["h"], parameters], sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], **parameters) -> DataFrame:
    """The written table of ``build``, made once for a fingerprint of name, parameters and inputs.

    A changed input file or parameter gives another fingerprint and a table of its own.
    Tables are deleted when the driver ends, or by ``drop_cached``.
    """
    key = spark.sparkContext.applicationId, fingerprint(spark, name, inputs, **parameters)
    if key not in _CACHED:
        df = build()
        path = f"{shared_dir(spark)}/pairlens-{name}-{key[1]}-{uuid.uuid4().hex[:6]}"
        _LEFT.append((spark, path))
        df.write.parquet(path)
        _CACHED[key] = path, df.schema
    path, schema = _CACHED[key]
    return spark.read.schema(schema).parquet(path)


def drop_cached(spark: SparkSession) -> None:
    """Delete all tables that ``cached`` keeps for this session."""
    for key in [k for k in _CACHED if k[0] == spark.sparkContext.applicationId]:
        _delete(spark, _CACHED.pop(key)[0])
