"""Session helpers: where intermediate results go."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key that names the folder which driver and executors share.
CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is configured and everything runs in one process (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small intermediate in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Give the driver's freed native memory back to its machine.

    Planning many small jobs leaves hundreds of MB in the C library's per-thread pools, which
    count as used until they are trimmed. JVMs without that command (before 17.0.9) are left alone.
    """
    gateway = spark.sparkContext._gateway
    jvm, empty = gateway.jvm, lambda kind: gateway.new_array(kind, 0)
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by its public interface, as the server's own class is hidden
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = empty(jvm.java.lang.Object), empty(jvm.java.lang.String)
    with contextlib.suppress(Py4JJavaError):
        call.invoke(server, args)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of `scratch`, in whichever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the decimal id, as the contracts fix their folds; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
