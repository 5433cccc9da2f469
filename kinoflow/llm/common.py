"""What the operators of this subpackage share: the folder that all executors see, cutting lineage, small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a folder of our own is set. On a cluster without one there is no folder
    that all see, and the driver's own disk would lose rows: an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinoflow-")
        passing(spark, found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def passing(spark: SparkSession, path: str) -> str:
    """Marks a folder to be removed when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def spare(taken: list[str], *names: str) -> list[str]:
    """Names for columns that are added for a while: each lengthened until it clashes with none of ``taken``."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Runs ``df`` and cuts its lineage; the rows lie in the shared folder, so lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: For files in a local folder. Hadoop's usual class for them starts three processes for each file that a task writes
#: (chmod, of its folder, of the file and of a file of checksums), and until its program runs each shows all of the
#: executor's memory as its own. This class writes no file of checksums; those in the Parquet pages are verified instead.
#: Other file systems take no notice of UNSUMMED.
UNSUMMED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, as a compressed Parquet table of which later reads take only the columns they need.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**UNSUMMED, **VERIFIED, compression="zstd").parquet(path)
    passing(spark, path)
    return spark.read.options(**VERIFIED).schema(df.schema).parquet(path)


#: So many narrow rows are no load for one task, whatever their keys.
PLAIN_ROWS = 100_000


def hub_join(left: DataFrame, right: DataFrame, key: str, of: str, n: str, rows: int, outer: bool = False) -> DataFrame:
    """``left`` with the other columns of ``right``'s row for its ``key``; rows without one, or of a null key, go, or with
    ``outer`` stay with nulls. No name may clash.

    ``right`` has one row a key ``of``, and in ``n`` how many of ``left``'s ``rows`` rows have that key. Keys that hold
    more than a thousandth of them (and more than 64) are at most 1000: they are broadcast, and their rows, like those
    of a null key, are dealt out by a hash of the whole row. All others are joined by key, by sorting: adaptive execution
    would go by the compressed size of that side and broadcast one that is many times as large in memory. So no task gets
    all rows of a hot key. Up to PLAIN_ROWS rows a plain join does, with a plan of a quarter of the size.
    """
    if rows <= PLAIN_ROWS:
        how = "left" if outer else "inner"
        return left.join(right.drop(n), F.col(key) == F.col(of), how).drop(of)
    limit = max(64, rows // 1000)
    others = [c for c in right.columns if c not in (of, n)]
    hub, hub_row, salt, row, none = spare([*left.columns, *right.columns], "hub", "hub_row", "salt", "row", "none")
    hubs = right.where(F.col(n) > limit).select(F.col(of).alias(hub), F.struct(*others).alias(hub_row))
    # Zero, but not to the optimizer: it would take a literal out of the join's keys, and the salt with it.
    zero = F.pmod(F.col(n), F.lit(1)).cast("int")
    rest = right.where(F.col(n) <= limit).select(of, F.struct(*others).alias(row), zero.alias(none))
    some = left.join(F.broadcast(hubs), F.col(key) == F.col(hub), "left")
    dealt = F.when(F.col(hub).isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("int") + 1).otherwise(0)
    both = some.withColumn(salt, dealt).join(rest.hint("merge"), (F.col(key) == F.col(of)) & (F.col(salt) == F.col(none)), "left")
    found = F.coalesce(hub_row, row)
    return (both if outer else both.where(found.isNotNull())).select(*left.columns, *[found[c].alias(c) for c in others])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size to ``rows``. Whole texts make the default of 10,000 rows tens of MB, and
    the buffers that grow to hold them stay with the executor's process."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
