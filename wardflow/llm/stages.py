"""Tables between the steps of an operator, ranks over a whole table, keys that repeat."""

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.session import WRITES, new_folder


_SHARED = set()


def share_package(spark):
    """Send this package to the executors of a session, once, as --py-files would.

    Needed where Python workers start in another folder than the repository.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHARED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/package", "zip", root, "wardflow")
        context.addPyFile(archive)
        _SHARED.add(context.applicationId)


def stored(df, name="step"):
    """Write df into the shared folder (spark.checkpoint.dir) and go on from there.

    Cuts lineage: a lost executor costs the reading of files, not the work before them.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**WRITES, compression="zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value, body):
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def ranked(df, order, rank="rank"):
    """Rows of df with their position from 0 in the order of the named columns.

    One range shuffle; a hot value is split as long as the order tells its rows apart. The
    offsets table has one row for each partition.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return at.join(offsets, "_part").withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _repeated(key):
    def keep(batches):
        held = held_key = None
        held_stays = broken = False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            equal = np.empty(n, bool)
            equal[1:] = keys[1:] == keys[:-1]
            equal[0] = held is not None and keys[0] == held_key
            stays = equal.copy()
            stays[:-1] |= equal[1:]
            if not broken:
                breaks = np.flatnonzero(~equal)
                breaks = breaks if held is not None else breaks[1:]
                broken = len(breaks) > 0
                stays[: breaks[0] if broken else n] = True
            if held is not None and (held_stays or equal[0]):
                yield held
            if n > 1:
                yield batch.slice(0, n - 1).filter(pa.array(stays[:-1]))
            held, held_key, held_stays = batch.slice(n - 1, 1), keys[-1], stays[-1]
        if held is not None:
            yield held

    return keep


def repeated_keys(table, key, order):
    """Rows of a stored table whose key (a long, never null) stands in two rows or more.

    One range shuffle on the key and the order columns, so a hot key spreads over
    partitions; a task reads its rows in order and looks at neighbours only. The first and
    the last key of a partition always stay, because their other rows may be next door: a
    few keys with one row remain, and callers must bear them.
    """
    rows = table.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return rows.mapInArrow(_repeated(key), table.schema)
