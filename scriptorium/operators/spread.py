"""Use of all cores on inputs that come in few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out to all cores, but only where it has fewer tasks than there are cores.

    A large input has more splits than cores and is left as it is, so that nothing is shuffled at scale; a table in
    one small file would otherwise be read and worked on by a single core. Only for scans: planning one runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan
