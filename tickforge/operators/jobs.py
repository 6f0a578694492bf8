"""The parallel job engine as a thin layer: cuts of work, and any callable over atoms on the executors."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def lin_parts(atoms: int, parts: int) -> np.ndarray:
    """Near-equal contiguous cuts."""
    return np.ceil(np.linspace(0, atoms, min(parts, atoms) + 1)).astype(int)


def nested_parts(atoms: int, parts: int, upper: bool = False) -> np.ndarray:
    """Cuts that balance a cost growing (or falling, if upper) with the row of a triangle."""
    k = min(parts, atoms)
    cuts = np.sqrt(np.arange(k + 1) / k * atoms * (atoms + 1) + 0.25) - 0.5
    cuts = np.round(cuts).astype(int)
    return atoms - cuts[::-1] if upper else cuts


def process_jobs(spark: SparkSession, jobs: list[dict], task: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """The rows that task(**job) gives for each job, each a Spark task; they carry `job`."""
    rows = spark.createDataFrame([(k, bytearray(pickle.dumps(j))) for k, j in enumerate(jobs)], "job long, data binary")

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        out = task(**pickle.loads(bytes(part["data"].iloc[0])))
        return out.assign(job=key[0])

    return rows.groupBy("job").applyInPandas(run, f"{schema}, job long")


def map_atoms(atoms: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int, order: str) -> DataFrame:
    """func over contiguous molecules of atoms; Spark cuts them by ranges of the order, so the result of a row-wise func doesn't depend on the cuts."""
    return atoms.repartitionByRange(parts, order).sortWithinPartitions(order).mapInPandas(lambda batches: (func(b) for b in batches), schema)
