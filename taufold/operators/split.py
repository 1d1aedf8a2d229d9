"""Train/test splits and folds by hash of the unit key.

``randomSplit`` depends on the partition layout; a hash of the key does not, so
a rerun after a lost executor puts every unit in the same part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.functions.numeric import hash32, uniform
from taufold.operators.rank import distributed_rank


def fold_of(unit: Column, folds: int, seed: int = 123) -> Column:
    return hash32(seed, unit) % folds


def train_flag(unit: Column, test_share: float = 0.2, seed: int = 42) -> Column:
    return uniform(seed, unit) >= test_share


def train_test_split(df: DataFrame, unit_id: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    flag = train_flag(F.col(unit_id), test_share, seed)
    return df.filter(flag), df.filter(~flag)


def with_folds(df: DataFrame, unit_id: str, folds: int, seed: int = 123, fold: str = "fold") -> DataFrame:
    """Hash folds: no shuffle, sizes equal up to chance."""
    return df.withColumn(fold, fold_of(F.col(unit_id), folds, seed))


def with_stratified_folds(
    df: DataFrame, unit_id: str, treatment: str, folds: int, seed: int = 123, fold: str = "fold"
) -> DataFrame:
    """Folds whose sizes differ by at most one within each arm.

    Units are shuffled by hash and dealt out round-robin per arm.  The rank is
    distributed, so an arm of any size is spread over many tasks.
    """
    shuffled = df.withColumn("_shuffle", hash32(seed, F.col(unit_id)))
    ranked = distributed_rank(shuffled, [F.col("_shuffle"), F.col(unit_id)], by=[treatment], rank="_rank")
    return ranked.withColumn(fold, (F.col("_rank") - 1) % folds).drop("_shuffle", "_rank")


def with_draws(
    df: DataFrame, unit_id: str, seed: int, keys: Sequence[object], decide: Callable[[np.ndarray], np.ndarray], width: int | None = None
) -> DataFrame:
    """Adds ``draws``, an array of small whole numbers: ``decide`` of a unit's uniforms, one for each key.

    ``decide`` gets the uniforms of many units as (units, keys) and returns (units, ``width``);
    ``width`` is by default the number of ``keys``.

    The uniforms are those of ``numeric.uniform``, so they do not depend on the
    layout; a list of hundreds of md5 columns takes eight times as long.
    """
    heads = [f"{seed}:{key}" for key in keys]
    width = width or len(heads)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = [hashlib.md5(h.encode()) for h in heads]
        for batch in batches:
            raw = []
            for unit in batch.column(0).to_pylist():
                tail = b"" if unit is None else b":" + unit.encode()
                for start in started:
                    own = start.copy()
                    own.update(tail)
                    raw.append(own.digest()[:4])
            numbers = np.frombuffer(b"".join(raw), ">u4").reshape(batch.num_rows, len(heads))
            out = decide((numbers + 0.5) / 2**32).astype(np.int8)
            cuts = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            draws = pa.ListArray.from_arrays(pa.array(cuts), pa.array(out.reshape(-1)))
            yield pa.record_batch([*batch.columns[1:], draws], [*batch.schema.names[1:], "draws"])

    source = df.select(F.col(unit_id).cast("string").alias("_unit"), *df.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return source.mapInArrow(draw, f"{kinds}, draws array<tinyint>")
