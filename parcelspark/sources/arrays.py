"""NumPy archives as DataFrames: one row for each index of the first axis, one column for each array."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parcelspark.scratch import prepare

#: Values of one Arrow batch.
VALUES = 1 << 20


def _arrays(name: str, raw: bytes) -> dict[str, np.ndarray]:
    found = np.load(io.BytesIO(raw), allow_pickle=False)
    return {"value": found} if isinstance(found, np.ndarray) else {k: found[k] for k in found.files}


def shape_of(spark: SparkSession, path: str) -> dict[str, tuple[str, tuple[int, ...]]]:
    """Type and shape of each array of the first archive at a path; members are read for it, not unpacked into rows."""
    row = spark.read.format("binaryFile").load(path).orderBy("path").select("path", "content").first()
    if row is None:
        raise ValueError(f"no archive at {path}")
    return {k: (v.dtype.str, v.shape) for k, v in _arrays(*row).items()}


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, row and the arrays of .npz or .npy files; axes beyond the first are flattened into one list.

    Arrays of one archive that have no rows in common (scalars, other lengths) are an error.
    """
    kinds = shape_of(spark, path)
    lengths = {s[0] if s else None for _, s in kinds.values()}
    if len(lengths) != 1 or None in lengths:
        raise ValueError(f"arrays of unlike lengths: { {k: s for k, (_, s) in kinds.items()} }")
    spark_kind = {"i": "long", "u": "long", "b": "boolean", "f": "double"}
    plain = {k: spark_kind[np.dtype(d).kind] for k, (d, _) in kinds.items()}
    schema = "path string, row long, " + ", ".join(f"`{k}` {plain[k] if len(s) == 1 else f'array<{plain[k]}>'}" for k, (_, s) in kinds.items())
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    names = list(kinds)
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _arrays(name, raw)
                n = len(found[names[0]])
                step = max(1, VALUES // max(1, sum(v[:1].size for v in found.values())))
                for i in range(0, n, step):
                    cols = [pa.array([name] * min(step, n - i)), pa.array(np.arange(i, min(i + step, n)))]
                    for k in names:
                        part = found[k][i : i + step]
                        flat = pa.array(part.reshape(-1)).cast(arrow[plain[k]])
                        cols.append(flat if part.ndim == 1 else pa.ListArray.from_arrays(np.arange(0, len(part) + 1, dtype=np.int32) * (part[:1].size), flat))
                    yield pa.RecordBatch.from_arrays(cols, ["path", "row", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
