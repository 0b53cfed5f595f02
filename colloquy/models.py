"""Models at the border: an operator gets what a model says as columns.

A model is any function from an Arrow batch to an Arrow batch. It is loaded once
a worker and partition, never on the driver, and a batch that it fails on comes
back with an error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    """``load()`` gives a function from a batch of the inputs to a batch of the outputs, row by row in order."""

    inputs: list[str]
    outputs: str
    model_id: str

    def load(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]: ...


def apply_model(df: DataFrame, model: Model, key: str = "id", batch_rows: int = 128) -> DataFrame:
    """(key, outputs, model_id, error) of each row; outputs are null where the model failed."""
    kind = dict(df.dtypes)[key]
    names = [p.split()[0] for p in model.outputs.split(", ")]
    load, inputs, model_id = model.load, model.inputs, model.model_id
    schema = df.select(*(F.lit(None).cast(p.split(None, 1)[1]).alias(p.split()[0]) for p in model.outputs.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)]
        fn = None
        for whole in batches:
            for lo in range(0, whole.num_rows, batch_rows):
                b = whole.slice(lo, batch_rows)
                error = None
                try:
                    fn = fn or load()
                    out = fn(b.select(inputs))
                    cols = [out.column(k).cast(t) for k, t in enumerate(types)]
                except Exception as e:  # a model's failure is a result of its rows
                    error = f"{type(e).__name__}: {e}"[:500]
                    cols = [pa.nulls(b.num_rows, t) for t in types]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(key)), *cols, pa.array([model_id] * b.num_rows), pa.array([error] * b.num_rows, pa.string())], [key, *names, "model_id", "error"])

    return df.select(key, *inputs).mapInArrow(run, f"{key} {kind}, {model.outputs}, model_id string, error string")


class HashedEmbedder:
    """A stand-in: hashed words as a unit vector, so that everything around a model runs without one."""

    inputs = ["text"]
    outputs = "vector array<float>"

    def __init__(self, dim: int = 64):
        self.dim, self.model_id = dim, f"hashed-words-{dim}"

    def load(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        dim = self.dim

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_hashed(t or "", dim) for t in b.column(0).to_pylist()], pa.list_(pa.float32()))], ["vector"])

        return run

    def __call__(self, text: str) -> list[float]:
        return _hashed(text, self.dim)


def _hashed(text: str, dim: int) -> list[float]:
    import zlib

    v = [0.0] * dim
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    size = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / size for x in v]


def pending(turns: DataFrame, done: DataFrame, model_id: str) -> DataFrame:
    """What an incremental pass still has to do: rows without this model's result; rerunning it does nothing twice."""
    return turns.join(done.where(F.col("model_id") == model_id).select("id"), "id", "left_anti")
