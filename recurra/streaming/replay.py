"""Two shells around a system: batch replay of stored streams, and Structured Streaming with keyed state.

Both need the columns stream_id, example, x array<double>, y int, and for the bound systems concept. A stream is one
key: its rows are order-dependent and go through one object. Streams run in parallel, each read and logged in pieces.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .system import Options, make

LOG = (
    "stream_id long, example long, y int, p int, is_correct int, active_model int, change_detected int, model_evolution int, "
    "similarity double, likelihoods map<int,double>, priors map<int,double>, posteriors map<int,double>, merges string, deletions string"
)
_NAMES = [part.split()[0] for part in LOG.split(", ")]


def step(system, stream: int, rows: pd.DataFrame) -> list[tuple]:
    """Predict, score, learn: the log of some rows in order.

    Rows without features are left out. A null label is only predicted; with `impute_labels` the system learns its own
    prediction in its place, and the row has no score either way.
    """
    out = []
    known = rows["concept"].tolist() if "concept" in rows else [None] * len(rows)
    for example, x, y, concept in zip(rows["example"].tolist(), rows["x"].tolist(), rows["y"].tolist(), known, strict=True):
        if x is None:
            continue
        v = np.asarray(x, float)
        if not np.isfinite(v).all():
            v = np.nan_to_num(v)
        if hasattr(system, "at"):
            system.at(concept)
        p = system.predict(v)
        if y is None or y != y:
            if getattr(system.o, "impute_labels", False):
                system.learn(v, p)
            out.append((stream, example, None, p, None, None, 0, 0, None, {}, {}, {}, None, None))
            continue
        y = int(y)
        got = system.learn(v, y)
        out.append((stream, example, y, p, int(p == y), *(got[m] for m in _NAMES[5:])))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"y": "Int32", "p": "Int32", "is_correct": "Int32", "active_model": "Int32"}) if rows else pd.DataFrame(columns=_NAMES)


#: Rows of a stream that are learned, and logged, at a time: each fifth row names all states there are.
_PIECE = 1000
_MAP = pa.map_(pa.int32(), pa.float64())
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "map<int,double>": _MAP}[part.split()[1]] for part in LOG.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = []
    for values, kind in zip(zip(*rows, strict=True), _TYPES, strict=True):
        if kind is _MAP:
            ends = np.cumsum([0, *map(len, values)])
            keys, items = (pa.array(chain.from_iterable(part), k) for part, k in ((values, pa.int32()), ((m.values() for m in values), pa.float64())))
            columns.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, items))
        else:
            columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _apart(streams: DataFrame) -> DataFrame:
    """The rows of each stream in order in one partition, few streams in any: neighbouring ids are dealt out in turn, and
    neither small partitions are put together nor do ids at equal distances meet."""
    spark = streams.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    turn = F.pmod(F.col("stream_id") + F.floor(F.col("stream_id") / n), F.lit(n)).cast("int")
    return streams.repartitionById(n, turn).sortWithinPartitions("stream_id", "example")


def _start(name: str, x, options: Options, drifts: dict[int, tuple[int, ...]], stream: int):
    return make(name, len(x), replace(options, forced_drifts=frozenset(drifts.get(stream, ()))))


def replay(stream: DataFrame, system: str = "CC", options: Options | None = None, drifts: dict[int, tuple[int, ...]] | None = None) -> DataFrame:
    """The log of a whole stored stream per stream_id. drifts: rows of each stream at which a drift is forced."""
    options, drifts = options or Options(), drifts or {}
    keep = [c for c in ("stream_id", "example", "x", "y", "concept") if c in stream.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = now = None
        for batch in batches:
            ids = batch.column("stream_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for first, last in zip(cuts, cuts[1:]):
                for at in range(first, last, _PIECE):
                    pdf, key = batch.slice(at, min(_PIECE, last - at)).to_pandas(), int(ids[first])
                    if key != now:
                        own, now = None, key
                    some = pdf["x"].dropna()
                    if own is None and len(some):
                        own = _start(system, some.iloc[0], options, drifts, key)
                    rows = step(own, key, pdf) if own is not None else []
                    if rows:
                        yield _batch(rows)

    return _apart(stream.select(*keep)).mapInArrow(run, LOG)


def streaming(stream: DataFrame, system: str = "CC", options: Options | None = None, drifts: dict[int, tuple[int, ...]] | None = None) -> DataFrame:
    """The same log as a streaming query (append): the system is the state of its key, kept between micro-batches.

    Rows must reach a key in order of example over the micro-batches; inside one they are sorted.
    """
    options, drifts = options or Options(), drifts or {}
    keep = [c for c in ("stream_id", "example", "x", "y", "concept") if c in stream.columns]

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("example", kind="stable")
        some = pdf["x"].dropna()
        if state.exists:
            own = pickle.loads(state.get[0])
        elif len(some):
            own = _start(system, some.iloc[0], options, drifts, int(key[0]))
        else:
            return
        yield _frame(step(own, int(key[0]), pdf))
        state.update((pickle.dumps(own),))

    return stream.select(*keep).groupBy("stream_id").applyInPandasWithState(run, LOG, "system binary", "append", "NoTimeout")


def write_log(log: DataFrame, path: str, checkpoint: str):
    """Start a streaming log sink: parquet with a checkpoint, all that is there now."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def experience(log: DataFrame) -> DataFrame:
    """The log with its running counts and packed cells, as a per-run file has them."""
    from ..operators.evaluation import running_accuracy

    cell = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.format_string("%d:%.4f", e["key"], e["value"])), ";")
    run = running_accuracy(log)
    packed = log.select(*[F.col(c) if c not in ("likelihoods", "priors", "posteriors") else cell(c).alias(f"concept_{c}") for c in log.columns])
    return packed.join(run, ["stream_id", "example"])
