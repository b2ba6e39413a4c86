"""Structured Streaming over the event feed.

* X1 — append: file source → Parquet sink; the checkpoint makes the job
  resumable after a failure (exactly-once file sink).
* X2 — the last N events per session: keyed state of N rows, fed by batches
  that are cut to N rows per key before they are shuffled.
* X3 — current state per key: a streaming ``max_by`` aggregation.

X2 and X3 keep their result and checkpoint in a folder that the caller names:
a job that stopped, or died inside a batch, goes on from there.

``availableNow`` processes everything present and stops, which makes the
same jobs usable as incremental batch loads.
"""

from __future__ import annotations

import pickle
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.ordered import null_safe_join
from tessera.session import ship

ship(__name__)


def event_stream(spark: SparkSession, directory: str, schema, file_glob: str = "events*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """Streaming read of event files in a directory (schema given, no inference)."""
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(directory)


def append_events(stream: DataFrame, sink: str, checkpoint: str, watermark: str | None = None,
                  ts_col: str = "ts") -> None:
    """Persist every event to a Parquet sink; resumable via the checkpoint."""
    s = stream.withWatermark(ts_col, watermark) if watermark else stream
    q = (s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``<kind>=<number>`` under ``root``, ascending."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith(kind + "=")]
    return sorted(int(x.getName().split("=")[1]) for x in found if fs.exists(Path(x, "_SUCCESS")))


def _folders(spark: SparkSession, root: str, upto: int | None = None) -> list[tuple[str, int]]:
    """The newest state and the batches after it: (folder, batch number)."""
    states = [v for v in _complete(spark, root, "state") if upto is None or v <= upto]
    since = states[-1] if states else -1
    batches = [b for b in _complete(spark, root, "batch") if b > since and (upto is None or b <= upto)]
    return [(f"{root}/state={since}", since)] * bool(states) + [(f"{root}/batch={b}", b) for b in batches]


def read_keyed(spark: SparkSession, root: str, key: list[str], upto: int | None = None) -> DataFrame | None:
    """The rows of every key as of its last batch; None before the first batch."""
    parts = [spark.read.parquet(path).withColumn("__batch", F.lit(b)) for path, b in _folders(spark, root, upto)]
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    last = rows.groupBy(*key).agg(F.max("__batch").alias("__batch"))
    return null_safe_join(rows, last, [*key, "__batch"], "left_semi").drop("__batch")


def run_keyed(stream: DataFrame, root: str, key: list[str], mode: str = "update", fold_every: int = 10) -> None:
    """Drives a keyed stream to the end of what is there and stops; a later call with the same ``root`` goes on.

    The checkpoint lies in ``root``.  Each micro-batch writes the rows of the keys that it changed to a folder of its
    own, with overwrite, so that a replayed batch leaves what it left before.  After ``fold_every`` batches they are
    folded into one state table and the folders that it stands for are deleted."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        folders = _folders(spark, root, number)
        if len(folders) > fold_every:
            read_keyed(spark, root, key, number).write.mode("overwrite").parquet(f"{root}/state={number}")
        newest = _complete(spark, root, "state")
        for kind in ("batch", "state"):
            for old in _complete(spark, root, kind):
                if newest and (old < newest[-1] if kind == "state" else old <= newest[-1]):
                    fs, p = _fs(spark, f"{root}/{kind}={old}")
                    fs.delete(p, True)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(sink).trigger(availableNow=True).start())
    query.awaitTermination()


def last_n_per_key(stream: DataFrame, key: str, order_cols: list[str], n: int, root: str, fold_every: int = 10) -> None:
    """The last ``n`` rows per key, as keyed state that survives restarts (``read_keyed`` reads it).

    Every Arrow batch is cut to ``n`` rows per key where it is read, so that of a key with a third of all rows only a
    few per batch travel; the state of a key is its last ``n`` rows.  Null orders come last, a null key is a key."""
    import pandas as pd
    columns, schema = stream.columns, stream.schema

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(order_cols, ascending=False, na_position="last", kind="stable")

    def cut(frames):
        for f in frames:
            yield best(f).groupby(key, dropna=False, sort=False).head(n)

    def update(_key, frames, state):
        kept = pickle.loads(state.get[0]) if state.exists else []
        for f in frames:
            rows = pd.concat([pd.DataFrame(kept, columns=columns).astype(f.dtypes.to_dict()), f[columns]]) if kept else f[columns]
            kept = list(best(rows).head(n).itertuples(index=False, name=None))
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame(kept, columns=columns)

    kept = stream.mapInPandas(cut, schema).groupBy(key).applyInPandasWithState(
        update, schema, "kept binary", "update", GroupStateTimeout.NoTimeout)
    run_keyed(kept, root, [key], fold_every=fold_every)


def current_state(stream: DataFrame, key: list[str], ts_col: str, value_col: str) -> DataFrame:
    """Latest value per key from the feed (streaming ``max_by``); ``run_keyed`` keeps it."""
    return stream.groupBy(*key).agg(F.max_by(value_col, ts_col).alias(value_col),
                                    F.max(ts_col).alias(ts_col), F.count(F.lit(1)).alias("n_events"))
