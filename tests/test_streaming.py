"""Streaming jobs across micro-batches, restarts and replays."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.streaming import events as st
from tests.conftest import SF


@pytest.fixture(scope="module")
def events(spark):
    """The events with a null key, a key that holds a third of all rows, and null order values."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7)).when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.col("user_id"))
    return ev.withColumn("user_id", user.cast(ev.schema["user_id"].dataType)).withColumn(
        "ts", F.when(F.col("event_id") % 40 != 2, F.col("ts"))).cache()


class Feed:
    """A directory that event files arrive in, one micro-batch each."""

    def __init__(self, spark, events, parts):
        self.spark, self.events, self.parts, self.given = spark, events, parts, 0
        self.dir, self.root = tempfile.mkdtemp(prefix="tessera-feed-"), tempfile.mkdtemp(prefix="tessera-keyed-") + "/root"

    def arrive(self, n):
        for k in range(self.given, self.given + n):
            at = tempfile.mkdtemp(prefix="tessera-part-")
            self.events.where(F.col("event_id") % self.parts == k).coalesce(1).write.mode("overwrite").parquet(at)
            name = next(f for f in os.listdir(at) if f.endswith(".parquet"))
            shutil.copy(f"{at}/{name}", f"{self.dir}/part{k:03d}.parquet")
        self.given += n

    def stream(self):
        return st.event_stream(self.spark, self.dir, self.events.schema, "part*.parquet", max_files=1)

    def so_far(self):
        return self.events.where(F.col("event_id") % self.parts < self.given)

    def folders(self):
        return sorted(f for f in os.listdir(self.root) if f.startswith(("batch=", "state=")))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _last_n(df, n):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _rows(df.withColumn("rn", F.row_number().over(w)).where(f"rn <= {n}").drop("rn"))


def _replay(root):
    """Takes back the mark that the last batch was finished, as when the job dies right before it."""
    commits = f"{root}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    return last


def test_last_n_resumes_and_replays(spark, events):
    feed = Feed(spark, events, 5)

    def run():
        st.last_n_per_key(feed.stream(), "user_id", ["ts", "event_id"], 3, feed.root, fold_every=2)
        return _rows(st.read_keyed(spark, feed.root, ["user_id"]).select(*events.columns))
    feed.arrive(1)
    assert run() == _last_n(feed.so_far(), 3)
    feed.arrive(3)
    assert run() == _last_n(feed.so_far(), 3)
    number = _replay(feed.root)
    assert run() == _last_n(feed.so_far(), 3)
    assert number == 3
    feed.arrive(1)
    assert run() == _last_n(events, 3)
    assert run() == _last_n(events, 3)      # nothing new
    assert len(feed.folders()) <= 4 and len([f for f in feed.folders() if f.startswith("state=")]) <= 1


def test_current_state_resumes_and_replays(spark, events):
    feed = Feed(spark, events, 4)

    def run():
        st.run_keyed(st.current_state(feed.stream(), ["user_id"], "ts", "event_type"), feed.root, ["user_id"], fold_every=2)
        return _rows(st.read_keyed(spark, feed.root, ["user_id"]).select("user_id", "event_type", "ts", "n_events"))

    def want(df):
        return _rows(df.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"),
                                               F.count(F.lit(1)).alias("n_events")))
    feed.arrive(2)
    assert run() == want(feed.so_far())
    _replay(feed.root)
    assert run() == want(feed.so_far())     # a batch that is written twice counts once
    feed.arrive(2)
    assert run() == want(events)
    assert len(feed.folders()) <= 3


def test_nothing_to_read(spark, events):
    feed = Feed(spark, events, 2)
    st.last_n_per_key(feed.stream(), "user_id", ["ts"], 3, feed.root)
    assert st.read_keyed(spark, feed.root, ["user_id"]) is None


def test_append(spark, events):
    feed = Feed(spark, events, 3)
    sink, checkpoint = feed.root + "/sink", feed.root + "/ckpt"
    for n in (1, 2):
        feed.arrive(n)
        st.append_events(feed.stream(), sink, checkpoint)
        assert spark.read.parquet(sink).count() == feed.so_far().count()
