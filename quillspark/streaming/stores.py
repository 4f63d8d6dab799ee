"""Streams into stores whose commits carry the batch's number, so that a batch that is played again adds nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vector_index import VectorIndex
from ..sources.snapshots import Registry, Snapshots


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands all that a stream has by now to `batch`, in as many batches as its source makes, and ends."""
    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index_stream(stream: DataFrame, index: VectorIndex, checkpoint: str, writer: str = "stream") -> None:
    """Appends a stream of rows (id, source, v) to an index, each batch once, whatever fails in between."""
    run(stream, lambda rows, epoch: index.append(rows, writer=writer, epoch=epoch), checkpoint)


def table_stream(stream: DataFrame, log: Snapshots, checkpoint: str, kind: str = "rows", writer: str = "stream") -> None:
    """Adds a stream's batches to snapshots as parts of a kind."""
    run(stream, lambda rows, epoch: log.add({kind: rows}, writer=writer, epoch=epoch), checkpoint)


#: Groups of users that share a state: what a batch calls for in Python grows with its rows, not with its users.
BUCKETS = 512
SESSION = "user string, began timestamp, ended timestamp, n bigint, total double, gone boolean"


def merged(sessions: list[list], more: list[list], gap: int) -> tuple[list[list], set[int]]:
    """Sessions [begin, end, n, total] (in microseconds) with more of them, joined where not more than gap lies between two; and begins that aren't any more."""
    out: list[list] = []
    for s in sorted([*sessions, *more]):
        if out and s[0] - out[-1][1] <= gap:
            last = out[-1]
            out[-1] = [last[0], max(last[1], s[1]), last[2] + s[2], last[3] + s[3]]
        else:
            out.append(list(s))
    kept = {s[0] for s in out}
    return out, {s[0] for s in sessions} - kept


def merged_all(known: pd.DataFrame, events: pd.DataFrame, gap: int, old: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """merged() for many users at once: sessions (user, began, ended, n, total, told) of known ones (user, began, ended, n, total) and events, of the same
    columns, that aren't more than `old` before the user's last known one; told are those that changed. And (user, began) of those that aren't any more.
    """
    last = events["user"].map(known.groupby("user")["ended"].max())
    events = events[~(events["began"] < last - old)]
    rows = pd.concat([known.assign(told=False), events.assign(told=True)], ignore_index=True).sort_values(["user", "began", "ended"], kind="stable", ignore_index=True)
    until, same = rows.groupby("user")["ended"].cummax().shift(), rows["user"].eq(rows["user"].shift())
    run = (~same | (rows["began"] - until > gap)).cumsum()
    out = rows.groupby(run).agg(user=("user", "first"), began=("began", "min"), ended=("ended", "max"), n=("n", "sum"), total=("total", "sum"), told=("told", "any"))
    return out, rows.loc[~rows["told"] & (rows["began"] > out["began"].reindex(run).to_numpy()), ["user", "began"]]


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """A stream (user, began, ended, n, total, gone) of what becomes of users' sessions by a stream of events (user, ts, value).

    Events of a user that are not more than `gap` apart are one session. A session is told anew whenever it changes; where an
    event that came late joins two, the later one's beginning is told as gone. Sessions that ended more than `late` before the user's
    last event are forgotten, and events older than that are left out: so the state of a user is bounded by what can happen within `late`.
    Users of a bucket share a state, and their events of a batch are merged together; a checkpoint holds for its number of buckets.
    """
    wide, old = (int(pd.Timedelta(x).total_seconds() * 1e6) for x in (gap, late))
    columns = ["user", "began", "ended", "n", "total"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames), ignore_index=True)
        at = f["ts"].astype("datetime64[us]").astype("int64")
        come = pd.DataFrame({"user": f["user"].astype("object"), "began": at, "ended": at, "n": 1, "total": f["value"].fillna(0.0).astype("float64")})
        kept = state.get if state.exists else ([], [], [], [], [])
        kinds = {"user": "object", "began": "int64", "ended": "int64", "n": "int64", "total": "float64"}
        known = pd.DataFrame({c: pd.Series(list(x), dtype=kinds[c]) for c, x in zip(columns, kept, strict=True)})
        now, gone = merged_all(known, come, wide, old)
        rest = now[now["ended"] >= now.groupby("user")["ended"].transform("max") - old - wide]
        state.update(tuple(rest[c].tolist() for c in columns))
        told = now.loc[now["told"], columns].assign(gone=False)
        gone = gone.drop_duplicates().assign(ended=gone["began"], n=0, total=0.0, gone=True)
        rows = pd.concat([x for x in (told, gone) if len(x)], ignore_index=True) if len(told) + len(gone) else told
        if len(rows):
            yield rows.assign(**{c: pd.to_datetime(rows[c], unit="us") for c in ("began", "ended")})[[*columns, "gone"]]

    kept = "user array<string>, began array<bigint>, ended array<bigint>, n array<bigint>, total array<double>"
    rows = events.where("user is not null and ts is not null").select(F.col("user").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("user"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(update, SESSION, kept, "update", GroupStateTimeout.NoTimeout)


def session_store(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 day", writer: str = "sessions") -> Registry:
    """Keeps a registry of sessions (user, began, ended, n, total) up to date with a stream of events."""
    store = Registry(events.sparkSession, path, ["user", "began"])

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            store.log.add({"rows": rows.where("not gone").drop("gone"), "gone": rows.where("gone").select("user", "began")}, writer=writer, epoch=epoch)
        finally:
            rows.unpersist()

    run(sessions(events, gap, late), batch, checkpoint, "update")
    return store
