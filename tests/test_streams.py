"""Recorded pages with retries, streams into stores, sessions with late events."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.vector_index import VectorIndex
from quillspark.sources.pages import fetched, lines, read_pages, record, stream_pages
from quillspark.sources.snapshots import Snapshots
from quillspark.streaming.stores import index_stream, merged, session_store, table_stream


@pytest.mark.parametrize(
    "attempts, row",
    [
        ([(200, "a")], (200, 1, "a", None)),
        ([(503, ""), (200, "b")], (200, 2, "b", None)),
        ([(429, ""), (500, ""), (502, ""), (200, "late")], (502, 3, None, "no answer after 3 attempts")),
        ([(503, "")], (503, 3, None, "no answer after 3 attempts")),
        ([(404, ""), (200, "never")], (404, 1, None, "HTTP 404")),
        ([(500, ""), (410, "")], (410, 2, None, "HTTP 410")),
    ],
)
def test_fetched(attempts, row):
    assert fetched("k", 5, attempts, 3) == ("k", 5, *row)


def test_lines_of_chunks():
    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:3], self.data[3:]
            return out

    assert list(lines(Stream(b"ab\ncdefgh\n\nx"))) == [b"ab", b"cdefgh", b"", b"x"] and list(lines(Stream(b""))) == []


def recording(n=40):
    rng, rows, want = random.Random(12), [], set()
    for k in range(n):
        for offset in range(0, rng.randint(1, 60 if k == 0 else 5)):
            last = rng.choice([200, 200, 200, 404, 503])
            tried = [503] * rng.randint(0, 2) + [last]
            rows += [(f"k{k}", offset, i, s, f"p{k}-{offset}" if s == 200 else "") for i, s in enumerate(tried)]
            asked = 3 if last == 503 else len(tried)
            want.add((f"k{k}", offset, last, asked, f"p{k}-{offset}" if last == 200 else None, {404: "HTTP 404", 503: "no answer after 3 attempts"}.get(last)))
    return rows, want


def test_pages_in_batches_and_streams(spark, tmp_path):
    rows, want = recording()
    path = f"file://{tmp_path}/recording"
    record(spark.createDataFrame(rows, "key string, offset int, attempt int, status int, body string"), path, 7)
    got = read_pages(spark, path)
    assert got.rdd.getNumPartitions() > 3 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    log = Snapshots(spark, f"file://{tmp_path}/log")
    table_stream(stream_pages(spark, path), log, f"file://{tmp_path}/checkpoint")
    assert len(log.versions()) == 1
    more = [("new", 0, 0, 200, "later")]
    record(spark.createDataFrame(more, "key string, offset int, attempt int, status int, body string"), f"{path}-more", 1)
    made = next(p for p in (tmp_path / "recording-more").iterdir() if p.name.startswith("part-"))
    made.rename(tmp_path / "recording" / "part-99999.txt")
    before = len(log.versions())
    table_stream(stream_pages(spark, path), log, f"file://{tmp_path}/checkpoint")
    assert len(log.versions()) == before + 1
    rows = log.read("rows").drop("__version").collect()
    assert {tuple(r) for r in rows} == want | {("new", 0, 200, 1, "later", None)} and len(rows) == len(want) + 1


def test_stream_into_an_index_fails_and_goes_on(spark, tmp_path):
    """A batch whose commit is done and whose stream then fails is played again, and adds nothing."""
    path = f"file://{tmp_path}"
    rows = [(i, "s", [1.0, i / 10]) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "id long, source string, v array<double>").coalesce(1).write.mode("append").parquet(f"{path}/landing")
    index = VectorIndex.create(spark.createDataFrame([(1000, "first", [1.0, 0.0])], "id long, source string, v array<double>"), f"{path}/index")
    stream = lambda: spark.readStream.schema("id long, source string, v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{path}/landing")
    add, calls = index.append, []

    def failing(rows, **kw):
        version = add(rows, **kw)
        calls.append(kw["epoch"])
        if len(calls) == 2:
            raise OSError("lost after the commit")
        return version

    index.append = failing
    with pytest.raises(Exception, match="lost after the commit"):
        index_stream(stream(), index, f"{path}/checkpoint")
    index_stream(stream(), index, f"{path}/checkpoint")
    assert calls.count(calls[1]) == 2 and sorted(r.id for r in index.rows().collect()) == [*range(40), 1000]


def brute(events, gap):
    out = {}
    for user in {u for u, _, _ in events}:
        own = sorted((t, v) for u, t, v in events if u == user)
        runs = [[own[0]]]
        for e in own[1:]:
            if e[0] - runs[-1][-1][0] <= gap:
                runs[-1].append(e)
            else:
                runs.append([e])
        out.update({(user, r[0][0]): (r[-1][0], len(r), round(sum(v for _, v in r), 6)) for r in runs})
    return out


def test_merged_sessions():
    rng = random.Random(3)
    for _ in range(300):
        events = [("u", rng.randint(0, 200), 1.0) for _ in range(rng.randint(1, 25))]
        sessions, told, at = [], {}, 0
        while at < len(events):
            part, at = events[at : at + 4], at + 4
            sessions, gone = merged(sessions, merged([], [[t, t, 1, v] for _, t, v in part], 5)[0], 5)
            told = {b: x for b, x in told.items() if b not in gone} | {s[0]: tuple(s[1:]) for s in sessions}
        assert told == {b: x for (_, b), x in brute(events, 5).items()}


def test_session_store(spark, tmp_path):
    rng, base, path = random.Random(4), 1_700_000_000, f"file://{tmp_path}"
    events = [(f"u{rng.randint(0, 4)}", base + rng.randint(0, 40_000), float(rng.randint(1, 9))) for _ in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "user string, t long, value double").select("user", F.timestamp_seconds("t").alias("ts"), "value")
    for k in range(4):
        frame(events[k::4] + ([(None, base, 1.0)] if k else [])).coalesce(1).write.mode("append").parquet(f"{path}/landing")
    stream = spark.readStream.schema("user string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{path}/landing")
    store = session_store(stream, f"{path}/store", f"{path}/checkpoint", gap="5 minutes", late="2 days")
    got = {(r.user, int(r.b)): (int(r.e), r.n, round(r.total, 6)) for r in store.rows().select("user", F.unix_timestamp("began").alias("b"), F.unix_timestamp("ended").alias("e"), "n", "total").collect()}
    assert got == brute(events, 300) and len(store.log.versions()) == 4
