"""Streams give what a batch over all files gives, also when files arrive one by one; their states stay bounded."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from sitelore.functions import urls as U

from sitelore.plans import catalog
from sitelore.sources import derived as D
from sitelore.streaming import job_progress, page_stream

SF = "/root/testdata/sf0.001"


def test_pages_arrive_in_parts(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").repartition(1)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):  # the third part repeats the first
        pages.filter(F.col("page_id") % 2 == part % 2).write.mode("append").parquet(folder)
        query = page_stream.start(page_stream.read_pages(spark, folder), out, state)
        query.awaitTermination()
        # what was seen is state; no batch reads more than its own files
        assert query.lastProgress["stateOperators"][0]["operatorName"] == "dedupeWithinWatermark"
        assert query.lastProgress["numInputRows"] <= 25
    got = spark.read.parquet(out).drop("content_hash", "seen_at")
    batch = page_stream.page_facts(pages)
    assert got.count() == pages.select(F.expr(U.normalize("url")), "html").distinct().count()
    assert got.exceptAll(batch.select(got.columns)).isEmpty()


def test_job_states_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(folder)
        raw = spark.readStream.schema(events.schema).parquet(folder)
        job_progress.start(D.as_job_events(raw), out, state, lateness="10000 days").awaitTermination()
    got = job_progress.current(spark, out)
    want = job_progress.latest_states(D.as_job_events(events)).drop("last_event").select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


DAY = dt.datetime(2024, 1, 1)


def test_a_changed_page_comes_again_and_versions_are_forgotten(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "page_id bigint, url string, html string, seen_at timestamp"
    kept = []
    for day in range(8):
        rows = [
            (1, "http://s/same", "<p>same</p>"), (2, "http://s/changes", f"<p>{day // 2}</p>"), (3, "http://s/none", None),
            *[(100 * day + k, f"http://s/{day}/{k}", "<p>x</p>") for k in range(20)],
        ]
        spark.createDataFrame([(*r, DAY + dt.timedelta(days=day)) for r in rows], schema).repartition(1).write.mode("append").parquet(folder)
        query = page_stream.start(spark.readStream.schema(schema).parquet(folder), out, state, remembered="2 days")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.parquet(out)
    seen = {u: got.filter(F.col("url") == u).count() for u in ("http://s/same", "http://s/changes", "http://s/none")}
    assert seen["http://s/changes"] >= 4  # each of the four versions
    assert 2 <= seen["http://s/same"] == seen["http://s/none"] <= 4  # anew when it was forgotten, not on each day
    assert got.filter("page_id between 100 and 199").count() == 20
    assert max(kept) <= 4 * 23 and kept[-1] < 8 * 20  # versions of the last days, not of all


def job(spark, rows):
    schema = "job_id bigint, event_id bigint, ts timestamp, status string, progress string, done bigint, total bigint"
    return spark.createDataFrame(rows, schema)


def test_jobs_retire_late_events_are_counted_and_few_folders_are_read(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda hour, minute=0: DAY + dt.timedelta(hours=hour, minutes=minute)
    schema, kept, late = None, [], []
    for n in range(9):
        rows = [(n, 10 * n, at(n), "running", "p", n, 9), (n, 10 * n + 1, at(n, 5), "completed", None, None, 9)]
        if n == 4:
            rows.append((0, 999, at(0, 1), "failed", "late", 50, 9))  # older than the watermark
        if n == 8:
            rows.append((1, 1000, at(8, 1), "running", "again", 2, 9))  # goes on after it retired
        job(spark, rows).repartition(1).write.mode("append").parquet(folder)
        schema = schema or spark.read.parquet(folder).schema
        query = job_progress.start(
            spark.readStream.schema(schema).parquet(folder), out, state, "30 minutes", 2 * 3600, compact_every=3
        )
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        late.append(job_progress.late_events(query))
        assert len(job_progress.folders_of_current(spark, out)) <= 3
    assert max(kept) <= 5 and kept[-1] <= 5  # not nine
    jobs = {r.job_id: r for r in job_progress.jobs(spark, out).collect()}
    assert len(jobs) == 9 and late == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert (jobs[0].status, jobs[0].done, jobs[0].retired) == ("completed", 0, True)
    assert (jobs[1].status, jobs[1].progress, jobs[1].done, jobs[1].retired) == ("running", "again", 2, False)
    assert jobs[8].retired is False
    shown = {r.job_id: r.counter for r in job_progress.current(spark, out).collect()}
    assert shown[3] == "3/9" and len(shown) == 9
    # a batch that runs again changes nothing
    before = sorted(map(str, job_progress.jobs(spark, out).collect()))
    assert before == sorted(map(str, job_progress.merged(job_progress.jobs(spark, out)).collect()))


def test_tables_may_be_folders_of_files(spark, tmp_path):
    pages = [(1, "http://s/a", "<p>one</p>"), (2, "http://s/b", "<p>two</p>"), (3, "http://s/a", "<p>one</p>")]
    for n, rows in enumerate((pages, [])):
        sf = f"{tmp_path}/{n}/"
        spark.createDataFrame(rows, page_stream.PAGE_SCHEMA).repartition(3).write.parquet(sf + "pages.parquet")
        spark.createDataFrame([(9, "http://other/", "")], page_stream.PAGE_SCHEMA).write.parquet(sf + "other.parquet")
        got = catalog.page_stream(spark, sf.rstrip("/"))
        assert got.columns == ["page_id", "site", "url", "title", "chunk", "emails", "phones"]
        assert sorted((r.url, r.chunk) for r in got.collect()) == ([("http://s/a", "one"), ("http://s/b", "two")] if rows else [])
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/0/events.parquet")
    want = catalog.job_progress_stream(spark, SF).collect()
    assert want and sorted(catalog.job_progress_stream(spark, f"{tmp_path}/0").collect()) == sorted(want)


class State:
    """What ``_fold`` asks of a group's state."""

    hasTimedOut, exists, get = False, False, None

    def update(self, values):
        self.exists, self.get = True, values

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def test_the_last_event_of_a_job_is_found_without_sorting_its_rows(monkeypatch):
    monkeypatch.delattr(pd.DataFrame, "sort_values")
    names = ["job_id", "ts_us", "event_id", "status", "progress", "total", "done"]
    frames = [
        pd.DataFrame([(7, 9000, 1, "a", "p", 4, 3), (7, 9000, 2, "b", None, None, None), (7, 9000, 2, "c", None, None, 1), (7, 8000, 5, "d", "q", 4, 2)], columns=names),
        pd.DataFrame([(7, 7000, 8, "e", "r", 4, None)], columns=names),  # older, in a later frame
        pd.DataFrame([(7, 9000, 3, None, "s", 6, None), (7, 9000, 0, "f", "t", 4, None)], columns=names),
    ]
    run, state = job_progress._fold(10), State()
    # equal rows: the later one; nulls of the last event are kept as such, those of counters are passed over
    got = [*run((7,), iter(frames[:1]), state)][0]
    assert [*got.columns] == [*job_progress.COLUMNS] and got.iloc[0].tolist() == [7, 9000, 2, "c", None, None, 3, 5, False]
    got = [*run((7,), iter(frames[1:]), state)][0].iloc[0].tolist()
    assert got == [7, 9000, 3, None, "s", 6, 3, 8, False] and state.until == 9 + 10_000
    none = pd.DataFrame([(1, 9000, 1, None, None, None, None)], columns=names)
    state = State()
    assert [*run((None,), iter([none]), state)][0].iloc[0].tolist() == [None, 9000, 1, None, None, None, None, 1, False]
    state.hasTimedOut, state.remove = True, lambda: None
    assert [*run((None,), iter([none]), state)][0].iloc[0].tolist() == [None, 9000, 1, None, None, None, None, 1, True]
