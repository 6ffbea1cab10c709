"""The bucketed snapshot and its scheduler: files of untouched buckets stay, failures leave the last commit, runs are logged, caps run on."""

import time

import pytest

from newsloom.streaming.ingest import Scheduler, Store, start

COLUMNS = "id long, link string, title string, published_at string, image_url string, article_text string, fetched_at string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")


def item(i, link, title="t", fetched="f1"):
    return (i, link, title, None, "", "x", fetched)


def files(folder):
    """Data files by bucket, with when they were written."""
    out = {}
    for f in sorted((folder / "items" / "data").glob("v*/bucket=*/*.parquet")):
        out.setdefault(f.parent.name, []).append((f.parent.parent.name, f.name, f.stat().st_mtime_ns))
    return out


def stream(spark, folder, **options):
    return lambda: spark.readStream.schema(COLUMNS).options(**options).parquet(f"file://{folder}/in")


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/items", buckets=16)
    put(spark, tmp_path, [item(i, f"l{i}") for i in range(40)] + [item(99, "l0", "older", "f0")])
    start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    first, rows = files(tmp_path), {r.link: r for r in store.read().collect()}
    assert len(rows) == 40 and rows["l0"].title == "t" and len(first) > 8
    put(spark, tmp_path, [item(500, "l3", "new", "f2"), item(501, "other", "o", "f2")])
    start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    second = files(tmp_path)
    changed = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(changed) <= 2 and all(first[b] == second[b] for b in first if b not in changed)
    rows = {r.link: r for r in store.read().collect()}
    assert len(rows) == 41 and (rows["l3"].id, rows["l3"].title) == (3, "new") and store.versions() == [0, 1]
    assert len(store.read(before=1).collect()) == 40
    log = {r.batch_id: r for r in store.runs().collect()}
    assert (log[0].received, log[0].links, log[0].inserted, log[0].updated, log[0].status) == (41, 40, 40, 0, "success")
    assert (log[1].received, log[1].links, log[1].inserted, log[1].updated, log[1].touched) == (2, 2, 1, 1, len(changed))
    # a third commit lets go of what the first alone held
    put(spark, tmp_path, [item(600, "l3", "newer", "f3")])
    start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    assert store.versions() == [1, 2] and len(store.read().collect()) == 41
    third = files(tmp_path)
    assert all(len(v) <= 2 for v in third.values())


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/items", buckets=8)
    put(spark, tmp_path, [item(i, f"l{i}") for i in range(10)])
    start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    put(spark, tmp_path, [item(50, "l1", "new", "f2"), item(51, "l77")])

    def broken():
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(store, "manifest", lambda *a: broken())
        with pytest.raises(Exception, match="no space"):
            start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    assert store.versions() == [0] and {r.title for r in store.read().collect()} == {"t"}
    start(stream(spark, tmp_path)(), store, f"file://{tmp_path}/cp").awaitTermination()
    rows = {r.link: r.title for r in store.read().collect()}
    assert len(rows) == 11 and rows["l1"] == "new" and store.versions() == [0, 1]
    assert sorted((r.batch_id, r.status, r.error) for r in store.runs().collect()) == [(0, "success", ""), (1, "failed", "no space"), (1, "success", "")]


def test_scheduler_runs_on_at_its_cap_and_waits_otherwise(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/items", buckets=4)
    for i in range(3):
        put(spark, tmp_path, [item(i, f"l{i}")])
    s = Scheduler(stream(spark, tmp_path, maxFilesPerTrigger="1"), store, f"file://{tmp_path}/cp", interval=3600, max_batches=1)
    s.start()
    s.start()

    def until(test):
        for _ in range(600):
            if test():
                return True
            time.sleep(0.2)
        return False

    assert until(lambda: s.state()["batches"] == 3 and not s.state()["is_running"])
    assert {r.link for r in store.read().collect()} == {"l0", "l1", "l2"}
    state = s.state()
    assert state["last_error"] == "" and state["runs"] >= 3 and state["last_tick_at"]
    put(spark, tmp_path, [item(9, "l9")])
    time.sleep(1)
    assert s.state()["batches"] == 3  # it waits for its time
    s.trigger_now()
    assert until(lambda: s.state()["batches"] == 4)
    s.stop(30)
    assert not s._thread.is_alive() and store.read().count() == 4
    bad = Scheduler(lambda: spark.readStream.schema(COLUMNS).parquet(f"file://{tmp_path}/nowhere"), store, f"file://{tmp_path}/cp2", 1)
    assert bad.run_once() is False and bad.state()["last_error"] and not bad.state()["is_running"]
