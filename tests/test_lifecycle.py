"""Failures, replays and expiry of reports in a stream of micro-batches."""

from datetime import datetime, timedelta

import pytest

from weftmatch.streaming.lifecycle import lifecycle

SCHEMA = "report long, at timestamp, kind string, is_sample boolean, overlap double"
DAY = datetime(2024, 3, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


@pytest.fixture()
def run(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(rows, name, fail=False):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = lifecycle(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), kept_days=2)

        def store(batch, number):
            if fail:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{name}-{number}")

        query = out.writeStream.foreachBatch(store).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        found = sorted(p for p in (tmp_path / "out").glob(f"{name}-*")) if (tmp_path / "out").exists() else []
        return [tuple(r) for p in found for r in spark.read.parquet(str(p)).select("report", "status", "attempts", "scoring", "stale_scoring", "overlap").orderBy("report", "at").collect()]

    yield go
    spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def test_life_of_reports(run):
    first = run([(1, at(0), "submitted", False, None), (1, at(1), "failed", False, None), (2, at(0), "submitted", True, None), (1, at(2), "scored", False, 40.0), (9, at(1), "scored", False, 1.0), (None, at(1), "scored", False, 1.0)], "a")
    assert first == [(1, "waiting", 0, 0, None, None), (1, "waiting", 1, 0, None, None), (1, "done", 0, 1, None, 40.0), (2, "waiting", 0, 0, None, None)]
    # the same events again, and an older one, change nothing; three failures end a job
    second = run([(1, at(2), "scored", False, 40.0), (1, at(1), "failed", False, None), *[(2, at(3 + i), "failed", True, None) for i in range(3)]], "b")
    assert second == [(2, "waiting", 1, 0, None, None), (2, "waiting", 2, 0, None, None), (2, "failed", 3, 0, None, None)]
    # another scoring makes what was marked for the first one stale; a batch that is lost is done again
    third = [(1, at(5), "scored", False, 42.0)]
    with pytest.raises(Exception):  # noqa: B017
        run(third, "c", fail=True)
    assert run([(3, at(5), "submitted", False, None)], "d")[0] == (1, "done", 0, 2, 1, 42.0)
    # time passes: report 1 expires by its timer, the sample 2 does not, and what comes for an expired one is not known
    run([(4, at(60), "submitted", False, None)], "e")
    later = run([(4, at(61), "scored", False, 3.0)], "f") + run([(1, at(62), "scored", False, 5.0)], "g")
    assert not [r for r in later if r[0] == 2 or r[:2] == (1, "done")]


def test_expiry(run):
    run([(1, at(0), "submitted", False, None), (1, at(1), "scored", False, 9.0), (2, at(0), "submitted", True, None)], "a")
    found = run([(3, at(60), "submitted", False, None)], "b") + run([(3, at(61), "scored", False, 1.0)], "c")
    assert (1, "expired", 0, 1, 1, None) in found and not [r for r in found if r[0] == 2]
