"""One call of the quota's Python code serves many users."""

import datetime as dt

import pandas as pd

from wardline.streaming import streams as K


class Stand:
    """State of one key, in place of RocksDB."""

    def __init__(self):
        self.rows, self.timers = {}, []

    def getMapState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):  # noqa: N802
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_one_call_serves_many_users():
    work, stand = K._Quota(2), Stand()
    work.init(stand)
    rows = [(u, t, f"{u}{t}", 1) for u in ("u", "v", None) for t in (3, 1, 2)]
    first = pd.DataFrame(rows, columns=["user_key", "t", "id", "billable"])
    got = pd.concat(work.handleInputRows((0, "2024-01-10"), iter([first[:4], first[4:]]), stand))
    assert {i for i, a in zip(got["id"], got["admitted"]) if a} == {f"{u}{t}" for u in ("u", "v", None) for t in (1, 2)} and len(got) == 9
    assert stand.rows == {("u",): (3,), ("v",): (3,), (None,): (3,)} and len(stand.timers) == 1
    later = pd.DataFrame([("u", 9, "late", 1), ("w", 9, "new", 1)], columns=first.columns)
    got = pd.concat(work.handleInputRows((0, "2024-01-10"), iter([later]), stand))
    assert dict(zip(got["id"], got["admitted"])) == {"late": False, "new": True} and len(stand.timers) == 1


def test_users_share_calls_of_the_quota(spark, tmp_path):
    K.rocksdb_state(spark)
    day = dt.datetime(2024, 1, 10)
    rows = [(f"{u}.{k}", None if u == 7 else f"u{u}", day + dt.timedelta(minutes=k), "ok") for u in range(40) for k in range(4)]
    schema = "id string, user_key string, ts timestamp, status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = K.quota_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit=3, shares=2)
    K.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id for r in out.filter("admitted").collect()} == {f"{u}.{k}" for u in range(40) for k in range(3)}
    assert out.count() == 160 and out.filter("user_key is null").count() == 4
