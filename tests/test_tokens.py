"""One-shot tokens over several micro-batches."""

import datetime as dt
import os
import shutil

from tesserae.streaming import tokens as T

ROWS = "token long, ts timestamp, action string"
BEGIN = dt.datetime(2024, 5, 1, 12)


def landed(spark, folder, batches):
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(t, BEGIN + dt.timedelta(minutes=m), a) for t, m, a in rows], ROWS).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet"))
        shutil.move(f"{folder}/tmp{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_tokens_over_batches(spark, tmp_path):
    """A second use, a late use, one of no known token, an expiry, rows behind the stream, and a purge after which a token is unknown."""
    batches = [
        [(1, 0, "issue"), (2, 0, "issue"), (3, 1, "issue"), (1, 5, "use"), (9, 3, "use"), (4, 2, "issue"), (4, 2, "use")],
        [(1, 6, "use"), (2, 15, "use"), (3, 15, "use"), (5, 20, "issue"), (3, 14, "issue")],
        [(6, 200, "issue")],
        [(6, 201, "use"), (6, 202, "use")],
        [(5, 21, "use"), (7, 1600, "issue")],  # 21 is behind the stream by then
        [(1, 1600, "use"), (7, 1601, "use")],
    ]
    got, dropped = T.run_tokens(T.one_shot(landed(spark, str(tmp_path), batches)), spark, f"file://{tmp_path}/work")
    rows = sorted((r.token, round((r.moment - BEGIN).total_seconds() / 60), r.outcome) for r in got.collect())
    assert dropped == 1
    assert rows == sorted([
        (1, 0, "issued"), (1, 5, "used"), (1, 6, "used before"), (1, 1440, "purged"), (1, 1600, "unknown"), (2, 0, "issued"), (2, 15, "too late"), (2, 15, "expired"), (2, 1440, "purged"), (3, 1, "issued"), (3, 15, "used"), (3, 1441, "purged"),
        (4, 2, "issued"), (4, 2, "used"), (4, 1442, "purged"), (5, 20, "issued"), (5, 35, "expired"), (5, 1460, "purged"), (6, 200, "issued"), (6, 201, "used"), (6, 202, "used before"), (7, 1600, "issued"), (7, 1601, "used"), (9, 3, "unknown"),
    ])


def test_a_restart_goes_on(spark, tmp_path):
    """The state outlives the query: a use after a restart is the second one."""
    stream = landed(spark, str(tmp_path), [[(1, 0, "issue"), (1, 1, "use")]])
    T.run_tokens(T.one_shot(stream), spark, f"file://{tmp_path}/work")
    spark.createDataFrame([(1, BEGIN + dt.timedelta(minutes=2), "use")], ROWS).coalesce(1).write.parquet(f"{tmp_path}/more")
    part = next(f for f in os.listdir(f"{tmp_path}/more") if f.endswith(".parquet"))
    shutil.move(f"{tmp_path}/more/{part}", f"{tmp_path}/in/9.parquet")
    got, _ = T.run_tokens(T.one_shot(stream), spark, f"file://{tmp_path}/work")
    assert sorted(r.outcome for r in got.collect()) == ["issued", "used", "used before"]
