"""Write jobs of archives: appending, overwriting, attempts that were lost, jobs side by side."""

import pyarrow as pa
import pytest

from clauseworks.llm import warc


def rows(spark, ids):
    return spark.createDataFrame([(str(i), "response", "u", b"p%d" % i) for i in ids], "record_id string, record_type string, target_uri string, payload binary").repartition(3)


def ids(spark, path):
    return sorted(int(r.record_id) for r in warc.read_archives(spark, path).select("record_id").collect())


def test_append_then_overwrite(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    rows(spark, range(5)).write.format("warc").mode("append").save(path)
    rows(spark, range(5, 9)).write.format("warc").mode("append").save(path)
    assert ids(spark, path) == list(range(9))
    rows(spark, [20, 21]).write.format("warc").mode("overwrite").save(path)
    assert ids(spark, path) == [20, 21]
    assert len(list((tmp_path / "w").iterdir())) == 1
    rows(spark, []).write.format("warc").mode("overwrite").save(path)
    assert ids(spark, path) == []


def batch(*names):
    return pa.RecordBatch.from_pylist([{"record_id": n, "record_type": "response", "target_uri": "u", "payload": b"x"} for n in names])


def test_lost_attempts_and_jobs_side_by_side(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    a, b = warc.WarcWriter({"path": path}), warc.WarcWriter({"path": path})
    a.write(iter([batch("1")]))  # an attempt whose message never came
    done = a.write(iter([batch("2", "3")]))
    other = b.write(iter([batch("4")]))
    assert ids(spark, path) == []
    b.abort([other])
    a.commit([done, None])
    assert ids(spark, path) == [2, 3]


def test_an_overwriting_job_that_fails_takes_nothing_away(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    a = warc.WarcWriter({"path": path})
    a.commit([a.write(iter([batch("1")]))])
    b = warc.WarcWriter({"path": path}, overwrite=True)
    b.write(iter([batch("2")]))
    b.abort([None])
    assert ids(spark, path) == [1]


@pytest.mark.parametrize("kept", [True, False])
def test_other_archives_of_the_folder(spark, tmp_path, kept):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "given.warc.gz").write_bytes(warc.member(warc.record("response", "7", "u", b"x", None, None)))
    path = f"file://{tmp_path}/w"
    w = warc.WarcWriter({"path": path}, overwrite=not kept)
    w.commit([w.write(iter([batch("8")]))])
    assert ids(spark, path) == ([7, 8] if kept else [8])
