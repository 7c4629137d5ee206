"""File formats and streams."""

import numpy as np

from cohortweave.sources import files
from cohortweave.streaming.activity import running_runs


def test_arrays_and_text(spark, tmp_path):
    ts = np.arange(12.0).reshape(4, 3)
    (tmp_path / "ts").mkdir()
    np.save(tmp_path / "ts" / "sub-01_bold.npy", ts)
    got = {(r["subject"], r["t"], r["roi"]): r["v"] for r in files.read_timeseries(spark, str(tmp_path / "ts")).collect()}
    assert len(got) == 12 and got["sub-01", 3, 2] == 11
    (tmp_path / "m").mkdir()
    np.savez(tmp_path / "m" / "sub-02_fc.npz", np.array([[1, 2.0], [4.0, np.nan]]))
    assert [tuple(r) for r in files.read_matrices(spark, str(tmp_path / "m")).collect()] == [("sub-02", 0, 1, 3.0)]
    (tmp_path / "sub-03_sc.csv").write_text("0,2,4\n2,0,6\n4,6,0\n")
    assert sorted(tuple(r) for r in files.read_csv_matrix(spark, str(tmp_path / "sub-03_sc.csv")).collect()) == [("sub-03", 0, 1, 2.0), ("sub-03", 0, 2, 4.0), ("sub-03", 1, 2, 6.0)]
    (tmp_path / "sub-04_confounds.tsv").write_text("framewise_displacement\tx\nn/a\t1\n0.2\t1\n0.4\t1\n")
    r = files.read_confounds(spark, str(tmp_path / "sub-04_confounds.tsv")).first()
    assert r["subject"] == "sub-04" and abs(r["mean_fd"] - 0.3) < 1e-12
    (tmp_path / "a.txt").write_text("1 2\n0 3\n")
    (tmp_path / "w.txt").write_text("0.5\n1.5\n")
    assert sorted((x["a"], x["b"], x["w"]) for x in files.read_streamlines(spark, str(tmp_path / "a.txt"), str(tmp_path / "w.txt")).collect()) == [(0, 3, 1.5), (1, 2, 0.5)]


def test_running_runs(spark, tmp_path):
    for k, rows in enumerate([[(0, 0, 1), (0, 1, 1)], [(0, 2, 0), (0, 3, 2)], [(0, 4, 0)]]):
        spark.createDataFrame(rows, "subject long, t long, act long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = running_runs(spark.readStream.schema("subject long, t long, act long").parquet(str(tmp_path / "in")))
        s = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        s.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0, 2, 2), (0, 3, 2, 1)]
