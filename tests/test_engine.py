"""Session, settings, files, blocked layout and stream."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.conf import EngineConf
from lattica.operators import blocked, numeric
from lattica.operators import entries as e
from lattica.session import SpdSession
from lattica.sources import files
from lattica.streaming.refactor import stream_logdets


def laplacian(n, extra=()):
    rows = [(k, k, 3.0 + 2 * len(extra)) for k in range(n)] + [(k, k - 1, -1.0) for k in range(1, n)] + [(i, j, -1.0) for i, j in extra]
    a = np.zeros((n, n))
    for i, j, v in rows:
        a[i, j] = a[j, i] = v
    return rows, a


def frame(spark, rows, name="a"):
    return spark.createDataFrame([(name, i, j, v) for i, j, v in rows], "matrix_id string, i long, j long, v double")


def test_conf():
    c = EngineConf().with_(tile_size=32)
    assert c.tile_size == 32 and c.reset("tile_size") == EngineConf() and c.reset() == EngineConf()
    for bad in ({"tile_size": 0}, {"orderings": "best"}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            EngineConf(**bad)
    with pytest.raises(TypeError):
        EngineConf(tile_size="64")


def test_session(spark):
    rows, a = laplacian(12, [(7, 2), (11, 0)])
    pattern = spark.createDataFrame([("a", p, i, j) for p, (i, j, _) in enumerate(rows)], "matrix_id string, pos long, i long, j long")
    values = spark.createDataFrame([("a", c, p, v * (c + 1)) for c in (0, 1) for p, (_, _, v) in enumerate(rows)], "matrix_id string, call_id long, pos long, v double")
    s = SpdSession(spark).assign_pattern(pattern).assign_values(values)
    expected = np.linalg.slogdet(a)[1]
    got = {r.call_id: r.logdet for r in s.logdets().collect()}
    assert got[0] == pytest.approx(expected) and got[1] == pytest.approx(expected + 12 * np.log(2))
    assert s.analyse().first()["status"] == "ok" and s.call_counts().first()["calls"] == 2
    z = {(r.i, r.j): r.z for r in s.inverse().where("call_id = 0").collect()}
    inverse = np.linalg.inv(a)
    assert z and all(v == pytest.approx(inverse[k]) for k, v in z.items())
    row = s.inverse_rows(spark.createDataFrame([("a", 0, 7)], "matrix_id string, call_id long, node long")).collect()
    assert {r.j for r in row} >= {2, 6, 7, 8}
    s.alias_call("a", 9, "a", 1)
    assert {r.call_id for r in s.logdets().collect()} == {0, 1, 9}
    order = spark.createDataFrame([("a", k, 11 - k) for k in range(12)], "matrix_id string, old_id long, new_id long")
    s.assign_order(order)
    assert {(r.old_id, r.new_id) for r in s.permutation().collect()} == {(k, 11 - k) for k in range(12)}
    assert s.summary().where("call_id = 0").first()["logdet"] == pytest.approx(expected)
    with pytest.raises(ValueError):
        s.assign_order(order.where("new_id <> 3"))
    assert s.memory(1e9).where("fits").count() == 2 and s.timing_report().count() >= 1
    s.close()
    with pytest.raises(RuntimeError):
        s.entries()


def test_solve_without_factor_is_null(spark):
    f = numeric.cholesky(frame(spark, [(0, 0, -1.0)]))
    rhs = spark.createDataFrame([("a", 0, 0, 0, 1.0)], "matrix_id string, call_id long, rhs_id long, i long, b double")
    assert numeric.solve(f, rhs).first()["x"] is None and numeric.summary(f).first()["status"] == "not_spd"
    with pytest.raises(ValueError):
        numeric.solve(f, rhs, "sideways")


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    f = numeric.cholesky(none)
    assert f.isEmpty() and numeric.logdet(none).isEmpty() and numeric.selected_inverse(f).isEmpty()
    assert e.expand(none).isEmpty() and e.graph_statistics(none).isEmpty() and e.tiles(none, 4).isEmpty()


def test_duplicates_last_wins(spark):
    raw = spark.createDataFrame([("a", 0, 0, 1, 5.0), ("a", 1, 1, 0, 7.0), ("a", 2, 0, 0, 1.0)], "matrix_id string, pos long, i long, j long, v double")
    assert {(r.i, r.j, r.v) for r in e.dedupe_last(raw).collect()} == {(1, 0, 7.0), (0, 0, 1.0)}


@pytest.mark.parametrize("size", [3, 8, 64])
def test_blocked(spark, size):
    rows, a = laplacian(29, [(20, 3), (28, 10), (15, 14)])
    rows = list({(i, j): (i, j, v) for i, j, v in rows}.values())
    factor, place = blocked.blocked_cholesky(frame(spark, rows).select("i", "j", "v"), 29, EngineConf(tile_size=size))
    assert blocked.blocked_logdet(factor).first()[0] == pytest.approx(np.linalg.slogdet(a)[1])
    assert sorted(place.tolist()) == list(range(len(place)))
    bad = [(i, j, -v if i == j == 28 else v) for i, j, v in rows]
    factor, _ = blocked.blocked_cholesky(frame(spark, bad).select("i", "j", "v"), 29, EngineConf(tile_size=size))
    assert blocked.blocked_logdet(factor).first()[0] is None


def test_matrix_market(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/one.mtx", "w") as f:
        f.write("%%MatrixMarket matrix coordinate real symmetric\n% note\n\n3 3 4\n1 1 2.5\n1 2 -1\n2 2 2e0\n3 3 1\n")
    with open(f"{folder}/two.mtx", "w") as f:
        f.write("%%MatrixMarket matrix coordinate pattern symmetric\n1 1 1\n1 1\n")
    got = {(r.matrix_id, r.i, r.j, r.v) for r in files.read_matrix_market(spark, f"{folder}/*.mtx").collect()}
    assert got == {("one", 0, 0, 2.5), ("one", 1, 0, -1.0), ("one", 1, 1, 2.0), ("one", 2, 2, 1.0), ("two", 0, 0, 1.0)}
    with open(f"{folder}/bad.mtx", "w") as f:
        f.write("2 3 1\n1 1 1\n")
    with pytest.raises(Exception, match="not square"):
        files.read_matrix_market(spark, f"{folder}/bad.mtx").collect()


def test_binary_files(spark):
    rows, _ = laplacian(5)
    content = files.to_binary(frame(spark, rows)).first()["content"]
    folder = tempfile.mkdtemp()
    head = np.array([5, 9], "<f8").tobytes()
    for name, body in (("ints", bytes(content)), ("doubles", head + bytes(content)[8:])):
        with open(f"{folder}/{name}.bin", "wb") as f:
            f.write(body)
    got = files.read_binary(spark, folder)
    for name in ("ints", "doubles"):
        assert {(r.i, r.j, r.v) for r in got.where(F.col("matrix_id") == name).collect()} == set(rows)


def test_stream(spark):
    rows, a = laplacian(6)
    pattern = spark.createDataFrame([("a", p, i, j) for p, (i, j, _) in enumerate(rows)], "matrix_id string, pos long, i long, j long")
    folder = tempfile.mkdtemp()
    values = spark.createDataFrame([("a", c, p, v * (c + 1)) for c in range(3) for p, (_, _, v) in enumerate(rows)], "matrix_id string, call_id long, pos long, v double")
    values.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(values.schema).parquet(f"{folder}/in")
    stream_logdets(stream, pattern, f"{folder}/out", f"{folder}/check").awaitTermination()
    got = {r.call_id: r.logdet for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {c: pytest.approx(np.linalg.slogdet(a)[1] + 6 * np.log(c + 1)) for c in range(3)}
    assert os.path.isdir(f"{folder}/check")
