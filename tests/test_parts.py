"""Matrices worked on part by part give what they give whole; kernels that must not slow down on hubs and loose nodes."""

import time

import numpy as np
import pytest

from lattica import queries
from lattica.functions import kernels
from lattica.functions import orderings as o
from lattica.functions import symbolic as s
from lattica.operators import numeric, parts


@pytest.fixture(scope="module")
def loose(spark):
    """Three components with nodes between each other's, in matrix a; a matrix b of one; a gap in c; a bad row in d."""
    rows = [("a", i, i, 5.0) for i in range(12)] + [("a", i, i - 3, -1.0) for i in range(3, 12)] + [("a", 9, 0, -0.5)]
    rows += [("b", i, i, 3.0) for i in range(5)] + [("b", i, i - 1, -1.0) for i in range(1, 5)]
    rows += [("c", i, i, 2.0) for i in (0, 1, 3)] + [("d", i, i, 2.0) for i in range(4)] + [("d", 1, 3, 1.0)]
    a = spark.createDataFrame(rows, "matrix_id string, i long, j long, v double")
    nodes = parts.nodes_of(a, size=4, links=7)
    return a, parts.mark(a, nodes), nodes


def test_parts_are_components(loose):
    _, split, nodes = loose
    got = {(r.matrix_id, r.i): (r.part, r.first) for r in nodes.collect()}
    assert {i: got["a", i] for i in range(12)} == {i: (i % 3, 4 * (i % 3)) for i in range(12)}
    assert len(got) == 12 + 5 + 3 + 4 and split.where("part IS NULL").isEmpty()


def test_parts_give_whole_answers(loose):
    a, split, nodes = loose
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    columns = ["matrix_id", "n", "logdet", "status"]
    assert {r.status for r in numeric.logdet(a).collect()} == {"ok", "not_spd", "bad_index"}
    assert rows(numeric.logdet(split).select(*columns).fillna(0)) == rows(numeric.logdet(a).select(*columns).fillna(0))
    fine = lambda df: df.where("matrix_id IN ('a', 'b')")
    assert rows(numeric.factor_pattern(fine(split))) == rows(numeric.factor_pattern(fine(a)))
    x = queries.known(fine(a), 2)
    b = queries.rhs_of(fine(a), x)
    f = numeric.cholesky(fine(split))
    assert rows(numeric.solve(f, parts.mark(b, nodes))) == rows(x.select("matrix_id", "call_id", "rhs_id", "i", "x"))
    pick = lambda z: z.where("i = j").select("matrix_id", "i", "z")
    assert rows(pick(numeric.selected_inverse(f))) == rows(pick(numeric.selected_inverse(numeric.cholesky(fine(a)))))
    own = numeric.orderings(fine(split), queries.ORDERS).where("matrix_id = 'a'").collect()
    for name in queries.ORDERS:
        assert sorted(r.old_id for r in own if r.ordering == name) == sorted(r.new_id for r in own if r.ordering == name) == list(range(12))


def test_large_queries_work_by_parts(spark, sf_dir):
    """No task of these gets a matrix whole."""
    for name in ("logdet_graph", "fill_bipartite", "inverse_vs_solve", "ordering_choice", "ordering_valid"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "part" in plan, name
    assert queries.QUERIES["fill_bipartite"](spark, sf_dir).exceptAll(numeric.factor_pattern(queries.d2(spark, sf_dir)).where("i <> j")).isEmpty()


def test_counts_and_degrees_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 90))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 4 * n))))
        g = o.Graph(n, i, j)
        assert (o._minimum_degree_sets(g) == o.minimum_degree(g)).all() and (o._minimum_degree_sets(g) == o.minimum_degree(g, 64)).all()
        starts, cols = s.lower_csr(n, i, j)
        parent = s.elimination_tree(n, starts, cols)
        assert s.column_counts(n, starts, cols, parent).tolist() == [len(x) + 1 for x in s.fill_pattern(n, starts, cols, parent)]


def test_orderings_of_hubs_take_seconds():
    """4,000 nodes with 30 of 300 hubs each (minimum degree took minutes), 6,000 loose pairs, and a factor of 12 million entries."""
    rng = np.random.default_rng(1)
    i, j = 4000 + rng.integers(0, 300, 120_000), np.repeat(np.arange(4000), 30)
    began = time.process_time()
    assert sorted(o.minimum_degree(o.Graph(4300, i, j)).tolist()) == list(range(4300))
    assert sorted(o.nested_dissection(o.Graph(12_000, np.arange(0, 12_000, 2), np.arange(1, 12_000, 2))).tolist()) == list(range(12_000))
    n = 5000
    starts, cols = s.lower_csr(n, np.concatenate((np.arange(1, n), np.full(n - 1, n - 1))), np.concatenate((np.zeros(n - 1, int), np.arange(n - 1))))
    assert s.column_counts(n, starts, cols, s.elimination_tree(n, starts, cols)).sum() == n * (n + 1) // 2
    assert time.process_time() - began < 20


def _links(parts: int, hubs: int, each: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A connected graph of parts with each links to hubs, as entries of a definite matrix: all hubs fill in."""
    rng = np.random.default_rng(2)
    keys = np.unique(np.repeat(np.arange(parts), each) * hubs + rng.integers(0, hubs, parts * each))
    i, j, n = parts + keys % hubs, keys // hubs, parts + hubs
    diagonal = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1.0
    return n, np.concatenate((i, np.arange(n))), np.concatenate((j, np.arange(n))), np.concatenate((-np.ones(len(i)), diagonal))


def test_connected_graph_holds_one_square_of_its_hubs():
    """fronts of the 1,200 hubs (11.5 MB square, 10 fronts) share one buffer; they took a square each, in factor and inverse."""
    import tracemalloc

    n, i, j, v = _links(3000, 1200, 12)
    symbolic = kernels.analyse(n, i, j, ["dense_last"], dense_below=1)
    assert len(symbolic.fronts) > 2000
    tracemalloc.start()
    factor = kernels.factorise(symbolic, i, j, v)
    probes = np.arange(7, n, 131)
    x, z, z_all = factor.solve_at(probes, probes, np.ones(len(probes))), np.empty(n), 0
    for k, block in factor.inverse_fronts():
        f = symbolic.fronts[k]
        z[symbolic.order[f.first : f.last]] = np.diagonal(block)[: f.last - f.first]
        z_all += block.nbytes
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 < z_all
    dense = np.zeros((n, n))
    dense[i, j] = dense[j, i] = v
    exact = np.linalg.inv(dense[3000:, 3000:] - dense[3000:, :3000] / np.diagonal(dense)[:3000] @ dense[:3000, 3000:])
    assert np.allclose(z[3000:], np.diagonal(exact)) and np.allclose(x, z[probes])


def test_diagonal_two_ways(spark, loose):
    a, split, _ = loose
    fine = lambda df: df.where("matrix_id IN ('a', 'b')")
    own = {(r.matrix_id, r.i): (r.x, r.z) for r in numeric.diagonal_two_ways(fine(split), queries.F.col("i") % 2 == 1).collect()}
    z = {(r.matrix_id, r.i): r.z for r in numeric.selected_inverse(numeric.cholesky(fine(a)), diagonal=True).collect() if r.i % 2}
    assert own.keys() == z.keys() and all(abs(x - z[k]) < 1e-12 and abs(y - z[k]) < 1e-12 for k, (x, y) in own.items())


def test_symbolic_analysis_is_compact():
    """tree and counts take a few tens of bytes an entry (lists of Python numbers took over a hundred), graph included."""
    import tracemalloc

    n, i, j, _ = _links(20_000, 2_000, 30)
    i, j = i.astype(np.int32), j.astype(np.int32)
    tracemalloc.start()
    g = o.Graph(n, i, j)
    counts = kernels.tree_under(g, np.arange(n))[1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 75 * len(i) + 60 * n, most / len(i)
    assert counts[:20_000].sum() == len(i) - 2_000 and counts[-1] == 1


def test_many_nodes_are_not_broadcast(spark):
    """300,000 nodes were collected in the driver to be sent to all tasks."""
    nodes = spark.range(300_000).selectExpr("'a' AS matrix_id", "id AS i", "0L AS part", "0L AS first")
    own = parts.mark(nodes.select("matrix_id", "i"), nodes)
    assert "broadcast" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.where("part IS NULL").isEmpty()
