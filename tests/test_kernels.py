import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.functions import kernels, orderings, symbolic


def random_matrix(n, m, seed):
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, m), rng.integers(0, n, m)
    keys = np.unique(np.maximum(i, j)[i != j] * n + np.minimum(i, j)[i != j])
    i, j = np.divmod(keys, n)
    v = rng.normal(size=len(i))
    a = np.zeros((n, n))
    a[i, j] = a[j, i] = v
    d = np.abs(a).sum(1) + 1
    a[np.arange(n), np.arange(n)] = d
    return a, np.concatenate((i, np.arange(n))), np.concatenate((j, np.arange(n))), np.concatenate((v, d))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(0, 150), st.integers(0, 10**6), st.sampled_from(sorted(orderings.ORDERINGS)))
def test_factor_solve_inverse(n, m, seed, name):
    a, i, j, v = random_matrix(n, m, seed)
    s = kernels.analyse(n, i, j, [name], dense_below=0, widest=8)
    assert sorted(s.order.tolist()) == list(range(n))
    f = kernels.factorise(s, i, j, v)
    assert f.logdet() == pytest.approx(np.linalg.slogdet(a)[1], abs=1e-8)
    b = np.random.default_rng(1).normal(size=(n, 2))
    assert np.allclose(a @ f.solve(b), b, atol=1e-8)
    assert np.allclose(f.solve(f.solve(b, "forward"), "backward"), f.solve(b))
    inverse = np.linalg.inv(a)
    for front, z in zip(s.fronts, f.selected_inverse(), strict=True):
        every = s.order[np.concatenate((np.arange(front.first, front.last), front.rows))]
        w = front.last - front.first
        assert np.allclose(z[:, :w], inverse[np.ix_(every, every[:w])], atol=1e-8)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 90), st.integers(0, 10**6))
def test_symbolic_against_elimination(n, m, seed):
    _, i, j, _ = random_matrix(n, m, seed)
    starts, cols = symbolic.lower_csr(n, i, j)
    parent = symbolic.elimination_tree(n, starts, cols)
    full = np.zeros((n, n), bool)
    full[i, j] = True
    for k in range(n):
        below = np.flatnonzero(full[k + 1 :, k]) + k + 1
        full[np.ix_(below, below)] |= np.tri(len(below), dtype=bool)
    assert parent.tolist() == [int(np.flatnonzero(full[k + 1 :, k])[0]) + k + 1 if full[k + 1 :, k].any() else -1 for k in range(n)]
    assert symbolic.column_counts(n, starts, cols, parent).tolist() == [int(full[k:, k].sum()) for k in range(n)]
    pattern = symbolic.fill_pattern(n, starts, cols, parent)
    assert all(np.array_equal(p, np.flatnonzero(full[k + 1 :, k]) + k + 1) for k, p in enumerate(pattern))
    post = symbolic.postorder(parent)
    place = np.argsort(post)
    assert sorted(post.tolist()) == list(range(n)) and all(place[k] < place[p] for k, p in enumerate(parent) if p >= 0)


def test_not_positive_definite():
    s = kernels.analyse(2, np.array([0, 1, 1]), np.array([0, 0, 1]), ["identity"])
    with pytest.raises(kernels.NotPositiveDefinite):
        kernels.factorise(s, np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1.0, 2.0, 1.0]))


def test_ordering_reduces_fill_of_an_arrow():
    n = 200
    i, j = np.concatenate((np.arange(n), np.arange(1, n))), np.concatenate((np.arange(n), np.zeros(n - 1, int)))
    worst = kernels.analyse(n, i, j, ["identity"], dense_below=0)
    best = kernels.analyse(n, i, j, ["identity", "min_degree"], dense_below=0)
    assert worst.nnz_l == n * (n + 1) // 2 and best.nnz_l == 2 * n - 1 and best.ordering == "min_degree"
