"""Nearest centres: the same as the full matrix of distances, without making it."""
import tracemalloc

import numpy as np

from clientele.operators import kmeans as K


def test_nearest_equals_the_distance_matrix():
    rng = np.random.default_rng(8)
    x, centers = np.round(rng.normal(size=(3000, 3)), 1), np.round(rng.normal(size=(9, 3)), 1)
    centers[7] = centers[2]  # a tie goes to the first
    full = ((x[:, None, :] - centers) ** 2).sum(axis=2)
    at, far = K.nearest(np.ascontiguousarray(x.T), centers)
    assert (at == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all() and 7 not in at
    assert (K.Clusters(centers, 0.0).nearest(x) == at).all()


def test_temporaries_do_not_grow_with_the_centres():
    columns = np.ascontiguousarray(np.random.default_rng(1).normal(size=(8192, 3)).T)
    tracemalloc.start()
    K.nearest(columns, columns.T[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8192 * 8
