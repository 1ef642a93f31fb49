"""K-means starts worked out side by side against one by one."""

import numpy as np

from probity.operators import cluster


def test_starts_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(3_000, 3)).astype(float)        # many rows halfway between centroids
    starts = {s: x[rng.choice(len(x), size=k)] for s, k in enumerate((2, 5, 2, 3, 5))}
    starts[4][3] = starts[4][1]                                  # the later of two equal centroids stays empty
    for names, k, c in cluster._stacked(starts):
        ones = np.column_stack([x, np.ones(len(x))])
        mine, best = cluster._nearest_of_all((c @ ones.T).reshape(k, len(names), -1))
        for i, s in enumerate(names):
            near, d = cluster.nearest(x, starts[s])
            assert (mine[:, i].sum(axis=0) == 1).all()
            assert np.allclose(np.maximum(best[i] + (x * x).sum(axis=1), 0), d)
            assert (mine[:, i].argmax(axis=0) == near).all()
