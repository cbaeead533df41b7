"""How a forest's passes are cut: into parts of rows, runs of cells and jobs, none of which changes a tree."""
import numpy as np
import pytest

from clientele.operators import blocks as B
from clientele.operators import forest as R
from tests.test_boosting import sample

CONFIG = R.Forest(trees=6, depth=5, min_split=6)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(s, i, int(y), list(map(float, x))) for s, n in ((0, 260), (3, 90)) for i, (x, y) in enumerate(zip(*sample(n, s + 1)))]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("fit_set", "id"))
    return spark.createDataFrame(_cut(B.to_blocks(df).collect(), 32), B.SCHEMA).repartition(3).checkpoint()


def _cut(stored, size):
    for s, n, x, y, key in stored:
        x, y, key = B.matrix(x, n), np.frombuffer(y, np.uint8), np.frombuffer(key, np.int64)
        for lo in range(0, n, size):
            part = slice(lo, lo + size)
            yield s, len(y[part]), bytearray(x[part].tobytes()), bytearray(y[part].tobytes()), bytearray(key[part].tobytes())


def arrays(models):
    return {s: [getattr(m, c).tolist() for c in ("root", "feature", "threshold", "left", "right", "value", "cover", "gain")] for s, m in models.items()}


def test_a_part_joins_the_blocks_of_a_fit_set(blocks):
    assert blocks.count() > 8
    parts = R.binned(blocks, R.distinct_values(blocks)).collect()
    assert sorted((r["fit_set"], r["n"]) for r in parts) == [(0, 260), (3, 90)]


def test_cuts_do_not_change_the_trees(blocks, monkeypatch):
    whole = arrays(R.train(blocks, CONFIG))
    passes, own = [], R._pass
    monkeypatch.setattr(R, "_pass", lambda *a: passes.append(a) or own(*a))
    for name, size in (("PART_ROWS", 100), ("JOB_BYTES", 1 << 13)):
        monkeypatch.setattr(R, name, size)
    assert len(R.binned(blocks, R.distinct_values(blocks)).collect()) > 2
    assert arrays(R.train(blocks, CONFIG)) == whole
    assert len(passes) > 2 * CONFIG.depth  # several jobs a level


def test_runs_of_cells_and_sparse_counts(monkeypatch):
    rng = np.random.default_rng(4)
    sizes, chosen = np.array([40, 3, 900]), np.array([[2, 0], [1, 2], [0, 1]])
    first = R.starts(chosen, sizes)
    monkeypatch.setattr(R, "CELLS", 900)
    runs = R.run_of(chosen, sizes)
    assert runs.tolist() == [0, 0, 1, 1, 2, 2] and first[-1] == 1886
    bins = np.column_stack([rng.integers(0, n, 500) for n in sizes]).astype(np.uint16)
    y, w = rng.integers(0, 2, 500), rng.integers(0, 4, 500)
    # A tree whose root has three levels of children: nodes 3, 4 and 5 are searched at depth 2.
    tree = np.array([0, 1, 2, -1, -1, -1, -1]), np.array([20, 1, 450, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1])
    cells, weight, ones, n = R.count_cells(tree, np.array([3, 4, 5]), chosen, sizes, 2, bins, y, w)
    low, high = bins[:, 0] <= 20, bins[:, 0] > 20
    inside = [low & (bins[:, 1] <= 1), low & (bins[:, 1] > 1), high & (bins[:, 2] <= 450)]
    for slot, rows in enumerate(inside):
        for d, j in enumerate(chosen[slot]):
            for v in range(sizes[j]):
                at = rows & (bins[:, j] == v) & (w > 0)
                found = np.flatnonzero(cells == first[slot * 2 + d] + v)
                got = (weight[found].sum(), ones[found].sum(), n[found].sum())
                assert got == (w[at].sum(), (w * y)[at].sum(), at.sum()) and len(found) == (at.any())
    assert all((R._unpacked(R._packed(x)) == x).all() for x in (cells, weight, n, np.array([70000, 1])))
