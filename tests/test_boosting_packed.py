"""Bins that share a byte, and rows of nodes as lists: the same sums as feature by feature."""
import numpy as np

from clientele.operators import boosting as G

WIDTHS = [255, 2, 1, 7, 2, 256, 2, 2, 40, 2]


def packed(n=400, seed=1):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, w, n) for w in WIDTHS]).astype(np.uint8)
    packing = G.Packing.of(np.append(0, np.cumsum(WIDTHS)))
    return bins, packing, packing.codes(bins), rng


def test_small_features_share_bytes():
    bins, packing, codes, _ = packed()
    assert len(codes) == 4 and sorted(np.bincount(packing.group).tolist()) == [1, 1, 1, 7]  # 2^5 * 7 values and one of a single bin
    for j, width in enumerate(WIDTHS):
        assert (codes[packing.group[j]] // packing.unit[j] % width == bins[j]).all()


def test_sums_of_shared_bytes_equal_sums_by_feature():
    bins, packing, codes, rng = packed()
    g, h, rows = rng.integers(-2**30, 2**30, 400).astype(float), rng.integers(0, 2**28, 400).astype(float), np.arange(3, 390, 2)
    got = packing.sums(codes, rows, g, h)
    for j, width in enumerate(WIDTHS):
        for b in range(width):
            at = rows[bins[j][rows] == b]
            assert got[packing.first[j] + b].tolist() == [g[at].sum(), h[at].sum(), len(at)]


def test_rows_follow_the_splits():
    bins, packing, codes, _ = packed()
    tree = G.Growing([0, 4, 8, -1, -1, -1, -1], [99, 0, 20, 0, 0, 0, 0], [1, 3, 5, -1, -1, -1, -1], [None] * 7, [0.0] * 7, {})
    rows = np.arange(0, 400, 3)
    found = G.rows_of(packing, tree, codes, [3, 6], rows)
    assert found.keys() == {3, 6}
    assert found[3].tolist() == [i for i in rows if bins[0][i] <= 99 and bins[4][i] <= 0]
    assert found[6].tolist() == [i for i in rows if bins[0][i] > 99 and bins[8][i] > 20]
    values = packing.values((np.array(tree.feature), np.array(tree.bin), np.array(tree.child), np.arange(7.0)), codes)
    assert values.tolist() == [(5 + (bins[8][i] > 20)) if bins[0][i] > 99 else 3 + (bins[4][i] > 0) for i in range(400)]


def test_a_million_rows_take_no_job_per_level():
    """1 GB of orders gives fit sets of 1.1 million rows; their boosters are grown whole."""
    assert G.FIT_ROWS >= 60 * 18_700
