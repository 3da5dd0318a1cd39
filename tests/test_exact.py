"""The search of all pairs: what it moves, and rows that rough distances can't tell apart."""

import numpy as np
import pytest

from nearfield.operators import exact as X


def test_vectors_move_few_times():
    """Vectors shuffled a row of an exact graph: as many at 50,000 rows as at 200,000, and few at 600,000 (298 in cells of 4,096 by 1,024 rows)."""
    moved = {n: sum(X._blocks(n, n, 12)) for n in (50_000, 200_000, 600_000)}
    assert moved[50_000] == moved[200_000] <= 24 and moved[600_000] <= 40
    assert all(n / min(X._blocks(n, n, 12)) <= X.MOST_ROWS for n in moved)


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
@pytest.mark.parametrize("how", ["far from the origin", "repeats", "large", "with zeros"])
def test_nearest_against_all_distances(monkeypatch, metric, how):
    monkeypatch.setattr(X, "TILE_QUERIES", 16)
    monkeypatch.setattr(X, "TILE_ROWS", 64)
    monkeypatch.setattr(X, "FIRST_ROWS", 32)
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((500, 8))
    rows = {"far from the origin": rows * 1e-3 + 1e4, "repeats": np.repeat(rows[:25], 20, axis=0), "large": rows * 1e25, "with zeros": rows * (np.arange(500) % 3 > 0)[:, None]}[how]
    rows = rows.astype(np.float32).astype(np.float64)
    ids = rng.permutation(500) + 7
    asked = rng.permutation(500)[:60]
    found = X.nearest(metric, ids, rows, ids[asked], rows[asked], 10, True)
    for at in asked:
        far = np.where(ids == ids[at], np.inf, X._exact(metric, rows[at], rows))
        order = np.lexsort((ids, far))
        mine = found[0] == ids[at]
        got = sorted(zip(found[2][mine], found[1][mine]))[:10]
        assert got == [(far[i], ids[i]) for i in order[:10] if far[i] < np.inf]


def test_blocks_of_rows_are_larger_where_their_components_are_bounded():
    """Each block of rows returns k rows a query, so that many of them shuffle more than the vectors do."""
    assert X._blocks(615_000, 615_000, 12, 64)[0] <= 12 < X._blocks(615_000, 615_000, 12, 1024)[0]
    assert all(n / X._blocks(n, n, 12, 64)[0] * 64 <= X.MOST_COMPONENTS for n in (50_000, 200_000, 3_000_000))
