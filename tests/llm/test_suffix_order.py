"""Order of suffixes against sorting them, and how much each round sorts."""

import numpy as np

from gleaner.llm import bwt


def test_order_equals_sorted_prefixes():
    rng = np.random.default_rng(3)
    for n, depth in [(1, 8), (3, 40), (30, 9), (200, 50), (400, 8), (900, 400)]:
        data = rng.integers(97, 99, n).astype(np.uint8)
        data[n // 2 : n // 2 * 2] = data[: n // 2]
        known = bytes(data) * (-(-max(8, depth) // n) + 1)
        prefixes = [known[i : i + max(8, depth)] for i in range(n)]
        assert [prefixes[i] for i in bwt.order_suffixes(data, depth)] == sorted(prefixes)


def test_suffixes_that_are_alone_are_not_sorted_again(monkeypatch):
    rng, sizes, argsort = np.random.default_rng(4), [], np.argsort
    data = rng.integers(0, 255, 5000).astype(np.uint8)
    data[4000:4500] = data[:500]
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or argsort(x, *a, **b))
    bwt.order_suffixes(data, 400)
    assert sizes[0] == 5000 and 0 < sum(sizes[1:]) <= 6 * 1000
