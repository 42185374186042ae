"""Every window has an anchor near it, also where grams hash to zero."""

import numpy as np

from surveyframe.llm import suffix


def test_grams_of_hash_zero(monkeypatch):
    rng = np.random.default_rng(4)
    length, bounds = 40, np.array([0, 3_000, 3_020, 9_000])
    r, w = suffix.geometry(length)
    plain = suffix.span

    def span(run, start, end):
        h = plain(run, start, end)
        return np.where((end - start == w) & (h % np.uint64(20) == 0), h & np.uint64(0xFFFFFFFF), h)

    monkeypatch.setattr(suffix, "span", span)
    run, at = suffix.symbols(rng.integers(97, 123, 9_000).astype(np.uint8), bounds, False)
    text, p, lo, hi = suffix.anchors(run, at, length)
    owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert owned.tolist() == [*range(0, 3_000 - length + 1), *range(3_020, 9_000 - length + 1)]
    assert (p - lo <= 2 * r - 2).all() and (p >= lo).all()
