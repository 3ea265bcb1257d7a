"""Windows that no other can equal are left out before the sort; the others all stay."""
import numpy as np

from tapeloom.llm.prefix_free import _maybe_repeated


def test_only_windows_that_may_repeat_are_sorted():
    keys = np.random.default_rng(5).integers(0, 2**64, 50_000, dtype=np.uint64)
    keys[40_000:41_000] = keys[:1_000]
    kept = _maybe_repeated(keys)
    assert set(range(1_000)) | set(range(40_000, 41_000)) <= set(kept.tolist())
    assert len(kept) < 20_000 and (np.diff(kept) > 0).all()
    assert _maybe_repeated(keys[:0]).tolist() == [] and _maybe_repeated(keys[:1]).tolist() == []
    assert _maybe_repeated(np.array([7, 7], dtype=np.uint64)).tolist() == [0, 1]
