"""Stretches of suffixes that are equal in their first bytes."""

import numpy as np

from skyloom.llm import suffixes


def test_strings_that_equal_no_other_take_no_leaf(monkeypatch):
    rng, added, whole = np.random.default_rng(5), [], suffixes.BlindTrie.add
    monkeypatch.setattr(suffixes.BlindTrie, "add", lambda self, *a: (added.append(1), whole(self, *a))[1])
    span, head = 50, b"x" * suffixes.SHALLOW
    segments = [head + rng.integers(97, 123, span - suffixes.SHALLOW, dtype=np.uint8).tobytes() for _ in range(300)]
    same = [7, 8, 9, 250]
    for i in same[1:]:
        segments[i] = segments[same[0]]
    segments[20] = segments[21][:-1] + b"A"  # one byte apart
    groups, owners = np.repeat([0, 1], [200, 100]), np.arange(300)[::-1]
    masks = suffixes.equal_strings(groups, segments, span, owners)
    assert np.flatnonzero(masks).tolist() == [7, 8]  # 9 has the least owner of its group, and 250 is of another one
    assert len(added) == 3
