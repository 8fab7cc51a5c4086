"""A task adds up the k-mers that its texts share before it hands them on."""

import numpy as np
import pytest

from tidemark.llm import near


@pytest.mark.parametrize("most", [1, 40, 1000, 10**6])
def test_kmers_that_texts_of_a_task_share_go_out_once(most):
    rng = np.random.default_rng(9)
    shared = rng.integers(-(2**62), 2**62, 50)
    parts, want = [], {}
    for node in range(100, 0, -1):
        k = np.concatenate([shared, rng.integers(-(2**62), 2**62, 2)])
        parts.append(np.stack([k, np.ones_like(k), np.full_like(k, node), np.full_like(k, 50 + node % 3)]))
        for x in k.tolist():
            n, least, size = want.get(x, (0, node, 99))
            want[x] = (n + 1, min(least, node), min(size, 50 + node % 3))
    out = list(near._added_up(iter(parts), most))
    got = {}
    for x, texts, node, size in np.concatenate(out, axis=1).T.tolist():
        n, least, smallest = got.get(x, (0, node, size))
        got[x] = (n + texts, min(least, node), min(smallest, size))
    assert got == want
    if most >= 1000:
        assert sum(x.shape[1] for x in out) == 250
    assert not list(near._added_up(iter([]), most))


def test_counted_kmers_leave_the_tasks_added_up(spark, monkeypatch):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, f"x{i}", f"y{i}"]), i) for i in range(50)]
    made = []
    monkeypatch.setattr(near, "written", lambda df, name: made.append((name, df)) or df.localCheckpoint())
    got = near.rare_pairs(spark.createDataFrame(rows, "node bigint, text string, label bigint").coalesce(1), near.SIMILARITY).collect()
    assert len(got) == 50 * 49 // 2
    assert [name for name, _ in made][:2] == ["left", "counted"]
    counts = sorted(r.texts for r in dict(made)["counted"].collect())
    assert counts == [1] * 100 + [50] * 56
