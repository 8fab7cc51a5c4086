"""Words are looked up once a text, and gradients are summed for all groups at once."""

import numpy as np
import pyarrow as pa

from tidemark.llm import lm
from tidemark.llm.shared import slices


def _orders(rng, sizes, rows):
    """An order of the rows in groups of sizes, and where each group starts."""
    assert sum(sizes) == rows
    return rng.permutation(rows), np.cumsum([0, *sizes[:-1]]), np.array(sizes)


def test_sums_of_all_groups_at_once_are_those_of_each_feature():
    rng = np.random.default_rng(7)
    rows = 6000
    p = rng.normal(size=(rows, lm.WIDTH)).astype(np.float32)
    made = []
    for sizes in ([*range(1, 100)], [1] * 500, [127, 128, 129, 130, 131, 136, 137, 138, 255, 257, 258, 265], [2, 3, 8, 9, 10, 16, 17, 18, 1025, 2049]):
        made.append(_orders(rng, [*sizes, rows - sum(sizes)], rows))
    order, n = np.concatenate([o for o, _, _ in made]), np.concatenate([n for *_, n in made])
    first = np.concatenate([f + rows * i for i, (_, f, _) in enumerate(made)])
    want = np.concatenate([lm._sums(p, *m) for m in made])
    assert np.array_equal(lm._all_sums(p, order, first, n), want)


def test_a_step_sums_no_group_of_a_feature_by_itself(monkeypatch):
    rng = np.random.default_rng(8)
    slots = rng.integers(0, 900, 5000)
    starts = np.arange(0, 5000, 250)
    new = lambda: (np.zeros((lm.ROWS, lm.WIDTH), np.float32), np.zeros(lm.ROWS, np.float32), np.ones(lm.ROWS, np.float32))
    together, alone = new(), new()
    calls = []
    monkeypatch.setattr(lm, "_sums", lambda *a, was=lm._sums: calls.append(a) or was(*a))
    lm.train_on(*together, slots, starts)
    assert not calls
    monkeypatch.setattr(lm, "_all_sums", lambda p, order, first, n: np.concatenate([np.add.reduceat(p[order[a : a + k]], [0], axis=0) for a, k in zip(first, n, strict=True)]))
    lm.train_on(*alone, slots, starts)
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True))


def test_words_are_looked_up_once_a_text(spark, tmp_path):
    texts = ["a b a", None, "", "c  d\x0be é", "b퟿x b", "zz " * 40] * 4
    docs = spark.createDataFrame([(i if i % 5 else None, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean")
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.encode().split()

    training = docs.where("not held_out")
    vocabulary, words = lm.learn_vocabulary(training, words_of=split)
    before = seen.value
    numbered = lm.number(docs, vocabulary, words_of=split)
    looked_up = seen.value - before
    weights = lm.train(numbered.where("not held_out"), vocabulary)
    got = lm.score(numbered, vocabulary, words, weights).collect()
    assert looked_up == len(texts) and seen.value == before + looked_up
    plain = lm.score(docs, vocabulary, words, lm.train(training, vocabulary, words_of=split), words_of=split)
    assert plain.columns == ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    key = lambda rows: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in rows)
    assert key(got) == key(plain.collect())
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").encode().split()) + 1 for t in texts)


def test_slices_by_given_sizes():
    batch = pa.RecordBatch.from_arrays([pa.array([4, None, 7, 1, 30, 2], pa.int32())], names=["size"])
    text = pa.RecordBatch.from_arrays([pa.array(["x" * (n or 0) for n in batch.column(0).to_pylist()])], names=["text"])
    assert [b.num_rows for b in slices(iter([batch]), 0, 10)] == [b.num_rows for b in slices(iter([text]), 0, 10)]
