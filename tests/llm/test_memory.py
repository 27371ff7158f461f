"""What a Python worker holds at once, whatever the number and length of the rows that a task reads."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loadproof.llm import jaccard


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts_of(n, words):
    return [" ".join(f"w{(i * words + k) * 7919 % 1_000_003}" for k in range(words)) for i in range(n)]


def test_hashing_takes_texts_in_small_pieces(monkeypatch):
    monkeypatch.setattr(jaccard, "_POWERS", [np.empty(0, np.uint64), np.empty(0, np.uint64)])
    texts = texts_of(1500, 400)
    assert peak_mb(lambda: sum(len(s) for s in jaccard.shingle_sets(texts))) < 30
    whole = list(jaccard.shingle_sets(texts, 1 << 30))
    assert all(np.array_equal(a, b) for a, b in zip(jaccard.shingle_sets(texts), whole, strict=True))


def test_a_run_of_postings_is_small():
    batches = [pa.record_batch([pa.array(range(k, k + 500)), pa.array(texts_of(500, 2000))], names=["sid", "text"]) for k in range(0, 3000, 500)]
    most = []
    assert peak_mb(lambda: most.extend(b.num_rows for b in jaccard._reported(iter(batches)))) < 80
    assert max(most) < 600_000 < sum(most)


def test_postings_of_a_run_are_a_row_a_bucket():
    # rows of one posting each cost the engine several times what their bytes do
    texts = texts_of(300, 60)
    batches = [pa.record_batch([pa.array([*range(300), *range(500, 550)]), pa.array(texts + texts[:50])], names=["sid", "text"])]
    rows = list(jaccard._packed(jaccard._reported(iter(batches)), 24))
    assert sum(r.num_rows for r in rows) <= 25
    met = [r for part in range(3) for r in jaccard._met(iter([b.filter(pa.array([x % 3 == part for x in b.column(0).to_pylist()])) for b in rows]))]
    shared, size = {}, {}
    for r in met:
        for sid, c, n in zip(*(x.to_pylist() for x in r.columns), strict=True):
            shared[sid], size[sid] = shared.get(sid, 0) + c, max(size.get(sid, 0), n)
    prefix = jaccard._prefix(56)
    assert shared == {s: prefix if s < 50 or s >= 500 else 0 for s in size} and set(size.values()) == {56} and len(size) == 350


def test_tokens_are_counted_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKETS", 2)
    sets = [[1, 2, 3], [2, 3, 1 << 59], [3, 7, 1 << 59], [], [9]]
    rows = spark.createDataFrame([(s,) for s in sets], "tokens array<long>")
    assert {tuple(r) for r in jaccard._counts(rows.repartition(4), 3).collect()} == {(2, 2), (3, 3), (1 << 59, 2)}
    assert jaccard._counts(rows.where("false"), 3).count() == 0
