import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from driftline.llm import language_id, storage


def test_language_id_holds_a_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(language_id, "beside_rows", lambda docs, id_col, whole_rows, columns, run, found: run)
    r = np.random.default_rng(5)
    centroids = r.random((8, language_id.BUCKETS), dtype=np.float32)
    model = language_id.LanguageModel(list("abcdefgh"), np.ones(language_id.BUCKETS, np.float32), centroids, np.arange(8), np.full(40, np.inf))
    text = pa.array([bytes(x).decode() for x in r.integers(97, 123, (500, 3000), np.uint8)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), text, pa.array([True] * 500)], names=["doc_id", "_0", "_1"])
    run = language_id.identify(spark, None, model)
    rows = sum(b.num_rows for b in run(iter([batch])))  # imports and the broadcast model
    tracemalloc.start()
    try:
        rows += sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows == 1000
    assert peak < 20


def _anonymous_mb() -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_worker_gives_back_what_its_tasks_have_freed():
    pins = []

    def run(batches):
        some = [bytes([k % 251]) * 2000 for k in range(60_000)]  # 120 MB in small parts
        pins.append(bytes([7]) * 2000)  # stays, above them
        yield from batches
        del some

    before = _anonymous_mb()
    for _ in range(2):
        assert list(storage.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert _anonymous_mb() - before < 40


def test_a_task_starts_without_what_an_earlier_one_has_freed():
    some, pin = [bytes([k % 251]) * 2000 for k in range(60_000)], bytes([7]) * 2000
    held = _anonymous_mb()
    del some

    def run(batches):
        yield from (held - _anonymous_mb() for _ in batches)

    (given,) = storage.giving_back(run)(iter([0]))
    assert given > 80 and pin
