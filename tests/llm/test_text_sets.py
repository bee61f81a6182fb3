import re

import numpy as np
import pyarrow as pa

from driftline.llm import textvec
from driftline.llm.components import connected_components
from driftline.llm.jaccard_join import jaccard_components, linked, prefix, sketch
from driftline.llm.storage import Workspace


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def shingle_set(text, size):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def jaccard_links(rows, size, num, den):
    sets = {i: shingle_set(t, size) for i, t in rows}
    ids = sorted(sets)
    return sets, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def test_words_and_shingles_match_plain_code(corpus):
    texts = [t for _, t in corpus]
    for size in (1, 4):
        found = []
        for s in textvec.slices(pa.array(texts), 500):
            w = textvec.words(s)
            assert [len(x) for x in np.split(w.hash, w.first[1:-1])] == [len(words_of(t)) for t in texts[s.first : s.first + len(s)]]
            hashes, bounds = textvec.shingles(w, size)
            found += [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sets = [shingle_set(t, size) for t in texts]
        assert [len(x) for x in found] == [len(x) for x in sets]
        for i in range(len(texts)):
            for j in range(i):
                assert len(found[i] & found[j]) == len(sets[i] & sets[j])


def test_slices_of_sliced_and_null_columns():
    column = pa.array(["zero", None, "one two", "", "three"]).slice(1)
    assert [bytes(s.data) for s in textvec.slices(column)] == [b"one twothree"]
    assert [s.valid.tolist() for s in textvec.slices(column)] == [[False, True, True, True]]
    assert [(s.first, len(s)) for s in textvec.slices(column, rows=3)] == [(0, 3), (3, 1)]
    assert [(s.first, len(s)) for s in textvec.slices(column, 1)] == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_prefixes_of_linked_sets_share_enough():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, 40).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.08], r.integers(0, 1 << 63, 3).astype(np.uint64)]))
        counts = r.integers(0, 50, 1 << 20).astype(np.uint32)
        if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
            (la, a), (lb, b) = prefix(x, counts, 5.0, 85, 100), prefix(y, counts, 5.0, 85, 100)
            assert len(np.intersect1d(a, b)) >= min(la, lb)


def test_sketches_differ_no_more_than_sets():
    r = np.random.default_rng(2)
    for n in (1, 5, 60, 400):
        for _ in range(50):
            x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[r.random(len(x)) > 0.2], r.integers(0, 1 << 63, 1 + n // 9).astype(np.uint64)]))
            bits = int(np.bitwise_count((sketch(x) ^ sketch(y)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(x, y)) and (sketch(x) == sketch(x[::-1])).all()


def test_join_matches_brute_force(spark, frame, corpus):
    for size, num, den in ((4, 85, 100), (2, 1, 2)):
        sets, links = jaccard_links(corpus, size, num, den)
        root = components_of([i for i, _ in corpus], links)
        out = {r.doc_id: r for r in jaccard_components(spark, frame(corpus), size, num, den).collect()}
        assert {i: r.component_id for i, r in out.items()} == root
        assert {i: r.n_shingles for i, r in out.items()} == {i: len(x) for i, x in sets.items()}


def test_join_of_one_group_whose_members_differ(spark, frame, monkeypatch):
    """Pairs are found by stars and by the early filter too."""
    from driftline.llm import jaccard_join

    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        w = list(words)
        for j in range(k % 4):
            w[(7 * k + 13 * j) % 60] = f"edit{k}_{j}"
        rows.append((k, " ".join(w)))
    _, links = jaccard_links(rows, 4, 85, 100)
    root = components_of([i for i, _ in rows], links)
    for run in (100_000, 5):
        monkeypatch.setattr(jaccard_join, "RUN_ROWS", run)
        assert {r.doc_id: r.component_id for r in jaccard_components(spark, frame(rows)).collect()} == root


def test_pairs_are_found_without_leaders(spark, frame, monkeypatch, corpus):
    """All links through the size bands and index prefixes alone."""
    from driftline.llm import jaccard_join
    from driftline.llm.jaccard_join import JaccardJoin

    calls, kept = [], JaccardJoin.verify

    def verify(self, pairs):
        calls.append(1)
        return kept(self, pairs.limit(0) if len(calls) == 1 else pairs)

    monkeypatch.setattr(JaccardJoin, "verify", verify)
    for num, den, few in ((6, 10, 64), (85, 100, 64), (6, 10, 1), (85, 100, 1)):
        monkeypatch.setattr(jaccard_join, "FEW", few)
        calls.clear()
        _, links = jaccard_links(corpus, 4, num, den)
        out = jaccard_components(spark, frame(corpus), 4, num, den).collect()
        assert {r.doc_id: r.component_id for r in out} == components_of([i for i, _ in corpus], links)


def thue_morse(n, flip=0):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_words_that_a_rolling_hash_confuses(spark, frame):
    a, b = thue_morse(1024), thue_morse(1024, 1)
    rows = [(1, a), (2, b), (3, a + b), (4, b + a), (5, f"x {a} y z u"), (6, f"x {b} y z u"), (7, f"X  {a.upper()} y z u")]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, frame(rows)).collect()}
    assert out == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (2, 5), 6: (2, 6), 7: (2, 5)}


def test_pairs_are_decided_on_words_where_hashes_agree(monkeypatch):
    texts = ["a b c d e f", "a b c d e f g", "a b c", "a b d", "A b\nC", "a  b c", "é b c d", "é b c d"]
    want = [True, False, True, True]
    s = next(textvec.slices(pa.array(texts), together=2))
    assert linked(s, 4, 60, 100).tolist() == want
    monkeypatch.setattr(textvec, "_chain", lambda hashes, size: np.zeros(len(hashes[0]), np.uint64))
    assert linked(s, 4, 60, 100).tolist() == want
    monkeypatch.undo()
    monkeypatch.setattr(textvec.Words, "span_hash", lambda self, start, end: np.zeros(len(start), np.uint64))
    assert linked(s, 4, 60, 100).tolist() == want
    assert [linked(x, 4, 60, 100).tolist() for x in textvec.slices(pa.array(texts), 1, together=2)] == [[x] for x in want]


def test_join_of_odd_tables(spark, frame):
    assert jaccard_components(spark, frame([])).count() == 0
    rows = [(1, "a b c d e", "x", "y"), (1, "a b c d e", "x", "y"), (None, "a b c d e", "x", "y"), (3, None, "x", "y"), (0, "A B\nC d e", "x", "y")]
    rows += [(7, "p q r s t u v w", "", ""), (7, "q " * 30, "", ""), (5, "q " * 9, "", ""), (8, "p q r s t u v w", "", ""), (None, "no id here at all", "", ""), (None, "", "", ""), (4, " \n ", "", "")]
    out = jaccard_components(spark, frame(rows, "doc_id long, text string, cls string, component_id string")).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
    assert found == [(-1, 0, -1), (-1, 2, -1), (-1, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0), (3, 0, 3), (4, 0, 4), (5, 1, 5), (7, 1, 5), (7, 5, 7), (8, 5, 7)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 101), (None, 5), (7, 3), (3, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    out = {r.node: r.root for r in connected_components(spark, edges, Workspace(spark, "test")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert connected_components(spark, edges.limit(0), Workspace(spark, "test")).count() == 0


def test_runs_do_not_depend_on_batches():
    from driftline.llm.jaccard_join import _runs

    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 40))
        token = np.sort(r.integers(0, 12, n))
        salt = np.where(token % 5 == 0, r.integers(1, 3, n), 0)
        band = r.integers(1, 3, n).astype(np.int32)
        order = np.lexsort((np.arange(n), band, salt, token))
        cols = [token[order], salt[order], band[order], np.arange(n), r.integers(1, 9, n), r.integers(1, 4, n).astype(np.int32), r.integers(1, 9, n).astype(np.int32)]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("abcdefg"))
        rows = list(zip(*(c.tolist() for c in cols), strict=True))
        want = []
        for x in rows:
            run = [y for y in rows if y[:2] == x[:2]]
            if len(run) > 1 or x[1] > 0:
                want.append((*x, *next(y for y in run if y[2] == x[2])[3:]))
        cuts = np.unique(np.append([0, n], r.integers(0, n, 6)))
        parts = [whole.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] + [whole.slice(0, 0)]
        out = [tuple(t.values()) for b in _runs(iter(parts)) for t in b.to_pylist()]
        assert out == want
