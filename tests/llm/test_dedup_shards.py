import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import embedding_dedup, exact_dedup, hilbert_shards
from tests.llm.test_text_sets import components_of


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_filter_keeps_and_merges_counts():
    r = np.random.default_rng(2)
    parts = [r.choice(r.integers(0, 1 << 62, 500).astype(np.uint64), 800) for _ in range(3)]
    built = []
    for p in parts:
        keys, counts = np.unique(p, return_counts=True)
        f = exact_dedup.QuotientFilter.of_sorted(keys, counts.astype(np.int64), 64)
        back = exact_dedup.QuotientFilter.unpack(64, *f.pack())
        assert (back.keys() == keys).all() and (back.counts == counts).all()
        built.append(back)
    whole = built[0].merge(*built[1:])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.keys() == keys).all() and (whole.counts == counts).all()


def test_repeated_fingerprints(spark, monkeypatch):
    values = [5, -1, -1, 2**62, 2**62, 2**62, -(2**63), 0, 0]
    df = spark.createDataFrame([(v,) for v in values * 1] + [(None,)], "fp long").repartition(3)
    for rows in (1, 10**7):
        out = {r.fp: r.rows for r in exact_dedup.repeated_fingerprints(df, rows).collect()}
        assert out == {-1: 2, 2**62: 3, 0: 2}


def test_exact_dedup(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GATHER", 10)
    rows = [*corpus, (9001, "a b\x0bc"), (9000, "a\tb c"), (9000, "a\tb c")]
    out = exact_dedup.exact_duplicates(spark, frame([(*r, "z") for r in rows], "doc_id long, text string, keep_id string")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = [(i, min(g := groups[norm(t)]), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_exact_dedup_of_odd_tables(spark, frame):
    assert exact_dedup.exact_duplicates(spark, frame([])).count() == 0
    out = exact_dedup.exact_duplicates(spark, frame([(None, "a"), (4, "a"), (None, "b"), (None, "b"), (None, "c")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == [("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_collisions_are_told_apart_by_bytes(spark, frame, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    out = exact_dedup.exact_duplicates(spark, frame([(1, "a"), (2, "b"), (3, "a")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_each_cell_by_steps(spark, dims, bits):
    names = [f"x{i}" for i in range(dims)]
    cells = spark.range(1 << (bits * dims)).select(*[((hilbert_shards.F.col("id") / (1 << (bits * i))).cast("long") % (1 << bits)).cast("int").alias(n) for i, n in enumerate(names)])
    rows = cells.select(*names, hilbert_shards.hilbert_index([hilbert_shards.F.col(n) for n in names], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (bits * dims)))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "PARTS", 8)
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 5}", 1) for i, t in corpus] + [(None, "x", "en", None, 1), (5, "y", "en", "s1", 1)] + [(20_000 + i, "same", "en", "s0", 1) for i in range(300)]
    ddl = "doc_id long, text string, lang string, source string, rank int"
    out = hilbert_shards.hilbert_shards(spark, frame(rows, ddl), 16).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in out) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    runs = sorted((r.curve, r.shard) for r in out)
    assert [s for _, s in sorted((c, s) for c, s in runs)] == sorted(s for _, s in runs)
    assert hilbert_shards.hilbert_shards(spark, frame([], ddl)).count() == 0
    assert hilbert_shards.hilbert_shards(spark, frame(rows[:1], ddl)).count() == 1


def vectors():
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 8))
    close = base[:30] + r.normal(size=(30, 8)) * 0.12
    chain = [np.cos(a) * base[0] / np.linalg.norm(base[0]) + np.sin(a) * np.eye(8)[0] for a in np.arange(0, 2, 0.25)]
    return [x.astype(np.float32).tolist() for x in [*base, *close, *chain, *base[:5], base[0] * 3]]


def brute(rows, least):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: x / np.linalg.norm(x) for i, x in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= least]
    root = components_of([i for i, _ in rows], links)
    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, n[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("cell_rows,block", [(4096, 2048), (6, 4), (20, 1000)])
def test_embeddings_match_brute_force(spark, frame, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = list(enumerate(vectors()))
    odd = [None, [0.0] * 8, [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows = [(len(rows) - i, v) for i, v in rows] if block == 4 else rows
    out = embedding_dedup.embedding_duplicates(spark, frame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int")).collect()
    assert {tuple(r) for r in out} == brute(rows, 0.95) and len(out) == len(rows)


def test_embeddings_of_odd_tables(spark, frame):
    ddl = "vec_id long, embedding array<float>"
    assert embedding_dedup.embedding_duplicates(spark, frame([], ddl)).count() == 0
    assert [tuple(r) for r in embedding_dedup.embedding_duplicates(spark, frame([(3, None)], ddl)).collect()] == [(3, 0, 3, True)]
    out = embedding_dedup.embedding_duplicates(spark, frame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], ddl)).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == ["(2, 1, 2, True)", "(2, 1, 2, True)", "(None, 0, None, True)"]


def test_unit_rows():
    x, good = embedding_dedup.unit_rows(pa.array([[3.0, 4.0], None, [1e300, 0.0], [0.0, 0.0]]))
    assert good.tolist() == [True, False, True, False] and np.allclose(x[0], [0.6, 0.8]) and x[2, 0] == 1


def test_shard_files_are_passed_over(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = f"{tmp_path}/shards"
    hilbert_shards.write_shards(spark, docs, path)
    back = spark.read.parquet(path)
    assert sorted(back.select(*docs.columns).collect(), key=str) == sorted(docs.collect(), key=str)
    groups = [g for f in sorted((tmp_path / "shards").rglob("*.parquet")) for i in range(pq.ParquetFile(f).metadata.num_row_groups) for g in [pq.ParquetFile(f).metadata.row_group(i)]]
    column = lambda g, name: next(c for c in (g.column(k) for k in range(g.num_columns)) if c.path_in_schema == name).statistics
    for name in ("lang", "source"):
        values = [r[0] for r in docs.select(name).where(f"{name} is not null").distinct().collect()]
        hit = [sum(column(g, name).has_min_max and column(g, name).min <= v <= column(g, name).max for g in groups) for v in values]
        assert sum(hit) < 0.6 * len(values) * len(groups)


def test_many_values_of_a_dimension_keep_their_order(spark, frame):
    rows = [(i, "t" * (1 + i % 5), "en", f"source {i * 7919 % 30000:05d}") for i in range(30_000)]
    docs = frame(rows, "doc_id long, text string, lang string, source string")
    out = hilbert_shards.hilbert_shards(spark, docs, carry=("source",)).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.shard, []).append(r.row.source)
    assert len(spans) == 16 and max(map(len, spans.values())) - min(map(len, spans.values())) <= 1
    width = [int(max(v)[7:]) - int(min(v)[7:]) for v in spans.values()]
    assert sorted(width)[8] < 10_000  # a hash would spread every shard over all of them


def test_vectors_of_several_lengths(spark, frame):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0]), (6, None), (7, []), (8, [0.0, 1.0])]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_duplicates(spark, frame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}


def test_copies_without_a_broadcast(spark, frame, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(200)] + [(None, "text 1"), (None, None), (500, ""), (501, "own")]
    want = sorted(map(str, exact_dedup.exact_duplicates(spark, frame(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "with_rows_bounded", lambda *a: False)
    kept = exact_dedup.join_hot
    monkeypatch.setattr(exact_dedup, "join_hot", lambda *a, **k: kept(*a, most=9, **k))
    assert sorted(map(str, exact_dedup.exact_duplicates(spark, frame(rows)).collect())) == want


def test_rows_of_hot_keys_are_joined_in_parts(spark):
    from driftline.llm.storage import Workspace, join_hot

    left = spark.createDataFrame([(k if k != 9 else None, i) for i in range(300) for k in [0 if i % 3 else i % 10]], "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 10, 2)], "k long, v string")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    for most in (10, 1000):
        assert sorted(map(str, join_hot(Workspace(spark, "test"), left, right, "k", ["i"], most).collect())) == want


def test_embeddings_take_disk_in_proportion_whatever_cells_they_visit(spark, monkeypatch, tmp_path):
    """Of vectors without structure each is near to most cells."""
    from pathlib import Path

    import pyarrow.parquet as pq

    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 200)
    monkeypatch.setattr(embedding_dedup.Workspace, "drop", lambda self, *tables: None)
    x = np.random.default_rng(7).normal(size=(8000, 64)).astype(np.float32)
    pa_table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    pq.write_table(pa_table, f"{tmp_path}/e.parquet")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def written():
        shuffled = spark._jsc.sc().statusStore().executorList(False)
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) + sum(shuffled.apply(i).totalShuffleWrite() for i in range(shuffled.size()))

    before = written()
    assert len(embedding_dedup.embedding_duplicates(spark, spark.read.parquet(f"{tmp_path}/e.parquet")).collect()) == len(x)
    assert written() - before < 4 * x.nbytes


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_in_many_rounds_match_brute_force(spark, frame, monkeypatch, kind):
    for name, value in (("CELL_ROWS", 12), ("BLOCK", 4), ("COLUMNS", 3), ("FOLDERS", 8), ("ROUND_BYTES", 15 * 8 * 8)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = list(enumerate([*vectors(), *vectors()[:20] * 2, [-0.0, *[1.0] * 7], [0.0, *[1.0] * 7]]))[::-1]
    out = embedding_dedup.embedding_duplicates(spark, frame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    assert {tuple(r) for r in out} == brute(rows, 0.95) and len(out) == len(rows)


@pytest.mark.parametrize("strong", [64, 5])
def test_the_bound_of_a_product_loses_no_link(strong):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 64)) * np.where(np.arange(64) < strong, 1, 0.05)
    x = embedding_dedup.units(np.concatenate([base, base + r.normal(size=base.shape) * 0.3 * np.abs(base).mean()]))
    basis = embedding_dedup.bounding_basis(x, 0.95)
    y = embedding_dedup.shortened(x, basis)
    assert basis.shape[1] < 64 and (y @ y.T >= x @ x.T - embedding_dedup.margin(basis)).all() and (x @ x.T >= 0.95).sum() > len(x)
