"""The registered queries and the pipeline over the smallest tables."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from driftline.llm import queries
from tests.llm.test_dedup_shards import brute, norm
from tests.llm.test_text_sets import components_of, jaccard_links

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in rows_of("documents")}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    twin = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in columns)} from ({queries.ORACLES[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, twin))


def test_op1(spark, docs):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    parts = {}
    for r in run(spark, "op1_harmonic_packing"):
        parts.setdefault(r.doc_id, []).append(r)
    assert parts.keys() == docs.keys()
    for i, rs in parts.items():
        ids, at = np.array([*t.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(rs, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_op3(spark, docs):
    out = run(spark, "op3_language_id")
    assert {r.doc_id for r in out} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id]["lang"] for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in out)


def test_op4(spark, docs):
    rows = [(i, d["text"]) for i, d in docs.items()]
    sets, links = jaccard_links(rows, 4, 85, 100)
    want = components_of(docs, links)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op4_jaccard_join")} == {(i, len(sets[i]), want[i]) for i in docs}


def test_op6(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, d in docs.items():
        ids = np.array(e.encode_ordinary(d["text"] or ""), "<u4")
        want.add((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in run(spark, "op6_byte_bpe")} == want


def test_op7(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in rows_of("embeddings")]
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    links = np.array(unit) @ np.array(unit).T >= 0.95
    want = components_of([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(links), strict=True) if a < b])
    assert {tuple(r) for r in run(spark, "op7_embedding_dedup")} == {(i, int(n) - 1, want[i], want[i] == i) for (i, _), n in zip(rows, links.sum(1), strict=True)}
    assert brute([], 0.95) == set()


def test_op9(spark, docs):
    out = run(spark, "op9_hilbert_sharding")
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for i, d in docs.items()}
    counts = np.bincount([r.shard for r in out], minlength=16)
    assert counts.max() - counts.min() <= 1 and len({(r.shard, r.slot) for r in out}) == len(out)
    placed = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.slot for r in placed] == [i for n in counts for i in range(n)]
    assert [r.curve for r in placed] == sorted(r.curve for r in out)  # a plain sort along the curve


def test_op10(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op10_toxicity")}
    assert out.keys() == docs.keys()
    clean = [r["doc_id"] for r in rows_of("labels") if r["toxic"] == 0]
    assert np.mean([out[i].toxic for i in clean if i in out]) < 0.02


def test_op10_on_labels_it_was_not_fitted_on(spark):
    """A model that flags nothing fails: two thirds of the labels are learned,
    the rest are found again."""
    from driftline.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    model = toxicity.fit(spark, docs, labels.where(f"not {held}"))
    found = toxicity.score(spark, docs, model).join(labels.where(held).selectExpr("doc_id", "toxic as label"), "doc_id").collect()
    of = lambda label: np.mean([r.toxic for r in found if r.label == label])
    assert sum(r.label == 1 for r in found) > 100 and of(1) > 0.8 and of(0) < 0.01
    assert np.mean([r.severity for r in found if r.label == 1]) > 10 * np.mean([r.severity for r in found if r.label == 0])


def test_pipeline_stages(spark, docs):
    """Each stage against what it should keep of its own input."""
    import corpus_pipeline as pipeline

    now, columns = spark.read.parquet(f"{SF}/documents.parquet"), list(next(iter(docs.values())))
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        after = stage(spark, now, SF)
        rows = after.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == before.keys()
            break
        assert after.columns == columns
        kept[name] = {r.doc_id for r in rows}
        assert len(rows) == len(kept[name]) and kept[name] <= before.keys()
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]), i)
            assert kept[name] == set(first.values())
        if name == "jaccard_join":
            _, links = jaccard_links(list(before.items()), 5, 8, 10)
            assert kept[name] == {i for i, root in components_of(before, links).items() if i == root}
        now = spark.createDataFrame(rows, after.schema)
    assert len(kept["language_id"]) > 0.97 * len(docs)
    toxic = {r["doc_id"] for r in rows_of("labels") if r["toxic"] == 1}
    assert len(kept["toxicity"] - toxic) > 0.97 * len(kept["language_id"] - toxic)
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == kept["jaccard_join"]


def rows_with_odd_ones(spark):
    """Rows of every kind that a stage may meet, with clashing columns."""
    base = [r["text"] for r in rows_of("documents") if r["lang"] == "en" and r["text"] and 60 < len(r["text"].split()) < 400][:30]
    one, two = base[0], base[1]
    near = " ".join([*two.split()[:-1], "changed"])
    rows = [(1, one), (2, one), (2, two), (2, two), (None, one), (None, base[2]), (None, base[2]), (3, None), (4, ""), (5, " \n "), (6, "12 !!"), (7, near), (8, "\n".join(base * 40)), (9, base[3].replace(" ", "  ")), (9, base[3])]
    rows = [(i, t, "en", f"s{k}", k, "x", True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _sha string, kept boolean").repartition(4)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    stages, docs = dict(pipeline.STAGES), rows_with_odd_ones(spark)
    all_rows = {r.n_chars: r for r in docs.collect()}
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(all_rows[r.n_chars] == r for r in rows) and len({r.n_chars for r in rows}) == len(rows)
        kept[name] = {r.n_chars for r in rows}
        assert stage(spark, docs.limit(0), SF).count() == 0
    texts = {k: r.text for k, r in all_rows.items()}
    assert kept["language_id"] == {k for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert kept["toxicity"] == set(texts)
    assert len(kept["exact_dedup"]) == len({norm(t) for t in texts.values()}) and 0 in kept["exact_dedup"] and 2 in kept["exact_dedup"] | {3}
    assert {norm(texts[k]) for k in kept["exact_dedup"]} == {norm(t) for t in texts.values()}
    near = kept["jaccard_join"]
    assert 0 in near and not near & {1, 4, 11} and len(near & {2, 3}) == len(near & {5, 6}) == len(near & {13, 14}) == 1 and {7, 8, 9, 10, 12} <= near
    pieces = stages["packing"](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in pieces) == len(texts) and stages["packing"](spark, docs.limit(0), SF).count() == 0


def test_a_unique_text_stays_when_its_id_is_repeated(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (2, "unique text of its own")], "doc_id long, text string")
    for name in ("exact_dedup", "jaccard_join"):
        assert sorted(tuple(r) for r in dict(pipeline.STAGES)[name](spark, docs, SF).collect()) == [(1, "same text"), (2, "unique text of its own")]
