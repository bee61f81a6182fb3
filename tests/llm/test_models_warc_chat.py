import hashlib
import random

import numpy as np
import pytest

from driftline.llm import language_id, perspectives, toxicity, warc

STEMS = {"en": ["the", "and", "ing", "th", "er", "was"], "de": ["der", "und", "sch", "ung", "ß", "ein"], "fr": ["é", "eau", "le", "ou", "tion", "è"]}


def sentences(lang, n, r):
    word = lambda: "".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3)))
    return [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(1)
    return [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang in STEMS for t in sentences(lang, 150, r))]


def test_language_accuracy_on_held_out(spark, frame, spoken):
    docs = frame([(*d, "x") for d in spoken], "doc_id long, text string, lang string, score string")
    model = language_id.fit(spark, docs.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in language_id.identify(spark, docs, model).collect()}
    held = [(i, lang) for i, _, lang in spoken if i % 4 == 2]
    assert np.mean([out[i].lang_pred == lang for i, lang in held]) > 0.97
    assert np.mean([out[i].rejected for i, _ in held]) < 0.05 and all(0 <= r.score <= 1 for r in out.values())
    again = {r.doc_id: r.lang_pred for r in language_id.identify(spark, docs.repartition(7), model).collect()}
    assert again == {i: r.lang_pred for i, r in out.items()}
    strange = frame([(1, None), (2, ""), (3, "12 + 34 !!"), (None, "the and er"), (5, "the " * 20000), (6, "ЖШЩЪ " * 200), (6, "zzz")])
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(spark, strange, model).collect()]
    assert {g for g in got if g[0] in (1, 2, 3)} == {(i, "und", True) for i in (1, 2, 3)}
    assert (None, "en", False) in got and sum(g[0] == 6 for g in got) == 2 and all(g[1] in STEMS for g in got if g[0] in (5, 6))
    assert (6, True) in {(i, rejected) for i, _, rejected in got}


def test_language_without_training_rows(spark, frame):
    docs = frame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = language_id.fit(spark, docs)
    assert [(r.lang_pred, r.rejected) for r in language_id.identify(spark, docs, model).collect()] == [("und", True)]
    assert language_id.identify(spark, docs.limit(0), model).count() == 0


def test_spherical_kmeans_finds_directions():
    r = np.random.default_rng(0)
    x = np.repeat(np.eye(4), 30, 0) + r.normal(size=(120, 4)) * 0.05
    c = language_id.spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    assert sorted(np.abs(c).argmax(1)) == [0, 1, 2, 3]


def test_ordinal_regression_orders_grades():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    grade = np.digitize(x @ [4.0, 2.0, 0.0], [2.0, 3.0, 4.0])
    w, theta = toxicity.fit_ordinal(x, grade, 3)
    assert (np.diff(theta) > 0).all() and w[0] > w[1] > abs(w[2])
    z = x @ w
    assert np.mean((z[:, None] > theta).sum(1) == grade) > 0.85


def test_toxicity(spark, frame):
    r = random.Random(9)
    texts = sentences("en", 600, r)
    bad = ["idiot", "scumbag", "trashy"]
    rows, labels = [], []
    for i, t in enumerate(texts):
        w = t.split(" ")
        if i % 3 == 0:
            for _ in range(1 + i % 5):
                w.insert(r.randrange(len(w) + 1), r.choice(bad))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 3 == 0)))
    docs = frame(rows, "doc_id long, text string, toxic string")
    given = frame([x for x in labels if x[0] % 2 == 0] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, given)
    out = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    held = [x for x in labels if x[0] % 2]
    assert np.mean([out[i].toxic for i, t in held if t]) > 0.95 and np.mean([out[i].toxic for i, t in held if not t]) < 0.02
    few, many = ([out[i].severity for i, t in labels if t and i % 5 == k] for k in (0, 4))
    assert np.mean(few) < np.mean(many) and all(0 <= r.severity <= toxicity.GRADES for r in out.values())
    odd = toxicity.score(spark, frame([(1, None), (None, ""), (3, "Idiot! SCUMBAG idiot " * 5000)]), model).collect()
    assert sorted((str(r.doc_id), r.toxic) for r in odd) == [("1", False), ("3", True), ("None", False)]
    assert toxicity.score(spark, docs.limit(0), model).count() == 0
    none = toxicity.fit(spark, docs, given.limit(0))
    assert not any(r.toxic for r in toxicity.score(spark, docs, none).collect())


PAGES = [(5, "http://a/ b", "x" * 99), (6, "http://a", "x" * 99), (7, None, "y" * 100), (3, "u", "y" * 100), (9, "u", "y" * 100), (1, "u", None), (2, "u", ""), (10, "u", "é\r\n\r\nWARC/1.1" * 30_000), (11, "u", "é\r\n\r\nWARC/1.1" * 30_000), (None, "u", "y" * 100)]


@pytest.mark.parametrize("chunk", [7, 1 << 10, 1 << 16])
def test_warc_round_trip(spark, frame, chunk):
    pages = frame([(*p, "z") for p in PAGES if chunk > 7 or p[0] not in (10, 11)], "page_id long, url string, html string, digest string")
    out = {str(r.page_id): r for r in warc.pages_through_warc(spark, pages, chunk).collect()}
    assert len(out) == pages.count()
    for i, _, html in PAGES:
        if str(i) in out:
            data, r = (html or "").encode(), out[str(i)]
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    types = {k: (r.record_type, r.refers_to) for k, r in out.items()}
    assert types["7"] == types["9"] == types["None"] == ("revisit", 3) and types["3"] == ("response", None)
    assert all(types[k] == ("response", None) for k in ("5", "6", "1", "2"))
    assert chunk == 7 or types["11"] == ("revisit", 10)


def test_warc_files_and_damage(spark, frame, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark, frame(PAGES, "page_id long, url string, html string"), path, 1000)
    files = warc.export_files(spark, path, f"file://{tmp_path}/files").collect()
    data = b"".join(f.read_bytes() for f in (tmp_path / "files").iterdir())
    assert sum(f.bytes for f in files) == len(data) and data.count(b"\r\nWARC-Record-ID:") == len(PAGES)
    one = next(iter(warc.record_chunks(warc.record_head(4, "u", 3, hashlib.sha256(b"abc").hexdigest(), None), memoryview(b"abc"))))[0]
    for size in (1, 5, 1000):
        reader = warc.RecordReader()
        for k in range(0, len(one), size):
            reader.feed(one[k : k + size])
        assert reader.result() == (4, 3, hashlib.sha256(b"abc").hexdigest(), "response", None)
    broken = warc.RecordReader()
    broken.feed(one.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        broken.result()
    cut = warc.RecordReader()
    cut.feed(one[:-5])
    with pytest.raises(ValueError):
        cut.result()
    assert warc.pages_through_warc(spark, frame([], "page_id long, url string, html string")).count() == 0


def test_running_digests_are_read(spark, frame, tmp_path):
    path, bad = f"{tmp_path}/archive", f"{tmp_path}/bad"
    warc.write_archive(spark, frame([p for p in PAGES if p[0] != 11], "page_id long, url string, html string"), path, 1000)
    chunks = spark.read.parquet(path)
    long = chunks.where("chunks > 3").first().record
    for where in (f"record = {long} and chunk = 2", "chunks = 1"):
        chunks.selectExpr("record", "chunk", "chunks", "data", f"case when {where} then 'bad' else digest end as digest").write.mode("overwrite").parquet(bad)
        with pytest.raises(Exception, match="is damaged"):
            warc.read_archive(spark, bad).collect()
    assert warc.read_archive(spark, path).count() == len(PAGES) - 1


def test_revisits_without_a_broadcast(spark, frame, monkeypatch):
    pages = frame([(i, "u", "y" * (100 + i % 3)) for i in range(60)] + [(100, "u", "z" * 120)], "page_id long, url string, html string")
    want = {r.page_id: r.refers_to for r in warc.pages_through_warc(spark, pages).collect()}
    monkeypatch.setattr(warc, "with_rows_bounded", lambda *a: False)
    kept = warc.join_hot
    monkeypatch.setattr(warc, "join_hot", lambda *a, **k: kept(*a[:5], 7, **k))
    assert {r.page_id: r.refers_to for r in warc.pages_through_warc(spark, pages).collect()} == want
    assert want == {100: None} | {i: (i % 3 if i > 2 else None) for i in range(60)}


def plain_grams(text):
    """Letters alone, anything else one blank, counted by a hash, byte by byte."""
    out, run = np.zeros(language_id.BUCKETS), []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or not run or run[-1] != 32:
            run.append(b)
    for size in language_id.GRAMS:
        for i in range(len(run) - size + 1):
            code = 0
            for b in run[i : i + size]:
                code = (code * 256 + b) % (1 << 32)
            out[(code * 2654435761 + size * 40503) % (1 << 32) >> 20] += 1
    return out


def test_language_equals_a_plain_form(spark, frame, spoken, corpus):
    docs = frame(spoken, "doc_id long, text string, lang string")
    model = language_id.fit(spark, docs)
    rows = [(i, t) for i, t in corpus if t and any(c.isalpha() for c in t)] + [(1000 + i, t) for i, t, _ in spoken[::20]]
    out = {r.doc_id: r for r in language_id.identify(spark, frame(rows), model).collect()}
    for i, t in rows:
        x = np.log1p(plain_grams(t)) * model.idf
        cosine = model.centroids @ (x / np.linalg.norm(x))
        assert abs(out[i].score - cosine.max()) < 1e-5
        near = {model.languages[model.owner[k]] for k in np.flatnonzero(cosine > cosine.max() - 1e-6)}
        assert out[i].lang_pred in near


def test_more_languages_than_any_fixed_number(spark, frame):
    r = random.Random(2)
    stems = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for k in range(260)}
    say = lambda x: " ".join(r.choice(stems[x]) for _ in range(60))
    rows = [(i, say(x), x) for i, x in enumerate(x for x in stems for _ in range(12 if x < "l250" else 5))]
    model = language_id.fit(spark, frame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == set(stems) and set(model.owner) == set(range(260))
    tests = [(i, say(x), x) for i, x in enumerate(stems)]
    out = {x.doc_id: x.lang_pred for x in language_id.identify(spark, frame([t[:2] for t in tests]), model).collect()}
    assert np.mean([out[i] == x for i, _, x in tests]) > 0.97


def test_perspectives(spark, frame):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|bob|>"), (1, 2, "bob", None), (1, 3, "cy", "Yo"), (1, 3, "ann", "tie"), (2, None, None, "?"), (None, 1, "ann", "lost"), (3, 0, "system", "alone"), (1, 2000, "ann", "late"), (1, 2000, "ann", "late")]
    out = perspectives.rotate_perspectives(spark, frame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, start int")).collect()
    texts = {}
    for r in sorted(out, key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        assert len(texts.get(key, "")) == r.start and r.end - r.start == len(r.segment)
        texts[key] = texts.get(key, "") + r.segment
        said = texts[key][r.mask_start : r.mask_end]
        assert (said.endswith("<|end|>") and r.role == "assistant") or (said == "" and r.role != "assistant")
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann")}
    assert texts[1, "bob"].startswith("<|system|>Be kind.<|end|>\n<|user ann|>Hi <\\|bob|\\><|end|>\n<|assistant|><|end|>\n<|user ann|>tie<|end|>\n<|user cy|>Yo<|end|>\n<|user ann|>late")
    assert perspectives.rotate_perspectives(spark, frame([], "conv_id long, turn long, role string, text string")).count() == 0
