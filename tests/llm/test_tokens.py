import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from driftline.llm import byte_bpe, packing, textvec

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a\n\n b", "a \n  b", " x y", "it's I'LL 'd", "é" * 70, "ab" * 500, "!" * 200, "\x1c\x85 a", "<|endoftext|> x <|ENDOFTEXT|>", "é É ΑΣ ΑΣ. Σ", "1234567 ²½", "日本語テキスト。", "x.y,z;", "don't.", "퟿\U0001f600 ok!"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=300):
    r = random.Random(3)
    return ["".join(r.choice(["a", "b", "the", "ing", " ", " ", "  ", "\n", "é", "ß", "'s", "1", ".", "日", "\U0001f600", "Q", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library(reference):
    e = byte_bpe.Encoder(byte_bpe.Vocabulary.load(BPE), P.PATTERN)
    texts = ODD + random_texts()
    for _ in range(2):  # without and with what is remembered
        for text, ids in zip(texts, e.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
            assert e.decode(ids) == text.encode()


def test_bpe_both_trees_agree(reference):
    v = byte_bpe.Vocabulary.load(BPE)
    r = random.Random(5)
    pieces = ["".join(r.choice("thein gao") for _ in range(r.randint(2, 64))).encode() for _ in range(400)]
    for width in (2, 4, 8, 16, 32, 64):
        some = [p for p in pieces if width // 2 < len(p) <= width]
        if some:
            assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merge_short(v, some, width)] == [byte_bpe.merge_long(v, p) for p in some]
    assert byte_bpe.merge_long(v, b"aaaa" * 3000) == reference._core_bpe.encode_single_piece(b"aaaa" * 3000)


def test_bpe_query(spark, frame, corpus, reference):
    rows = [*corpus, (None, "x y"), (1, "again")]
    out = byte_bpe.encode_decode(spark, frame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int"), BPE, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert byte_bpe.encode_decode(spark, frame([]), BPE, P.PATTERN).count() == 0
    whole = {r.doc_id: r.ids for r in byte_bpe.encode(spark, frame(corpus), BPE, P.PATTERN).collect()}
    assert whole == {i: reference.encode_ordinary(t or "") for i, t in corpus}


def test_word_ids_equal_the_library():
    w, t = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    texts = ODD + random_texts() + ["End. END! (end), end... é. ².", "A" * 100 + " " + "A" * 100 + "."]
    for size in (1, 200, 1 << 20, 1 << 20):
        found = [ids.tolist() for s in textvec.slices(pa.array(texts), size) for ids in w.encode(s)]
        for text, ids in zip(texts, found, strict=True):
            assert ids == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_table_grows():
    r, table = np.random.default_rng(0), packing.WordTable()
    keys = np.unique(r.integers(1, 1 << 63, 200_000).astype(np.uint64))
    keys[:1000] = np.arange(1, 1001, dtype=np.uint64) << np.uint64(32)  # one slot for all of them
    keys = np.unique(keys)
    for part in np.array_split(r.permutation(keys), 7):
        assert (table.find(part) < 0).all()
        table.add(part, [str(k).encode() for k in part], [[int(k % np.uint64(97))] * int(k % np.uint64(4)) for k in part])
    place = table.find(keys)
    assert (place >= 0).all() and (table.size[place] == keys % np.uint64(4)).all()
    long = place[table.size[place] > 0]
    assert (table.ids[table.start[long]] == keys[table.size[place] > 0] % np.uint64(97)).all()
    assert all(table.data[table.at[p] : table.at[p] + table.length[p]].tobytes() == str(k).encode() for p, k in zip(place[:2000], keys[:2000], strict=True))


def thue_morse(n, flip=0):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    t = Tokenizer.from_file(WORDS)
    a, b = thue_morse(1024), thue_morse(1024, 1)
    texts = [a, b, f"x {b} {a}. {a[:900]}", a + b, b + a, "A" * 129 + " " + "a" * 130, *ODD]
    for patched in (False, True):
        if patched:
            monkeypatch.setattr(textvec.Words, "span_hash", lambda self, start, end: (end - start).astype(np.uint64) % np.uint64(3))
        w = packing.WordIds(WORDS)
        for _ in range(2):
            found = [ids.tolist() for s in textvec.slices(pa.array(texts), 3000) for ids in w.encode(s)]
            assert found == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_classes_are_of_reciprocal_capacity():
    for n in range(1, packing.CAPACITY + 1):
        k = packing.class_of(n)
        assert k * n <= packing.CAPACITY and (k >= 16 or k == packing.CAPACITY // n)


@pytest.mark.parametrize("lengths", ["spread", "short", "half", "long", "one"])
def test_bins_take_a_fixed_number_of_documents(lengths):
    r = random.Random(4)
    draw = {"spread": lambda: int(r.lognormvariate(6.3, 1.2)) + 1, "short": lambda: r.randint(1, 40), "half": lambda: r.randint(2049, 4000), "long": lambda: r.randint(1, 60_000), "one": lambda: 1}[lengths]
    sizes = [draw() for _ in range(3000)]
    p, out = packing.Packer(5 << 36), []
    for i, n in enumerate(sizes):
        out += p.add(i, n)
        assert p.gap <= 2 * packing.CAPACITY + 1 and p.gap == -sum(x[0] for x in p.gaps)
    before = len({x[3] for x in out})
    out += p.finish()
    by_doc, by_sequence = {}, {}
    for doc, start, length, sequence, offset in out:
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length, doc, start))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    lost = whole = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        lost += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        members = [n for _, n, doc, start in parts if start == 0 and n == sizes[doc]]
        whole += bool(members) and len(members) == packing.class_of(min(members))
    assert lost < 0.005 * sum(sizes) + packing.CAPACITY
    assert len(by_sequence) - before < 80 and (lengths not in ("spread", "half") or p.regular > 0.7 * sum(len(x) > 1 for x in by_sequence.values()))
    cut = sum(len(by_doc[i]) > 1 for i, n in enumerate(sizes) if n <= packing.CAPACITY)
    assert lengths != "spread" or cut < 0.1 * len(sizes)


def test_packing(spark, frame, corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [*corpus, (None, "no id"), *[(1000 + i, f"word{i} " * (i * 7 % 90)) for i in range(300)]]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in rows}
    out = packing.pack_documents(spark, frame(rows), WORDS, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == ids[i]
        assert all(r.doc_tokens == len(ids[i]) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
    lost = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        size = sum(r.length for r in parts)
        assert size <= packing.CAPACITY
        lost += 0 if size & (size - 1) == 0 else packing.CAPACITY - size
    assert lost == 0  # a worker's last sequence is cut at powers of two
    assert packing.pack_documents(spark, frame([]), WORDS).count() == 0
    odd = frame([(1, "a b", 3, "x"), (1, "a b", 4, "y"), (None, None, 5, "z"), (2, "", 6, None), (3, "word " * 100_000, 1, "")], "doc_id long, text string, start int, ids string")
    found = packing.pack_documents(spark, odd, WORDS).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in found if r.start == 0) == [("1", 3), ("1", 3), ("2", 1), ("3", 100_001), ("None", 1)]
    assert sum(r.length for r in found) == 100_009
