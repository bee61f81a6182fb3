import random

import pytest


@pytest.fixture
def corpus():
    """Texts with copies, near copies, ties, nulls and odd ones; ids shuffled."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(25)]
    texts = [None, "", "   \n\t ", "...", "One", "one two", "ONE two", "x" * 3000, "a  b\x0bc", "日本語 テキスト", "İ ſ K", *base, *base[:8]]
    for t in base:
        words = t.split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    long = " ".join(word() for _ in range(4000))
    texts += [long, long + " end", long.upper()]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture
def frame(spark):
    def make(rows, ddl="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, ddl).repartition(parts)

    return make
