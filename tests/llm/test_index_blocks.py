"""The index is read a block at a time, and a search's memory is that of arrays, however many items hold a window."""

import pickle
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate


def test_a_file_holds_one_block(spark):
    docs = spark.range(0, 3, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 500000) as text")
    index = decontaminate.build_index(docs)
    assert index.count() == len(index.inputFiles()) == 3


def test_windows_of_many_items_are_small():
    words = [f"w{i}" for i in range(2000)]
    items = [(str(k), " ".join(words)) for k in range(50)]
    phrases = decontaminate.Phrases(items, 10)
    phrases.rank(np.ones(len(phrases.terms), np.int64))
    assert len(phrases.words) == 1991 and len(phrases.owners) == 1 and len(pickle.dumps(phrases)) < 200_000


def test_hits_by_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    monkeypatch.setattr(decontaminate, "ROW_ITEMS", 3)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    docs = [None, "", "zz", *[say(rng.randrange(30)) for _ in range(60)], ""]
    items = [(None, say(4)), ("7", ""), ("9", "a b"), ("10", "a b"), ("x", None or "zz"), *[(str(k % 9), say(rng.randrange(1, 9))) for k in range(20)]]
    phrases = decontaminate.Phrases(items, 3)
    batch = decontaminate._index(pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": docs}))
    block = decontaminate.Block(batch, 0, phrases.terms)
    phrases.rank(np.array([sum((d or "").split().count(t) for d in docs) for t in phrases.terms.to_pylist()]))
    out = [r for b in decontaminate._hits(block, phrases) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(len(docs)))
    for r, doc in zip(out, docs):
        w, hit, names = (doc or "").split(), set(), set()
        for name, text in items:
            v = text.split()
            for i in range(max(1, len(v) - 2) if v else 0):
                for k in range(len(w)):
                    if w[k : k + len(v[i : i + 3])] == v[i : i + 3]:
                        hit |= set(range(k, k + len(v[i : i + 3])))
                        names.add(name)
        assert {k for s, e in zip(r["begins"], r["ends"]) for k in range(s, e)} == hit and r["n_words"] == len(w)
        assert r["items"] == sorted(names - {None}) and all(e < s for e, s in zip(r["ends"], r["begins"][1:]))
