"""The registered queries over the whole test tables: by SQL, or by brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from tidemark.llm import queries
from tidemark.llm.common import LOWER, UPPER

FOLDER = str(oracle.DATA)
LOW = str.maketrans(UPPER, LOWER)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def result(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.difference(queries.QUERIES[name], queries.ORACLE_SQL[name], spark) == ""


def test_op1(spark, texts):
    got = result(spark, "op1_lm_scoring")
    words = {i: [*SPACED.findall(t.translate(LOW)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r, base = got[i], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n) and abs(r.base_score - base) < 1e-6 * abs(base)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_op5(spark):
    """Of the labelled documents that training never saw."""
    from tidemark.llm import quality

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    trained = {r.doc_id for r in quality.trusted(labels).collect()}
    got = result(spark, "op5_quality_classifier")
    good, bad = ([got[r.doc_id].kept for r in labels.collect() if r.doc_id not in trained and r.quality == k and not (k and r.toxic)] for k in (1, 0))
    assert len(good) > 30 and np.mean(good) > 0.97 and len(bad) > 30 and np.mean(bad) < 0.05


def test_op6(spark, texts):
    got = result(spark, "op6_minhash_near_dedup")
    sets, held = {}, defaultdict(list)
    for i, t in texts.items():
        w = SPACED.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
        for s in sets[i]:
            held[s].append(i)
    both = Counter((a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[:k])
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in texts}


def test_op7(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    truth, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), result(spark, "op7_bpe")
    for i, t in texts.items():
        ids = np.array(truth.encode(t, add_special_tokens=False).ids, "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op4_and_op8(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    text = {r.page_id: r.text for r in queries.QUERIES["op4_html_extraction"](spark, FOLDER).collect()}
    records = {r.page_id: r for r in queries.QUERIES["op8_warc"](spark, FOLDER).collect()}
    last = {}
    for p in pages:
        last[p.html] = max(last.get(p.html, -1), p.page_id)
    import html

    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert text[p.page_id] == "\n".join(b for b in blocks if b)
        r = records[p.page_id]
        assert r.payload_bytes == len(p.html.encode()) and (r.record_type == "response") == (last[p.html] == p.page_id) and (r.refers_to or p.page_id) == last[p.html]


def test_op10(spark, texts):
    got = result(spark, "op10_suffix_array_dedup")
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(t[p : p + 200]) for t in raw.values() for p in range(len(t) - 199))
    for i, t in raw.items():
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - 199):
            if seen[hash(t[p : p + 200])] > 1:
                gone[p + 1 : p + 201] = 1
        kept = np.frombuffer(t, np.uint8)[gone[1:-1] == 0].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), len(t) - len(kept), int((np.diff(gone) > 0).sum()), hashlib.sha256(kept).hexdigest())


def test_pipeline(spark, texts):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    kept = {texts[i].translate(LOW) for i in got}
    assert 0 < len(got) == len(kept) < len(texts)
    dirty = {r.doc_id for r in queries.QUERIES["op2_benchmark_decontamination"](spark, FOLDER).filter("contaminated").collect()}
    assert not dirty & got.keys()
