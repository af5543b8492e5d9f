"""One-permutation fingerprints against exact similarities, and the query by brute force."""

import hashlib

import numpy as np
import oracle
import pyarrow as pa

from tidemark.llm import one_permutation as op
from tidemark.llm import queries
from tidemark.llm.common import LOWER, UPPER

DOCS = "doc_id long, text string, kind string, part int, after string, _order long"  # with names that the operator uses itself


def shingles(text):
    w = text.translate(str.maketrans(UPPER, LOWER)).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def compared(spark, rows, got):
    """Checks rows (doc_id, text or None) in order of their successors; the errors of both likenesses."""
    errors = []
    assert len(rows) == len(got)
    for k, ((i, text), r) in enumerate(zip(rows, got, strict=True)):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = r.edited_sha256 if isinstance(r.edited_sha256, str) else bytes(r.edited_sha256).hex()
        assert (r.doc_id, r.n_chars, sha) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        errors.append((r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)))
    return np.array(errors)


def test_op11(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect())
    got = sorted(queries.QUERIES["op11_document_fingerprints"](spark, str(oracle.DATA)).collect(), key=lambda r: r.doc_id)
    errors = compared(spark, rows, got)
    assert np.abs(errors).max() < 0.12 and errors.std() < 0.03 and abs(errors[:, 0].mean()) < 0.005
    same = {}
    for (_, text), r in zip(rows, got, strict=True):
        assert same.setdefault(text, r.fingerprint) == r.fingerprint


def test_awkward_rows(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(None, "a b"), (None, None), (1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "oNE tWO"), (6, long), (7, long + " end"), (8, "éß" * 9), (8, "éß" * 9)]
    got = op.edited_and_next(spark.createDataFrame([(*r, "k", 1, "a", 2) for r in rows[::-1]], DOCS)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 0].near_next == 1 and by[2, 0].near_next == 1 and by[3, 3].near_next == 0 and by[4, 7].near_next == 1 and by[6, len(long)].near_next > 0.99
    ordered = [r for r in rows if r[0] is not None]
    assert {(r.doc_id, bytes(r.edited_sha256).hex()) for r in got if r.doc_id in (4, 5, 6)} == {
        (i, hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[k + 1][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered) if i in (4, 5, 6)
    }
    one = op.edited_and_next(spark.createDataFrame([(9, "abcd")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1 and bytes(one.edited_sha256) == hashlib.sha256(b"abab").digest()
    assert op.edited_and_next(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_and_single_texts_agree(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, int(n))) for n in rng.integers(0, 60, 700)]
    whole, has = op.fingerprint(texts)
    alone = [op.fingerprint([t]) for t in texts]
    assert all((w == a[0]).all() and h == a[1][0] for w, h, a in zip(whole, has, alone, strict=True))
    found = op.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(bytes(r.fingerprint) == whole[r.doc_id].tobytes() for r in found)


def test_densified_bins_are_full_and_keep_full_bins():
    values = op.minima(pa.array(["a b c d e f g", "one"]))
    full = values != op._EMPTY
    dense = op.densified(values)
    assert (dense != op._EMPTY).all() and (dense[full] == values[full]).all()
    assert all(set(d) == set(v[f]) for d, v, f in zip(dense, values, full, strict=True))
