"""Each stage of the pipeline on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import random
from pathlib import Path

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id int, digest string, winner int"


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def rows():
    base, item = words(60, 1), words(12, 2)
    near = [*base[:-1], "other"]
    texts = [
        (1, " ".join(base)), (2, " ".join(base).upper().replace("W", "w")), (3, " ".join(near)), (4, None), (5, ""), (6, " \n"), (7, " ".join(words(20000, 3))),
        (8, "x " + " ".join(item) + " y"), (9, " ".join(words(30, 4))), (9, " ".join(words(30, 4))), (9, " ".join(words(30, 5))), (None, " ".join(words(30, 6))), (None, " ".join(base)), (10, "short one"),
    ]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, 1, "d", 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Tables in which the good documents are prose of few words."""
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (10, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("a", " ".join(words(12, 2)).upper()), (None, None), ("c", "")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def ran(spark, name, rows, folder):
    found = STAGES[name](spark, spark.createDataFrame(rows, DOCS), folder)
    if name != "bpe":
        assert found.columns == [c.split()[0] for c in DOCS.split(", ")]
    return found.collect()


def test_exact_stage(spark, rows, folder):
    best = {}
    for r in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        best[key] = max(best.get(key, (-1,)), (-1 if r[0] is None else r[0],))
    got = ran(spark, "exact_dedup", rows, folder)
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted(b[0] for b in best.values())


def test_near_stage(spark, rows, folder):
    got = ran(spark, "near_dedup", rows, folder)
    group = {}
    for r in [r for r in rows if r[0] is not None and shingles(r[1] or "")]:
        for s in [s for s in rows if s[0] is not None and shingles(s[1] or "")]:
            a, b = shingles(r[1]), shingles(s[1])
            if len(a & b) * 100 >= 80 * len(a | b):
                group[r[0]] = min(group.get(r[0], r[0]), s[0])
    stay = sorted(-1 if r[0] is None else r[0] for r in rows if r[0] is None or group.get(r[0], r[0]) == r[0])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == stay


def test_decontamination_stage(spark, rows, folder):
    got = ran(spark, "decontamination", rows, folder)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows if r[0] != 8)


def test_bpe_stage(spark, rows, folder):
    got = ran(spark, "bpe", rows, folder)
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}


def test_quality_stage(spark, rows, folder):
    got = {r.doc_id for r in ran(spark, "quality", rows, folder)}
    assert not got & {4, 5, 6}


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_nothing(spark, name, folder):
    assert ran(spark, name, [], folder) == []


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert not {r.doc_id for r in got} & {4, 5, 6, 8}
    assert Path(folder).exists()
