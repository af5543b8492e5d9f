"""The defined results of each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, chat, components, decontaminate, exact_dedup, extract, near_dedup, pitman_yor, quality, substrings, warc

LONG = " ".join(f"word{i}" for i in range(20_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, block string"  # with names that operators use themselves
ROWS = [
    (1, None, None, None, None, "x", 9, "b"), (2, "", "en", "s", 0, "x", 9, "b"), (3, "   \n", "en", "s", 4, "x", 9, "b"), (4, "Abc def", "en", "s", 7, "x", 9, "b"), (5, "aBC dEF", "en", "s", 7, "x", 9, "b"),
    (6, LONG, "en", "s", 1, "x", 9, "b"), (7, LONG + " end", "en", "s", 1, "x", 9, "b"), (8, "ÀBC É", "fr", "s", 5, "x", 9, "b"), (9, "àbc é", "fr", "s", 5, "x", 9, "b"), (None, "Abc def", "en", "s", 7, "x", 9, "b"), (8, "ÀBC É", "fr", "s", 5, "x", 9, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(spark, docs, none):
    found = exact_dedup.duplicate_groups(docs)
    assert found.count() == len(ROWS) and exact_dedup.duplicate_groups(none).count() == 0
    got = by(found, "keep_id", "group_size", "kept")
    assert got[1] == (2, 2, False) and got[2] == (2, 2, True) and got[3] == (3, 1, True)
    assert got[4] == (5, 3, False) and got[5] == (5, 3, True) and got[None] == (5, 3, False) and got[8] == (8, 2, True) and got[9] == (9, 1, True)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]


def test_exact_dedup_compares_texts_of_equal_digests(docs):
    from pyspark.sql import functions as F

    a, b = (sorted(map(str, exact_dedup.duplicate_groups(docs, **o).drop("text_sha256").collect())) for o in ({}, {"digest": lambda c: F.substring(c, 1, 1)}))
    assert a == b


def test_near_dedup(docs, none):
    got = by(near_dedup.near_duplicates(docs, 3, 85), "n_shingles", "component_id", "kept")
    assert near_dedup.near_duplicates(none).count() == 0
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[7] == (19999, 6, False) and got[None] == (1, None, True)
    assert got[8][1] == 8 and got[9][1] == 9
    assert near_dedup.deduplicate(docs).columns == docs.columns


def test_near_dedup_of_a_crowded_group_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.choice(60, int(rng.integers(0, 6)), replace=False):
            words[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = by(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "component_id")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    assert {i: c for i, (c,) in got.items()} == label


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components.components(chain).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "abc DEF"), (2, None), (3, " ".join(f"word{i}" for i in range(50, 62))), (12, "abc"), (None, "é")], "item_id long, text string")
    got = by(decontaminate.contamination(docs, items), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got[1] == (0, 0, 0, decontaminate.digest([]), False) and got[4] == (2, 2, 2, decontaminate.digest(["1", "12"]), True)
    assert got[6] == (20000, 12, 1, decontaminate.digest(["3"]), True) and got[9][1:3] == (1, 0)
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert {1, 2, 3} <= {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()}


def test_decontamination_keeps_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, "nothing of this stands anywhere")], "item_id long, text string")
    odd = docs.selectExpr("*", "1 as _id", "2 as __id")
    assert decontaminate.decontaminate(odd, items).columns == odd.columns and decontaminate.decontaminate(odd, items).count() == odd.count()


def test_warc_of_others(spark, tmp_path):
    """Archives without an index: plain, a member a record, all records in one member; long payloads, other types, no headers inside."""
    import gzip

    long = b"x" * 3_000_000
    wanted = [("a", "response", b"hello"), ("b", "response", long), ("c", "response", b""), ("d", "revisit", b"hello")]
    parts = [warc.record(i, kind, f"http://h/{i}", "S", "a" if kind == "revisit" else None, p) for i, kind, p in wanted]
    if parts[0][:2] == b"\x1f\x8b":
        parts = [gzip.decompress(p) for p in parts]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoft: us\n\r\n\r\n"
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <o>\r\nContent-Type: application/http\r\nContent-Length: 3\r\n\r\nodd\r\n\r\n"
    every = [info, *parts, odd]
    forms = {"p": b"".join(every), "m": b"".join(map(gzip.compress, every)), "o": gzip.compress(b"".join(every))}
    for name, data in forms.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / ("x.warc" if name == "p" else "x.warc.gz")).write_bytes(data)
        read = warc.read_archive(spark, str(tmp_path / name))
        got = {r.record_id: (r.record_type, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in read.collect()}
        assert got["a"] == ("response", 5, b"hello") and got["b"] == ("response", len(long), long) and got["c"] == ("response", 0, b"")
        assert got["d"] == ("revisit", 5, None) and got["o"] == ("response", 3, b"odd") and got["i"][0] == "warcinfo" and len(got) == 6
        assert [r.record_id for r in read.filter("record_type = 'revisit'").collect()] == ["d"]
        assert {r.payload for r in warc.read_archive(spark, str(tmp_path / name), payload=False).collect()} == {None}


def test_warc_in_ranges(spark, tmp_path, monkeypatch):
    """However a file is cut into ranges of bytes, each record is read once."""
    pages = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 40) as html").coalesce(2)
    warc.write_archive(pages, str(tmp_path / "a"))
    for size in (1, 100, 1000, 1 << 20):
        monkeypatch.setattr(warc, "SPLIT_BYTES", size)
        reader = warc.WarcReader(str(tmp_path / "a"), True)
        found = [i for span in reader.partitions() for batch in reader.read(span) for i in batch.column("record_id").to_pylist()]
        assert len(found) == len(set(found)) == 50


def test_decontamination_in_chunks_and_near(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, f"word{k} word{k + 1} word{k + 2}") for k in range(5)], "item_id long, text string")
    whole = by(decontaminate.contamination(docs, items, 3), "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 1)
    assert by(decontaminate.contamination(docs, items, 3), "n_hit", "items_sha256") == whole and whole[6][0] == 7
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    assert by(decontaminate.contamination(docs, items, 3), "n_hit", "items_sha256") == whole
    index = decontaminate.build_index(docs)
    far = spark.createDataFrame([(1, "word30 word10 word20"), (2, "word1 word900")], "item_id long, text string")
    assert {(r.doc_id, r.item) for r in decontaminate.near(index, far, 3, slop=25).collect()} == {(6, "1"), (7, "1")}


def test_html(spark):
    page = "<html><head><title>t</title></head><body><div class='cookie-banner'>We use</div><nav>menu</nav>{}<article><h1>T</h1><p>one &amp; two<p>three<br>four</article><div id=comments>c</div></body>"
    rows = [(1, "http://a.b/x/12", page.format("")), (2, None, None), (3, "http://a.b/x/13", ""), (4, "http://c.d/1", "<div>shared line</div><div>only here</div>"), (5, "http://c.d/2", "<div>shared line</div><div>and here</div>"), (5, "http://c.d/2", "<div>shared line</div><div>and here</div>")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    found = extract.main_text(pages).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in found}
    assert len(found) == 6 and got[1] == ("T\none & two\nthree four", 22) and got[2] == ("", 0) and got[4] == ("only here", 9) and got[5][0] == "and here"
    assert extract.main_text(pages.limit(0)).count() == 0


def test_html_without_markup_is_told_by_neighbours(spark):
    """Nothing here names what a block is, or names it wrongly; only other pages show what is the site's."""
    page = "<div>Start</div><div class=article>Read our papers</div><div>{}</div><div>{}</div><div>Imprint</div>"
    rows = [(k, f"http://a.b/{d}/{k}", page.format(f"First of {k}", f"Second of {k}" if k != 3 else "Second of 2")) for k, d in ((1, "x"), (2, "x"), (3, "x"), (4, "yy/zz"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    assert got == {1: "First of 1\nSecond of 1", 2: "First of 2\nSecond of 2", 3: "First of 3\nSecond of 2", 4: "First of 4\nSecond of 4"}  # one neighbour quotes, the other lacks it


def test_nearest_urls():
    others = [("/a/12", 1), ("/a/2", 2), ("/a/125", 3), ("/b", 4)]
    assert extract.nearest("/a/124", others) == [1, 3] and extract.nearest("/c", others) == [1, 2] and extract.nearest("/c", []) == []


def test_html_unclosed_and_long(spark):
    deep = "<div>" * 3000 + "<b>" * 3000 + "x" + "</i>" * 3000 + "</b>" * 10 + "<p>y" * 3000
    pages = spark.createDataFrame([(1, "http://a.b/1", deep), (2, "http://a.b/2", "<p>" + "long " * 400_000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    assert got[1] == "x" + "\ny" * 3000 and len(got[2]) == 5 * 400_000 - 1


def test_html_of_copies(spark):
    body = "".join(f"<div>paragraph {i} of the text</div>" for i in range(12))
    page = "<div>site line</div>{}<div>imprint</div>"
    rows = [(1, "http://a.b/x/1", body), (2, "http://a.b/x/2", body), (3, "http://a.b/x/3", "<div>another page</div>")]  # equal ones and one of the same site
    rows += [(4, "http://c.d/x/1", body), (5, "http://c.d/x/1-print", body), (6, "http://e.f/1", body), (7, "http://e.f/2", body + "<div>Printed</div>")]
    pages = spark.createDataFrame([(i, u, page.format(b)) for i, u, b in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in extract.main_text(pages).collect()}
    assert got[1] == got[2] == [f"paragraph {i} of the text" for i in range(12)] and got[3] == ["another page"]
    assert len(got[4]) == len(got[5]) == 14 and len(got[6]) == 14 and got[7][-2:] == ["Printed", "imprint"]


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = extract.common(a, b)
    it = iter(b)
    assert len(found) == best[-1][-1] and found == sorted(found) and all(any(a[k] == y for y in it) for k in found)


TRICKY = ["", " ", "a  b", "don't'll 123 ½ <|endoftext|> x<|endoftext|>", "　 \x1c\x85é", "ab" * 3000, " \n\n\t x", "𝔘 🤖🤖 ñ", "x " * 900 + "'s" * 700]


def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@given(st.lists(st.one_of(st.sampled_from(TRICKY), st.text(max_size=40), st.text(alphabet="ab c'<|>\n", max_size=200)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_the_library(texts):
    encoder, truth = bpe.ChunkEncoder(bpe.default_tokenizer()), hf()
    joined = [*texts, " ".join(texts) * 3]
    try:
        [t.encode() for t in joined]
    except UnicodeEncodeError:
        return
    for text, ids in zip(joined, encoder.batch(pa.array(joined))):
        want = truth.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and encoder.decode(ids) == truth.decode(want, skip_special_tokens=False)


def test_bpe(docs, none):
    got = by(bpe.round_trip(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    ids = np.array(hf().encode(LONG, add_special_tokens=False).ids, "<u4")
    assert got[1][0] == 0 and got[6] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(LONG.encode()).hexdigest())
    assert bpe.round_trip(none).count() == 0
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}[6] == LONG


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>x"), (3, None, None), (4, "http://a/4", ""), (None, "http://a/5", "<p>x"), (6, "http://a/6\r\nX: y", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (4, "revisit", 2), 2: (4, "response", None), None: (4, "revisit", 2), 3: (0, "revisit", 4), 4: (0, "response", None), 6: (400_000, "response", None)}
    assert {r.page_id: r.record_type for r in warc.round_trip(pages, least=5).collect()}[1] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0
    warc.write_archive(pages, str(tmp_path / "a"))
    one = warc.read_archive(spark, str(tmp_path / "a")).filter("record_type = 'response' and record_id = 'urn:page:2'").collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"<p>x" and one[0].payload_digest == base64.b32encode(hashlib.sha1(b"<p>x").digest()).decode()
    headers = warc.read_archive(spark, str(tmp_path / "a"), payload=False)
    assert headers.filter("payload is not null").count() == 0 and headers.count() == 6


def test_chat(spark):
    schema = "conv_id long, turn long, role string, kind string, call_id string, parent_id string, name string, arguments string, content string, level int"
    rows = [
        (1, 0, "assistant", "call", "a", None, "add", '{"y": 2, "x": 1}', None, 7), (1, 1, "tool", "result", "a", None, None, None, "3", 7), (1, 2, "assistant", "call", "b", "a", "add", '{"x": "1", "z": 0}', None, 7),
        (1, 3, "tool", "result", "q", None, None, None, 'say "hi"\n', 7), (1, 4, "assistant", "call", "c", "d", "nope", "broken", None, 7), (1, 5, "assistant", "call", "d", "c", "add", None, None, 7), (None, 6, "user", "message", None, None, None, None, None, 7),
    ]
    schemas = {"add": {"x": {"type": "integer", "required": True, "minimum": 0}, "y": {"type": "number"}}}
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, schema), schemas).collect()}
    assert got[0].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","type":"call"}' and got[0].linked and got[0].valid and got[0].level == 0
    assert got[1].linked and got[1].level == 1 and got[2].level == 2 and got[2].errors == "x: not integer; z: unknown" and not got[3].linked
    assert got[4].errors == "arguments: not an object; cycle" and got[4].level is None and got[5].errors == "arguments: not an object; cycle" and got[3].json == '{"content":"say \\"hi\\"\\n","id":"q","type":"result"}'
    assert got[6].json == '{"content":null,"role":"user","type":"message"}'
    turns = spark.createDataFrame([(1, 0, "user", None, 5), (1, 1, "assistant", "x", 5), (1, 1, "assistant", "x", 5), (None, None, None, None, 5)], "conv_id long, turn long, role string, text string, kind int")
    assert chat.link(chat.from_turns(turns), chat.RESPOND).count() == 4 and chat.link(chat.from_turns(turns.limit(0)), chat.RESPOND).count() == 0


def test_chain_of_many_calls(spark):
    n = 3000
    calls = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, call_id string, parent_id string")
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {f"c{i}": i for i in range(n)}


def removed(texts, length):
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("big", [2, 256])
def test_repeats_by_brute_force(spark, big, monkeypatch):
    monkeypatch.setattr(substrings, "BIG", big)
    rng = np.random.default_rng(3)
    pieces = ["".join(rng.choice(list("abcdefgh é"), 150)) for _ in range(6)]
    texts = ["".join(pieces[k] if rng.random() < 0.7 else "".join(rng.choice(list("xyz "), int(rng.integers(0, 90)))) for k in rng.integers(0, 6, 5)) for _ in range(40)]
    texts += ["ab" * 400, "ab" * 130, "", None, "q" * 199, "q" * 200, "q" * 201]
    found = by(substrings.remove_repeats(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, print string")), "n_removed", "n_bytes")
    raw = [(t or "").encode() for t in texts]
    assert [found[i] for i in range(len(texts))] == [(g, len(r)) for g, r in zip(removed(raw, 200), raw)]


def test_repeated_rows_and_empty_table(spark, docs, none):
    assert substrings.remove_repeats(none).count() == 0
    got = by(substrings.remove_repeats(docs, texts=False), "n_removed", "n_bytes", "n_spans")
    assert got[1] == (0, 0, 0) and got[6][0] == len(LONG) and got[7][0] == len(LONG) and got[None][1] == 7


def test_perplexity_model(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, None), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by(quality.judge(docs, labels), "perplexity", "kept")
    assert got[1] == (None, False) and got[3] == (None, False) and got[4][1] and got[6][1] and got[8][0] > got[4][0]
    assert quality.judge(none, labels).count() == 0
    assert by(quality.judge(docs, labels.limit(0)), "kept")[4] == (True,) and {r.doc_id for r in quality.keep_good(docs, labels).collect()} <= {4, 5, 6, 7, 8, 9, None}


def asked(model, grams, order):
    """The model's log probability of each n-gram."""
    rows = model.mapInArrow(quality._keyed(order), "key long, logp float, backoff float").toPandas().astype({"logp": float, "backoff": float})
    rows["key"] = rows["key"].to_numpy().view(np.uint64)
    rows = rows.sort_values("key")
    chars = np.frombuffer("".join(g.rjust(order, "\0") for g in grams).encode("utf-32-le"), np.uint32).reshape(len(grams), order)
    return quality.back_off(chars, rows["key"].to_numpy(), rows["logp"].to_numpy(), rows["backoff"].to_numpy()).tolist()


def read(text):
    """A text as the model reads it."""
    words = text.split()
    return "\x02" + "".join(("\x04" if k and words[k - 1] == w else "") + w + "\x03" for k, w in enumerate(words))


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by its definition: the probability of the last character of an n-gram."""
    n = Counter(t[max(0, i - order + 1) : i + 1] for t in texts for i in range(1, len(t)))
    n += Counter(tail[1:] for tail in {g[i:] for g in n for i in range(len(g) - 1)})
    discounts = {}
    for size in range(1, order + 1):
        of = Counter(c for g, c in n.items() if len(g) == size)
        n1, n2, n3, n4 = (max(of[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[size] = [min(max(v, 0.1), i - 0.05) for i, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    d = lambda g: discounts[len(g)][min(n[g], 3) - 1]
    total, lost = Counter(), Counter()
    for g in n:
        total[g[:-1]] += n[g]
        lost[g[:-1]] += d(g)
    known = sum(len(g) == 1 for g in n) + 1

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / known
        if not total[g[:-1]]:
            return below
        return (n[g] - d(g) if g in n else 0) / total[g[:-1]] + lost[g[:-1]] / total[g[:-1]] * below

    return p


@pytest.mark.parametrize("order", [2, 5])
def test_perplexity_by_brute_force(spark, order):
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "b", "ca", "caé", "𝔘b"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(40)] + ["never seen zz zz", "é"]
    p = kneser_ney([read(t) for t in texts[:25]], order)
    model = quality.train(spark.createDataFrame([(t,) for t in texts[:25]], "text string"), order)
    got = by(quality.perplexities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, order), "n_chars", "perplexity")
    for i, t in enumerate(texts):
        t = read(t)
        logs = [math.log(p(t[max(0, k - order + 1) : k + 1])) for k in range(1, len(t))]
        assert got[i][0] == len(logs) and abs(math.log(got[i][1]) + sum(logs) / len(logs)) < 1e-5


def test_perplexity_model_sums_to_one(spark):
    train = spark.createDataFrame([("the cat sat on the mat the end",), ("a cat and a hat",)], "text string")
    model = quality.train(train, 3)
    symbols = sorted({g.gram for g in model.collect() if len(g.gram) == 1 and g.logp is not None} | {"\ufffd"})
    for context in ("\x02t", "at", "zz", "\x02"):
        assert abs(sum(map(math.exp, asked(model, [context + s for s in symbols], 3))) - 1) < 1e-6


def test_perplexity_reads_across_words(spark):
    docs = spark.createDataFrame([(1, "ab cd ef gh", "en"), (2, "gh ef cd ab", "en"), (3, "Ab  cd\n𝔘é cd cd", "en"), (None, "ab cd ef gh", "en")], "doc_id long, text string, lang string")
    model = quality.train(spark.createDataFrame([("ab cd ef gh ab cd ef gh",)] * 3, "text string"), 5)
    got = by(quality.perplexities(docs, model, 5), "n_chars", "perplexity")
    assert got[1] == got[None] and got[1][1] < got[2][1] / 2 and got[1][0] == got[2][0] == 12
    text = read("ab cd 𝔘é cd cd")
    logp = asked(model, [text[max(0, i - 4) : i + 1] for i in range(1, len(text))], 5)
    assert got[3][0] == len(logp) and abs(math.log(got[3][1]) + sum(logp) / len(logp)) < 1e-6


def test_perplexity_in_many_blocks(spark, docs, monkeypatch):
    model = quality.train(docs.filter("doc_id in (4, 6)"), 5)
    whole = sorted(map(str, quality.perplexities(docs, model).collect()))
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1)
    monkeypatch.setattr(quality, "PIECE", 1)
    assert sorted(map(str, quality.perplexities(docs, model).collect())) == whole and len(whole) == len(ROWS)


def test_thresholds_cover_all_held_out_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "trusted", partial(quality.trusted, limit=1))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two"), (F.col("id") % 7).cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    unseen = {r.doc_id for r in quality.labelled_good(labels).filter("unseen").collect()}
    got = by(quality.judge(docs, labels), "perplexity", "threshold", "lang")
    assert unseen and unseen.isdisjoint(r.doc_id for r in quality.trusted(labels).collect())
    for lang in ("en", "fr"):
        assert {v[1] for v in got.values() if v[2] == lang} == {max(got[i][0] for i in unseen if got[i][2] == lang) * quality.MARGIN}


def test_pitman_yor_by_a_plain_sampler(spark):
    """A sampler that moves customers one by one, over the whole hierarchy, gives nearly the same scores."""
    import random

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], 40, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(14)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(14)]
    tokens = [[*t.split(), "\n"] for t in texts]
    pairs = [[(u, w) for u, w in zip(["\n", *ws[:-1]], ws)] for ws in tokens]
    c = Counter(p for k, ps in enumerate(pairs) if not held[k] for p in ps)
    own = Counter()
    for (u, _), n in c.items():
        own[u] += n
    known, s = len({w for _, w in c}), pitman_yor.STRENGTH
    d = pitman_yor.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    random.seed(4)
    seats, top = {p: [n] for p, n in c.items()}, Counter(w for _, w in c)
    top = {w: [n] for w, n in top.items()}
    e, sums, samples = 0.8, Counter(), 0

    def move(tables, discount, weight):
        x, j = random.random() * sum(tables), 0
        while x >= tables[j]:
            x, j = x - tables[j], j + 1
        tables[j] -= 1
        if not tables[j]:
            tables.pop(j)
        x, j = random.random() * (sum(tables) - discount * len(tables) + weight()), 0
        while j < len(tables) and x >= tables[j] - discount:
            x, j = x - tables[j] + discount, j + 1
        tables[j:] = [tables[j] + 1, *tables[j + 1 :]] if j < len(tables) else [1]

    for epoch in range(150):
        eaten, held_by = Counter(), Counter()
        for (u, w), t in seats.items():
            eaten[w] += len(t)
            held_by[u] += len(t)
        for w, n in eaten.items():
            more = n - sum(top[w])
            if more > 0:
                top[w][0] += more
            while more < 0:
                j = random.choices(range(len(top[w])), top[w])[0]
                top[w][j] -= 1
                top[w], more = [x for x in top[w] if x], more + 1
            for _ in range(n):
                move(top[w], e, lambda: (s + e * sum(map(len, top.values()))) / (known + 1))
        k, all_ = sum(map(len, top.values())), sum(eaten.values())
        p = {w: (eaten[w] - e * len(top[w]) + (s + e * k) / (known + 1)) / (s + all_) for w in top}
        if epoch >= 30:
            samples += 1
            for q in {q for ps in pairs for q in ps}:
                sums[q] += (c[q] - d * len(seats.get(q, ())) + (s + d * held_by[q[0]]) * p[q[1]]) / (s + own[q[0]])
        for (u, w), t in seats.items():
            for _ in range(sum(t)):
                move(t, d, lambda: (s + d * held_by[u]) * p[w])
        e = pitman_yor.discount(sum(n == 1 for n in eaten.values()), sum(n == 2 for n in eaten.values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = pitman_yor.scores(docs, burn=4, samples=6)
    got = by(scored, "score", "held_out")
    for i, ps in enumerate(pairs):
        want = sum(math.log10(sums[q] / samples) for q in ps)
        assert got[i][1] == held[i] and abs(got[i][0] - want) < 0.02 * abs(want)
    measured = {r.held_out: r.perplexity for r in pitman_yor.perplexity(scored).collect()}
    for side in (False, True):
        mine = [i for i in range(14) if held[i] == side]
        assert abs(math.log10(measured[side]) + sum(got[i][0] for i in mine) / sum(len(pairs[i]) for i in mine)) < 1e-9


def test_pitman_yor(docs, none):
    assert pitman_yor.scores(none).count() == 0
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith(("hpy_", "kn_"))]
    got = by(pitman_yor.scores(docs), "n_tokens", "n_known", "score", "base_score", "held_out")
    assert got[1][0] == 1 and got[3][0] == 1 and got[6][0] == 20001 and all(v[2] < 0 for v in got.values())


def test_seating_follows_the_process():
    rng = np.random.default_rng(1)
    d = 0.5
    for c, a in ((2, 0.5), (3, 0.5), (7, 2.0), (40, 3.0)):
        many = np.full(2000, c), np.full(2000, a)
        seats = pitman_yor.filled(*many, d, rng)
        for _ in range(80):
            seats = pitman_yor.reseat(many[0], *seats, many[1], d, rng, 24)
        assert seats[0].sum() == len(seats[1]) and (np.add.reduceat(seats[1], np.cumsum(seats[0]) - seats[0]) == c).all()
        ways = {1: 1.0}  # of seating n customers at t tables, by weight
        for n in range(1, c):
            ways = {t: ways.get(t - 1, 0) + (n - d * t) * ways.get(t, 0) for t in range(1, n + 2)}
        weight = np.array([ways[t] * a**t for t in range(1, c + 1)])
        expected = (weight * np.arange(1, c + 1)).sum() / weight.sum()
        assert abs(seats[0].mean() - expected) < 0.05 * expected
    t, sizes = pitman_yor.filled(np.array([0, 1, 500]), np.full(3, 0.5), d, rng)
    assert t[:2].tolist() == [0, 1] and sizes.sum() == 501
    empty = np.zeros(0, np.int64)
    assert len(pitman_yor.reseat(empty, empty, empty, np.zeros(0), d, rng, 24)[0]) == 0


def test_a_restaurant_over_several_shards(docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 400)
    got = by(pitman_yor.scores(docs), "n_tokens", "score")
    assert got[6][0] == 20001 and all(v[1] < 0 for v in got.values())
