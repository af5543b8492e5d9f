"""Structure repair and the prefix trie against brute force, on awkward rows and with small bands and shards."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import prefix_trie, structure

TURNS = "conv_id long, turn long, role string, text string"
MORE = TURNS + ", digest int, number string, gone string, band string, key int"  # names that the operators use themselves
AWKWARD = [
    (None, 1, "user", "hi."), (None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (1, 3, "assistant", ""),
    (1, 2, "user", "x"), (2, 0, "system", "s."), (2, 0, "", "q"), (3, 7, "tool", "z " * 50_000 + "."), (-7, 0, "user", "é"), (-7, 0, "user", "é"),
    (7, 1, "assistant", "b"), (7, 1, "assistant", ""), (7, 1, "assistant", None), (10, 0, " ", "\x0b \n"), (12, 4, "user", "end. \n"),
] * 2


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault): Dijkstra over (rows taken, state), ties by the audit."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, heap = {}, [((0, ""), 0, 0, ())]
    while heap:
        (cost, audit), i, q, turns = heapq.heappop(heap)
        if (i, q) in best:
            continue
        best[i, q] = cost, audit, turns
        wanted = "assistant" if q == 2 else "user"
        then = after[q, wanted[0]]
        heapq.heappush(heap, ((cost + 2, audit + "I"), i, then, (*turns, (wanted, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, ((cost + 3, audit + "D"), i + 1, q, turns))
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                heapq.heappush(heap, ((cost + 2, audit + "R"), i + 1, then, (*turns, (wanted, text))))
                if (q, role[:1]) in after:
                    heapq.heappush(heap, ((cost, audit + "K"), i + 1, after[q, role[:1]], (*turns, (role, text))))
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def decoded(rows):
    decoder, out = structure.Decoder(), []
    for k, row in enumerate(rows):
        out += decoder.row(*row, k)
    cost, rest = decoder.end()
    out += rest
    return (cost, "".join(m for m, _ in out), tuple(t[1:] for m, t in out if m != "D")), decoder


def test_decoder_by_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [
            (rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), f"t{k}", rng.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for k in range(rng.randint(0, 12))
        ]
        assert decoded(rows)[0] == cheapest(rows), rows


def test_decoder_holds_little():
    rng = random.Random(5)
    _, decoder = decoded([(rng.choice(["user", "assistant", "tool"]), "x", rng.choice([None, "truncated", "blank"])) for _ in range(5000)])
    assert decoder.most < 100


def test_repair_by_brute_force(spark):
    found = structure.report(structure.edits(structure.damaged(spark.createDataFrame(AWKWARD, TURNS)), "dropped"))
    got, convs = {r.conv_id: tuple(r)[1:] for r in found.collect()}, defaultdict(list)
    for c, *row in AWKWARD:
        convs[c].append(row)
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        out = []
        for turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            out += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
        out.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, judged = set(), []
        for _, role, text in out:
            full = re.findall(r"[^\x20\x09-\x0D]", text)
            judged.append((role, text, "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit, turns = cheapest(judged)
        at, initials = [t for t, _, _ in out if t is not None], [r[:1] for _, r, _ in out]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        counts = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert got[c] == (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(map(":".join, turns)).encode()).hexdigest()), c


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", " ")]
    found = structure.edits(spark.createDataFrame([(*r, 1, "", "", "", 2) for r in rows], MORE)).collect()
    assert [(r.edit, r.role, r.text, r.fault) for r in found if r.edit] == [
        ("K", "user", "Hi.", None), ("I", "assistant", "", None), ("K", "user", "Well?", None), ("K", "assistant", "Yes.", None), ("D", None, None, "blank"),
    ]
    assert [r.cost for r in found if not r.edit] == [5]
    assert structure.edits(spark.createDataFrame([], MORE)).count() == 0


def test_findclose():
    rng = random.Random(2)
    for _ in range(200):
        bits, depth, left = [], 0, rng.randint(1, 400)
        while left or depth:
            if left and (not depth or rng.random() < 0.55):
                bits, depth, left = [*bits, 1], depth + 1, left - 1
            else:
                bits, depth = [*bits, 0], depth - 1
        tree, stack, wanted = prefix_trie.Parentheses(np.array(bits, np.int8)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                wanted[stack.pop()] = i
        assert tree.findclose(tree.opens).tolist() == [wanted[i] for i in tree.opens]


def trie(rows):
    """Every node of the rebuilt conversations, by listing all prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), text))
    own, paths = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(int(c - np.fmod(c, 5)), [])[:h] + own[c][h:]
    members, ends, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        ends[tuple(p)].append(c)
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def conversations():
    rng = random.Random(3)
    rows = [
        (c, t, "user" if rng.random() < 0.9 else "assistant", f"t{t if rng.random() < 0.9 else rng.randint(0, 3)}")
        for c in range(40) for t in range(rng.choice([0, 1, 3, 9, 12, 30]))
    ]
    return rows + AWKWARD


@pytest.mark.parametrize("sizes", [{"nodes": 10}, {"band": 8, "nodes": 40}])
def test_trie_by_brute_force(spark, sizes):
    turns, convs = prefix_trie.rebuilt(prefix_trie.positions(spark.createDataFrame([(*r, 1, "", "", "", 2) for r in conversations()], MORE)))
    got = prefix_trie.trie(turns, convs, **sizes).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == trie(conversations())


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 0, "user", "x")]):
        assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.positions(spark.createDataFrame(rows, TURNS)))).count() == 0
