"""Operators 11 to 13 against brute force: odd tables, hot groups, very long texts."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from cohortloom.llm import filter_audit, lexical, minhash_forest
from cohortloom.session import scratch_path

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, class long, m int, mask int, part string, kept boolean, n long, score long"


def rows():
    rng = random.Random(11)
    texts = [None, None, "", "   \n", "one", "One", "two words", "Two  words", "x" * 9000, "ab Cd " * 4000, "日本 ünï é-ö $5 #tag 7a", "\x1c \x85 \xa0", "A|B"]
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "ΑΒΓ", "naïve", "x$y", "100%", "a_b"]
    texts += [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(1, 130))) for _ in range(80)]
    base = [f"v{i}" for i in range(220)]
    for edits in (0, 0, 1, 5, 10, 12, 13, 20, 40):
        copy = list(base)
        for at in rng.sample(range(220), edits):
            copy[at] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base).upper(), " ".join(base), " ".join(f"n{i % 7000}" for i in range(300_000))]
    out = [(i, t, rng.choice(["en", "de", None, ""]), 5, 6, 7, "p", True, 8, 9) for i, t in enumerate(texts)]
    return out + [out[30], out[30], out[4], (None, "one", "en", *[None] * 7), (None, None, None, *[None] * 7), (None, "only nameless words here", "fr", *[None] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(tuple(words) and [tuple(words)])


def component_names(data):
    """Smallest id of each row's component, by comparing all pairs of different sets."""
    sets = [pairs_of(r[1]) for r in data]
    kinds = sorted({s for s in sets if s}, key=sorted)
    root = {k: k for k in kinds}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(kinds, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            root[top(a)] = top(b)
    least = {}
    for r, s in zip(data, sets):
        if s and r[0] is not None:
            least[top(s)] = min(r[0], least.get(top(s), r[0]))
    return [least.get(top(s)) if s else r[0] for r, s in zip(data, sets)]


def test_op11_equals_brute_force(docs, nothing):
    want = collections.Counter((r[0], len(pairs_of(r[1])), name, r[0] == name) for r, name in zip(rows(), component_names(rows())))
    found = minhash_forest.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert collections.Counter(map(tuple, found)) == want
    assert minhash_forest.near_duplicates(nothing).count() == 0


def test_op11_crowded_regions_lose_no_link(spark, monkeypatch):
    """Tiles far smaller than a group of near copies, with members that only one other links."""
    monkeypatch.setattr(minhash_forest, "TILE", 6)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    data = []
    for _ in range(60):
        copy = [w if rng.random() > 0.01 else f"v{rng.randrange(99999)}" for w in base]
        data.append((len(data), " ".join(copy)))
    for start in range(0, 40, 2):  # chains that lead away from the group
        copy = data[start][1].split(" ")
        for _ in range(3):
            for at in rng.sample(range(150), rng.choice([6, 8, 9, 13])):
                copy[at] = f"u{rng.randrange(99999)}"
            data.append((len(data), " ".join(copy)))
    found = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [found[i] for i, _ in data] == component_names(data)
    assert 1 < len(set(found.values())) < len(data) - 50


def test_op11_links_at_the_very_bound(spark):
    """Of 100 pairs of words a copy has 80 (similarity 0.8, linked) or 79."""
    a = [f"a{i}" for i in range(101)]
    close, far = a[:81], a[:80]  # 80 of 100 pairs, and 79 of 100
    found = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(close))], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1}
    found = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(far))], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2}


def test_prefixes_follow_similarity():
    rng = np.random.default_rng(5)
    shared = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 180, np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 22, np.uint64)])) for _ in range(2))
        shared += (minhash_forest.prefixes(a) == minhash_forest.prefixes(b)).sum()
    # Similarity 0.8036: a prefix of four hashes is shared with odds of 0.417.
    assert abs(shared / 300 / minhash_forest.TREES - 0.8036**4) < 0.03


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def best_documents(data, items, k=20):
    worded = [(r[0], collections.Counter(terms(r[1]))) for r in data]
    worded = [(d, c) for d, c in worded if c]
    n_docs, total = len(worded), sum(sum(c.values()) for _, c in worded)
    df = collections.Counter(t for _, c in worded for t in c)
    found = {}
    for item, text in items:
        asked = collections.Counter(terms(text))
        scored = []
        for d, c in worded:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found[item] = [(None if none else d, -s) for s, none, d in sorted(scored)[:k]]
    return found


ITEMS = [(1, "w0 w1 w2 w2 The missing naïve"), (2, None), (3, "..."), (4, "ΑΒΓ 100 n5 n6 日本"), (5, " ".join(f"w{i}" for i in range(60)) * 3), (6, "one"), (None, "two words")]


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_op12_equals_brute_force(spark, docs, shard, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4 if shard == 50 else 1024)
    monkeypatch.setattr(lexical, "SCORED_ITEMS", 2 if shard == 50 else 128)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 50 if shard == 50 else 1 << 19)
    monkeypatch.setattr(lexical, "VISIT_POSTINGS", 90 if shard == 50 else 1 << 19)
    path = scratch_path(spark, "lexical")
    lexical.build_index(docs, path, shard)
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    found = collections.defaultdict(list)
    for r in lexical.search(spark, path, items).orderBy("item_id", "rank").collect():
        found[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    want = best_documents(rows(), ITEMS)
    assert dict(found) == {i: x for i, x in want.items() if x}


def test_op12_asks_an_index_again_and_an_empty_one(spark, nothing):
    path = scratch_path(spark, "lexical")
    data = [(i, "common " * (1 + i % 3) + f"own{i}") for i in range(50)]
    lexical.build_index(spark.createDataFrame(data, "doc_id long, text string"), path)
    for items in ([(1, "common own7")], [(1, "own3"), (2, "own4 own4")]):
        found = collections.defaultdict(list)
        for r in lexical.search(spark, path, spark.createDataFrame(items, "item_id long, text string"), k=5).orderBy("rank").collect():
            found[r.item_id].append((r.doc_id, r.score))
        assert dict(found) == best_documents(data, items, 5)
    empty = scratch_path(spark, "lexical")
    lexical.build_index(nothing, empty)
    assert lexical.search(spark, empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_op12_bounds_leave_out_only_what_cannot_count():
    rng = np.random.default_rng(2)
    strata = []
    for m in range(80, 120):
        docs = [(1000 * m + i, np.sort(rng.choice(30, 6, replace=False)), rng.integers(1, 4, 6)) for i in range(int(rng.integers(1, 9)))]
        b = lexical._block(m, docs)
        strata.append(lexical.Stratum(m, b.column(1)[0].values, *lexical._opened(b.column(2)[0].as_py(), b.column(3)[0])))
    items = [(np.sort(rng.choice(40, 5, replace=False)).astype(np.uint64), rng.integers(1, 10**4, 5)) for _ in range(20)]
    got, whole = lexical.rank(strata, items, 3), lexical.rank(strata, items, 10**6)
    for (ids, _, scores), (every, _, all_scores) in zip(got, whole):
        by = np.lexsort((every, -all_scores))[:3]
        assert ids.tolist() == every[by].tolist() and scores.tolist() == all_scores[by].tolist()


LABELS = [(0, 1, 0), (4, 1, 1), (5, 0, 1), (20, 1, None), (20, 0, 1), (30, 1, 1), (31, 1, 0), (None, 1, 1), (93, 1, 0), (94, 1, 0), (99999, 1, 1)]


def audited(data):
    least, fails = {}, []
    for r in data:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    for r in data:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails.append((r[2] or "", bad + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (r[0] is not None and r[0] > least[t]), r[0]))
    good, toxic = ({i for i, *x in LABELS if i is not None and x[k] == 1} for k in (0, 1))
    found, shapley = {}, collections.Counter()
    for part in {p for p, *_ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [i for f, i in own if letter in f and not before & set(f)]
                found[(part, order, step)] = [
                    sum(not (before | {letter}) & set(f) for f, _ in own), len(gone), sum(letter in f and bool(before & set(f)) for f, _ in own),
                    sum(f == letter for f, _ in own), sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
                shapley[(part, letter)] += len(gone)
    return {k: (*v, shapley[(k[0], k[1][k[2] - 1])]) for k, v in found.items()}


@pytest.mark.parametrize("cells", [4, filter_audit.SLICE, filter_audit.MAX_CELLS])
def test_op13_equals_brute_force(spark, docs, cells, monkeypatch):
    """With any size of sketch: a crowded one clears fewer texts and changes nothing."""
    if cells == 4:
        monkeypatch.setattr(filter_audit, "SLICE", 4)
    monkeypatch.setattr(filter_audit, "MAX_CELLS", cells)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == audited(rows())
    assert len(found) == 600 * len({r[2] or "" for r in rows()})


def test_op13_empty_tables(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit.audit(docs, labels).collect()} == {(0, 0)}


def test_sketch_clears_unique_texts_and_never_a_repeat():
    rng = np.random.default_rng(7)
    h = rng.integers(-(1 << 63), 1 << 63, 4000)
    h = np.concatenate([h, h[:500], h[:200]])
    counts = np.zeros(1 << 16, np.uint8)
    at, n = np.unique(filter_audit._cells(h, 1 << 16), return_counts=True)
    counts[at] = np.minimum(n, 2)
    maybe = filter_audit.met(h, filter_audit._packed(counts), 2)
    assert filter_audit.met(h, filter_audit._packed(counts), 1).all()
    assert maybe[:500].all() and maybe[4000:].all() and maybe[500:4000].mean() < 0.05
    assert (filter_audit._unpacked(filter_audit._packed(counts)) == counts).all()
