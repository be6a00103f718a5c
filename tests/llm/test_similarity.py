import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from stageflow.llm import decontaminate as D
from stageflow.llm import ngram_join as N
from stageflow.llm.components import components


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(docs, threshold=0.8):
    """doc index -> (class id, links), by all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    linked = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(linked):
            for j in js:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
                elif label[i] < label[j]:
                    label[j], changed = label[i], True
    classes = defaultdict(list)
    for i, x in enumerate(label):
        classes[x].append(docs[i][0])
    best = {x: min((d for d in ids if d is not None), default=None) for x, ids in classes.items()}
    return Counter((docs[i][0], best[label[i]], len(linked[i])) for i in range(len(docs)))


def family(rng, n, words, changes):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 5])
def test_classes_equal_all_pairs(spark, block):
    rng = random.Random(5)
    texts = family(rng, 40, 120, 6) + family(rng, 10, 30, 1) + family(rng, 12, 400, 12) + ["short one", "short one", "short  one", None, None, "", " ", "a b c d e", "a b c d e f"]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(40)] + [texts[0]] * 5
    docs = [(i * 3 % 211, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "only null ids " * 5), (17, texts[-1]), (17, texts[-1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in N.similarity_classes(df, block=block).collect())
    assert got == brute_classes(docs)


def test_join_odd_and_empty(odd_docs, no_docs):
    rows = N.similarity_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert Counter((r.class_id, r.n_links) for r in rows if r.doc_id in (1, 6, 7)) == {(1, 1): 2, (6, 1): 2}
    assert N.similarity_classes(no_docs).count() == 0


def test_least_matches_is_the_posterior_tail():
    """Against the tail of the beta posterior, summed numerically."""
    limits = N.least_matches(0.8, 1e-5)
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, limit in zip(range(N.STEP, N.FRESH + 1, N.STEP), limits, strict=True):
        def tail(m, n=n):
            density = x**m * (1 - x) ** (n - m)
            return density[x >= 0.8].sum() / density.sum()
        assert tail(limit) >= 1e-5 and (limit == 0 or tail(limit - 1) < 1e-5)


def test_exact_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    got = N.links(sets, i, j, Fraction("0.5"))
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(200, k) for k in range(201, 230)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def weights(w):
    c = Counter()
    for k in range(len(w) - 4):
        c[tuple(w[k : k + 5])] += sum(map(len, w[k : k + 5]))
    return c


def best_similarity(text, item):
    w, b = words_of(text), words_of(item)
    target, best = weights(b), 0.0
    for p in range(len(w) - len(b) + 1):
        m = weights(w[p : p + len(b)])
        both = sum(min(m[x], target[x]) for x in m)
        best = max(best, both / (sum(m.values()) + sum(target.values()) - both)) if both else best
    return best


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([14, 25, 25, 40, 59])))) for k in range(30)] + [(90, None), (91, "too short"), (92, "")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(rng.randrange(0, 120))]
        w = words_of(items[k % 30][1])
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = word()
        if k % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = w if k % 4 else [x.upper() + "," for x in w]
        docs.append((k, " ".join(body)))
    docs += [(None, items[0][1]), (500, None), (501, ""), (502, f"{items[1][1]} gap {items[2][1]} {items[1][1]}"), (502, f"{items[1][1]} gap {items[2][1]} {items[1][1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(df, bench).collect()
    expected = {(d, i) for d, t in docs for i, it in items if len(words_of(it)) >= 5 and best_similarity(t, it) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 10
    assert sum(r.doc_id == 502 for r in got) == 6
    flags = D.flagged(df, bench, "hit").collect()
    assert {r.doc_id for r in flags if r.hit} == {d for d, _ in expected}


def test_documents_shorter_than_the_item(spark):
    """Near copies without some of the first or last words, against the whole document as the one window."""
    rng = random.Random(3)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([59, 59, 40, 25, 14, 8])]
    docs = [(100 * k + 10 * a + b, " ".join(t.split()[a : len(t.split()) - b])) for k, t in items for a in range(6) for b in range(6) if a + b]
    docs += [(900, " ".join(items[0][1].split()[:-1] + ["other"])), (901, " ".join(items[1][1].split()[:30])), (902, "a b c d"), (None, " ".join(items[0][1].split()[:-1]))]
    expected = {}
    for d, t in docs:
        for i, it in items:
            w, target = words_of(t), weights(words_of(it))
            if 5 <= len(w) < len(words_of(it)):
                m = weights(w)
                both = sum(min(m[x], target[x]) for x in m)
                if (value := both / (sum(m.values()) + sum(target.values()) - both)) >= 0.8:
                    expected[d, i] = (0, len(w), pytest.approx(value))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in D.contaminated(df, bench).where("doc_id IS NULL OR doc_id != 900").collect()}
    assert got == expected and len(expected) > 30 and (1, 0) in got and (None, 0) in got
    assert {r.doc_id for r in D.flagged(df, bench, "hit").where("hit").collect()} - {900} == {d for d, _ in expected}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    index = D.Index(list(range(400)), [" ".join(f"t{x}" for x in rng.integers(0, 10**6, 20)) for _ in range(400)])
    probes = index.prints[rng.integers(0, 400, 300)]
    flips = rng.integers(0, 26, 300)
    for n, k in enumerate(flips):
        for b in rng.choice(64, k, replace=False):
            probes[n] ^= np.uint64(1) << np.uint64(b)
    row, item, far = index.near(probes, 20)
    all_ = np.bitwise_count(probes[:, None] ^ index.prints[None, :])
    assert sorted(zip(row.tolist(), item.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(all_ <= D.RADIUS).tolist()))
    assert (far == all_[row, item]).all()


def test_decontamination_odd_empty_and_slices(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "The cat sat on the mat, and looked at the dog"), (2, "word5 the of and word6 the of and")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in D.contaminated(odd_docs, bench).collect())
    assert got[1, 1] == 2 and got[6, 2] == got[7, 2] > 10 and {d for d, _ in got} == {1, 6, 7}
    monkeypatch.setattr(D, "SLICE", 1)
    assert [len(s) for s in D.slices(bench, "item_id", "text", 1)] == [1, 1]
    assert D.contaminated(no_docs, bench).count() == 0 and D.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert D.flagged(odd_docs, bench.limit(0), "hit").where("hit").count() == 0


def test_window_similarities_equal_counting():
    """Windows verified one from the other, with gaps, repeated shingles and shingles of the item that come more often than there."""
    rng = np.random.default_rng(5)
    vocabulary = np.sort(rng.integers(0, 2**63, 12).astype(np.uint64))
    chars = rng.integers(5, 40, 12)
    for size in (1, 3, 8):
        at = rng.integers(0, 12, 200)
        item_at = rng.integers(0, 9, size)
        item = D._multiset(vocabulary[item_at], chars[item_at])
        start = np.flatnonzero(rng.random(200 - size) < 0.3)
        got = D._similarities(vocabulary[at], chars[at], np.concatenate([[0], np.cumsum(chars[at])]), start, size, item)
        for s, value in zip(start, got, strict=True):
            a, b = Counter(at[s : s + size].tolist()), Counter(item_at.tolist())
            both, either = (sum(n * int(chars[k]) for k, n in x.items()) for x in (a & b, a | b))
            assert abs(value - both / either) < 1e-12


def test_repeated_passages_in_pieces(monkeypatch):
    """A text that repeats a passage many times gives one match a copy, the same in pieces of any size, and in time that grows with its length."""
    rng = np.random.default_rng(6)
    item = " ".join(f"w{n}" for n in rng.integers(0, 500, 40))
    other = " ".join(f"w{n}" for n in rng.integers(0, 500, 23))
    index = D.Index([7, 8, 9], [item, other, None])
    text = "\n".join([item, other, "some words between them"] * 60)
    h, weight, _, _ = D._shingles([text])
    whole = D._matches_of(h, weight, index, 0.8)
    assert [m[1] for m in whole if m[0] == 7 and m[3] == 1.0] == [67 * k for k in range(60)]
    assert [m[1] for m in whole if m[0] == 8 and m[3] == 1.0] == [67 * k + 40 for k in range(60)]
    monkeypatch.setattr(D, "PIECE", 64)
    monkeypatch.setattr(D, "_PAIRS", 16)
    assert D._matches_of(h, weight, index, 0.8) == whole
    monkeypatch.undo()
    h, weight, _, _ = D._shingles([" ".join([item] * 4000)])  # about 650 kB
    assert len(D._matches_of(h, weight, index, 0.8)) == 4000
