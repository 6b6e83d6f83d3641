"""Substrings, near-duplicates and vectors against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edges import TEXTS, frame, low, sha
from tidemark.llm.common import Words, window_hash
from tidemark.llm.components import connected_components, spanning_forest
from tidemark.llm.minhash import CirculantMinHash, exact_sets, first_of_each, near_duplicates, shingle_sets
from tidemark.llm.substrings import repeated_passages
from tidemark.llm.vectors import recall, vector_duplicates


def passages(seed=4, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = [[word() for _ in range(rng.choice((34, 35, 36, 60)))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(shared)
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(ws)))
    return rows + [(n, " ".join(["x"] * 80)), (n + 1, " ".join(["y", "z"] * 18))]


def brute_passages(rows, size=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    c = Counter(tuple(w[j : j + size]) for _, w in words for j in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if c[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [passages(), passages(8, 25) + passages(8, 10), TEXTS, []])
def test_passages(spark, rows):
    got = sorted((tuple(r) for r in repeated_passages(frame(spark, rows, clash=True)).collect()), key=repr)
    assert got == brute_passages(rows)


def near(seed=6, n=60):
    rng = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            ws = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(10**6)}"
        else:
            ws = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((3, 40, 120, 200)))]
            base.append(ws)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in ws)))
    return rows


def brute_near(rows, percent=85):
    sets = []
    for _, t in rows:
        w = low(t).split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = None if i is None else least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), c, i is None or c == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [near(), near(9, 90), TEXTS, []])
def test_near_duplicates(spark, rows):
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows, clash=True)).collect()), key=repr)
    assert got == brute_near(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    import tidemark.llm.components as c

    monkeypatch.setattr(c, "BLOCK", 3)
    monkeypatch.setattr(c, "WEIGHT", 400)
    monkeypatch.setattr(c, "SPEAKERS", 1)
    rows = near(12, 70)
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=repr) == brute_near(rows)


def chain(n=60):
    """Each text is linked with its neighbours only."""
    ws = [f"c{i}" for i in range(100 + 4 * n)]
    return [(i * 7 % n, " ".join(ws[4 * i : 4 * i + 100])) for i in range(n)]


def test_a_chain_over_blocks_is_one_component(spark, monkeypatch):
    import tidemark.llm.components as c

    monkeypatch.setattr(c, "BLOCK", 7)
    rows = chain()
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows), percent=85).collect()), key=repr) == brute_near(rows)


def thue_morse(n=11):
    x = [0]
    for _ in range(n):
        x += [1 - b for b in x]
    return x


def test_structured_words_do_not_collide(spark):
    """Words, and texts of two words, that hashes by powers modulo 2**64 confuse."""
    bits = thue_morse()
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    tail = [f"x{i}" for i in range(34)]
    rows = [(1, " ".join([a] + tail)), (2, " ".join([b] + tail)), (3, a), (4, b), (5, " ".join("AB"[x] for x in bits[:64])), (6, " ".join("BA"[x] for x in bits[:64])), (7, " ".join([a] * 6)), (8, " ".join([b] * 6))]
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=repr) == brute_near(rows)
    assert sorted((tuple(r) for r in repeated_passages(frame(spark, rows)).collect()), key=repr) == brute_passages(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\x85é", max_size=40), max_size=8), st.integers(1, 6))
def test_hashes_tell_words_and_runs_apart(texts, size):
    w = Words(pa.array(texts, pa.string()))
    ws = [t for x in texts for t in x.encode().split()]
    assert len(w) == len(ws) and [w.data[i:j].tobytes() for i, j in zip(w.start, w.end)] == ws
    for h in (w.hash, w.hashed(1)):
        assert len(set(zip(ws, h.tolist()))) == len(set(ws)) == len(set(h.tolist()))
    runs = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]
    h = window_hash(w.hash, size).tolist()
    assert len(h) == len(runs) and len(set(zip(runs, h))) == len(set(runs)) == len(set(h))
    ids, cuts = exact_sets(pa.array(texts, pa.string()), 5)
    hs, cuts2 = shingle_sets(pa.array(texts, pa.string()), 5)
    assert (cuts == cuts2).all()
    for i in range(len(texts)):
        for j in range(i):
            a, b = (set(ids[cuts[k] : cuts[k + 1]].tolist()) for k in (i, j))
            c, d = (set(hs[cuts[k] : cuts[k + 1]].tolist()) for k in (i, j))
            assert len(a & b) == len(c & d) or min(len(texts[k].encode().split()) for k in (i, j)) < 5


def test_first_of_each_keeps_columns(spark):
    df = frame(spark, clash=True)
    kept = first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "9", "10", "11", "11", "12", "None", "None"])


def test_first_of_each_loses_no_other_text(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(None, a), (None, a), (1, a), (2, a), (2, b), (2, b), (3, c), (3, c + " tail"), (4, None), (4, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in first_of_each(frame(spark, rows)).collect()), key=repr)
    assert [x for x in got if x[0] != 3] == sorted([(None, a), (None, a), (1, a), (2, b), (4, None), (4, "")], key=repr)
    assert len([x for x in got if x[0] == 3]) == 1
    assert first_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [near(21, 80), near(22, 80), chain(30)])
def test_first_of_each_keeps_the_first(spark, rows):
    want = sorted(i for i, _, _, kept in brute_near(rows, 80) if kept)
    assert sorted(r.doc_id for r in first_of_each(frame(spark, rows)).collect()) == want


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    m = CirculantMinHash(64, 8)
    s = m.signatures(np.concatenate([a, b]), np.array([0, 500, 1000]))
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.08


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    import tidemark.llm.components as c

    monkeypatch.setattr(c, "FEW", few)
    monkeypatch.setattr(c, "HUB", 50)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(1000, i) for i in range(1001, 1300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 200, 300)} == {100} and {got[i] for i in range(1000, 1300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    x = np.array([0.0, 0.4, 5.0, 0.8, 5.3])
    assert len(spanning_forest(5, lambda i, left: np.abs(x[left] - x[i]) <= 0.5)) == 3


def vectors(seed=2, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(100, 200):
        x[i] = x[i % 20] + rng.normal(size=d) * rng.choice((0.01, 0.2, 0.25, 0.3))
    x[200] = x[0]
    x[201] = 2 * x[0]
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [float("nan")]), (904, [1.0] * 15 + [float("inf")]), (905, [1.0] * 15 + [None]), (906, [1.0] * 8), (None, [1.0] * 16), (907, [1e30] * 16), (907, [1e30] * 16)]


def brute_vectors(rows, least=0.95):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = Counter()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= least:
                    n[a] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k, (i, _) in enumerate(rows):
        c = i if i is None else min(rows[j][0] for j in good if find(j) == find(k)) if k in good else i
        out.append((i, n[k], c, i is None or i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [vectors() + ODD, ODD, []])
def test_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_duplicates(df)
    got, want = (sorted(x, key=repr) for x in ([tuple(r) for r in found.collect()], brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want))
    if not rows or rows is ODD:
        assert got == want


def test_recall_audit(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    assert recall(df, vector_duplicates(df), every=5) >= 0.9


def test_vector_blocks(spark, monkeypatch):
    import tidemark.llm.vectors as v

    rows = vectors(5, 220)
    monkeypatch.setattr(v, "BLOCK", 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = sorted((tuple(r) for r in vector_duplicates(df).collect()), key=repr), brute_vectors([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)


def test_recall_audit_on_odd_vectors(spark):
    df = spark.createDataFrame(ODD + vectors(9, 210), "vec_id long, embedding array<float>")
    found = vector_duplicates(df.withColumn("cls", df.vec_id).withColumn("shard", df.vec_id).withColumn("n", df.vec_id))
    assert 0.95 <= recall(df, found, every=3) <= 1.0


def test_large_shards_are_split_again(spark, monkeypatch):
    import tidemark.llm.vectors as v

    for name, value in (("SAMPLE", 400), ("CENTRES", 4), ("SHARD", 60), ("PLACED", 150)):
        monkeypatch.setattr(v, name, value)
    rows = many_groups(5, 10)
    got, want = sorted(tuple(r) for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), exact_vectors(rows)
    assert sum(a[1] for a in got) >= 0.95 * sum(b[1] for b in want) and all(a[1] <= b[1] for a, b in zip(got, want))


def many_groups(seed=3, groups=24, d=64, noise=0.1):
    """One shard of groups of 30 to 300 distinct near copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in np.linspace(30, 300, groups).astype(int):
        base = rng.normal(size=d)
        rows += list(base + noise * rng.normal(size=(size, d)))
    x = np.array(rows)[rng.permutation(len(rows))].astype(np.float32)
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


def exact_vectors(rows, least=0.95):
    """brute_vectors by one product."""
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label, len(x)).min(1))
        if (new == label).all():
            return [(i, int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))]
        label = new


def test_no_group_of_near_copies_is_lost(spark, monkeypatch):
    import tidemark.llm.vectors as v

    rows = many_groups()
    monkeypatch.setattr(v, "SHARD", len(rows))  # one shard
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_duplicates(df)
    assert sorted(tuple(r) for r in found.collect()) == exact_vectors(rows)
    assert recall(df, found, every=5) == 1.0


def test_links_found_in_any_common_shard_count_once(spark, monkeypatch):
    import tidemark.llm.vectors as v

    rows = many_groups(11, 12)
    monkeypatch.setattr(v, "SHARD", len(rows) // 8)  # 8 shards, each class in 3
    got, want = sorted(tuple(r) for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), exact_vectors(rows)
    short = [(a, b) for a, b in zip(got, want) if a[2:] == b[2:] and a[1] != b[1]]  # the forest links them, the count does not
    assert not short and got == want
