"""Quality, language and likelihood: held-out accuracy, brute force, edge cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.edges import TEXTS, fold, frame, low
from tidemark.llm.language import Profiles, grams, language_id, learn_profiles, ranked, with_language
from tidemark.llm.lattice import document_likelihood, lattice
from tidemark.llm.quality import FEATURES, bradley_terry, fit, quality_scores, statistics
from tidemark.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out")
    assert r.filter("predicted = quality").count() >= 0.97 * r.count()
    assert r.filter("score < 0 OR score > 1 OR predicted != int(score >= 0.7)").count() == 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (7, None), (9, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_scores(frame(spark, clash=True), labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows if r.doc_id is not None)
    none = quality_scores(frame(spark), labels.filter("false")).collect()
    assert len({r.score for r in none}) == 1 and none[0].predicted == 1
    assert quality_scores(frame(spark, []), labels).count() == 0


def test_preferences_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) > 0).astype(float)
    w = bradley_terry(x[y == 1], x[y == 0])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]
    m = fit(x, y)
    assert ((m.score(x) >= 0.7) == (y == 1)).mean() > 0.97


def brute_grams(text, longest=3):
    words, word = [], ""
    import regex

    for c in text.lower() + " ":
        if regex.match(r"\p{L}", c):
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    s = " " + " ".join(words) + " " if words else ""
    for n in range(1, longest + 1):
        for i in range(len(s) - n + 1):
            if s[i : i + n].strip() and not (n == 1 and s[i] == " "):
                out[s[i : i + n]] += 1
    return out


@pytest.mark.parametrize("text", [t for _, t in TEXTS if t and len(t) < 20000] + ["a,b  c", "x" * 3 + "1" * 5 + "y"])
def test_grams_equal_brute_force(text):
    k, n = grams(text)
    pack = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert dict(zip(k.tolist(), n.tolist())) == {pack(g): c for g, c in brute_grams(text).items()}


def test_grams_do_not_depend_on_pieces(monkeypatch):
    import tidemark.llm.language as lang

    text = "The cat, the dog -- and 77 birds. " * 9
    whole = grams(text)
    for piece in (1, 2, 3, 5, 17):
        monkeypatch.setattr(lang, "PIECE", piece)
        k, n = grams(text)
        assert (k == whole[0]).all() and (n == whole[1]).all()


def test_profiles_pick_the_nearer():
    en, de = (ranked(*grams(t), 50) for t in ("the cat and the dog and the hat", "der hund und die katze und der hut"))
    p = Profiles({"en": en, "de": de}, 50)
    assert p.predict("the hat and the cat")[0] == "en" and p.predict("und der hund")[0] == "de"
    assert p.predict(None) == ("und", 0.0) == p.predict("123 !")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() >= 0.98 * r.count()


def test_language_edges(spark):
    df = frame(spark, clash=True).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    rows = language_id(df).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert language_id(df.filter("false")).count() == 0
    assert {r.lang_pred for r in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_likelihood_equals_brute_force(spark):
    rows = {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), r.held_out, r.smoothed_score) for r in document_likelihood(frame(spark, clash=True)).collect()}
    words = [(i, low(t).split()) for i, t in TEXTS]
    ho = lambda i: i is not None and fold(i, 7) == 2
    c = Counter(w for i, ws in words if not ho(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    m = lattice(vocabulary_path("piece_bpe_32k.model"))
    want = set()
    for i, ws in words:
        ts = [*ws, None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)
        of = lambda w: m.end if w is None else m.word(w.decode())
        own = sum(of(w)[0] for w in ts) / math.log(10)
        full = sum(math.log10((c[w] + v * math.exp(of(w)[1])) / (n + v)) for w in ts)
        want.add((i, len(ts), sum(c[w] > 0 for w in ts), n, round(base, 6), round(own, 6), ho(i), full))
    assert {r[:4] for r in rows} == {r[:4] for r in want}
    key = lambda r: (str(r[0]), r[1], r[2], r[4])
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert a[6] == b[6] and math.isclose(a[4], b[4], rel_tol=1e-6, abs_tol=1e-5) and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-5) and math.isclose(a[7], b[7], rel_tol=1e-6, abs_tol=1e-5)
    assert document_likelihood(frame(spark, [])).count() == 0


def test_lattice_sums_all_segmentations():
    m = lattice(vocabulary_path("piece_bpe_32k.model"))

    def brute(s, k):
        ways = [m.pieces[s[:j]][k] + brute(s[j:], k) for j in range(1, len(s) + 1) if s[:j] in m.pieces]
        if s and s[0] not in m.pieces:
            ways.append(m.byte[k] * len(s[0].encode()) + brute(s[1:], k))
        return np.logaddexp.reduce(ways) if s else 0.0

    for w in ("hello", "the", "日x", "thonsh", "", "\U0001f9ff", "qqzzqq"):
        assert all(math.isclose(m.word(w)[k], brute("▁" + w, k), rel_tol=1e-9) for k in (0, 1))
    for k in (0, 1):
        total = sum(math.exp(x[k]) for x in m.pieces.values()) + 256 * math.exp(m.byte[k]) + math.exp(m.end[k])
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_vocabulary_scores_are_kept():
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    m, file = lattice(path), sentencepiece.SentencePieceProcessor(model_file=path)
    a, b = "▁t", "in"
    assert math.isclose(m.pieces[a][0] - m.pieces[b][0], file.get_score(file.piece_to_id(a)) - file.get_score(file.piece_to_id(b)))


def brute_language(rows, size):
    """Profiles, ranks and out-of-place distances by plain loops."""
    counts = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and not (i is not None and fold(i, 4) == 2):
            counts.setdefault(lang, Counter()).update(brute_grams(t))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], sum(ord(ch) << (21 * (len(x[0]) - 1 - k)) for k, ch in enumerate(x[0]))))][:size]
    profiles = {k: order(c) for k, c in counts.items() if c}
    out = []
    for i, t, _ in rows:
        mine = order(brute_grams(t)) if t else []
        best = ("und", 0.0)
        if mine and profiles:
            far = {k: sum(abs(p.index(g) - at) if g in p else size for at, g in enumerate(mine)) for k, p in profiles.items()}
            name = min(sorted(far), key=far.get)
            best = (name, 1 - far[name] / (size * len(mine)))
        out.append((str(i), i is not None and fold(i, 4) == 2, best[0], round(best[1], 9)))
    return sorted(out)


def test_language_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = [(i, t[:3000] if t else t, lang) for i, t, lang in docs[:120]] + [(i, t, "aa" if i and i % 2 else "bb") for i, t in TEXTS if not t or len(t) < 20000]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = language_id(df, 60)
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got.collect()) == brute_language(docs, 60)


def test_many_languages_come_in_parts(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 3} {chr(97 + i % 26)}{chr(97 + i % 7)} ab", f"l{i % 23:02d}") for i in range(200)], "doc_id long, text string, lang string")
    parts = list(learn_profiles(df, 30, keep=5))
    assert len(parts) == 5 and sum(len(p.langs) for p in parts) == 23
    key = lambda rows: sorted((r.doc_id, r.lang_pred, r.score) for r in rows)
    assert key(with_language(df, parts).collect()) == key(with_language(df, learn_profiles(df, 30)).collect())


def brute_statistics(text):
    """The features of one text by plain loops over its bytes and words."""
    raw = (text or "").encode()
    ws = raw.split()
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!?", "|", "*#$%&@^~=+_<>\\/", "'\"()-[]{}`"]
    kinds = [g.encode() for g in groups]
    share = [sum(b in k for b in raw) / max(len(raw), 1) for k in kinds]
    share.append(sum(not any(b in k for k in kinds) for b in raw) / max(len(raw), 1))
    n = max(len(ws), 1)
    runs = lambda k: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    unique = [len(set(runs(k))) / len(runs(k)) if runs(k) else 1.0 for k in (1, 3, 8)]
    upper = lambda w: sum(b in kinds[0] for b in w) >= 2 and not any(b in kinds[1] or not any(b in k for k in kinds) for b in w)
    ends = sum(w[-1] in kinds[6] or w[-1] in kinds[8] for w in ws) / n
    return [*share, math.log1p(len(ws)), sum(map(len, ws)) / n, *unique, sum(map(upper, ws)) / n, ends, sum(len(w) == 1 for w in ws) / n, math.log1p(max(map(len, ws), default=0)), math.log1p(len(raw))]


def test_statistics_equal_brute_force():
    texts = [t for _, t in TEXTS] + ["ABC dE! F* {g} | 12,5;", "a\nb\tc", "é É ÀB"]
    got = statistics(pa.array(texts, pa.string()))
    assert np.allclose(got[:, : len(FEATURES)], [brute_statistics(t) for t in texts])


def test_fit_is_the_likelihood_maximum():
    """Newton steps end where the gradient of the pairs' logistic loss vanishes, and the cut leaves as many rows below as have label 0."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.logistic(size=300) > 0.3).astype(float)
    w = bradley_terry(x[y == 1], x[y == 0], pairs=20_000, decay=1e-3, seed=7)
    rng = np.random.default_rng(7)
    a, b = x[y == 1], x[y == 0]
    d = a[rng.integers(0, len(a), 20_000)] - b[rng.integers(0, len(b), 20_000)]
    loss = lambda v: np.mean(np.log1p(np.exp(-(d @ v)))) + 0.5e-3 * v @ v
    steps = np.eye(4) * 1e-3
    assert all(loss(w) <= loss(w + s * e) for e in steps for s in (1, -1))
    m = fit(x, y)
    assert abs(int((m.score(x) < 0.7).sum()) - int((y == 0).sum())) <= 1
    order = np.argsort(m.raw(x))
    assert (np.diff(m.score(x)[order]) >= 0).all()
