"""Language mixtures, weighted fingerprints, partial matching and quality rules."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowscope.llm import fingerprints, language, ppm, quality
from rowscope.llm._text import fold_of
from tests.llm.conftest import SF, prose


# --- language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and abs(sum(r["mixture"].values()) - 1) < 1e-5 for r in rows)
    assert all(r["held_out"] == (fold_of(r["doc_id"], 4) == 2) for r in rows)


def test_language_mixture_and_edges(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500 and text not like '%|%'")
    model = language.train(docs)
    en = docs.where("lang = 'en'").first()["text"][:1500]
    de = docs.where("lang = 'de'").first()["text"][:1400]
    mixed = spark.createDataFrame([(1, en + " " + de), (2, en)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language.predict(mixed, model).collect()}
    assert set(got[1]["mixture"]) == {"en", "de"} and 0.3 < got[1]["mixture"]["de"] < 0.7
    assert set(got[2]["mixture"]) == {"en"} and got[2]["score"] == pytest.approx(1)
    edge = language.predict(edge_docs, model).collect()
    assert len(edge) == edge_docs.count()
    by = {(r["doc_id"]): r["lang_pred"] for r in edge}
    assert by[0] == by[1] == by[2] == by[10] == "und" and by[9] != "und"
    assert {r["lang_pred"] for r in language.predict(edge_docs, language.train(no_docs)).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    like = rng.random((60, 3)).astype(np.float32)
    doc, first = np.repeat(np.arange(3), 20), np.array([0, 20, 40])
    share, last = np.full((3, 3), 1 / 3, np.float32), np.full(3, -np.inf)
    for _ in range(10):
        share, ll = language._em(like, doc, first, share, 1)
        assert (ll >= last - 1e-4).all() and np.allclose(share.sum(axis=1), 1, atol=1e-5)
        last = ll


# --- fingerprints

def test_edited_text_and_neighbours(spark, edge_docs):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for docs in (plain, odd, plain.limit(1)):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(rows):
            nxt = rows[(i + 1) % len(rows)]
            k = len(t) // 2
            edited = t[: len(t) - k] + nxt[1][:k]
            assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            pair = lambda a, b: np.mean([a[j:j + 4] == b[j:j + 4] for j in range(0, len(a), 4)])
            assert got[d]["near_next"] == pytest.approx(pair(got[d]["fingerprint"], got[nxt[0]]["fingerprint"]))
            assert got[d]["near_edited"] == pytest.approx(pair(got[d]["fingerprint"], got[d]["edited_fingerprint"]))


def test_equal_texts_equal_fingerprints_and_edges(edge_docs, no_docs):
    rows = fingerprints.fingerprints(edge_docs).join(edge_docs.select("doc_id").distinct(), "doc_id").collect()
    assert fingerprints.fingerprints(edge_docs).count() == edge_docs.count()
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"0" * 256}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_collision_rate_is_generalised_jaccard():
    a = ("red " * 5 + "green " * 2 + "blue black white " + prose(3, 40)).strip()
    b = ("red " * 3 + "green " * 4 + "blue pink " + prose(3, 40)).strip()
    ca, cb = Counter(a.split()), Counter(b.split())
    want = sum(min(ca[w], cb[w]) for w in ca | cb) / sum(max(ca[w], cb[w]) for w in ca | cb)
    s = fingerprints.signatures([a, b, a, ""], 4000)
    assert fingerprints.likeness(s[:1], s[1:2])[0] == pytest.approx(want, abs=0.03)
    assert (s[0] == s[2]).all() and (s[3] == 0).all() and (s[0] > 0).all()


# --- partial matching

def brute_ppm(training, texts, order, least):
    counts = defaultdict(Counter)
    for w in training:
        raw = bytes([255]) * order + b" ".join(w) + b"\xff"
        for i in range(order, len(raw)):
            if raw[i] == 255 and raw[i - 1] == 255:
                continue
            for j in range(order + 1):
                counts[raw[i - j:i]][raw[i]] += 1

    def cost(sym, ctx):
        left, gone = 1.0, set()
        for j in range(order, -1, -1):
            c = counts.get(ctx[len(ctx) - j:], {})
            if j and sum(c.values()) < least:
                continue
            c = {s: n for s, n in c.items() if s not in gone}
            if c:
                t, d = sum(c.values()), len(c)
                if sym in c:
                    return math.log10(left * (c[sym] - 0.5) / t)
                left *= d / 2 / t
                gone |= set(c)
        return math.log10(left / (256 - len(gone)))

    out = []
    for w in texts:
        raw = bytes([255]) * order + b" ".join(w) + b"\xff"
        out.append(sum(cost(raw[i], raw[i - order:i]) for i in range(order, len(raw))))
    return out


@pytest.mark.parametrize(("order", "cells"), [(1, ppm.CELLS), (3, 0), (5, ppm.CELLS), (5, 2000), (5, 0)])
def test_scores_match_brute_force(spark, edge_docs, order, cells, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 20)  # most words take the join
    docs = edge_docs.where("doc_id <> 7 or length(text) < 1000").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(200 + i, prose(i, 30).title()) for i in range(12)], "doc_id bigint, text string"))
    training = docs.where("doc_id % 3 <> 1")
    got = ppm.score(docs, training, order=order, cells=cells).collect()
    train = [ppm.tokens(r["text"]) for r in training.collect()]
    rows = [(r["doc_id"], ppm.tokens(r["text"])) for r in docs.collect()]
    vocab = Counter(w for t in train for w in t)
    n, v, ends = sum(vocab.values()) + len(train), len(vocab) + 1, len(train)
    scores = brute_ppm(train, [t for _, t in rows], order, 2)
    want = sorted(((d, len(t) + 1, 1 + sum(w in vocab for w in t), n,
                    sum(math.log10((vocab[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1)), s)
                   for (d, t), s in zip(rows, scores, strict=True)), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=str), want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-4)


def test_probabilities_sum_to_one(spark):
    counts = ppm.corpus_counts(spark.read.parquet(f"{SF}/documents.parquet").select("text"), 3)
    trie = ppm.build(ppm.cached_contexts(ppm.levels(counts, 3), 3, 100_000))
    p = 10.0 ** trie.logp[1:].astype(float)
    weight = np.bincount(trie.symbol, minlength=p.shape[1])
    assert np.allclose((p * weight).sum(axis=1), 1, atol=1e-4) and len(p) > 300


def test_longer_contexts_help_and_edges(spark, no_docs, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held, training = docs.where("doc_id % 7 = 2"), docs.where("doc_id % 7 <> 2")
    total = [ppm.score(held, training, order=k).agg(F.sum("score")).first()[0] for k in (1, 3, 5)]
    assert total[0] < total[1] < total[2]
    assert ppm.corpus_scores(no_docs).count() == 0
    none = ppm.score(edge_docs, no_docs).collect()
    assert len(none) == edge_docs.count() and all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


# --- quality

def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows) and len(rows) > 50
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_rules_are_paths_and_columns_agree(spark):
    debug = "  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 2 > 3.0)\n      Predict: 1.0\n     Else (feature 2 <= 3.0)\n" \
            "      Predict: 0.0\n    Else (feature 0 > 1.5)\n     Predict: 0.0\n"
    rules = quality.rule_paths(debug)
    assert set(rules) == {((0, "<=", 1.5),), ((0, "<=", 1.5), (2, ">", 3.0)), ((0, "<=", 1.5), (2, "<=", 3.0)), ((0, ">", 1.5),)}
    df = spark.createDataFrame([([1.0, 0.0, 5.0],), ([2.0, 0.0, 5.0],), ([1.0, 0.0, 1.0],)], "s array<double>")
    model = quality.Rules(0.5, [(((0, "<=", 1.5), (2, ">", 3.0)), 2.0), (((0, ">", 1.5),), -1.0)])
    got = [r[0] for r in df.select(model.score("s")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-z)) for z in (2.5, -0.5, 0.5)])


def test_quality_edges(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    scored = quality.score(edge_docs, rules).collect()
    assert len(scored) == edge_docs.count() and all(0 <= r["score"] <= 1 and np.isfinite(r["stats"]).all() for r in scored)
    kept = quality.keep_good(edge_docs, labels, threshold=0.0)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    one = labels.where("quality = 1")
    alone = quality.quality_scores(docs, one).select(F.min("score"), F.max("score")).first()
    assert alone[0] == alone[1] > 0.9
    assert quality.quality_scores(docs, labels.where("false")).select("score").distinct().first()[0] == pytest.approx(0.5)
    assert quality.quality_scores(no_docs, labels).count() == 0
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality.quality_scores(docs, odd).count() == docs.count()
