"""Near-duplicates, passages and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowscope.llm import neardup, passages, substrings
from rowscope.llm._graph import components
from rowscope.llm._text import shingles, span_hash, prefix_hash, utf8, words
from tests.llm.conftest import SF, WORDS, prose


def edit(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    out = text.split()
    for _ in range(max(1, int(len(out) * share))):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[i] = r.choice(WORDS) + "x"
        elif kind == 1:
            out.insert(i, r.choice(WORDS) + "y")
        elif len(out) > 1:
            out.pop(i)
    return " ".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def seq(text):
    data, off = utf8(pa.array([text]))
    _, _, h, woff = words(data, off)
    return shingles(h, woff)[0]


# --- helpers

def test_span_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = span_hash(prefix_hash(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_words_and_shingles():
    text = "The  the\tTHE\nend\x0bof\x0cit\r1"
    data, off = utf8(pa.array([text, None, "a b", ""]))
    s, e, h, woff = words(data, off)
    raw = text.encode() + b"a b"
    assert [raw[a:b].lower() for a, b in zip(s, e, strict=True)] == text.encode().lower().split() + [b"a", b"b"]
    assert woff.tolist() == [0, 7, 7, 9, 9] and h[0] == h[1] == h[2]
    sh, soff = shingles(h, woff)
    assert soff.tolist() == [0, 3, 3, 4, 4]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars already take no round; the groups do not repeat the components of the links."""
    from rowscope.llm import _graph

    rounds = []
    star = _graph._star
    monkeypatch.setattr(_graph, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    stars = [(1, 5), (7, 1), (1, 9), (20, 21), (30, 22), (30, 22)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(stars, "a int, b int"), "a", "b").collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20, 22: 22, 30: 22} and not rounds
    for chain in ([(1, 2), (2, 3)], [(3, 1), (3, 2)]):  # a root that hangs on another, a node on two
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
        assert got == {1: 1, 2: 1, 3: 1}
    assert rounds
    runs = []
    monkeypatch.setattr(neardup, "components", lambda *a: runs.append(a) or components(*a))
    rows = [(1, prose(1, 60)), (2, prose(1, 60) + " tail"), (3, prose(2, 60)), (4, prose(1, 60))]
    groups = {r["doc_id"]: (r["group_id"], r["n_texts"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert groups == {1: (1, 2), 2: (1, 2), 4: (1, 2), 3: (3, 1)} and len(runs) == 1


# --- Order MinHash

def test_banded_alignment_is_exact():
    r = random.Random(3)
    for _ in range(3000):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = a[:] if r.random() < 0.6 else [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randint(0, 3)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        most, d = r.randint(0, 8), distance(a, b)
        assert neardup.banded_distance(a, b, most) == min(d, most + 1)


def test_sketches_keep_text_order():
    one, two = prose(1, 60).split(), prose(2, 60).split()
    s = [neardup.sketches(*_shingled(" ".join(t)), 200, 3)[0] for t in (one + two, two + one, one + two)]
    assert (s[0] == s[2]).all()
    plain = [neardup.sketches(*_shingled(" ".join(t)), 200, 1)[0] for t in (one + two, two + one)]
    assert (plain[0] == plain[1]).mean() > 0.85  # nearly the same set of shingles
    assert (s[0] == s[1]).mean() < 0.55  # in another order


def _shingled(text):
    data, off = utf8(pa.array([text]))
    _, _, h, woff = words(data, off)
    return shingles(h, woff)


def test_groups_against_brute_force(spark):
    base = [prose(100 + i, 60 + 5 * i) for i in range(30)]
    rows = list(enumerate(base))
    for i, t in enumerate(base):
        rows += [(100 + 10 * i + k, edit(t, 10 * i + k, 0.004 + 0.01 * k)) for k in range(4)]
    rows += [(500 + i, base[0]) for i in range(40)] + [(600 + i, edit(base[1], 900 + i, 0.01)) for i in range(60)]
    rows += [(700 + i, prose(999, 40) + " " + prose(2000 + i, 30)) for i in range(40)]  # a passage that many share
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in neardup.groups(docs).collect()}
    texts = {}
    for d, t in rows:
        texts.setdefault(t, d)
    ids, seqs = list(texts.values()), [seq(t) for t in texts]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if neardup.alike(seqs[i], seqs[j], 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), 1 << 60), ids[i])
    where = {t: least[root(i)] for i, t in enumerate(texts)}
    assert {d: got[d]["group_id"] for d, _ in rows} == {d: where[t] for d, t in rows}
    assert {d: got[d]["class_id"] for d, _ in rows} == {d: texts[t] for d, t in rows}
    kept = neardup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(where.values()))


@pytest.mark.parametrize("edits", [3, 4])
def test_edited_copies_without_a_base_are_grouped(spark, edits):
    """No copy is central: links between bucket-mates must still be found (brute force over all pairs)."""
    base = prose(77 + edits, 150).split()
    texts = []
    for k in range(160):
        r, t = random.Random(1000 * edits + k), base[:]
        for _ in range(edits):
            t[r.randrange(len(t))] = f"w{r.randrange(10 ** 9)}"
        texts.append(" ".join(t))
    seqs = [seq(t) for t in texts]
    true = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.alike(seqs[i], seqs[j], 0.8)]
    group = {r["doc_id"]: r["group_id"] for r in neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    held = sum(group[i] == group[j] for i, j in true)
    assert held >= 0.97 * len(true), (held, len(true))


def test_candidates_of_unlike_bucket_mates_do_not_grow_with_the_square(spark, monkeypatch):
    """Texts that share a passage but are not alike: four times the texts, under six times the candidates."""
    counts = []
    aligned = neardup._aligned

    def counted(seqs, pairs, similarity):
        counts[-1] += pairs.count()
        return aligned(seqs, pairs, similarity)

    monkeypatch.setattr(neardup, "_aligned", counted)
    common = prose(5, 45)
    for n in (150, 600):
        counts.append(0)
        rows = [(i, common + " " + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(n)]
        assert neardup.links(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert counts[1] <= 6 * counts[0] + 1000, counts


def test_alike_is_the_edit_similarity():
    for i in range(60):
        a = prose(i, 40)
        b = edit(a, i, 0.02 + 0.001 * i)
        x, y = seq(a), seq(b)
        inter, union = len(set(x.tolist()) & set(y.tolist())), len(set(x.tolist()) | set(y.tolist()))
        want = 1 - distance(x.tolist(), y.tolist()) / max(len(x), len(y)) >= 0.8 - 1e-9 and inter >= union * 0.8 / 1.2 - 1e-9
        assert neardup.alike(x, y, 0.8) == want


def test_neardup_edges(edge_docs, no_docs):
    rows = neardup.groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["group_id"])
    assert by[5] == by[6] == {5} and by[3] == by[12] == {3} and by[0] == by[1] == {0}
    kept = neardup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    n_groups = neardup.classes(edge_docs).select("group_key").distinct().count()
    assert kept.count() == n_groups and kept.where("doc_id = 5").count() == 1
    assert neardup.groups(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0


# --- passages

def test_window_centres_and_extents_against_definition():
    rng = np.random.default_rng(2)
    for n in (5, 12, 40, 90):
        v = rng.integers(1, 1 << 60, n).astype(np.uint64)
        if n == 40:
            v[[3, 9, 30]] = v[3]
        soff = np.array([0, n // 3, n])
        c = passages.window_centres(v, soff, 7)
        want = set()
        for lo, hi in ((0, n // 3), (n // 3, n)):
            for s in range(lo, hi - 6):
                least = v[s:s + 7].min()
                want |= {int(p) for p in range(s, s + 7) if v[p] == least}
        assert set(c.tolist()) == want
        row = np.searchsorted(soff, c, side="right") - 1
        left, right = passages.extents(c, v, row, soff)
        for p, r, a, b in zip(c, row, left, right, strict=True):
            x = max([int(soff[r]), *[q + 1 for q in range(soff[r], p) if v[q] <= v[p]]])
            y = min([int(soff[r + 1]) - 1, *[q - 1 for q in range(p + 1, soff[r + 1]) if v[q] < v[p]]])
            assert (a, b) == (x, y)


def test_planted_passages(spark):
    one, two = prose(7, 52), prose(8, 70)
    rows = [(i, prose(100 + i, 40) + " " + one + " " + prose(200 + i, 30 + i)) for i in range(30)]
    rows += [(50 + i, prose(300 + i, 25 + i) + " " + edit(two, i, 0.02) + " " + prose(400 + i, 10)) for i in range(5)]
    rows += [(80 + i, prose(500 + i, 150)) for i in range(20)]
    rows += [(90 + i, prose(600, 60)) for i in range(3)] + [(120 + i, prose(700 + i, 60) + " " + prose(9, 30)) for i in range(5)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    where = defaultdict(list)
    for r in got:
        where[r["doc_id"]].append(r)
    for i in range(30):  # the whole passage, one class
        assert any(r["start_word"] <= 40 and r["end_word"] >= 92 for r in where[i])
    assert len(set.intersection(*[{r["class_id"] for r in where[i]} for i in range(30)])) >= 1
    assert all(where[50 + i] for i in range(5))
    assert not any(where.get(80 + i) for i in range(10)) and not any(where.get(120 + i) for i in range(5))
    assert all({(r["class_id"], r["start_word"], r["end_word"]) for r in where[90 + i]} == {(90, 0, 60)} for i in range(3))


def test_hot_values_are_dealt_out_in_parts(spark):
    one = prose(7, 60)
    rows = [(i, prose(100 + i, 20) + " " + one + " " + prose(200 + i, 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = passages.passage_pairs(docs).collect()
    parts = passages.passage_pairs(docs, hot=5).collect()
    for pairs in (whole, parts):
        reach = {r["b"]: r["b"] for r in pairs} | {r["a"]: r["a"] for r in pairs}
        assert len(reach) == 40  # every text has its passage, and all are one group
        for _ in range(40):
            for r in pairs:
                reach[r["a"]] = reach[r["b"]] = min(reach[r["a"]], reach[r["b"]])
        assert len(set(reach.values())) == 1
    assert len({r["b"] for r in whole}) < len({r["b"] for r in parts}) and len(parts) < 8 * 40  # not all pairs


def test_passages_cover_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    seen = defaultdict(set)
    for d, w in own.items():
        for i in range(len(w) - 50):
            seen[tuple(w[i:i + 51])].add(d)
    got = defaultdict(list)
    for r in passages.repeated_passages(docs).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    hits = [(d, i) for key, ds in seen.items() if len(ds) > 1 for d in ds for i in [next(
        k for k in range(len(own[d]) - 50) if tuple(own[d][k:k + 51]) == key)]]
    assert hits and {d for d, _ in hits} <= set(got)
    covered = sum(any(a <= i + 5 and b >= i + 46 for a, b in got[d]) for d, i in hits)
    assert covered >= 0.98 * len(hits)


def test_representative_holds_passage_twice(spark):
    one = prose(7, 60)
    others = [prose(100 + i, 40) + " " + one + " " + prose(200 + i, 30) for i in range(5)]
    key = lambda t: hashlib.md5(t.encode()).digest()
    twice = next(t for t in (f"{prose(1000 + i, 30)} {one} {prose(2000 + i, 80)} {one} {prose(3000 + i, 20)}" for i in range(1000))
                 if key(t) < min(map(key, others)))
    alone = f"{prose(11, 30)} {prose(12, 60)} {prose(13, 80)} {prose(12, 60)}"
    docs = spark.createDataFrame(list(enumerate([twice, *others, alone])), "doc_id bigint, text string")
    got = passages.repeated_passages(docs).collect()
    for first in (30, 170):
        assert any(r["doc_id"] == 0 and r["class_id"] == 0 and abs(r["start_word"] - first) <= 5
                   and abs(r["end_word"] - first - 60) <= 5 for r in got)
    assert not any(r["doc_id"] == 6 for r in got)  # repeats inside one text alone are no result


def _edited_copies():
    """Copies of a passage with one to three edited words each, none of them unedited, between words of their own."""
    base = prose(31, 60).split()
    texts = []
    for i in range(60):
        r = random.Random(900 + i)
        own = list(base)
        for at in r.sample(range(60), r.choice((1, 2, 2, 3))):
            own[at] = f"edited{i}x{at}"
        texts.append(" ".join([prose(5000 + i, 20 + i % 7), *own, prose(6000 + i, 25)]))
    return texts


def _brute_force(texts):
    """Texts that share a passage with any other one."""
    data = [t.encode() for t in texts]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    _, _, hashes, woff = passages.words(raw, off)
    sh, soff = passages.shingles(hashes, woff, passages.SHINGLE)
    seqs = [sh[soff[i]: soff[i + 1]] for i in range(len(texts))]
    least, out = passages.PASSAGE - passages.SHINGLE + 1, set()
    for i, x in enumerate(seqs):
        for j, y in enumerate(seqs):
            places = {int(v): p for p, v in enumerate(y.tolist())}
            common = [(p, places[int(v)]) for p, v in enumerate(x.tolist()) if int(v) in places]
            if i != j and common and any(passages.stretches(x, y, d, 0, len(x) - 1, least, passages.SIMILARITY) for d in {p - q for p, q in common}):
                out |= {i, j}
    return out


def test_edited_passages_without_an_unedited_copy(spark):
    texts = _edited_copies()
    want = _brute_force(texts)
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(want) > 25 and got <= want and len(got) >= 0.97 * len(want)


def test_every_text_of_a_shingle_is_met(spark, monkeypatch):
    """Ranges go on to further texts until they are covered; a passage is named once for each text, not once for each pair."""
    monkeypatch.setattr(passages, "FIRST", 1)
    monkeypatch.setattr(passages, "FACTOR", 2)
    texts = _edited_copies()
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    want = _brute_force(texts)
    assert len({r["doc_id"] for r in rows} & want) >= 0.97 * len(want) and len(rows) < 6 * 60


def test_uncovered_ranges_and_their_rarest_shingles():
    assert passages.uncovered([(0, 100)], [(20, 60)], 10, 8) == [(0, 17), (53, 100)]
    assert passages.uncovered([(0, 5), (40, 50)], [(0, 30), (45, 70)], 10, 8) == [(40, 42)]
    assert passages.uncovered([(3, 9)], [(5, 9)], 10, 8) == [(3, 9)]  # a passage shorter than need covers none
    r = np.random.default_rng(4)
    for _ in range(20):
        seq, level = r.integers(-40, 40, 60).astype(np.int32), r.integers(0, 5, 60)
        place, first, last = passages.rarest(seq, level, [(0, 20), (30, 70)], 10, 7)
        order = [(level[i], int(seq[i]) & 0xFFFFFFFF) for i in range(60)]
        reach = defaultdict(list)
        for s in [*range(21), *range(30, 51)]:
            if (level[s:s + 10] == 0).sum() <= 3:
                low = sorted(order[s:s + 10])[:4]
                for i in range(s, s + 10):
                    if level[i] > 0 and order[i] <= low[-1]:
                        reach[i].append(s)
        assert set(place.tolist()) <= set(reach)
        for s in [*range(21), *range(30, 51)]:
            if (level[s:s + 10] == 0).sum() <= 3:  # four positions of the range, those of level 0 among them
                assert (level[s:s + 10] == 0).sum() + sum(s <= p < s + 10 and f <= s <= e - 9 for p, f, e in zip(place, first, last, strict=True)) >= 4


def test_passage_edges(edge_docs, no_docs):
    rows = {tuple(r) for r in passages.repeated_passages(edge_docs).collect()}
    assert rows == {(5, 0, 80, 5, 0, 80), (6, 0, 80, 5, 0, 80)}
    assert passages.repeated_passages(no_docs).count() == 0


def test_bucket_mates_without_a_central_text(spark):
    """Edited copies without their base: groups are the components of all bucket-mates that are alike."""
    base = prose(17, 150).split()
    texts = []
    for i in range(120):
        r = random.Random(i)
        own = list(base)
        for at in r.sample(range(150), r.randint(3, 5)):
            own[at] = f"edit{i}x{at}"
        texts.append(" ".join(own))
    data, off = utf8(pa.array(texts))
    _, _, hashes, woff = words(data, off)
    sh, soff = shingles(hashes, woff)
    values = [set(row) for row in neardup.sketches(sh, soff).tolist()]
    seqs = [(sh[soff[i]: soff[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for i in range(len(texts))]
    head = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if values[i] & values[j] and neardup.alike(seqs[i], seqs[j], 0.8):
                head = [min(head[i], head[j]) if h in (head[i], head[j]) else h for h in head]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["group_id"] for r in neardup.groups(docs).collect()}
    assert 1 < len(set(head)) < len(texts) and [got[i] for i in range(len(texts))] == head


# --- substrings

def brute_substrings(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings_against_brute_force(spark, hot):
    common = prose(1, 25)
    rows = [(i, prose(10 + i, 8) + " " + common[: 60 + 5 * i] + " " + prose(40 + i, 12) + ("é" * i)) for i in range(14)]
    rows += [(30, common * 3), (31, "ab" * 300), (32, "ab" * 70 + "x" + "ab" * 50), (33, common), (33, common), (34, None), (35, ""),
             (36, "short"), (None, prose(11, 40)), (37, prose(11, 40)[5:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.digest(docs, length=60, gram=12, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substrings(rows, 60)


def test_substrings_on_documents(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_substrings([tuple(r) for r in docs.collect()], 200)
    assert sum(r[2] for r in want) > 0
    for bits in (substrings.FILTER_BITS, 1 << 12):  # a full filter only costs work
        assert sorted((tuple(r) for r in substrings.digest(docs, bits=bits).collect()), key=str) == want
    edge = edge_docs.where("doc_id is null or doc_id <> 7")
    assert sorted((tuple(r) for r in substrings.digest(edge).collect()), key=str) == brute_substrings(
        [tuple(r) for r in edge.select("doc_id", "text").collect()], 200)
    assert substrings.digest(no_docs).count() == 0


def test_bucket_cuts_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 3)
    rows = [(i, prose(1, 6) + " " + prose(2 + i % 3, 14)) for i in range(20)] + [(i, prose(70 + i, 20)) for i in range(30, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in substrings.digest(docs, length=40, gram=8).collect()), key=str) == brute_substrings(rows, 40)


def test_multikey_sort():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (500, 24)).astype(np.uint8)
    x[100:200] = x[0]
    order = substrings.multikey_sort(x)
    keys = [bytes(r) for r in x[order]]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))
