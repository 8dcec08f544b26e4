"""BPE (against the tokenizers library), decontamination (brute force, SQL, blocks), line templates (SQL)."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from rowscope.llm import decontaminate, linededup, queries, tokens
from scripts.oracle_check import digest
from tests.llm.conftest import SF, prose


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def library_rows(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    out = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=str)


def test_bpe_matches_library(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = library_rows([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        assert sorted((tuple(r) for r in tokens.digest(docs).collect()), key=str) == want
    assert tokens.digest(no_docs).count() == 0


def test_bpe_round_trip_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PRETOKENS", 3)
    bpe = tokens.Bpe(tokens.default_vocabulary())
    texts = [prose(i, 50) + " \n\n  ünï<|endoftext|>" for i in range(5)] + ["", "a" * 3001]
    for _ in range(2):
        ids = [i for t in texts for i in bpe.encode([t])]
        assert [bpe.decode(i) for i in ids] == texts


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({65 + i: 97 + i for i in range(26)}))
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                pats.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in pats:
                    hit |= set(range(k, k + n))
                    ids |= pats[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(1, 30)), (1, prose(2, 12)), (2, prose(2, 15)), (3, "two three"), (4, None), (None, "one"),
                                  (5, ""), (10, "ONE!"), (11, prose(9, 40))], "item_id bigint, text string")


def test_contamination_brute_force(spark, edge_docs, no_docs, items):
    more = spark.createDataFrame([(100 + i, prose(50 + i, 30) + " " + " ".join(prose(1, 30).split()[i:i + 14]) + ", End. " + prose(60, 9))
                                  for i in range(8)], "doc_id bigint, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    want = brute_contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    got = decontaminate.digest(decontaminate.contamination(docs, items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    blocks = decontaminate.digest(decontaminate.contamination(docs, items, block_bytes=60))
    assert sorted((tuple(r) for r in blocks.collect()), key=str) == want
    clean = decontaminate.remove_contaminated(edge_docs, items, block_bytes=100)
    assert clean.columns == edge_docs.columns
    bad = sum(r[5] for r in brute_contamination([tuple(r) for r in edge_docs.select("doc_id", "text").collect()],
                                                [tuple(r) for r in items.collect()]))
    assert clean.count() == edge_docs.count() - bad
    assert decontaminate.digest(decontaminate.contamination(no_docs, items)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.contamination(edge_docs, items.where("false"))).collect())


@pytest.mark.parametrize("name", ["op8_line_templates", "op9_benchmark_decontamination"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


def test_line_templates(spark, edge_docs, no_docs):
    rows = [(i, f"{prose(i, 12)}\nPosted by user{i} on day {i} of the year\n  All rights reserved \n{prose(100 + i, 9)}") for i in range(12)]
    rows += [(50 + i, f"{prose(1000, 12)}\n{prose(1001, 20)}") for i in range(15)]  # copies are one text
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.clean_documents(docs).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert got[i] == ("\n".join([lines[0], lines[3]]) if i < 50 else text)
    clean = linededup.clean_documents(edge_docs, min_docs=2)
    assert clean.columns == edge_docs.columns and clean.count() == edge_docs.count()
    assert clean.where("text is null").count() == 2
    assert linededup.digest(no_docs).count() == 0 and linededup.clean_documents(no_docs).count() == 0


def test_line_join_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, linededup.digest(docs, min_docs=3).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, linededup.digest(docs, min_docs=3).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_long_lines_from_two_texts(spark):
    """Planted lines of 2 to 9 texts: the long ones go everywhere, short ones and other long lines stay."""
    long, short = prose(7, 14), "see also the list"
    rows, planted = [], set()
    for i in range(60):
        lines = [prose(200 + 3 * i + j, 11 + i % 9) for j in range(3)]
        k = i // 6  # ten planted lines, each in two to six texts
        if i % 6 < 2 + k % 5:
            lines.insert(i % 4, f"{prose(900 + k, 20)} no {i}")
            planted.add((i, i % 4))
        if i in (3, 4):
            lines.append(short)
        if i in (5, 6):  # one word differs in the middle
            lines.append(" ".join([*long.split()[:8], f"word{'ab'[i - 5]}", *long.split()[9:]]))
            planted.add((i, len(lines) - 1))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.clean_documents(docs).collect()}
    for i, text in rows:
        assert got[i] == "\n".join(x for j, x in enumerate(text.split("\n")) if (i, j) not in planted)
    assert len(planted) > 30


def test_quality_fit_repeats(spark):
    from rowscope.llm import quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(3, "doc_id"), labels)
    assert [r for r, _ in want.weighted] == [r for r, _ in quality.fit(docs, labels).weighted]
    assert want.weighted and again.weighted


def test_lines_are_counted_without_token_arrays(spark):
    texts = ["a b  c\td\n\t\n   \n <*> x1 y <*>z 2\nlone", " one two  ", "été à 3é\x0Bq\f\n\r\n"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lines = linededup._leaves(linededup._lines(docs), 3, 10, 10, 6, 2)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "array<string>" not in plan and plan.count("split(") == 1  # into lines; every line was split into tokens before
    want = []
    for t in texts:
        for at, line in enumerate(t.split("\n")):
            if line.strip(" "):
                own = [x if not any(c in "0123456789" for c in x) else "<*>" for x in line.translate(str.maketrans("\t\x0B\f\r", "    ")).split(" ") if x]
                want.append((at, " ".join(own), max(1, len(own))))
    assert sorted(map(tuple, lines.select("pos", "plain", "n").collect())) == sorted(want)
