import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rowscope.llm import prefixtrie, repair
from tests.conftest import spark  # noqa: F401

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key string, gone string, fault string, nth string"


def table(spark, rows):  # noqa: F811
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def some_rows(seed, convs):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, 9)):
            if r.random() < 0.1:
                continue
            role = r.choice(["user", "assistant", "system", None, ""])
            text = r.choice(["Yes.", "No!", None, "", " \n", "hé😀llo", "c" * t, str(r.random()), "Is it? "])
            rows.append((c, None if r.random() < 0.03 else t, role, text))
            if r.random() < 0.05:
                rows.append(rows[-1])
    return [*rows, (None, 1, "user", "no conversation"), (800, 0, "user", "y" * 50_000)]


def expected_nodes(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest(), turn))
    own = {c: [v[3] for v in sorted(vs)] for c, vs in conv.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items()), key=str)


def test_trie_equals_brute_force_for_any_sharding(spark):  # noqa: F811
    rows = some_rows(3, 320)
    want = expected_nodes(rows)
    for options in ({}, {"parts": 5, "shard_turns": 20, "fan": 8}, {"parts": 3, "shard_turns": 300}):
        assert sorted(map(tuple, prefixtrie.prefix_trie(table(spark, rows), **options).collect()), key=str) == want


def test_trie_of_copies_and_of_nothing(spark):  # noqa: F811
    rows = [(c, t, "user", "same") for c in range(100, 400) for t in range(8)]
    got = sorted(map(tuple, prefixtrie.prefix_trie(table(spark, rows), parts=4, shard_turns=64, fan=8).collect()), key=str)
    assert got == expected_nodes(rows)
    assert prefixtrie.prefix_trie(table(spark, rows).where("false")).count() == 0


def test_find_close_equals_a_stack():
    r = random.Random(1)
    for n in (1, 2, 63, 64, 65, 3000):
        for lean in (0.5, 0.9, 0.1):
            bits, depth, opens = [1], 1, 1
            while opens < n or depth > 1:
                up = opens < n and (depth == 1 or r.random() < lean)
                bits.append(int(up))
                depth, opens = depth + (1 if up else -1), opens + up
            bits.append(0)
            stack, close = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            at = np.flatnonzero(bits)
            for block in (4, 64):
                assert prefixtrie.find_close(np.array(bits, np.uint8), at, block).tolist() == [close[i] for i in at.tolist()]


def cheapest(rows):
    """Best (cost, audit, repaired rows) of [(role, text, fault)] by searching all edit sequences, cheapest first."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        body = roles[1:] if roles[:1] == "s" else roles
        if i == len(rows) and body == "ua" * (len(body) // 2) and (body or not roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        need = "a" if len(body) % 2 else "u"
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + need, (*out, {"u": "user:", "a": "assistant:"}[need])))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if fault in ("none", "truncated"):
                more = 5 * (fault == "truncated")
                if role[:1] == need or role[:1] == "s" and not roles:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + need,
                                      (*out, {"u": "user:", "a": "assistant:"}[need] + text)))
    return best


def expected_repairs(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hurt = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hurt == 1 else text.translate({ord(x): None for x in ".!?"}) if hurt == 2 else text
        role = "user" if hurt == 4 else role
        conv[c] += [(t is not None, t or 0, role, text)] * {0: 0, 3: 2}.get(hurt, 1)
    out = []
    for c, vs in conv.items():
        vs.sort()
        seen, told = set(), []
        for _, _, role, text in vs:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {t for known, t, _, _ in vs if known}
        initials = [r[:1] for r, _, _ in told]
        cost, audit, body = cheapest(told)
        n = Counter(f for _, _, f in told)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                    hashlib.sha256("\n".join(body).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_a_search_of_all_edits(spark):  # noqa: F811
    rows = some_rows(5, 250)
    assert sorted(map(tuple, repair.repaired(table(spark, rows)).collect()), key=str) == expected_repairs(rows)
    assert repair.repaired(table(spark, rows).where("false")).count() == 0


def streamed(convs, batch):
    rows = [(c, t, False, *r) for c, rs in enumerate(convs) for t, r in enumerate(rs)]
    names = ["conv_id", "turn", "gone", "role", "text", "fault"]
    parts = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i: i + batch], strict=True)], names=names)
             for i in range(0, len(rows), batch)]
    return [row for b in repair._stream(iter(parts)) for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]


def test_repair_does_not_depend_on_batches():
    r = random.Random(2)
    convs = [[(r.choice(["user", "assistant", "system"]), f"t{i}", r.choice("kkktbd")) for i in range(r.randint(1, 9))] for _ in range(60)]
    convs.append([(r.choice(["user", "assistant"]), f"t{i}", r.choice("kkkktd")) for i in range(5000)])
    convs.append([("user", "x", "d")] * 3000)
    names = {"k": "none", "t": "truncated", "b": "blank", "d": "duplicate"}
    got = streamed(convs, 1000)
    assert got == streamed(convs, 1) == streamed(convs, 7)
    for row, conv in zip(got[:60], convs, strict=False):
        cost, audit, body = cheapest([(a, b, names[f]) for a, b, f in conv])
        assert row[6:] == (cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())


def test_rules_are_shared_and_expand_to_the_sequence():
    g = repair.Grammar()
    seqs = [[2, 4] * 6, [2, 4] * 3 + [8], [1], [], [2] * 9]
    out = g.compress(seqs)
    pairs = {v: k for k, v in g.rule.items()}

    def expand(s):
        return expand(pairs[s][0]) + expand(pairs[s][1]) if s in pairs else [s]

    assert [[t for s in o for t in expand(s)] for o in out] == seqs
    known = len(g.rule)
    g.compress(seqs)
    assert len(g.rule) == known
