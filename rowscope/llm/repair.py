"""Conversation structure repair by grammar-compressed dynamic programming.

Every row of a conversation becomes one of nine symbols: its role's initial (s, u, a or
another) with or without the truncation fault, or *must go* (blank, duplicate). The
symbols of the conversations of a batch are compressed by Re-Pair: the most frequent
adjacent pair becomes a rule, until no pair occurs twice. A rule's rows act on the four
states of ``(s?(ua)+)?`` (nothing yet, after s, after u, after a) as one 4 x 4 matrix
over (min, +): entry (p, q) is the cheapest way from p to q with its audit, a rope that
points to the two halves' ropes. A rule's matrix is the product of its halves', made
once, kept by the worker and shared by all conversations that contain the rule.

Among ways of equal cost the ASCII-least audit stays. That choice may be made inside a
rule: audits of one span and cost are never prefixes of one another, because a longer
one would have further inserts and so a higher cost.

Rows stream through a task in order, a batch at a time. Where a conversation goes on in
the next batch, states that can no longer win are given up, and what the audits of the
others have in common is final: its rows are hashed and let go. The text kept is that
of the rows still undecided.

Defined results: null conv_id, turn, role or text is one space where it is hashed or
compared (null conv_id is one conversation; null turns come first and make no gap);
rows of one turn are ordered by role and text; a role without initial is a role of its
own that only a rerole or a deletion mends; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscope.llm._text import bounded_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rules that a worker keeps; beyond, it starts afresh.
RULES = 20_000
#: Rows that are compressed together.
TOGETHER = 1000
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_CLASS = {"s": 0, "u": 1, "a": 2}
_GONE = 8
#: What state q (second) can cost more than state p (first) from here on: then p is given up if it is dearer than q by more.
_LEAD = {(0, 3): 2, (0, 2): 7, (0, 1): 10, (1, 0): 0, (1, 3): 0, (1, 2): 5, (2, 0): 5, (2, 1): 5, (2, 3): 5, (3, 0): 0, (3, 1): 10, (3, 2): 5}


def _letters(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r[1], r[0])
    return "".join(out)


def _before(a, b) -> bool:
    """Whether rope a is ASCII-less than rope b; halves that both share in the same place are passed over."""
    x, y = [a], [b]
    while x and y:
        if x[-1] is y[-1]:
            x.pop()
            y.pop()
            continue
        for side in (x, y):
            while not isinstance(side[-1], str):
                left, right = side.pop()
                side += (right, left)
        p, q = x.pop(), y.pop()
        n = min(len(p), len(q))
        if p[:n] != q[:n]:
            return p[:n] < q[:n]
        if p[n:]:
            x.append(p[n:])
        if q[n:]:
            y.append(q[n:])
        while x and x[-1] == "":
            x.pop()
        while y and y[-1] == "":
            y.pop()
    return bool(y)


def _better(a, b):
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or _before(a[1], b[1]) else b


def _then(row, matrix):
    """One row of a product over (min, +)."""
    out = []
    for q in range(4):
        best = None
        for k in range(4):
            x = row[k]
            if x is None:
                continue
            y = matrix[k][q]
            if y is not None and (best is None or x[0] + y[0] <= best[0]):
                rope = x[1] if y[1] == "" else y[1] if x[1] == "" else (x[1], y[1])
                best = _better(best, (x[0] + y[0], rope))
        out.append(best)
    return out


def _inserts() -> list[list]:
    """Cheapest inserts from each state to each other."""
    one = [[None] * 4 for _ in range(4)]
    for p in range(4):
        one[p][p] = (0, "")
        for role in "ua":
            q = _STEP.get((p, role))
            if q is not None:
                one[p][q] = _better(one[p][q], (INSERT, "I"))
    return [_then(r, one) for r in one]  # two inserts reach every state that inserts reach


INSERTS = _inserts()


def _terminal(symbol: int) -> list[list]:
    """Inserts, then one row kept, reroled or deleted."""
    edit = [[None] * 4 for _ in range(4)]
    role, cut = divmod(symbol, 2)
    more = TRUNCATED * cut
    for p in range(4):
        edit[p][p] = (DELETE, "D")
        if symbol == _GONE:
            continue
        for cost, letter, roles in ((more, "K", "sua"[role: role + 1] if role < 3 else ""), (REROLE + more, "R", "ua")):
            for r in roles:
                q = _STEP.get((p, r))
                if q is not None:
                    edit[p][q] = _better(edit[p][q], (cost, letter))
    return [_then(r, edit) for r in INSERTS]


class Grammar:
    """Re-Pair rules with their matrices; terminals are the symbols 0 to 8."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.matrix = [_terminal(s) for s in range(_GONE + 1)]
        self.rule: dict[tuple[int, int], int] = {}

    def symbol(self, pair: tuple[int, int]) -> int:
        made = self.rule.get(pair)
        if made is None:
            made = self.rule[pair] = len(self.matrix)
            right = self.matrix[pair[1]]
            self.matrix.append([_then(r, right) for r in self.matrix[pair[0]]])
        return made

    def compress(self, sequences: list[list[int]]) -> list[list[int]]:
        """The sequences with their most frequent pairs replaced, one pair after the other."""
        sym: list[int] = []
        for s in sequences:
            sym += s
            sym.append(-1)  # no pair reaches over it
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in range(n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0:
                places[sym[i], sym[i + 1]].add(i)
        heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            at = places.get(pair, ())
            if len(at) < 2:
                continue
            if len(at) < -count:
                heapq.heappush(heap, (-len(at), pair))
                continue
            made = self.symbol(pair)
            changed = set()
            for i in sorted(at):
                j = nxt[i]
                if sym[i] != pair[0] or j >= n or sym[j] != pair[1]:
                    continue  # an overlapping place that is used up
                h, k = prv[i], nxt[j]
                if h >= 0 and sym[h] >= 0:
                    places[sym[h], sym[i]].discard(h)
                    places[sym[h], made].add(h)
                    changed.add((sym[h], made))
                if k < n and sym[k] >= 0:
                    places[sym[j], sym[k]].discard(j)
                    places[made, sym[k]].add(i)
                    changed.add((made, sym[k]))
                sym[i], sym[j] = made, -2
                nxt[i] = k
                if k < n:
                    prv[k] = i
            places.pop(pair, None)
            for p in changed:
                if len(places.get(p, ())) > 1:
                    heapq.heappush(heap, (-len(places[p]), p))
        out, i, now = [], 0, []
        while i < n:
            if sym[i] == -1:
                out.append(now)
                now = []
            else:
                now.append(sym[i])
            i = nxt[i]
        return out


class _Conversation:
    """What is known of a conversation whose rows are still coming."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.ways: list = [(0, ""), None, None, None]
        self.rows: list[tuple[str, str]] = []  # not decided yet
        self.state, self.audit, self.hash, self.empty = 0, [], hashlib.sha256(), True
        self.counts = {"b": 0, "d": 0, "t": 0, "k": 0}
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = 0
        self.fresh: list[int] = []  # symbols of the batch at hand

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text))
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.fresh.append(_GONE if fault in "bd" else 2 * _CLASS.get(initial, 3) + (fault == "t"))

    def apply(self, grammar: Grammar, symbols: list[int]) -> None:
        for s in symbols:
            self.ways = _then(self.ways, grammar.matrix[s])
        self.fresh = []

    def settle(self) -> None:
        """Give up states that cannot win and decide what the others agree on."""
        ways = self.ways
        for (p, q), lead in _LEAD.items():
            if ways[p] is not None and ways[q] is not None and ways[p][0] > ways[q][0] + lead:
                ways[p] = None
        flat = [None if w is None else _letters(w[1]) for w in ways]
        live = [f for f in flat if f is not None]
        least, most = min(live), max(live)
        same = next((i for i, (x, y) in enumerate(zip(least, most, strict=False)) if x != y), min(len(least), len(most)))
        self.decide(least[:same])
        self.ways = [None if w is None else (w[0], f[same:]) for w, f in zip(ways, flat, strict=True)]

    def decide(self, letters: str) -> None:
        self.audit.append(letters)
        at = 0
        for x in letters:
            if x == "D":
                at += 1
                continue
            role, text = ("", "") if x == "I" else self.rows[at]
            at += x != "I"
            need = "a" if self.state == 2 else "u"
            if x != "K":
                role = {"u": "user", "a": "assistant"}[need]
            self.state = _STEP[self.state, role[:1]]
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False
        del self.rows[:at]

    def finish(self) -> tuple:
        ended = _then(self.ways, INSERTS)
        cost, rope = _better(ended[0], ended[3])
        self.decide(_letters(rope))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        c = self.counts
        return (self.conv_id, gaps, c["b"], c["d"], c["t"], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_SCHEMA = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in _COLUMNS])


def _stream(batches):
    grammar = Grammar()
    open_conv: _Conversation | None = None
    for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
        ended: list[_Conversation] = []
        for conv, turn, gone, role, text, fault in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "role", "text", "fault")), strict=True):
            if open_conv is None or open_conv.conv_id != conv:
                if open_conv is not None:
                    ended.append(open_conv)
                open_conv = _Conversation(conv)
            if not gone:
                open_conv.add(turn, role, text, fault)
        if open_conv is None:
            continue
        touched = [*ended, open_conv]
        for c, symbols in zip(touched, grammar.compress([c.fresh for c in touched]), strict=True):
            c.apply(grammar, symbols)
        if ended:
            done = list(zip(*[c.finish() for c in ended], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(done, _SCHEMA, strict=True)], schema=_SCHEMA)
        open_conv.settle()
        if len(grammar.rule) > RULES:
            grammar.forget()
    if open_conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(open_conv.finish(), _SCHEMA, strict=True)],
                                         schema=_SCHEMA)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32(conv_id:turn) % 20 (0 drops the row, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 sets role user)."""
    col = lambda c: F.col(f"`{c}`")
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).cast("bigint").alias("turn"), spaced(role_col).alias("role"),
        spaced(text_col).alias("text"),
        (F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20).alias("hurt"))
    text = (F.when(F.col("hurt").isin(0, 1), "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("hurt") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hurt") == 0).alias("gone"), times).drop("col")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation of ``rows``
    (conv_id, turn, role, text; gone: the row only names its conversation)."""
    space = " \t\n\x0b\f\r"
    bounded_batches(rows)
    # one exchange by conversation serves the duplicates' window and the ordered stream
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.trim(F.col("text"), F.lit(space))
    fault = (F.when(bare == "", "b").when(F.col("nth") > 1, "d")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("k"))
    told = dealt.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = told.select("conv_id", "turn", "gone", "role", "text", "fault").sortWithinPartitions(*order)
    return ordered.mapInArrow(_stream, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _SCHEMA))


def repaired(conversations: DataFrame, **columns) -> DataFrame:
    """The repair of every damaged conversation."""
    return repair(damaged(conversations, **columns))
