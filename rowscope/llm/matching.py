"""Byte-level BPE by longest matches and backtracking over compatible neighbours.

The bytes of the vocabulary's tokens, read as Latin-1 characters, are the keys of an
Aho-Corasick automaton; one pass over a pretoken gives the longest token that starts
at each of its bytes. The encoder takes the longest match, and each further token must
be *compatible* with the one before it: merging the bytes of both by rank would leave
exactly these two. That holds for a whole sequence if it holds for every neighbouring
pair, so a sequence of compatible neighbours is the one the merges give. Where no
prefix of the match is compatible, the last token is taken back and shortened; an end
from which the rest could not be reached is marked and not tried again, so every place
is left once and the time is linear in the bytes.

Compatibility of two tokens undoes their merges from the last one back: the pair that
meets at the border must have no merge earlier than the merges undone so far. The
merge that makes a token is found in rank order from the shorter tokens; a vocabulary
entry that no merges make never takes part, except as a whole pretoken, which the
library looks up first. Answers and the ids of pretokens met before are remembered
(``MEMO`` entries at most, then afresh), which only saves time.

Defined results: null or empty text has no ids and no bytes; a special token's string
is ordinary text; ids of repeated rows repeat. The vocabulary file and the pattern are
parameters and are read by the workers.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import id_text

MEMO = 500_000
_ROWS = 256


class RankEncoder:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.find = regex.compile(pattern).findall
        self.token = {r: t for t, r in self.rank.items()}
        self.memo: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """The two tokens whose merge makes each token, in rank order, and the automaton of all made tokens."""
        import ahocorasick

        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        made: dict[bytes, int] = {bytes([b]): self.rank[bytes([b])] for b in range(256)}
        for r in sorted(self.token):
            raw = self.token[r]
            if len(raw) == 1:
                continue
            for cut in range(1, len(raw)):
                a, b = made.get(raw[:cut]), made.get(raw[cut:])
                if a is not None and b is not None and self._apart(a, b):
                    self.left[r], self.right[r] = a, b
                    self.joined[a, b] = r
                    made[raw] = r
                    break
        self.memo = {}
        automaton = ahocorasick.Automaton()
        for raw, r in made.items():
            automaton.add_word(raw.decode("latin-1"), (r, len(raw)))
        automaton.make_automaton()
        self.matches = automaton.iter
        # the longest made token that is a proper prefix of each token, or -1
        self.shorter = {r: next((made[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in made), -1)
                        for raw, r in made.items()}
        self.size = {r: len(raw) for raw, r in made.items()}

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves exactly a and b."""
        joined, left, right = self.joined, self.left, self.right
        last = None  # the earliest merge undone so far; on the left of the border it comes before its equal
        while True:
            made = joined.get((a, b))
            if made is not None and (last is None or (made, 0) < last):
                return False
            # undo the later of the two merges next to the border; of equal ones the right one
            ra, rb = (a if a in right else -1), (b if b in left else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                last, a = (a, 0), right[a]
            else:
                last, b = (b, 1), left[b]

    def compatible(self, a: int, b: int) -> bool:
        at = a << 32 | b
        known = self.memo.get(at)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[at] = self._apart(a, b)
        return known

    def pretoken(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pretoken."""
        whole = self.rank.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        longest, reach = array("l", bytes(array("l").itemsize * n)), array("H", bytes(2 * n))
        for end, (token, length) in self.matches(raw.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                longest[start], reach[start] = token, length
        open_end = bytearray(b"\x01") * (n + 1)  # places from which the rest may still be reached
        shorter, size, compatible = self.shorter, self.size, self.compatible
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_end[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: take the last token back and shorten it
                open_end[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= MEMO:
                    known.clear()
                ids = self.pretoken(piece.encode("utf-8"))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple[str, str], RankEncoder] = {}


def load(path: str | None = None, pattern: str | None = None) -> RankEncoder:
    """The encoder of a rank file (the public multilingual one by default), kept by the worker."""
    import public_tokenizers

    key = (path or os.fspath(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN)
    if key not in _LOADED:
        _LOADED[key] = RankEncoder(*key)
    return _LOADED[key]


def _apply(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, pattern: str | None,
           fields: list[tuple[str, pa.DataType, str]], finish) -> DataFrame:
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())] + [(n, t) for n, t, _ in fields])

    def run(batches):
        coder = load(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                counts, cols = [], [[] for _ in fields]
                for text in part.column("text").to_pylist():
                    ids = coder.encode(text or "")
                    counts.append(len(ids))
                    for col, value in zip(cols, finish(coder, ids), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
                     *[pa.array(c, t) for c, (_, t, _) in zip(cols, fields, strict=True)]], schema=schema)

    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of every document."""
    return _apply(docs, id_col, text_col, vocabulary, pattern,
                  [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.binary(), "binary")],
                  lambda coder, ids: (ids, coder.decode(ids)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the comma-joined ids and of the decoded bytes."""
    return _apply(docs, id_col, text_col, vocabulary, pattern,
                  [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")],
                  lambda coder, ids: (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                      hashlib.sha256(coder.decode(ids)).hexdigest()))
