"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken is a row of byte symbols. The leaves of its segment tree hold the rank of
the pair (symbol, next symbol) and the leaf's place; inner nodes hold the minimum, so
the root names the leftmost pair of lowest rank. A merge changes three leaves, each
repaired on the way to the root. The loop ends when the root holds no mergeable pair.

The trees of many pretokens are kept as rows of one array and advance together; a
very long pretoken is simply a wide row of its own. A worker remembers the ids of the
pretokens it has met (``CACHE_PRETOKENS`` at most, then it starts afresh), which only
saves time. The vocabulary file is a parameter and is read by the workers.

Defined results: null or empty text encodes to no ids and decodes to the empty text;
a special token's string in a text is that token, as the tokenizers library does by
default; rows keep their number and order of ids, repeats included.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import id_text

CACHE_PRETOKENS = 200_000
#: Fixed value: the pretoken pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
INF = np.int64(1) << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(back[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for t, i in vocab.items():
            self.text[i] = raw[t]
        for t, i in self.special.items():
            self.text[i] = t.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.key, self.rank = size, key[order], rank[order]
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        lengths = np.array([len(t) for t in self.text])
        self.text_len = lengths
        self.cache: dict = {}
        self.forget()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or INF; a symbol below 0 is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (right >= 0), self.rank[at], INF)

    def merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """Merge the rows of a (rows, width) symbol array, -1 after each row's end; width is a power of two."""
        n, width = sym.shape
        sym = np.ascontiguousarray(sym).astype(np.int64)
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), INF)
        right = np.concatenate([sym[:, 1:], np.full((n, 1), -1)], axis=1)
        rank = self.ranks(sym.ravel(), right.ravel()).reshape(n, width)
        leaf = np.where(rank < INF, rank * width + np.arange(width), INF)
        tree[:, width:] = leaf
        at = width
        while at > 1:
            tree[:, at // 2: at] = np.minimum(tree[:, at: 2 * at: 2], tree[:, at + 1: 2 * at: 2])
            at //= 2
        fs, fn, fp, ft = sym.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = ft[rows * (2 * width) + 1]
            live = root < INF
            rows, root = rows[live], root[live]
            if not len(rows):
                return sym
            i = root % width
            base, tbase = rows * width, rows * (2 * width)
            j = fn[base + i]
            fs[base + i] = self.made[root // width]
            after = fn[base + j]
            fs[base + j] = -1
            fn[base + i] = after
            more = after < width
            fp[(base + after)[more]] = i[more]
            before = fp[base + i]
            self._point(ft, fs, tbase, base, width, j, None)
            self._point(ft, fs, tbase, base, width, i, after)
            left = before >= 0
            if left.any():
                self._point(ft, fs, tbase[left], base[left], width, before[left], i[left])

    def _point(self, ft, fs, tbase, base, width, at, following) -> None:
        """Set the leaves ``at`` to the pair with ``following`` (None: no pair) and repair their paths."""
        if following is None:
            value = np.full(len(at), INF)
        else:
            ok = following < width
            right = np.where(ok, fs[base + np.minimum(following, width - 1)], -1)
            rank = self.ranks(fs[base + at], right)
            value = np.where(rank < INF, rank * width + at, INF)
        node = at + width
        ft[tbase + node] = value
        while width > 1:
            node = node >> 1
            ft[tbase + node] = np.minimum(ft[tbase + 2 * node], ft[tbase + 2 * node + 1])
            if node[0] == 1:  # all leaves have one depth
                break

    def learn(self, words: list[str]) -> None:
        """Put the ids of new pretokens (as little-endian 32-bit integers) in the cache."""
        raw = [w.encode("utf-8") for w in words]
        by_width: dict[int, list[int]] = {}
        for k, r in enumerate(raw):
            by_width.setdefault(1 << max(0, (len(r) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(members), step):
                part = members[at: at + step]
                data = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
                length = np.array([len(raw[k]) for k in part])
                sym = np.full((len(part), width), -1, np.int64)
                sym[np.arange(width) < length[:, None]] = self.byte_id[data]
                sym = self.merge_rows(sym)
                kept = sym >= 0
                ids = sym[kept].astype("<u4").tobytes()
                ends = 4 * np.cumsum(kept.sum(axis=1))
                start = 0
                for k, end in zip(part, ends.tolist(), strict=True):
                    self.cache[words[k]] = ids[start:end]
                    start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.cache) > CACHE_PRETOKENS:
            self.forget()
        find = self.pattern.findall
        pieces: list[list] = []
        for text in texts:
            parts = self.splitter.split(text) if self.splitter else [text]
            out: list = []
            for part in parts:
                if part in self.special:
                    out.append(self.special[part])
                else:
                    out += find(part)
            pieces.append(out)
        self.learn(list(set().union(*pieces) - self.cache.keys()))
        return [b"".join(map(self.cache.__getitem__, p)) for p in pieces]

    def forget(self) -> None:
        """Start the memory afresh; special tokens are keyed by their id."""
        self.cache = {i: i.to_bytes(4, "little") for i in self.special.values()}

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary on the machine that runs the task."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


_ROWS = 256


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and the decoded text of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return _apply(docs, id_col, text_col, vocabulary, out, "doc_id bigint, n_tokens bigint, ids binary, decoded string",
                  lambda ids, text: (ids, text))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded text, taken where the ids are made."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])
    return _apply(docs, id_col, text_col, vocabulary, out,
                  "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                  lambda ids, text: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()))


def _apply(docs, id_col, text_col, vocabulary, out, schema, finish) -> DataFrame:
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def run(batches):
        bpe = load(vocabulary or default_vocabulary())
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                done = [finish(i, bpe.decode(i)) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([d[0] for d in done], out.field(2).type), pa.array([d[1] for d in done], out.field(3).type)],
                    schema=out)

    return source.mapInArrow(run, schema)
