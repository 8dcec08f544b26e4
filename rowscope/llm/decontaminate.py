"""Benchmark decontamination: Wu-Manber search for every benchmark window over words.

The symbols are words. All windows of one length form one pattern set: a shift table
over blocks of two words tells how far the scan may jump, a block with shift 0 leads
to the bucket of windows that end with it, and a direct comparison of the words
confirms an occurrence. Windows of a short item have their own length and tables.

The item table is a stated query set: it is searched in blocks of at most
``block_bytes`` of text, each broadcast once, so its size is not bounded by memory.
Documents are only scanned: one block needs no shuffle; for several, ids, row numbers and
texts are written once, so that every block sees the same row numbers.

Defined results: null text has no words; items without id or words are left out;
rows of one item id count as one item; repeated documents give repeated rows; an
empty item table leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import bounded_batches, id_text, with_uid
from rowscope.session import reliable_checkpoint

WINDOW = 10
#: Text of a block of items. Its compiled tables take about 130 times as much memory.
BLOCK_BYTES = 2 << 20

#: A-Z to lower case; everything ASCII but letters and digits to a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


class WindowSet:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block:end]
                jump = length - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
            self.bucket.setdefault(window[length - self.block:], []).append((list(window), items))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and item ids of every occurrence."""
        n, m, shift, default = len(words), self.length, self.shift.get, self.default
        at = m
        if self.block == 2:
            while at <= n:
                key = (words[at - 2], words[at - 1])
                jump = shift(key, default)
                if jump:
                    at += jump
                    continue
                start = at - m
                for window, items in self.bucket[key]:
                    if words[start] == window[0] and words[start:at] == window:
                        yield start, items
                at += 1
        else:
            for start, word in enumerate(words):
                for _, items in self.bucket.get((word,), ()):
                    yield start, items


def compile_items(rows: list[tuple], window: int = WINDOW) -> list[WindowSet]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item_id, text in rows:
        w = word_list(text)
        length = min(window, len(w))
        if length:
            known = by_length.setdefault(length, {})
            for i in range(len(w) - length + 1):
                known.setdefault(tuple(w[i:i + length]), set()).add(item_id)
    return [WindowSet(n, known) for n, known in sorted(by_length.items())]


def find(words: list[bytes], sets: list[WindowSet]) -> tuple[list[list[int]], set]:
    """Merged word spans hit by any occurrence, and the items found."""
    found, items = [], set()
    for s in sets:
        for start, ids in s.scan(words):
            found.append((start, start + s.length))
            items |= ids
    return merge(found), items


def merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(x[0]), int(x[1])) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SCAN = "doc_id bigint, uid bigint, n_words bigint, spans array<array<int>>, items array<string>"
_HITS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _blocks(spark, items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int) -> list:
    """Broadcast pattern sets, one for each block of the item table."""
    bench = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(
        "i is not null and t is not null")
    total = bench.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = int(total // block_bytes) + 1
    out = []
    for k in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) if blocks > 1 else bench
        out.append(spark.sparkContext.broadcast(compile_items([(r["i"], r["t"]) for r in own.collect()], window)))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, uid, n_words, spans (merged [start, end) word spans), items."""
    source = with_uid(id_text(docs, id_col, text_col)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    parts = []
    blocks = _blocks(docs.sparkSession, items, item_id, item_text, window, block_bytes)
    if len(blocks) > 1:
        source = reliable_checkpoint(source)
    for sets in blocks:

        def search(batches, sets=sets):
            known = sets.value
            for batch in batches:
                ids, uids = batch.column("doc_id"), batch.column("uid")
                n, spans, found = [], [], []
                for text in batch.column("text"):
                    w = word_list(text.as_py())
                    s, i = find(w, known)
                    n.append(len(w))
                    spans.append(s)
                    found.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), uids, pa.array(n, pa.int64()), pa.array(spans, _HITS.field("spans").type),
                     pa.array(found, _HITS.field("items").type)], schema=_HITS)

        parts.append(source.mapInArrow(search, _SCAN))
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = F.udf(lambda s: merge(s or []), "array<array<int>>")
    return both.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).select(
        "doc_id", "uid", "n_words", "spans", "items")


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from the spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                        item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any occurrence, all columns unchanged: one filtering pass per block, no shuffle."""
    out = bounded_batches(docs)
    for sets in _blocks(docs.sparkSession, items, item_id, item_text, window, block_bytes):

        def keep(batches, sets=sets):
            known = sets.value
            for batch in batches:
                clean = [not find(word_list(t.as_py()), known)[0] for t in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
