"""Suffix-array dedup: bytes covered by a repeated string of ``LENGTH`` bytes.

Sorting the suffix of every byte would move LENGTH bytes for each byte of text, so a
sparse suffix array is built on anchors that the content itself chooses: a position is
an anchor if the hash of its ``GRAM`` leading bytes is the least of some window of
LENGTH - GRAM + 1 positions. Every string of LENGTH bytes holds such a window, hence an
anchor at the same place in each of its occurrences: no repeated string is missed.

1. One pass writes (gram hash, position hash) for each different context of an anchor in
   its task (twice if it recurs); a grouped minimum and maximum
   tells which grams occur at two positions or more. They set bits of a table of
   ``FILTER_BITS``; a bit set by chance only costs work.
2. A second pass emits the suffix of each anchor whose bit is set (the LENGTH bytes
   after it and the bytes before it), one for each different context of the task.
   Splitters sampled from the grams range-partition the suffixes by their leading bytes,
   so suffixes that can match meet in one bucket and no match crosses a boundary. A bucket is read in order, some ten thousand suffixes at a time
   (whole groups of a leading gram), and sorted by a multikey quicksort on 8-byte symbols.
   Neighbours' common prefixes, and those of the reversed left contexts, give for every
   offset o the classes of equal LENGTH - o bytes to the right and o bytes to the left:
   a class pair held twice is a repeated string that starts o bytes before the anchor.
3. A gram with more than ``HOT`` suffixes is not gathered: its strings are hashed, one
   row for each offset, and compared by grouped sums with map-side combination.
4. The spans join the documents by the hash of the text, and the bytes go.

A text that occurs twice is covered wholly (if it has LENGTH bytes) and sends its
anchors once per task. Defined results: null text is empty; nothing is removed from
texts under LENGTH bytes; positions are bytes of UTF-8; repeated rows count as repeats.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import U, bounded_batches, id_text, mix, powers, prefix_hash, slices, sliding, span_hash, utf8

LENGTH = 200
GRAM = 20
FILTER_BITS = 1 << 27
HOT = 200_000
SAMPLED = 256
CHUNK = 20_000


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their rows and gram hashes, over the rows of a slice."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64)
    _, inverse = powers(len(data))
    with np.errstate(over="ignore"):
        h = prefix[gram:] - prefix[:-gram]
        h *= inverse[: len(h)]
        order = h ^ (h >> U(29))
        order *= U(0xC4CEB9FE1A85EC53)
        order >>= U(32)
    order = order.astype(np.uint32) | np.uint32(1)
    width = length - gram + 1
    least = sliding(order, width, np.minimum)  # for every start of a string of `length` bytes
    whole = np.zeros(len(least) + 1, np.int32)
    long_rows = np.flatnonzero(np.diff(off) >= length)
    np.add.at(whole, off[:-1][long_rows], 1)
    np.add.at(whole, np.minimum(off[1:][long_rows] - length + 1, len(least)), -1)
    least[np.cumsum(whole[:-1]) <= 0] = 0
    edge = np.zeros(width - 1, np.uint32)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    pos = np.flatnonzero(most[: len(order)] == order)
    return pos, np.searchsorted(off, pos, side="right") - 1, mix(h[pos])


def _slice_anchors(part: pa.RecordBatch, length: int, gram: int, seen: set):
    """Bytes, offsets, prefix sums, anchors, rows, gram hashes and text hashes of the texts new to this task."""
    data, off = utf8(part.column("text"))
    raw = data.tobytes()
    keys, new = [], np.zeros(len(off) - 1, bool)
    for i in range(len(off) - 1):
        size = off[i + 1] - off[i]
        key = hashlib.md5(raw[off[i]: off[i + 1]]).digest() if size >= length else b""
        keys.append(key)
        new[i] = size >= length and key not in seen
        seen.add(key)
    prefix = prefix_hash(data)
    pos, row, h = anchors(data, off, length, gram, prefix)
    keep = new[row] if len(row) else np.zeros(0, bool)
    return raw, off, prefix, pos[keep], row[keep], h[keep], keys


def contexts(off, prefix, pos, row, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every anchor's context: all strings of ``length`` bytes that hold its gram."""
    begin, end = np.maximum(off[row], pos - (length - gram)), np.minimum(off[row + 1], pos + length)
    if not len(pos):
        return begin, end, np.zeros(0, np.uint64)
    return begin, end, mix(span_hash(prefix, begin, end) ^ mix((pos - begin).astype(np.uint64)))


def repeated_grams(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """gram (hash), suffixes (different contexts, counted by task) and, for one gram in ``SAMPLED``, the bytes of
    every gram with two positions or more. A context met again in a task sends its second place only."""

    def run(batches):
        seen: set = set()
        met: dict[int, bool] = {}  # whether the second place is known
        for batch in batches:
            for part in slices(batch):
                raw, off, prefix, pos, row, h, keys = _slice_anchors(part, length, gram, seen)
                own = np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)
                place = mix(own[row] ^ mix((pos - off[row]).astype(np.uint64) + U(1))) if len(row) else h
                _, _, context = contexts(off, prefix, pos, row, length, gram)
                take, new = [], []
                for i, c in enumerate(context.tolist()):
                    twice = met.get(c)
                    if not twice:
                        met[c] = twice is not None
                        take.append(i)
                        new.append(int(twice is None))
                h, place, pos = h[take], place[take], pos[take]
                lead = [None] * len(pos)
                for i in np.flatnonzero(h % U(SAMPLED) == 0).tolist():
                    lead[i] = raw[pos[i]: pos[i] + gram]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(place.view(np.int64)), pa.array(new, pa.int32()),
                                                  pa.array(lead, pa.binary())], names=["gram", "place", "new", "lead"])

    return (texts.mapInArrow(run, "gram bigint, place bigint, new int, lead binary").groupBy("gram")
            .agg(F.min("place").alias("a"), F.max("place").alias("b"), F.sum("new").alias("suffixes"), F.min("lead").alias("lead"))
            .where("a <> b").select("gram", "suffixes", "lead"))


def splitters(grams: DataFrame, buckets: int) -> list[bytes]:
    """Leading bytes that cut the suffixes into buckets of about equal size, from a bounded sample of grams."""
    sample = grams.where("lead is not null")
    thin = int(sample.count() // (32 * buckets)) + 1  # at most about 32 grams for each bucket
    rows = sample.where(F.pmod(F.xxhash64("gram"), F.lit(thin)) == 0).select("lead", "suffixes").orderBy("lead").collect()
    total, held, out = sum(r["suffixes"] for r in rows), 0, []
    for r in rows:
        if held * buckets >= total * (len(out) + 1):
            out.append(bytes(r["lead"]))
        held += r["suffixes"]
    return out


def _bits(grams: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the grams: at most bits / 64 rows reach the driver."""
    rows = (grams.select(F.expr(f"pmod(gram, {bits}L)").alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toArrow())
    table = np.zeros(bits // 64, np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return table


def _hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = np.mod(h.view(np.int64), np.int64(len(table) * 64))
    return (table[b >> 6] >> (b & 63).astype(np.uint64)) & U(1) == U(1)


def multikey_sort(x: np.ndarray) -> np.ndarray:
    """Order of the rows of a (rows, bytes) array: partition by an 8-byte symbol, then only the
    groups of equal symbols go on with the next one."""
    n = len(x)
    symbols = np.ascontiguousarray(x).view(">u8").astype(np.uint64)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the place in the order
    open_ = np.arange(n)
    for d in range(symbols.shape[1]):
        if not len(open_):
            break
        rows = order[open_]
        value = symbols[rows, d]
        by = np.lexsort((value, group[open_]))
        order[open_] = rows[by]
        value, g = value[by], group[open_][by]
        new = np.ones(len(open_), bool)
        new[1:] = (value[1:] != value[:-1]) | (g[1:] != g[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    return order


def _common(x: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before it in the order (0 for the first), within both sizes."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 8192):
        own = np.arange(lo, min(lo + 8192, len(order)))
        a, b = order[own - 1], order[own]
        differ = x[a] != x[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
        out[own] = np.minimum(first, np.minimum(size[a], size[b]))
    return out


def matched(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, length: int,
            gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset o of a repeated string [anchor - o, anchor - o + length) for every
    suffix, -1 if there is none. ``left`` is reversed: its first byte stands before the anchor."""
    n = len(right)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, l_order = multikey_sort(right), multikey_sort(left)
    r_lcp, l_lcp = _common(right, r_order, right_size), _common(left, l_order, left_size)
    r_class, l_class = np.empty(n, np.uint64), np.empty(n, np.uint64)
    shift = U(max(1, int(n).bit_length()))
    for o in range(length - gram + 1):
        rows = np.flatnonzero((right_size >= length - o) & (left_size >= o))
        if len(rows) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - o)
        l_class[l_order] = np.cumsum(l_lcp < o)
        key = (r_class[rows] << shift) | l_class[rows]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        found = np.zeros(len(rows), bool)
        found[by[1:][same]] = True
        found[by[:-1][same]] = True
        hit = rows[found]
        high[hit] = o
        low[hit] = np.where(low[hit] < 0, o, low[hit])
    return low, high


_SUFFIX = pa.schema([("bucket", pa.int32()), ("lead", pa.binary()), ("suffix", pa.binary()), ("before", pa.binary()),
                     ("key", pa.binary()), ("pos", pa.int64()), ("b", pa.int64())])


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bits: int = FILTER_BITS,
                   hot: int = HOT) -> DataFrame:
    """key (md5 of the text), a, b: byte spans [a, b) of repeated strings; spans may overlap."""
    from rowscope.session import reliable_checkpoint

    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    grams = reliable_checkpoint(repeated_grams(texts, length, gram))
    table = spark.sparkContext.broadcast(_bits(grams, bits))
    # at most (suffixes of the corpus) / hot grams
    heavy = spark.sparkContext.broadcast(np.array(sorted(
        r["gram"] for r in grams.where(F.col("suffixes") > hot).select("gram").toLocalIterator()), np.int64))
    back = length - gram
    wide = -(-length // 8) * 8
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(grams, buckets)

    def suffixes(batches):
        """The suffixes of the task, one for each different context; a context met again is repeated as a
        whole, which settles the spans of both places at once."""
        seen: set = set()
        first: dict[int, tuple] = {}
        for batch in batches:
            for part in slices(batch):
                raw, off, prefix, pos, row, h, keys = _slice_anchors(part, length, gram, seen)
                take = _hit(table.value, h) & ~np.isin(h.view(np.int64), heavy.value)
                pos, row = pos[take], row[take]
                begin, end, context = contexts(off, prefix, pos, row, length, gram)
                spans: dict[bytes, list] = {}
                new = []
                for i, (c, r, b, e) in enumerate(zip(context.tolist(), row.tolist(), begin.tolist(), end.tolist(), strict=True)):
                    span = (keys[r], b - int(off[r]), e - int(off[r]))
                    met = first.setdefault(c, span)
                    if met is span:
                        new.append(i)
                    elif e - b >= length:
                        spans.setdefault(span[0], []).append(span[1:])
                        if met[1] >= 0:
                            spans.setdefault(met[0], []).append(met[1:])
                            first[c] = (met[0], -1, -1)
                cols: list[list] = [[], [], [], [], [], [], []]
                for i in new:
                    p, lead = int(pos[i]), raw[pos[i]: pos[i] + gram]
                    for col, value in zip(cols, (bisect_right(cuts, lead), lead, raw[p: end[i]], raw[begin[i]: p], keys[row[i]],
                                                 p - int(off[row[i]]), None), strict=True):
                        col.append(value)
                for key, own in spans.items():
                    for a, b in zip(*merged(*zip(*own, strict=True)), strict=True):
                        for col, value in zip(cols, (key[0] % buckets, None, None, None, key, int(a), int(b)), strict=True):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SUFFIX, strict=True)], schema=_SUFFIX)

    def hot_strings(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                raw, off, prefix, pos, row, h, keys = _slice_anchors(part, length, gram, seen)
                take = np.isin(h.view(np.int64), heavy.value)
                yield from _strings(prefix, off, pos[take], row[take], keys)

    def _strings(prefix, off, pos, row, keys):
        for o in range(back + 1):
            ok = np.flatnonzero((pos - o >= off[row]) & (pos - o + length <= off[row + 1]))
            if len(ok):
                at = pos[ok] - o
                yield pa.RecordBatch.from_arrays([
                    pa.array(span_hash(prefix, at, at + length).view(np.int64)), pa.array(np.full(len(ok), o, np.int32)),
                    pa.array([keys[r] for r in row[ok].tolist()], pa.binary()), pa.array((at - off[row[ok]]).astype(np.int64))],
                    names=["string", "o", "key", "pos"])

    def compare(batches):
        held: list[pa.Table] = []
        count = 0

        def flush(t: pa.Table):
            t = t.combine_chunks()
            key, pos = t.column("key").to_pylist(), t.column("pos").to_numpy()
            first: dict = {}
            for i, k in enumerate(zip(key, pos.tolist(), strict=True)):
                first.setdefault(k, i)
            own = np.fromiter(first.values(), np.int64, len(first))
            suffix, before = t.column("suffix").to_pylist(), t.column("before").to_pylist()
            right = np.frombuffer(b"".join(suffix[i].ljust(wide, b"\0") for i in own), np.uint8).reshape(-1, wide)
            left = np.frombuffer(b"".join(before[i][::-1].ljust(wide, b"\0") for i in own), np.uint8).reshape(-1, wide)
            low, high = matched(right, np.array([len(suffix[i]) for i in own]), left, np.array([len(before[i]) for i in own]),
                                length, gram)
            hit = np.flatnonzero(high >= 0)
            at = pos[own[hit]]
            return pa.RecordBatch.from_arrays([pa.array([key[i] for i in own[hit]], pa.binary()), pa.array(at - high[hit]),
                                               pa.array(at - low[hit] + length)], names=["key", "a", "b"])

        for batch in batches:
            known = batch.filter(batch.column("lead").is_null())
            yield pa.RecordBatch.from_arrays([known.column(c) for c in ("key", "pos", "b")], names=["key", "a", "b"])
            t = pa.Table.from_batches([batch.filter(batch.column("lead").is_valid())])
            held.append(t)
            count += t.num_rows
            if count < CHUNK:
                continue
            t = pa.concat_tables(held)
            lead = t.column("lead").to_pylist()
            cut = len(lead) - 1
            while cut > 0 and lead[cut - 1] == lead[-1]:
                cut -= 1
            if cut:
                yield flush(t.slice(0, cut))
                held, count = [t.slice(cut)], t.num_rows - cut
            else:
                held = [t]
        if count:
            yield flush(pa.concat_tables(held))

    spans = (texts.mapInArrow(suffixes, "bucket int, lead binary, suffix binary, before binary, key binary, pos bigint, b bigint")
             .repartition(buckets // 4, "bucket").sortWithinPartitions("bucket", "lead").mapInArrow(compare, "key binary, a bigint, b bigint"))
    if len(heavy.value):
        strings = reliable_checkpoint(texts.mapInArrow(hot_strings, "string bigint, o int, key binary, pos bigint")
                                      .dropDuplicates(["string", "o", "key", "pos"]))
        twice = strings.groupBy("string", "o").agg(F.count("*").alias("c")).where("c > 1").select("string", "o")
        spans = spans.unionByName(strings.join(twice, ["string", "o"], "left_semi").select(
            "key", F.col("pos").alias("a"), (F.col("pos") + length).alias("b")))
    copies = (texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.octet_length("text").cast("bigint").alias("b"))
              .groupBy("key", "b").agg(F.count("*").alias("c")).where("c > 1").select("key", F.lit(0).cast("bigint").alias("a"), "b"))
    return spans.unionByName(copies)


def merged(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the spans."""
    a, b = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)] if len(a) else b


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
            bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every document."""
    spans = repeated_spans(docs, text_col, length, gram, bits, hot).groupBy("key").agg(
        F.collect_list(F.struct("a", "b")).alias("spans"))
    source = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                                                    F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def cut(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                flat = spans.values.flatten() if spans.is_valid else None
                a, b = merged(flat[0].to_numpy(), flat[1].to_numpy()) if flat else (np.zeros(0, np.int64),) * 2
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                for col, value in zip(cols, (len(raw), int((b - a).sum()), len(a), kept.hexdigest(),
                                             np.column_stack([a, b]).tolist()), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(out)[1:], strict=True)]],
                                             schema=out)

    return source.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")


def digest(docs: DataFrame, **options) -> DataFrame:
    return removed(docs, **options).drop("spans")
