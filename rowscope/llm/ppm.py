"""Language-model scoring by partial matching over a byte-context trie.

Training counts, in one distributed aggregation over all training texts, the words
and the byte strings of ``ORDER`` + 1 bytes. Shorter contexts are their marginals. Every
context that occurs ``LEAST`` times or more belongs to the model, at any corpus size; a
rarer one escapes to its suffix. The probability of a byte starts at the longest known
context: a byte counted c times of t has (c - 1/2) / t, and an unseen one costs the escape
(half of the distinct bytes / t) and goes on at the next shorter context, where the bytes
already offered by the longer one are excluded. Below order 0 the remaining bytes are
equally likely.

The counts stay in a table that grows with the corpus. The most frequent contexts, at most
``CELLS`` probabilities, go to the tasks as a trie in which these steps are worked out once
per context; a position whose longest context may be a rarer one leaves the task as a
(document, byte string, count) row. The distinct strings meet the counted ones by the last
three bytes of their context (shorter contexts, 256 ** 3 counts at most, are broadcast),
their probabilities are joined back by string and summed per document. The size of the
trie changes the work, not the scores; as a string that leaves has a rare context, no key
of that join is frequent in training.

A text is scored as its lower-cased words, joined by one space, and an end symbol; 0xFF
(which UTF-8 never holds) stands for the end and fills the context before the start.

The word baseline needs the exact count of every word: the most frequent words
(``FREQUENT`` at most) go to the tasks as a table, the others are joined with the
counts by a shuffle of (document, word) rows.

Defined results: null text is empty and scores its end symbol; equal texts have equal
scores; with no training texts all bytes are equally likely and the baseline is 0 per
token; repeated documents are kept apart by their row number.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import fold, id_text, with_uid

ORDER = 5
LEAST = 2
CELLS = 16_000_000
FREQUENT = 300_000
END = 255
FLUSH = 400_000
_CHUNK = 4 << 20

_WORD, _GRAM, _END = b"w", b"g", b"e"


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, separated by ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8").lower().split() if text else []


def corpus_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): words, byte strings of order + 1 bytes and ends of all texts, by a leading kind byte."""

    def emit(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["key", "n"])

    def count(batches):
        word: Counter = Counter()
        sums: list[tuple] = []  # sorted distinct strings and counts, of some megabytes of text each
        texts_read, size, held, parts = 0, 0, 0, []
        pad = bytes([END]) * order

        def grams():
            """Strings of order + 1 bytes of the texts at hand, as integers, with their counts."""
            data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
            own, width = data, 1
            for bit in bin(order + 1)[3:]:  # by doubling
                own = (own[: len(own) - width] << np.uint64(8 * width)) | own[width:]
                width *= 2
                if bit == "1":
                    own = (own[:-1] << np.uint64(8)) | data[width: width + len(own) - 1]
                    width += 1
            # strings that end in the filling before a text are not symbols of a text
            own = np.sort(own[(own & np.uint64(0xFFFF)) != np.uint64(END << 8 | END)])
            first = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1)) != 0)
            return own[first], np.diff(np.append(first, len(own)))

        def gram_rows():
            keys, n = np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums])
            order_ = np.argsort(keys, kind="stable")
            keys, n = keys[order_], n[order_]
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0)
            keys, n = keys[first], np.add.reduceat(n, first)
            out = np.full((len(keys), order + 2), _GRAM[0], np.uint8)
            out[:, 1:] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 7 - order:]
            flat = pa.py_buffer(out.tobytes())
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(order + 2), len(keys), [None, flat])
            return pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                w = tokens(text)
                word.update(w)
                texts_read += 1
                parts.append(pad + b" ".join(w) + bytes([END]))
                size += len(parts[-1])
                if size > _CHUNK:
                    sums.append(grams())
                    held, size, parts = held + len(sums[-1][0]), 0, []
                    if held > 8 * FLUSH:
                        yield gram_rows()
                        held, sums = 0, []
                if len(word) > FLUSH:
                    yield emit([_WORD + k for k in word], list(word.values()))
                    word.clear()
        if parts:
            sums.append(grams())
        if sums:
            yield gram_rows()
        yield emit([*(_WORD + k for k in word), _END], [*word.values(), texts_read])

    return texts.select("text").mapInArrow(count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


class Trie:
    """Child links (by the preceding byte) and log10 probabilities of every cached context. Bytes that
    no context holds share one symbol; their probability is that of each of them."""

    def __init__(self, symbol: np.ndarray, child: np.ndarray, logp: np.ndarray, order: int):
        self.symbol, self.child, self.logp, self.order = symbol, child, logp, order

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sum of each text over the positions whose longest context is cached, and the byte strings
        of the other positions: text, string and count."""
        pad = bytes([END]) * self.order
        raw = [pad + b" ".join(w) + bytes([END]) for w in texts]
        plain = np.frombuffer(b"".join(raw), np.uint8)
        data = self.symbol[plain]
        size = np.array([len(r) for r in raw])
        start = np.cumsum(size) - size
        own = np.ones(len(data), bool)
        own[(start[:, None] + np.arange(self.order)).ravel()] = False
        at = np.flatnonzero(own)
        kinds = np.int32(self.child.shape[1])
        node = np.ones(len(at), np.int32)
        child = self.child.ravel()
        for d in range(1, self.order + 1):
            node = child[node * kinds + data[at - d]]
        each = self.logp.ravel()[node * kinds + data[at]].astype(np.float64)  # node 0: nothing
        total = np.add.reduceat(each, np.concatenate([[0], np.cumsum(size - self.order)[:-1]]))
        left = at[node == 0]
        string = np.zeros(len(left), np.uint64)
        for d in range(self.order, -1, -1):
            string = (string << np.uint64(8)) | plain[left - d]
        text = np.searchsorted(start, left, side="right") - 1
        by = np.lexsort((string, text))
        text, string = text[by], string[by]
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (string[1:] != string[:-1])
        first = np.flatnonzero(new)
        return total, text[first], string[first], np.diff(np.append(first, len(by)))


def build(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
    """``contexts[j]``: context (as an integer of j bytes), symbol and count of every cached order-j entry."""
    order = len(contexts) - 1
    used = np.unique(np.append(contexts[0][1], END)).astype(np.int64)
    kinds = len(used) + (len(used) < 256)
    symbol = np.full(256, len(used), np.int32)
    symbol[used] = np.arange(len(used))
    weight = np.ones(kinds)  # bytes that stand behind each symbol
    if kinds > len(used):
        weight[-1] = 256 - len(used)
    ids: list[np.ndarray] = [np.unique(c[0]) for c in contexts]
    if not len(ids[0]):
        ids[0] = np.zeros(1, np.uint64)
    base = np.cumsum([1] + [len(i) for i in ids])  # node 0: no such context; node 1: the root
    child = np.zeros((max(base[order], 2), kinds), np.int32)  # the longest contexts have no children
    cells = np.zeros((base[-1], kinds), np.float32)  # counts, overwritten by logarithms from the longest contexts on
    parent = np.zeros(base[-1], np.int64)
    for j, (ctx, sym, n) in enumerate(contexts):
        cells[base[j] + np.searchsorted(ids[j], ctx), symbol[sym]] = n
        if j:
            lead = (ids[j] >> np.uint64(8 * (j - 1))).astype(np.int64)
            rest = ids[j] & np.uint64((1 << (8 * (j - 1))) - 1)
            up = base[j - 1] + np.searchsorted(ids[j - 1], rest)
            own = base[j] + np.arange(len(ids[j]))
            child[up, symbol[lead]] = own
            parent[own] = up
    for j in range(order, -1, -1):
        for lo in range(base[j], base[j + 1], 2048):
            own = np.arange(lo, min(lo + 2048, base[j + 1]))
            free = np.ones((len(own), kinds), bool)
            prob = np.zeros((len(own), kinds))
            left = np.ones(len(own))
            at = own
            for _ in range(j + 1):
                c = np.where(free, cells[at], 0)
                total, seen = c.sum(axis=1, dtype=np.float64), (c > 0).sum(axis=1)
                some = seen > 0
                prob += np.maximum(c - 0.5, 0) * np.where(some, left / np.maximum(total, 1), 0)[:, None]
                left = np.where(some, left * 0.5 * seen / np.maximum(total, 1), left)
                free &= c == 0
                at = parent[at]
            prob += free * (left / np.maximum((free * weight).sum(axis=1), 1))[:, None]
            cells[own] = np.log10(prob)
    return Trie(symbol, child, cells, order)


def levels(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(j, ctx, sym, n): the counts of every context of 0 to order bytes, contexts as integers."""
    grams = counts.where(F.substring("key", 1, 1) == F.lit(bytearray(_GRAM))).select(
        F.conv(F.hex(F.expr("substring(key, 2)")), 16, 10).cast("bigint").alias("g"), "n")
    out = None
    for j in range(order, -1, -1):
        if j < order:
            grams = grams.select(F.col("g").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
        own = grams.select(F.lit(j).alias("j"), F.shiftright("g", 8).alias("ctx"), F.col("g").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (table.column("ctx").to_numpy().astype(np.uint64), table.column("sym").to_numpy().astype(np.int16),
            table.column("n").to_numpy().astype(np.int64))


def cached_contexts(entries: DataFrame, order: int = ORDER, cells: int = CELLS) -> list[tuple]:
    """The entries of the most frequent contexts from ``levels``, as ``build`` takes them: the root and so
    many whole bands of counts that the trie has at most ``cells`` probabilities."""
    kinds = entries.where("j = 0").count() + 2
    contexts = entries.groupBy("j", "ctx").agg(F.sum("n").alias("t"), F.collect_list(F.struct("sym", "n")).alias("e"))
    longer = contexts.where((F.col("j") > 0) & (F.col("t") >= LEAST))
    bands = {r["b"]: r["k"] for r in longer.groupBy(F.floor(8 * F.log2("t")).alias("b")).agg(F.count("*").alias("k")).collect()}
    held, band = 1, None
    for b in sorted(bands, reverse=True):
        if (held + bands[b]) * kinds > cells:
            break
        held, band = held + bands[b], b
    kept = F.col("j") == 0
    if band is not None:
        kept = kept | (F.col("t") >= LEAST) & (F.floor(8 * F.log2("t")) >= band)
    found = contexts.where(kept).select("j", "ctx", F.inline("e")).toArrow()
    return [_columns(found.filter(pc.equal(found.column("j"), j))) for j in range(order + 1)]


def string_scores(strings: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of the last byte of each string after the bytes before it. ``tables[j]`` holds the
    sorted strings of j + 1 bytes and their counts."""
    order = len(tables) - 1
    left = np.zeros(len(strings))
    open_ = np.ones(len(strings), bool)
    gone_n, gone_k = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)  # excluded: counts, bytes
    for j in range(order, -1, -1):
        keys, n = tables[j]
        if not len(keys):
            continue
        ctx = keys >> np.uint64(8)
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        t, k = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
        if j:  # what this context's bytes count for its suffix
            shorter, m = tables[j - 1]
            up = np.add.reduceat(m[np.searchsorted(shorter, keys & np.uint64((1 << 8 * j) - 1))], first)
        own = strings & np.uint64((1 << 8 * (j + 1)) - 1)
        at = np.minimum(np.searchsorted(ctx[first], own >> np.uint64(8)), len(first) - 1)
        known = (ctx[first][at] == own >> np.uint64(8)) & ((t[at] >= LEAST) | (j == 0))
        where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = open_ & known & (keys[where] == own)
        total, kinds = t[at] - gone_n, k[at] - gone_k
        left[hit] += np.log10((n[where[hit]] - 0.5) / total[hit])
        miss = open_ & known & ~hit & (kinds > 0)
        left[miss] += np.log10(0.5 * kinds[miss] / total[miss])
        open_ &= ~hit
        if j:
            gone_n, gone_k = np.where(known, up[at], 0), np.where(known, k[at], 0)
        else:
            gone_k = np.where(known, k[at], 0)
    left[open_] -= np.log10(256 - gone_k[open_])
    return left


def _marginal(keys: np.ndarray, n: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of j + 1 bytes and their counts, from longer ones."""
    keys = keys & np.uint64((1 << 8 * (j + 1)) - 1)
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(first) else n


def rare_strings(strings: DataFrame, entries: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp) of the distinct strings ``g`` of order + 1 bytes, from the counts in ``levels``. Strings
    and counts meet by the last bytes of the context, three at most; shorter contexts are broadcast."""
    spark = entries.sparkSession
    near = min(3, order)
    low = entries.where(F.col("j") < near).toArrow()
    short = []
    for j in range(near):
        ctx, sym, n = _columns(low.filter(pc.equal(low.column("j"), j)))
        short.append(_marginal(ctx << np.uint64(8) | sym.astype(np.uint64), n, j))
    shorter = spark.sparkContext.broadcast(short)
    counted = entries.where(F.col("j") == order).select((F.shiftleft("ctx", 8) + F.col("sym")).alias("g"), "n")
    both = counted.unionByName(strings.select("g", F.lit(0).cast("bigint").alias("n")))
    suffix = F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * near) - 1))

    def run(batches):
        def scored(rows: pa.Table):
            g, n = rows.column("g").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
            want = g[n == 0]
            if len(want):
                have = [_marginal(g[n > 0], n[n > 0], j) for j in range(near, order + 1)]
                logp = string_scores(want, shorter.value + have)
                yield pa.RecordBatch.from_arrays([pa.array(want.astype(np.int64)), pa.array(logp)], names=["g", "logp"])

        held: list = []
        size = 0
        for batch in batches:  # sorted by suffix: whole suffixes of some hundred thousand rows together
            held.append(batch)
            size += batch.num_rows
            if size > FLUSH:
                t = pa.Table.from_batches(held).combine_chunks()
                s = t.column("s").to_numpy()
                cut = int(np.searchsorted(s, s[-1]))
                if cut:
                    yield from scored(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = len(s) - cut
        if held:
            yield from scored(pa.Table.from_batches(held))

    return both.withColumn("s", suffix).repartition("s").sortWithinPartitions("s").mapInArrow(run, "g bigint, logp double")


_BUILT: dict = {}


def built(held) -> Trie:
    """The trie of a broadcast list of contexts, built once by each worker."""
    contexts = held.value
    if _BUILT.get("of") is not contexts:
        _BUILT.update(of=contexts, trie=build(contexts))
    return _BUILT["trie"]


def frequent_words(words: DataFrame, most: int = FREQUENT) -> tuple[int, dict[bytes, int]]:
    """The least count of a frequent word, and the frequent words: at most ``most``."""
    bands = {r["b"]: r["k"] for r in words.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.count("*").alias("k")).collect()}
    held, band = 0, None
    for b in sorted(bands, reverse=True):
        if held + bands[b] > most:
            break
        held, band = held + bands[b], b
    if band is None:
        return 1 << 62, {}
    least = math.ceil(2 ** (band / 8) - 1e-9)
    found = words.where(F.floor(8 * F.log2("n")) >= band).toArrow()
    return least, dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          cells: int = CELLS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    from rowscope.session import reliable_checkpoint

    spark = docs.sparkSession
    counts = reliable_checkpoint(corpus_counts(id_text(training, id_col, text_col), order))
    entries = reliable_checkpoint(levels(counts, order))
    contexts = spark.sparkContext.broadcast(cached_contexts(entries, order, cells))
    words = counts.where(F.substring("key", 1, 1) == F.lit(bytearray(_WORD))).select(F.expr("substring(key, 2)").alias("word"), "n")
    ends = counts.where(F.col("key") == F.lit(bytearray(_END))).agg(F.sum("n")).first()[0] or 0
    held, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (held or 0) + ends, distinct + (ends > 0)
    _, table = frequent_words(words)
    known = spark.sparkContext.broadcast({w: math.log10(n + 1) for w, n in table.items()})
    end_value, end_known = math.log10(ends + 1), int(ends > 0)
    out = pa.schema([("uid", pa.int64()), ("word", pa.binary()), ("g", pa.int64()), ("cnt", pa.int64()), ("doc_id", pa.int64()),
                     ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        get, model = known.value.get, built(contexts)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [tokens(t) for t in part.column("text").to_pylist()]
                scores, begin, size, g_at, g_of, g_cnt = [], 0, 0, [], [], []
                for i, w in enumerate(texts):  # parts of some megabytes
                    size += sum(map(len, w)) + len(w)
                    if size > _CHUNK // 2 or i == len(texts) - 1:
                        closed, at_text, string, times = model.score(texts[begin: i + 1])
                        scores.append(closed)
                        g_at.append(at_text + begin)
                        g_of.append(string)
                        g_cnt.append(times)
                        begin, size = i + 1, 0
                uids, ids = part.column("uid").to_pylist(), part.column("doc_id").cast(pa.int64())
                n_known, base, r_uid, r_word, r_cnt = [], [], [], [], []
                for uid, w in zip(uids, texts, strict=True):
                    value, rare = end_value, {}
                    for x in w:
                        v = get(x)
                        if v is None:
                            rare[x] = rare.get(x, 0) + 1
                        else:
                            value += v
                    n_known.append(end_known + len(w) - sum(rare.values()))
                    base.append(value)
                    r_uid += [uid] * len(rare)
                    r_word += rare.keys()
                    r_cnt += rare.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), pa.array([b" %d" % u for u in uids], pa.binary()), pa.nulls(len(uids), pa.int64()),
                     pa.array([0] * len(uids), pa.int64()), ids,
                     pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(np.concatenate(scores))], schema=out)
                none = [pa.nulls(len(r_uid), f.type) for f in list(out)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(r_uid, pa.int64()), pa.array(r_word, pa.binary()), pa.nulls(len(r_uid), pa.int64()),
                                                  pa.array(r_cnt, pa.int64()), *none], schema=out)
                g_at, g_of = np.concatenate(g_at), np.concatenate(g_of).astype(np.int64)
                none = [pa.nulls(len(g_at), f.type) for f in list(out)[4:]]
                yield pa.RecordBatch.from_arrays([part.column("uid").take(pa.array(g_at)), pa.nulls(len(g_at), pa.binary()), pa.array(g_of),
                                                  pa.array(np.concatenate(g_cnt).astype(np.int64)), *none], schema=out)

    rows = reliable_checkpoint(with_uid(id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))).mapInArrow(
        run, "uid bigint, word binary, g bigint, cnt bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"))
    strings = rows.where("g is not null")
    rare = strings.join(rare_strings(strings.select("g").distinct(), entries, order), "g").groupBy("uid").agg(
        F.sum(F.col("cnt") * F.col("logp")).alias("score"))
    joined = rows.where("g is null").drop("g").join(words, "word", "left").unionByName(rare, allowMissingColumns=True)
    found = F.coalesce("n", F.lit(0))
    per = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.lit(0))) + F.sum(F.when(found > 0, F.col("cnt")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(F.col("cnt") * F.log10(found + 1))).alias("base"),
        F.sum("score").alias("score"))
    return per.select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score")


def corpus_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all documents, learned from those outside the held-out fold."""
    training = docs.where(F.coalesce(fold("doc_id", folds) != held, F.lit(True)))
    s = score(docs, training)
    return s.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
                    *[c for c in s.columns if c != "doc_id"])
