"""Near-duplicate documents by Order MinHash and banded alignment.

A text is its sequence of five-word shingles; a shingle's occurrence number makes
repeats distinct. Each of ``SKETCHES`` hash functions picks the ``PICK`` least
labelled shingles of a text and keeps them in text order, so texts agree in a sketch if
they share those shingles in that order: the chance falls with the edit similarity.

Texts with one sketch in common form a bucket. The members of a bucket are aligned with
its ``LEADERS`` most central members of about their own length (those in the largest
buckets; of a group of edited copies these are the least edited), so a bucket of b
members gives a few times LEADERS x b candidates. A bucket that this leaves with members
of different components is refined, not compared pair by pair: texts as alike as asked
share at least SIMILARITY of their labelled shingles, hence one of the rarest
(1 - SIMILARITY) of them, in whatever order rarity is counted. The texts of open buckets
meet again under these rarest shingles only (texts of repeated phrases under the rarest
of their different shingles). Texts that merely share a sentence or repeat a phrase have
it among their frequent shingles and do not meet; alike ones always do. Each such bucket
gets further leaders, twice as many in every round, until its members are of one
component or every member has led, so no candidate is left out. A pair is linked if the alignment of its shingle sequences, in a
band as wide as the allowed distance, costs at most (1 - ``SIMILARITY``) x the longer
length, and their distinct shingles agree as much as this asks of texts without repeats
(Jaccard SIMILARITY / (2 - SIMILARITY)), so that one phrase repeated through two texts
does not link them. Groups are the connected components of the links.

Equal texts are one class and are represented once per task and once after the shuffle.
Token sequences move for texts with a shared sketch only: a table of ``FILTER_BITS``
bits names them, a bit set by chance only costs work.

Defined results: null text counts as empty; texts without a word are near-duplicates
of equal texts only; a text of fewer than five words is one shingle; rows without id
take part and their class has the least other id or null; repeated rows share a class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscope.llm._graph import components, release
from rowscope.llm._text import U, bounded_batches, fresh, mix, shingles, slices, utf8, words
from rowscope.session import reliable_checkpoint

SKETCHES = 24
PICK = 3
LEADERS = 4
SIMILARITY = 0.8
#: Share of different shingles below which a text counts as one of repeated phrases (a choice of work, not of results).
REPEATS = 0.3
FILTER_BITS = 1 << 26
_THIN = 24
#: Texts of one group of alignments.
BLOCK = 400


def occurrence_labels(sh: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct inside a row by the number of earlier equal shingles."""
    n = len(sh)
    row = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
    order = np.lexsort((np.arange(n), sh, row))
    s, r = sh[order], row[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    at = np.arange(n)
    nth = np.empty(n, np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(sh ^ mix(nth + U(0x51ED2701)))


def sketches(sh: np.ndarray, soff: np.ndarray, count: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """(rows with shingles, count) order-min-hash values; equal picks in equal order give equal values."""
    size = np.diff(soff)
    rows = np.flatnonzero(size)
    if not len(rows):
        return np.zeros((0, count), np.uint64)
    label = occurrence_labels(sh, soff)
    row = np.repeat(np.arange(len(size)), size)
    share = np.minimum(1.0, _THIN / np.maximum(size, 1))
    limit = np.where(share < 1, share * 2.0 ** 64, 2.0 ** 64 - 1).clip(max=2.0 ** 64 - 4096).astype(np.uint64)[row]
    out = np.zeros((len(rows), count), np.uint64)
    for k in range(count):
        with np.errstate(over="ignore"):
            v = (label ^ U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xFF51AFD7ED558CCD)
            v ^= v >> U(32)
            v *= U(0xC4CEB9FE1A85EC53)
        at = np.flatnonzero(v <= limit)
        have = np.bincount(row[at], minlength=len(size))
        short = have < np.minimum(size, pick)
        if short.any():  # too few below the limit: all shingles of these rows take part
            at = np.flatnonzero((v <= limit) | short[row])
            have = np.bincount(row[at], minlength=len(size))
        order = np.lexsort((v[at], row[at]))
        first = (np.cumsum(have) - have)[rows]
        took = np.minimum(have[rows], pick)
        chosen = np.full((len(rows), pick), len(label), np.int64)
        for i in range(pick):
            ok = took > i
            chosen[ok, i] = at[order[first[ok] + i]]
        chosen.sort(axis=1)  # text order
        padded = np.append(label, U(0))
        value = np.full(len(rows), U(k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(pick):
                value = mix(value * U(0x9FB21C651E98DF25) + padded[chosen[:, i]])
        out[:, k] = value
    return out


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1. The alignment keeps to
    the diagonals -most..most; each column of the band is one integer of bits."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a -= 1
        hi_b -= 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    width = 2 * most + 1
    mask = (1 << width) - 1
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << i)
    up, down = mask >> most << most, 0  # vertical steps of +1 and -1 in the band
    score = min(m, most)
    for j in range(n):
        bits = place.get(b[j], 0)
        x = (bits >> (j - most) if j >= most else bits << (most - j)) & mask
        diagonal = (((x & up) + up) ^ up) | x | down
        right = down | ~(diagonal | up)
        left = diagonal & up
        if j + most < m:  # the lowest cell of the band moves down its diagonal
            score += not (diagonal >> (width - 1)) & 1
        else:  # then along the last row
            at = m - 1 - j + most
            score += ((right >> at) & 1) - ((left >> at) & 1)
        if score - (n - 1 - j) > most:
            return most + 1
        shifted = (diagonal & mask) >> 1
        up = (left | ~(shifted | right)) & mask
        down = shifted & right & mask
    return score if score <= most else most + 1


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the sequences' edit similarity reaches ``similarity``, and their sets of shingles what follows from it."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if np.array_equal(a, b):
        return True
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    shared = ub[at] == ua
    if np.where(shared, np.minimum(ca, cb[at]), 0).sum() < longer - most:  # cannot be reached
        return False
    if shared.sum() * (2 - similarity) < similarity * (len(ua) + len(ub) - shared.sum()) - 1e-9:
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def text_key(text: str | Column) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string").cast("binary")))


def _new_texts(batches, seen: set):
    """Slices with the texts this task has not met, and their keys."""
    for batch in batches:
        for part in slices(batch):
            data, off = utf8(part.column("text"))
            raw = data.tobytes()
            keys, take = [], []
            for i in range(len(off) - 1):
                key = hashlib.md5(raw[off[i]: off[i + 1]]).digest()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    take.append(i)
            if take:
                data, off = utf8(part.column("text").take(pa.array(take)))
                _, _, hashes, woff = words(data, off)
                yield keys, *shingles(hashes, woff)


def sketch_rows(texts: DataFrame, count: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """key, n (shingles) and the sketches of every text with a word; a copy may come from several tasks."""

    def run(batches):
        for keys, sh, soff in _new_texts(batches, set()):
            size = np.diff(soff)
            rows = np.flatnonzero(size)
            s = sketches(sh, soff, count, pick)
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[r] for r in rows.tolist()], pa.binary()), pa.array(size[rows].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count), pa.array(s.ravel().view(np.int64)))],
                names=["key", "n", "v"])

    return texts.mapInArrow(run, "key binary, n int, v array<bigint>")


def _rarest(seqs: DataFrame, similarity: float, bits: int) -> DataFrame:
    """bucket, key, n: the rarest shingles of every text, as many as one of alike texts must share, that occur in a second one.

    A text whose shingles are mostly different counts them with their occurrences: of n, the n - ceil(similarity x n) + 1
    rarest. A text of repeated phrases counts its d different ones, of which alike texts share the Jaccard that ``alike``
    asks. The share of different shingles of alike texts differs by a bounded factor, so that texts whose share lies
    within it of ``REPEATS`` are counted both ways and every alike pair meets. Shingles of one text alone are the
    rarest; they are counted, not moved."""
    jaccard = similarity / (2 - similarity)
    both = REPEATS / (jaccard * similarity)

    def one_way(keys, n, token, size, share, salt):
        least = np.ceil(size * share - 1e-9).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(mix(token ^ U(salt)).view(np.int64)), keys.take(pa.array(np.repeat(np.arange(len(size)), size))),
            pa.array(np.repeat(n, size).astype(np.int32)), pa.array(np.repeat(size, size).astype(np.int32)),
            pa.array(np.repeat(size - least + 1, size).astype(np.int32))], names=["bucket", "key", "n", "size", "rarest"])

    def labelled(batches, table=None):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                seq, keys = part.column("seq"), pa.array(part.column("key").to_pylist(), pa.binary())
                n = np.array([len(x) for x in seq], np.int64)
                row = np.repeat(np.arange(len(n)), n)
                sh = seq.flatten().to_numpy().view(np.uint32).astype(np.uint64)
                token = occurrence_labels(sh, np.concatenate([[0], np.cumsum(n)]))
                order = np.lexsort((sh, row))
                first = np.ones(len(sh), bool)
                first[1:] = (sh[order][1:] != sh[order][:-1]) | (row[order][1:] != row[order][:-1])
                place = order[first]
                d = np.bincount(row[place], minlength=len(n))
                share = d / np.maximum(n, 1)
                plain, phrases = share >= REPEATS, share < both
                for made in (one_way(keys, n, token[plain[row]], np.where(plain, n, 0), similarity, 1),
                             one_way(keys, n, sh[place][phrases[row[place]]], np.where(phrases, d, 0), jaccard, 2)):
                    yield made.select(["bucket"]) if table is None else made.filter(_named(table.value, made.column("bucket")))

    shared = reliable_checkpoint(seqs.mapInArrow(labelled, "bucket bigint").groupBy("bucket").agg(
        F.count("*").alias("texts")).where("texts > 1"))
    table = _bit_table(shared.select("bucket"), bits)
    tokens = seqs.mapInArrow(lambda batches: labelled(batches, table), "bucket bigint, key binary, n int, size int, rarest int")
    own = Window.partitionBy("key", "size", "rarest")
    ranked = tokens.join(shared, "bucket").withColumn("alone", F.col("size") - F.count("*").over(own)).withColumn(
        "place", F.col("alone") + F.row_number().over(own.orderBy("texts", "bucket")))
    rarest = reliable_checkpoint(ranked.where("place <= rarest").select("bucket", "key", "n"))
    table.destroy()
    return rarest


def _in_buckets(vectors: DataFrame, table) -> DataFrame:
    """bucket, key, n: the sketches that the table names."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            row = np.repeat(np.arange(batch.num_rows), np.diff(v.offsets.to_numpy()))
            out = pa.RecordBatch.from_arrays([v.flatten(), batch.column("key").take(pa.array(row)), batch.column("n").take(pa.array(row))],
                                             names=["bucket", "key", "n"])
            yield out.filter(_named(table.value, out.column("bucket")))

    return vectors.mapInArrow(run, "bucket bigint, key binary, n int")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    split = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    return members.join(split, "bucket", "left_semi")


def _cell(n: str) -> Column:
    """Length cell: texts that can be alike are of one cell or of neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(1 / SIMILARITY)))


def _with_leaders(members: DataFrame, first: int, most: int, order: list, similarity: float) -> DataFrame:
    """a, b, member (the one of them that does not lead): members of other components with the leaders of their bucket,
    in places first + 1 to first + most of each length cell."""
    place = F.row_number().over(Window.partitionBy("bucket", _cell("n")).orderBy(*order))
    top = (members.withColumn("place", place).where(F.col("place").between(first + 1, first + most))
           .select("bucket", F.col("key").alias("lead"), F.col("n").alias("lead_n"), F.col("root").alias("lead_root")))
    return (members.join(top, "bucket").where("root <> lead_root")
            .where(F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n") - 1e-9)
            .groupBy(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).agg(F.min("key").alias("member")))


def links(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, count: int = SKETCHES, pick: int = PICK,
          leaders: int = LEADERS, bits: int = FILTER_BITS) -> DataFrame:
    """a, b: keys of linked pairs of different texts."""
    return _linked(docs, text_col, similarity, count, pick, leaders, bits)[0]


def _linked(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, count: int = SKETCHES, pick: int = PICK,
            leaders: int = LEADERS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) and their components (node, root)."""
    release(docs.sparkSession)
    texts = bounded_batches(docs).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vectors = reliable_checkpoint(sketch_rows(texts, count, pick).dropDuplicates(["key"]))
    rows = vectors.select(F.explode("v").alias("bucket"))
    sizes = reliable_checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    table = _bit_table(sizes.select("bucket"), bits)
    members = reliable_checkpoint(_in_buckets(vectors, table).join(sizes, "bucket").withColumn("root", F.col("key")))
    table.destroy()
    central = members.groupBy("key").agg(F.sum("size").alias("central"))
    release(texts.sparkSession)
    pairs = reliable_checkpoint(_with_leaders(members.join(central, "key"), 0, leaders, [F.desc("central"), "key"], similarity))
    del vectors, rows, sizes, central  # so that their files can go
    release(texts.sparkSession)
    seqs = _sequences(texts, members.select("key"), bits)
    release(texts.sparkSession)
    linked = reliable_checkpoint(_aligned(seqs, pairs, similarity))
    compared, found = pairs, linked
    release(texts.sparkSession)
    stars = components(linked, "a", "b")
    release(texts.sparkSession)
    # texts of buckets that still hold several components meet under their rarest shingles
    rest = _open_buckets(_rooted(members.drop("root"), stars)).select("key").distinct()
    refined = _rarest(seqs.join(rest, "key", "left_semi"), similarity, bits)
    release(texts.sparkSession)
    first, most = 0, 16 * leaders  # the buckets are small by now: few rounds
    while True:
        members = reliable_checkpoint(_open_buckets(_rooted(refined, stars)))
        widest = members.groupBy("bucket", _cell("n")).count().agg(F.max("count")).first()[0] or 0
        if first >= widest:
            break
        fresh_pairs = _with_leaders(members, first, most, [F.xxhash64("key", "bucket"), "key"], similarity)
        fresh_pairs = reliable_checkpoint(fresh_pairs.join(compared, ["a", "b"], "left_anti"))
        linked = reliable_checkpoint(_aligned(seqs, fresh_pairs, similarity))
        if not linked.isEmpty():
            found = found.unionByName(linked)
            stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked), "a", "b")
        compared = compared.unionByName(fresh_pairs)
        first, most = first + most, 2 * most
        release(texts.sparkSession)
    return found, stars


def _rooted(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Members with the root of their component, themselves if they have no link."""
    return members.join(stars.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _bit_table(values: DataFrame, bits: int):
    """A broadcast table of ``bits`` bits that names the values of a bigint column; a bit set by chance only costs work."""
    h = F.pmod(F.col(values.columns[0]), F.lit(bits))
    hashed = (values.select(h.alias("h")).groupBy(F.expr("shiftright(h, 6)").alias("w"))
              .agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("v")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[hashed.column("w").to_numpy()] = hashed.column("v").to_numpy()
    return values.sparkSession.sparkContext.broadcast(table)


def _named(table: np.ndarray, values: pa.Array) -> pa.Array:
    h = np.mod(values.to_numpy(), np.int64(64 * len(table)))
    return pa.array((table[h >> 6] >> (h & 63)) & 1 == 1)


def _sequences(texts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """key, seq: the shingle sequences of the wanted texts (and of a few that the table of bits lets pass by chance)."""
    known = _bit_table(wanted.select(F.xxhash64("key")), bits)

    def tokens(batches):
        seen: set = set()
        for batch in batches:
            for keys, sh, soff in _new_texts([batch.filter(_named(known.value, batch.column("h")))], seen):
                low = (sh & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(
                    pa.array(soff.astype(np.int32)), pa.array(low))], names=["key", "seq"])

    seqs = texts.select("text", F.xxhash64(text_key("text")).alias("h")).mapInArrow(tokens, "key binary, seq array<int>")
    seqs = reliable_checkpoint(seqs.dropDuplicates(["key"]))
    known.destroy()
    return seqs


def _aligned(seqs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts, by key, that are alike.

    Pairs are dealt by the member that is not the leader, ``BLOCK`` members a group on average; a leader's sequence
    goes to each group once, not to each of its partners."""
    texts = pairs.select("member").distinct().count()
    blocks = max(1, -(-texts // BLOCK))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("member"), F.lit(blocks)))
    needed = dealt.select("block", F.col("member").alias("key")).unionByName(
        dealt.select("block", F.when(F.col("member") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("key"))).distinct()

    def align(held: pa.Table, asked: pa.Table) -> pa.Table:
        at = {k: i for i, k in enumerate(held.column("key").to_pylist())}
        seq = held.column("seq").combine_chunks()
        ok = [alike(seq[at[a]].values.to_numpy(), seq[at[b]].values.to_numpy(), similarity)
              for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)]
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = needed.withColumnRenamed("block", "part").join(seqs, "key")
    return held.groupBy("part").cogroup(dealt.groupBy("block")).applyInArrow(align, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """key, class_id (least id of the equal texts), copies, group_key, group_id (least id of the group)."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"))
    alone = own.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    _, roots = _linked(docs, text_col, **options)
    joined = alone.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = reliable_checkpoint(joined)
    heads = joined.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count("*").alias("texts"))
    return joined.join(heads, "root").select("key", "class_id", "copies", F.col("root").alias("group_key"), "group_id", "texts")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, group_id, n_texts (different texts of the group) of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"))
    return own.join(classes(docs, id_col, text_col, **options), "key").select(
        "doc_id", "class_id", "group_id", F.col("texts").alias("n_texts"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that of the least id, with all columns unchanged."""
    known = reliable_checkpoint(classes(docs, id_col, text_col, **options))
    key, head, least = fresh(docs, "key", "head", "least")
    # the class of the least id (null after all others), the first by key if ids repeat over texts
    heads = known.groupBy("group_key").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "key")).alias("h")).select(
        F.col("h.key").alias(head), F.col("h.class_id").alias(least))
    own = docs.withColumn(key, text_key(F.col(f"`{text_col}`")))
    kept = own.join(heads, (F.col(key) == F.col(head)) & F.col(f"`{id_col}`").eqNullSafe(F.col(least)), "left_semi")
    if (known.agg(F.max("copies")).first()[0] or 0) > 1:
        kept = kept.dropDuplicates([key])  # rows of one id and text
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
