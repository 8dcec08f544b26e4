"""Line dedup with a log-template tree, in DataFrame functions only.

A line is parsed at fixed depth: its number of tokens, then its leading ``DEPTH``
tokens, lead to a leaf. Tokens with a digit are variable from the start. Inside a leaf
that occurs in enough documents, a token is a constant of its place if enough lines of
the leaf hold it there, and variable (``<*>``) otherwise; constants and wildcards make
the line's template. A template with enough constants that recurs across ``MIN_DOCS``
different texts is boilerplate, and its lines are dropped from every document.

A long line needs less evidence: the chance that two texts share ``LONG`` words at the same
places is nil. Lines of ``LONG`` tokens or more are parsed a second time to ``LONG_DEPTH``
leading tokens, so that leaves stay small at every size of the corpus; a token that two lines
of such a leaf hold is a constant, and a template with ``LONG`` constants or more is dropped
from ``LONG_DOCS`` different texts on. Shorter lines keep the count of ``MIN_DOCS``.

Equal texts count once, so copies of a document do not make its lines boilerplate, and
decisions are joined back by the hash of the text, whatever the input's order.

Scale: leaves are counted by (leaf, text) pairs with partial aggregation; of the lines of
recurring leaves, equal ones count as one shape, and only leaves of several shapes are
opened into tokens. Recurring leaves are broadcast when they are
at most ``BROADCAST_ROWS`` (16 bytes each), and joined by shuffle beyond. A leaf or a
token that holds a third of all lines is split by the map-side sums; no group is
collected except the dropped line numbers of one text.

Defined results: null text has no lines and stays null; blank lines are never
dropped; an empty text is one blank line; a line is trimmed for comparison but kept as
it is; a document whose lines all go stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import fresh
from rowscope.session import reliable_checkpoint

DEPTH = 3
MIN_DOCS = 10
CONSTANTS = 0.6
LONG = 10
LONG_DEPTH = 6
LONG_DOCS = 2
BROADCAST_ROWS = 1 << 20
_VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _lines(docs: DataFrame) -> DataFrame:
    """key, pos, plain and n of every line that is not empty; n is the number of tokens, the pieces of plain between its spaces. Lines with
    other white space than single spaces, and lines with a digit, are rare: only they go through a regular expression, and only the
    lines of texts that hold such a place at all are looked at."""
    line, some = F.col("line"), F.col("text").rlike("[0-9\t\x0B\f\r]") | F.col("text").contains("  ")
    odd = F.lit(False)
    for space in ("  ", "\t", "\x0B", "\f", "\r"):
        odd = odd | line.contains(space)
    odd = F.col("some") & odd
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")).otherwise(line))
    masked = F.when(F.col("some") & line.rlike("[0-9]"), F.regexp_replace(plain, _VARIABLE, "<*>")).otherwise(plain)
    # what is asked of a text stands below the generator: beside it, it would be computed for every line
    return (docs.select(_key("text").alias("key"), some.alias("some"), "text")
            .select("key", "some", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .where(F.octet_length(F.trim("line")) > 0)
            .select("key", "pos", masked.alias("plain"))
            .withColumn("n", F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1))


def _leaves(lines: DataFrame, depth: int, min_docs: int, long: int, long_depth: int, long_docs: int) -> DataFrame:
    """The lines with their leaf and the number of texts it asks for; a long line has a leaf of each kind."""
    def leaf(kind: int, at: int, need: int) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), "n", F.substring_index("plain", " ", at)).alias("leaf"), F.lit(need).alias("need"))

    kinds = F.when(F.col("n") >= long, F.array(leaf(0, depth, min_docs), leaf(1, long_depth, long_docs))).otherwise(
        F.array(leaf(0, depth, min_docs)))
    return lines.select("key", "pos", "plain", "n", F.inline(kinds).alias("leaf", "need"))


def dropped_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
                  constants: float = CONSTANTS, long: int = LONG, long_depth: int = LONG_DEPTH,
                  long_docs: int = LONG_DOCS) -> DataFrame:
    """key (hash of the text) and pos (line number from 0) of every line to drop; a line may come twice."""
    lines = _leaves(_lines(docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")),
                    depth, min_docs, long, long_depth, long_docs)
    seen = lines.select("leaf", "need", "key").distinct().groupBy("leaf", "need").agg(F.count("*").alias("docs"))
    leaves = reliable_checkpoint(seen.where("docs >= need").select("leaf"))
    small = leaves.count() <= BROADCAST_ROWS
    word = "tok not in ('<*>', '')"
    # tokens are taken apart only where some are not words; a line of other white space alone has one, the empty one
    words = F.when(F.col("plain").contains("<*>") | (F.col("plain") == ""), F.size(F.filter(
        F.split("plain", " "), lambda t: ~t.isin("<*>", "")))).otherwise(F.col("n"))
    own = reliable_checkpoint(
        lines.join(F.broadcast(leaves) if small else leaves, "leaf", "left_semi")
        .select("key", "pos", "leaf", "need", F.xxhash64("plain").alias("shape"), "n", words.alias("words"), "plain"))
    # equal lines of a leaf are one shape with a count
    sites = own.select("key", "pos", "leaf", "need", "shape", "n", "words").distinct()
    shapes = reliable_checkpoint(sites.groupBy("leaf", "need", "shape", "n", "words").agg(F.count("*").alias("c")))
    mixed = reliable_checkpoint(shapes.groupBy("leaf").agg(F.min("shape").alias("a"), F.max("shape").alias("b"))
                                .where("a != b").select("leaf"))

    def enough(fixed: str) -> Column:
        return (F.col(fixed) >= constants * F.col("n")) & ((F.col("need") == min_docs) | (F.col(fixed) >= long))

    # a leaf of one shape: every word is a constant
    alone = shapes.where(enough("words")).join(mixed, "leaf", "left_anti").select("leaf", "shape", F.col("shape").alias("template"))
    # other leaves are opened: a shape's template is the sum of the hashes of its constants and places, in any order
    opened = (own.join(F.broadcast(mixed) if small else mixed, "leaf", "left_semi").groupBy("leaf", "shape").agg(F.first("plain").alias("plain"))
              .join(shapes.select("leaf", "shape", "need", "n", "c"), ["leaf", "shape"])
              .select("leaf", "shape", "need", "n", "c", F.posexplode(F.split("plain", " ")).alias("at", "tok")).where(word)
              .select("leaf", "shape", "need", "n", "c", F.xxhash64("at", "tok").alias("mark")))
    held = opened.groupBy("leaf", "mark").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("leaf", "mark")
    general = (opened.join(held, ["leaf", "mark"], "left_semi").groupBy("leaf", "shape", "need", "n")
               .agg(F.count("*").alias("fixed"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("sum"))
               .where(enough("fixed")).select("leaf", "shape", F.xxhash64("leaf", "fixed", F.col("sum").cast("string")).alias("template")))
    template = reliable_checkpoint(alone.unionByName(general))
    placed = sites.join(template, ["leaf", "shape"]).select("key", "pos", "leaf", "need", "template")
    recurring = (placed.select("leaf", "template", "need", "key").distinct().groupBy("leaf", "template", "need")
                 .agg(F.count("*").alias("docs")).where("docs >= need").select("leaf", "template"))
    return placed.join(recurring, ["leaf", "template"], "left_semi").select("key", "pos")


def cleaned(docs: DataFrame, text_col: str = "text", **options) -> tuple[DataFrame, str, str]:
    """All columns of the documents with ``text_col`` cleaned, and the names of two new columns: the
    number of lines and of dropped lines."""
    key, drop, n_lines, n_dropped = fresh(docs, "key", "drop", "n_lines", "n_dropped")
    drops = dropped_lines(docs, text_col, **options).groupBy(F.col("key").alias(key)).agg(F.collect_set("pos").alias(drop))
    text = F.col(f"`{text_col}`").cast("string")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    out = docs.withColumn(key, F.unhex(F.md5(text.cast("binary")))).join(drops, key, "left")
    return out.select(
        *[F.when(F.col(drop).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")
          for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias(n_lines),
        F.coalesce(F.size(drop), F.lit(0)).alias(n_dropped)), n_lines, n_dropped


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars and the hash of the kept text of every document."""
    own, n_lines, n_dropped = cleaned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **options)
    return own.select(
        "doc_id", F.col(n_lines).cast("bigint").alias("n_lines"), F.greatest(F.col(n_dropped), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The documents with recurring lines removed; ``chars_col``, if present, follows the new text."""
    own, _, n_dropped = cleaned(docs, text_col, **options)
    if chars_col in docs.columns:
        own = own.withColumn(chars_col, F.when(F.col(n_dropped) > 0, F.length(text_col).cast(
            docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])
