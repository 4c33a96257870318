"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

Lines become ids, documents sequences of ids. Suffixes are ranked by their first line, then by their
first 2, 4, 8, ... lines: the rank of 2k lines is the place of the pair (rank of k lines here, rank of
k lines k further on) in sorted order. Suffixes of one rank are an interval of the suffix array with
a common prefix of at least that length; an interval of one suffix is dropped, as it repeats
nothing. The array is refined as far as a run of the wanted size can reach.

A run of repeated lines counts from `min_words` words on. Every line of such a run lies in a
shortest window of `min_words` that starts at it or ends at the run's end, so those windows are looked up:
two overlapping power-of-two ranks name a window of any length. Of the windows of one interval the
first stays and the others are deleted; together they are the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import number_rows
from ..session import cut_lineage
from .common import SPACES

_BLANK = f"^[{SPACES}]*$"
#: Bits of the filter over documents that lose lines: at most 512 bitmaps of 4 KB, whatever it holds.
FILTER_BITS = 1 << 24


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, key, seq, at, a, b, words): the lines with a word, numbered, with their place among all."""
    lines = F.transform(F.split(F.coalesce(docs[text], F.lit("")), "\n"), lambda line, i: F.struct(
        i.alias("at"), F.trim(line).alias("line")))
    rows = docs.select(
        F.xxhash64(docs[key], docs[text]).alias("doc"), docs[key].alias("key"),
        F.filter(lines, lambda x: ~x["line"].rlike(_BLANK)).alias("lines"))
    rows = rows.select("doc", "key", F.posexplode("lines").alias("seq", "x"))
    return rows.select(
        "doc", "key", "seq", F.col("x.at").alias("at"), F.xxhash64("x.line").alias("a"),
        F.xxhash64(F.lit("line"), "x.line").alias("b"),
        F.regexp_count("x.line", F.lit(f"[^{SPACES}]+")).alias("words"))


def _ranked(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """The pairs that occur twice or more, with `rank`, their place in sorted order."""
    repeated = cut_lineage(pairs.groupBy(first, second).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    ranks = cut_lineage(number_rows(repeated, [first, second], "rank"))
    return pairs.join(ranks, [first, second]).drop(first, second)


def _doubled(ranks: DataFrame, width: int) -> DataFrame:
    """Ranks of twice as many lines."""
    further = ranks.select("doc", (F.col("seq") - width).alias("seq"), F.col("rank").alias("then"))
    return _ranked(ranks.select("doc", "seq", F.col("rank").alias("now")).join(
        further, ["doc", "seq"]), "now", "then")


def _islands(repeated: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines whose run of neighbours has `min_words` words; no window lies elsewhere."""
    in_doc = Window.partitionBy("doc").orderBy("seq")
    rows = repeated.withColumn("island", F.col("seq") - F.row_number().over(in_doc))
    whole = F.sum("words").over(Window.partitionBy("doc", "island"))
    return rows.withColumn("island_words", whole).where(F.col("island_words") >= min_words).drop("island_words")


def repeated_windows(active: DataFrame, min_words: int) -> DataFrame:
    """(doc, key, seq, length): shortest windows of `min_words` words, of neighbouring active lines."""
    upto = F.sum("words").over(Window.partitionBy("doc", "island").orderBy("seq"))
    rows = active.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy("doc", "island").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc", "island").orderBy("upto").rangeBetween(1 - min_words, 0)
    rows = rows.select("doc", "key", "seq", *[f(c).over(w).alias(n) for f, c, w, n in (
        (F.count, "words", ahead, "n"), (F.sum, "words", ahead, "n_words"),
        (F.count, "words", back, "m"), (F.sum, "words", back, "m_words"))])
    forward = F.struct("seq", F.col("n").alias("length"))
    backward = F.struct((F.col("seq") - F.col("m") + 1).alias("seq"), F.col("m").alias("length"))
    found = F.array_compact(F.array(
        F.when(F.col("n_words") >= min_words, forward), F.when(F.col("m_words") >= min_words, backward)))
    return rows.select("doc", "key", F.explode(found).alias("w")).select(
        "doc", "key", "w.seq", "w.length").distinct()


def later_copies(docs: DataFrame, min_words: int = 25, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc, at): the lines that are later copies.

    A window has at most `min_words` lines, so that the doubling ends. Each round goes on with the
    suffixes inside longer windows only; equal windows have equal lengths, so all their copies go on."""
    # a repeated row only lends its lines one count more than they have; single windows go at the end
    ranked = _ranked(_sequences(docs, key, text), "a", "b").dropDuplicates(["doc", "seq"])
    active = cut_lineage(_islands(ranked, min_words))
    windows = cut_lineage(repeated_windows(active, min_words))
    longest = windows.agg(F.max("length")).first()[0] or 0
    ranks, width, named = active.select("doc", "seq", "rank"), 1, None
    while width <= longest:
        here = windows.where((F.col("length") >= width) & (F.col("length") < 2 * width))
        start = ranks.withColumnRenamed("rank", "first_rank")
        end = ranks.withColumnRenamed("seq", "last").withColumnRenamed("rank", "last_rank")
        found = here.join(start, ["doc", "seq"]).withColumn(
            "last", (F.col("seq") + F.col("length") - width).cast("int")).join(end, ["doc", "last"]).drop("last")
        named = found if named is None else named.unionByName(found)
        if 2 * width <= longest:
            longer = windows.where(F.col("length") >= 2 * width).select("doc", F.explode(F.sequence(
                F.col("seq"), (F.col("seq") + F.col("length") - width).cast("int"))).alias("seq")).distinct()
            ranks = cut_lineage(_doubled(ranks.join(longer, ["doc", "seq"]), width))
        width *= 2
    if named is None:
        return active.select("doc", "at").limit(0)
    # the order of copies: key (null last), document, place
    named = cut_lineage(named.withColumn(
        "order", F.struct(F.col("key").isNull(), "key", "doc", "seq")).drop("key"))
    name = ["length", "first_rank", "last_rank"]
    firsts = named.groupBy(*name).agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    later = named.join(firsts.drop("k"), name).where(F.col("order") != F.col("first"))
    covered = later.select("doc", F.explode(F.sequence(
        F.col("seq"), (F.col("seq") + F.col("length") - 1).cast("int"))).alias("seq")).distinct()
    return covered.join(active.select("doc", "seq", "at"), ["doc", "seq"]).select("doc", "at")


def _may_be_in(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with `_maybe`: false only where `_doc` is not among `_deleted_of`."""
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS)) + 1
    bitmaps = found.groupBy(F.bitmap_bucket_number(place("_deleted_of")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("_deleted_of"))).alias("_bits"))
    bit = F.bitmap_bit_position(place("_doc"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_bucket", F.bitmap_bucket_number(place("_doc"))).join(
        F.broadcast(bitmaps), "_bucket", "left").withColumn(               # 2 MB at most
        "_maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def dedup_lines(docs: DataFrame, min_words: int = 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, the text without later copies of repeated line runs, and `n_lines`,
    `n_deleted` (lines with a word).

    Lines are compared without spaces around them; lines without a word are neither compared nor
    deleted. The first copy in the order of the key (null last) and of the lines stays. Null and
    empty texts stay as they are. Rows that repeat key and text are one document, so they keep the
    same lines. Columns named n_lines or n_deleted are replaced. An empty table gives an empty table."""
    gone = later_copies(docs, min_words, key, text)
    deleted = cut_lineage(gone.groupBy(F.col("doc").alias("_deleted_of")).agg(
        F.collect_set("at").alias("_gone")))                           # of one document
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    n_lines = F.size(F.filter(parts, lambda line: ~line.rlike(_BLANK)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    columns = [c for c in docs.columns if c not in (text, "n_lines", "n_deleted")]
    # only texts that may lose lines are shuffled
    rows = _may_be_in(docs.withColumn("_doc", F.xxhash64(docs[key], docs[text])), deleted)
    touched = rows.where("_maybe").join(deleted, F.col("_doc") == F.col("_deleted_of"), "left")
    whole = rows.where(~F.col("_maybe")).withColumn("_gone", F.lit(None).cast("array<int>"))
    out = lambda found: found.select(
        *columns, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest).alias(text),
        n_lines.alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_deleted"))
    return out(touched).union(out(whole))
