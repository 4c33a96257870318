"""Exact n-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

Sets of word shingles are ordered by shingle hash. Two sets of the wanted similarity share at least k
shingles in their first n - o + k, where o is the least overlap that a set of n shingles needs. Small
sets list all pairs (k = 2) of that prefix, so only small sets that share a pair meet; large sets, and
small ones near them in size, put single shingles (k = 1) in inverted lists that are scanned. The
boundary is where the counted rows of both ways cost least.

Equal sets are one node. Shingles are ordered from the rarest on, by counts over all documents in a
table of fixed size: any order that depends on the shingle alone gives whole results, and this one keeps
passages that unrelated texts share out of most prefixes. Short lists, which most are, become pairs where
they are found. Of long ones, families of near copies are joined first, through a few leaders of each list;
then lists are scanned for what is in different components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .common import Membership, as_text, blocks, encoded, mixed, rows_at_once

WIDTH = 5
#: Similarity 100 * overlap >= 75 * union.
PERCENT = 75
#: The boundary is sought up to this size.
SMALL = 64
#: Shingles are counted in so many buckets, in so many rows: a fixed size, whatever the corpus.
COUNT_BITS = 20
CHUNKS = 16
#: Lists of up to so many sets become pairs at once.
SHORT = 4
#: Texts that a task gets at once.
TEXTS = 1000
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: The first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many each has: eight bytes of every word at a time."""
    whole = b" ".join(texts) + b" " * 9
    inside = ~_BLANK[np.frombuffer(whole, np.uint8)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))    # from every place on
    out = mixed(lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i]:starts[i] + lengths[i]])
    some, at = np.flatnonzero(lengths <= _LONG), 0
    while len(some):
        left = lengths[some] - at
        out[some] = mixed(out[some] ^ (eight[starts[some] + at] & _FIRST[np.minimum(left, 8)]))
        some, at = some[left > 8], at + 8
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, begins))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text of a block."""
    lower = [encoded(t).lower() for t in texts]                   # of bytes, so A-Z only
    hashed, sizes = word_hashes(lower)
    n = max(len(hashed) - WIDTH + 1, 0)
    windows = np.full(n, np.uint64(WIDTH))
    with np.errstate(over="ignore"):
        for i in range(WIDTH):
            windows = (windows + hashed[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            windows ^= windows >> np.uint64(32)
    windows = mixed(windows)
    out, start = [], 0
    for text, size in zip(lower, sizes.tolist(), strict=True):
        if size >= WIDTH:
            out.append(np.unique(windows[start:start + size - WIDTH + 1]))
        elif size:
            whole = hashlib.blake2b(b" ".join(text.split()), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        start += size
    return out


def least_overlap(n: np.ndarray | int):
    return -(-PERCENT * n // 100)


def prefix(n):
    """How many first shingles hold one of every sufficient overlap."""
    return n - least_overlap(n) + 1


def survey(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, print) of every row's set, and counts of shingles: rows with `chunk`, `part` and `counts`.

    Each task counts its shingles in an array of fixed size, which comes out as rows of the same table."""
    def make(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for part in blocks(list(batch["_text"]), 1_000_000):
                sets = shingle_sets(list(batch["_text"].iloc[part]))
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
                yield pd.DataFrame({
                    "id": batch["_key"].iloc[part].array, "n": [len(s) for s in sets],
                    "print": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                    "chunk": -1, "part": -1, "counts": None})
        if counts.any():
            number = TaskContext.get().partitionId()
            yield pd.DataFrame({"id": None, "n": 0, "print": None, "chunk": range(CHUNKS), "part": number,
                                "counts": [c.astype(np.int64).tobytes() for c in np.split(counts, CHUNKS)]})

    return _keyed(docs, key, text).mapInPandas(
        make, "id string, n long, print binary, chunk int, part int, counts binary").withColumn(
        "id", F.col("id").cast("long"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(as_text(docs[key].cast("long")).alias("_key"), docs[text].alias("_text"))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def rarity_levels(counts: DataFrame, width: int = 64) -> np.ndarray:
    """A level for every bucket of shingles, the higher the more its count stands out.

    Counts of tasks are added `width` at a time in a tree, so that no task holds those of all."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return group[["chunk", "part"]].iloc[:1].assign(counts=[total.tobytes()])

    parts = counts.agg(F.max("part")).first()[0]
    while parts:
        counts = cut_lineage(counts.withColumn("part", F.floor(F.col("part") / width).cast("int")).groupBy(
            "chunk", "part").applyInPandas(add, "chunk int, part int, counts binary"))
        parts //= width
    chunks = {r["chunk"]: np.frombuffer(r["counts"], np.int64) for r in counts.collect()}
    if not chunks:
        return np.zeros(1 << COUNT_BITS, np.uint8)
    total = np.concatenate([chunks[i] for i in range(CHUNKS)])
    usual = float(np.median(total))
    above = np.maximum(total - usual, 0) / (3 * np.sqrt(usual) + 2)
    return np.minimum(np.ceil(2 * np.log2(np.maximum(above, 1))), 255).astype(np.uint8)


def _heads(docs: DataFrame, key: str, text: str, levels: np.ndarray) -> DataFrame:
    """(id, n, print, head, ends): of every row's set the shingles of its prefix and one more, rare ones
    first, and where in the order of all shingles the prefix ends, to 31 bits."""
    def ending(grams: np.ndarray) -> int:
        return int(levels[_bucket(grams)][0]) << 23 | int(grams[0] >> np.uint64(41)) if len(grams) else 0

    def make(batches):
        for batch in batches:
            for part in blocks(list(batch["_text"]), 1_000_000):
                sets = shingle_sets(list(batch["_text"].iloc[part]))
                heads = [s[np.argsort(levels[_bucket(s)], kind="stable")[:prefix(len(s)) + 1]] for s in sets]
                yield pd.DataFrame({
                    "id": batch["_key"].iloc[part].array, "n": [len(s) for s in sets],
                    "print": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                    "head": [h.view(np.int64) for h in heads],
                    "ends": [ending(h[:prefix(len(s))][-1:]) for h, s in zip(heads, sets, strict=True)]})

    return _keyed(docs, key, text).mapInPandas(
        make, "id string, n long, print binary, head array<long>, ends int").withColumn("id", F.col("id").cast("long"))


def choose_boundary(sets: DataFrame, scan_cost: float = 2.0) -> int:
    """The size up to which pairs of shingles are listed, by the rows that either way costs.

    Sizes of all sets are counted; only those up to SMALL can change sides."""
    counts = {r["n"]: r["count"] for r in
              sets.where(F.col("n").between(3, SMALL)).groupBy("n").count().collect()}

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in counts.items():
            p = prefix(n)
            if n <= boundary:
                total += count * p * (p + 1) / 2
            if 100 * n >= PERCENT * (boundary + 1):
                total += count * p * scan_cost
        return total

    return min(range(2, SMALL + 1), key=lambda b: (cost(b), b))


def _postings(sets: DataFrame, boundary: int) -> DataFrame:
    """(gram, small, id, pos, n, ends): pairs of shingles of small sets, single shingles of the others."""
    def make(batches):
        for batch in batches:
            out, held = [], 0
            for key, n, head, ends in zip(batch["id"], batch["n"], batch["head"], batch["ends"], strict=True):
                head = np.asarray(head, np.int64).view(np.uint64)
                if n < 3:
                    continue                       # only equal sets reach the similarity
                if n <= boundary:
                    i, j = np.triu_indices(len(head), 1)      # places in the one order, i before j
                    with np.errstate(over="ignore"):
                        pairs = mixed(head[i] * np.uint64(3) + mixed(head[j]))
                    out.append((pairs, True, key, n, ends))
                if 100 * n >= PERCENT * (boundary + 1):
                    out.append((head[:prefix(n)], False, key, n, ends))
                held += len(head) if n > boundary else len(head) ** 2
                if held > 200_000:
                    yield _frame(out)
                    out, held = [], 0
            if out:
                yield _frame(out)

    return sets.select("id", "n", "head", "ends").mapInPandas(
        make, "gram long, small boolean, id long, pos int, n int, ends int")


def _frame(lists: list[tuple]) -> pd.DataFrame:
    sizes = [len(values) for values, *_ in lists]
    column = lambda i, kind: np.repeat(np.array([x[i] for x in lists], kind), sizes)
    return pd.DataFrame({
        "gram": np.concatenate([x[0] for x in lists]).view(np.int64), "small": column(1, bool),
        "id": column(2, np.int64), "n": column(3, np.int32), "ends": column(4, np.int32),
        "pos": np.concatenate([np.full(k, -1) if x[1] else np.arange(k)
                               for x, k in zip(lists, sizes, strict=True)]).astype(np.int32)})


def _verified(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Of (a, b), those whose whole sets are similar enough. Sets are made again for those ids only."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = Membership.over(ids, "id")

    def make(batches):
        for batch in batches:
            known = batch["_key"].notna()
            some = known.to_numpy()
            some[some] = wanted.has(batch["_key"][known].astype(np.int64).to_numpy().view(np.uint64))
            batch = batch[some]
            for part in blocks(list(batch["_text"]), 1_000_000):
                sets = shingle_sets(list(batch["_text"].iloc[part]))
                yield pd.DataFrame({"id": batch["_key"].iloc[part].array,
                                    "grams": [s.view(np.int64) for s in sets]})

    rows = docs.select(as_text(docs[key].cast("long")).alias("_key"), docs[text].alias("_text"))
    whole = cut_lineage(rows.mapInPandas(make, "id string, grams array<long>").withColumn(
        "id", F.col("id").cast("long")))
    both = (pairs.join(whole.select(F.col("id").alias("a"), F.col("grams").alias("left")), "a")
            .join(whole.select(F.col("id").alias("b"), F.col("grams").alias("right")), "b"))
    overlap = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - overlap
    return both.where(100 * overlap >= PERCENT * union).select("a", "b").distinct()


def _possible(common: Column) -> Column:
    """Whether sets of n and m shingles that have so many in common in their prefixes can reach the
    similarity: of the set whose prefix ends first, only what follows it can be shared besides, and of
    both only what follows the last shared place."""
    p = lambda size: size - F.ceil(size * PERCENT / 100) + 1
    rest = F.greatest(F.col("n") - p(F.col("n")), F.col("m") - p(F.col("m")))
    rest = F.when(F.col("small"), rest - 1).otherwise(
        F.least(rest, F.col("n") - F.col("last") - 1, F.col("m") - F.col("other_last") - 1))
    return (common + rest) * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("m"))


def _counted(met: DataFrame) -> DataFrame:
    """Distinct (a, b) of (small, x, x_n, x_pos, y, y_n, y_pos) that share enough of their prefixes.

    Shared shingles are counted by pair; of small sets, the pairs of shingles that are shared give the
    number of shared shingles."""
    # a pair meets as (x, y) in one list and as (y, x) in another, where the main component differs
    first = F.col("x") < F.col("y")
    either = lambda c, d, name: F.when(first, F.col(c)).otherwise(F.col(d)).alias(name)
    counted = met.select(
        "small", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        either("x_n", "y_n", "n"), either("y_n", "x_n", "m"),
        either("x_pos", "y_pos", "pos"), either("y_pos", "x_pos", "other_pos")).groupBy(
        "a", "b", "n", "m", "small").agg(
        F.count(F.lit(1)).alias("k"), F.max("pos").alias("last"), F.max("other_pos").alias("other_last"))
    k = F.col("k")
    common = F.when(F.col("small"), F.ceil((1 + F.sqrt(1 + 8 * k)) / 2)).otherwise(k)
    return counted.where(_possible(common)).select("a", "b").distinct()


def _held(postings: DataFrame) -> DataFrame:
    """Lists of more than one set. Long ones are rows (gram, small, id, pos, n, ends) without y; of short ones each
    row (small, id, pos, n, y, y_pos, y_n) is a pair, and `own` tells how many of id and y are here for the first
    time of their list."""
    order = Window.partitionBy("gram", "small").orderBy("n", "id")
    rows = postings.withColumns({"before": F.lag("id").over(order), "after": F.lead("id").over(order)}).where(
        F.col("before").isNotNull() | F.col("after").isNotNull()).drop("before", "after")
    other = F.struct(F.col("id").alias("y"), F.col("pos").alias("y_pos"), F.col("n").alias("y_n"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "size": F.count(F.lit(1)).over(whole), "place": F.row_number().over(order),
        **{f"lag{j}": F.lag(other, j).over(order) for j in range(1, SHORT)}})
    long = F.col("size") > SHORT
    lags = F.array(*(f"lag{j}" for j in range(1, SHORT)))
    met = F.when(long, F.array(F.lit(None).cast(rows.schema["lag1"].dataType))).otherwise(
        F.filter(lags, lambda other: other.isNotNull()))
    return rows.select(
        F.when(long, F.col("gram")).alias("gram"), "small", "id", "pos", "n", F.when(long, F.col("ends")).alias("ends"),
        "place", F.posexplode(met).alias("lag", "other")).select(
        "gram", "small", "id", "pos", "n", "ends", "other.*",
        F.when(F.col("lag") > 0, 0).when(F.col("place") == 2, 2).otherwise(1).alias("own"))


def _alike(boundary: int) -> Column:
    """Whether the sizes of x and y allow the similarity, and are of this kind of list."""
    larger = F.greatest("x_n", "y_n")
    return (F.least("x_n", "y_n") * 100 >= larger * PERCENT) & (F.col("small") | (larger > boundary))


def _pairs_across(rows: DataFrame, short: DataFrame, families: DataFrame, boundary: int) -> DataFrame:
    """Distinct (a, b) in different components that share enough of their prefixes.

    Rows are those of `_open_lists`, `short` the pairs of short lists. Sets meet in classes of size, of which two similar ones are the same
    or neighbours. Rows of a list's main (largest) component do not meet one another. Whatever two sets
    of different components share of the prefix that ends first is in open or short lists, so `reach`, that part
    and what follows the prefix, bounds their overlap before a row is made."""
    single = short.where(~F.col("small"))
    shared = rows.where(~F.col("small")).select("id").unionAll(single.where("own > 0").select("id")).unionAll(
        single.where("own = 2").select("y")).groupBy("id").agg(F.count(F.lit(1)).alias("_open"))
    after = F.ceil(F.col("n") * PERCENT / 100) - 1          # shingles behind the prefix
    rows = rows.join(shared, "id", "left").withColumn("reach", F.col("_open") + after).drop("_open")
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    side = lambda s: [F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in (
        "n", "pos", "component", "ends", "reach"))]
    left = rows.where(~F.col("main")).select(
        "gram", "small", *side("x"), F.explode(F.array(size_class - 1, size_class, size_class + 1)).alias("class"))
    right = rows.select("gram", "small", *side("y"), "main", size_class.alias("class"))
    meet = left.join(right, ["gram", "small", "class"])
    once = F.col("main") | (F.col("x") < F.col("y"))
    reach = (F.when(F.col("x_ends") < F.col("y_ends"), F.col("x_reach"))
             .when(F.col("x_ends") > F.col("y_ends"), F.col("y_reach")).otherwise(F.greatest("x_reach", "y_reach")))
    enough = F.col("small") | (reach * (100 + PERCENT) >= PERCENT * (F.col("x_n") + F.col("y_n")))
    columns = ["small", "x", "x_n", "x_pos", "y", "y_n", "y_pos"]
    long = meet.where(_alike(boundary) & once & enough & (F.col("x_component") != F.col("y_component")))
    near = short.select("small", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"),
                        "y", "y_n", "y_pos").where(_alike(boundary) & (F.col("x") != F.col("y")))
    found = _counted(long.select(columns).unionAll(near.select(columns)))
    for side in ("a", "b"):                                   # short lists do not know the families
        found = found.join(families.select(F.col("node").alias(side), F.col("component").alias(f"{side}_family")),
                           side, "left")
    return found.where(~F.col("a_family").eqNullSafe(F.col("b_family")) | F.col("a_family").isNull()).select("a", "b")


def _with_leaders(crowded: DataFrame, turn: int, leaders: int) -> DataFrame:
    """(a, b) of sets and leaders of their lists that share enough of their prefixes.

    Leaders of a list are its sets with most rows in long lists (a text comes there before its changed
    copies), so many next ones in each turn. A row of a list makes `leaders` rows."""
    weights = crowded.groupBy("id").agg(F.sum("size").alias("weight"))
    order = Window.partitionBy("gram", "small").orderBy(F.desc("weight"), "id")
    ranked = crowded.join(weights, "id").withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= (turn + 1) * leaders)
    chosen = ranked.where(F.col("_rank") > turn * leaders).select(
        "gram", "small", F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"),
        F.col("component").alias("y_component"))
    met = crowded.select(
        "gram", "small", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"),
        F.col("component").alias("x_component")).join(chosen, ["gram", "small"])
    sized = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * PERCENT
    # two leaders meet twice in a list: their count is too high, which the exact comparison mends
    return _counted(met.where(sized & (F.col("x_component") != F.col("y_component"))))


def _open_lists(lists: DataFrame, families: DataFrame) -> DataFrame:
    """Rows of lists that hold more than one component, with `component`, `main` for its largest one, and
    `rest` and `size`, the list's rows outside that and all its rows."""
    rows = lists.join(families, F.col("id") == F.col("node"), "left").drop("node")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("gram", "small", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = parts.groupBy("gram", "small").agg(
        F.max(F.struct("k", "component")).alias("largest"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"))
    several = sizes.where(F.col("parts") > 1).select(
        "gram", "small", F.col("largest.component").alias("main"), "size",
        (F.col("size") - F.col("largest.k")).alias("rest"))
    return cut_lineage(rows.join(several, ["gram", "small"]).withColumn("main", F.col("main") == F.col("component")))


def jaccard_components(docs: DataFrame, heavy: int = 16, key: str = "doc_id",
                       text: str = "text", leaders: int = 4, turns: int = 2) -> DataFrame:
    """Per row: key, `n_shingles`, and `component_id`, the least key reachable by links.

    A document without words is linked with nothing and is its own component. A document of fewer
    than five words has its whole sequence as its one shingle. Rows that repeat a key are one
    document and share a component if one of their texts links. A null key gets a null component and
    links nothing. Other columns are not read; an empty table gives an empty table. In up to
    `turns` turns, sets of lists with more than `heavy` rows outside the largest component are compared
    with so many `leaders`; these numbers change the work only, as all lists are scanned in the end."""
    with rows_at_once(docs.sparkSession, TEXTS):
        return _components(docs, heavy, key, text, leaders, turns)


def _components(docs: DataFrame, heavy: int, key: str, text: str, leaders: int, turns: int) -> DataFrame:
    surveyed = cut_lineage(survey(docs, key, text))
    levels = rarity_levels(surveyed.where(F.col("chunk") >= 0).select("chunk", "part", "counts"))
    rows = surveyed.where(F.col("chunk") < 0).select("id", "n", "print")
    known = rows.where(F.col("id").isNotNull() & F.col("print").isNotNull())
    copies = cut_lineage(known.groupBy("print").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    others = cut_lineage(known.select("id", "print").join(copies, "print").where(
        F.col("id") != F.col("first")).select("id", "print").distinct())
    boundary = choose_boundary(known.join(others, ["id", "print"], "left_anti"))
    nodes = _heads(docs, key, text, levels).where(F.col("id").isNotNull() & F.col("print").isNotNull()).join(
        others, ["id", "print"], "left_anti")

    # lists with more than one set
    held = cut_lineage(_held(_postings(nodes, boundary)))
    short = held.where(F.col("y").isNotNull())
    lists = held.where(F.col("y").isNull()).select("gram", "small", "id", "pos", "n", "ends")

    # families of near copies are joined through leaders of long lists; then only what lists still hold
    # besides their largest component is compared with all of the list. A list that is not open stays so.
    links = lists.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    families = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    left = _open_lists(lists, families)
    for turn in range(turns):
        near = cut_lineage(_with_leaders(left.where(F.col("rest") > heavy), turn, leaders))
        found = None if near.isEmpty() else cut_lineage(_verified(docs, near, key, text))
        if found is None or found.isEmpty():
            break
        links = links.union(found)
        families = cut_lineage(connected_components(links, "a", "b"))
        left = _open_lists(left.select(lists.columns), families)
    pairs = cut_lineage(_pairs_across(left, short, families, boundary))
    more = _verified(docs, pairs, key, text)
    found = cut_lineage(connected_components(links.union(more), "a", "b"))

    own = rows.join(copies, "print", "left").withColumn("node", F.coalesce("first", "id"))
    return own.join(found, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
