"""Best-fit packing of whole documents into sequences, by bin completion over the counts of lengths.

Pieces are at most `capacity` tokens long, so a table of any size has at most `capacity` different lengths.
The search packs that histogram: it takes the largest length left, enumerates undominated fillings of the
room beside it, applies one to as many sequences as the counts allow, and goes on; branches whose waste
rules out fewer sequences than the incumbent's are cut. The incumbent to beat is best fit decreasing. What
the search returns (patterns and how often each is used) is as bounded as the histogram; which piece
goes where follows from the piece's number among those of its length, so the pieces themselves are never
sorted or sent to one place.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blocks

#: A pattern: (length, how many) of the pieces of one sequence, and how many sequences look like it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


class ChunkIds:
    """Ids of whole texts as little-endian 32-bit bytes, by encoding each distinct word once.

    For tokenizers that drop white space and make every run of letters a pre-token whose last token, and no other,
    ends in the model's word end. Then a text's ids are those of its chunks between spaces and line feeds; a chunk of
    Latin letters with punctuation after it is two parts; and words of Latin letters are encoded many at a time, as
    word ends tell them apart. Other chunks are encoded one by one. The memory of known chunks is bounded."""

    #: Latin letters, each one character in NFC, and what may end a word.
    _WORD = re.compile("(?m)^([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+)([.,;:!?]*)$")

    def __init__(self, file: str, memory: int = 800_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory, self.longest = memory, longest
        self.known: dict[str, bytes] = {}
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("aZ") == "az"
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of Latin letters."""
        out = []
        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            ids = self._encoded([" ".join(some)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [data[a:b] for a, b in itertools.pairwise(cuts)]
            else:
                out += [x.tobytes() for x in self._encoded(some)]
        return out

    def _learn(self, missing: list[str]) -> None:
        pairs = self._WORD.findall("\n".join(missing))
        whole = list(map("".join, pairs))
        words = [w for w, _ in pairs]
        if self.folds:                                        # as the tokenizer does, letter by letter
            words = "\n".join(words).lower().split("\n")
        new = list(set(words).difference(self.known))         # words are kept without what ends them too
        self.known.update(zip(new, self._words(new), strict=True))
        rest = list(set(missing).difference(whole).union(e for _, e in pairs))
        ends = {chunk: x.tobytes() for chunk, x in zip(rest, self._encoded(rest), strict=True)}
        self.known.update(ends)
        self.known.update((c, self.known[w] + ends[e]) for c, w, (_, e) in zip(whole, words, pairs, strict=False))

    def of(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()                                          # millions of strings, and no cycles
        try:
            parts = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
            chunks = set().union(*parts)
            if len(self.known) > self.memory:                 # what is needed now is often needed again
                self.known = {c: self.known[c] for c in chunks if c in self.known}
            missing = list(chunks.difference(self.known))
            self._learn(missing)
            out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        finally:
            gc.enable()
        for chunk in missing:
            if len(chunk) > self.longest:
                for long in (chunk, chunk.lower().rstrip(".,;:!?")):
                    self.known.pop(long, None)
        return out


@functools.lru_cache(maxsize=1)
def _shared(file: str) -> ChunkIds:
    """One encoder a Python worker, which goes on to its next tasks."""
    return ChunkIds(file)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: for each least length, what cannot share and what does not fit beside it."""
    n = np.zeros(capacity + 1, np.int64)
    for size, count in counts.items():
        n[size] = count
    total = n * np.arange(capacity + 1)
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    between = lambda table, a, b: int(table[b] - table[a]) if b > a else 0    # lengths a to b - 1
    half, best = capacity // 2, -(-int(total.sum()) // capacity)
    for least in range(1, half + 1):
        alone = between(number, capacity - least + 1, capacity + 1)
        shared = between(number, half + 1, capacity - least + 1)
        room = shared * capacity - between(volume, half + 1, capacity - least + 1)
        rest = between(volume, least, half + 1) - room
        best = max(best, alone + shared + max(0, -(-rest // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, for all sequences alike at once."""
    rooms: dict[int, list[list]] = {}                     # room -> [pieces, how many sequences]
    order: list[int] = []

    def put(room: int, pieces: tuple, times: int) -> None:
        if times:
            if room not in rooms:
                rooms[room] = []
                order.insert(bisect_left(order, room), room)
            rooms[room].append([pieces, times])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                put(capacity - each * size, ((size, each),), left // each)
                if left % each:
                    put(capacity - left % each * size, ((size, left % each),), 1)
                break
            room = order[at]
            pieces, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // size, left)
            used = min(times, left // each)
            put(room, pieces, times - used)
            put(room - each * size, (*pieces, (size, each)), used)
            left -= used * each
    return [(p, t) for groups in rooms.values() for p, t in groups]


def completions(sizes: list[int], counts: dict[int, int], room: int, width: int, steps: int) -> list[tuple[int, list]]:
    """Undominated fillings of the room, least waste first: (waste, lengths).

    `sizes` are the lengths at hand in ascending order. A filling is dominated if something more fits, or if
    one or two of its lengths can be exchanged for a single longer one at hand. At most `steps` are tried."""
    found: dict[tuple, int] = {}
    left = steps

    def at_hand(low: int, high: int, chosen: list[int]) -> bool:
        """Whether a length in (low, high] is at hand besides the chosen ones."""
        i = bisect_right(sizes, low)
        while i < len(sizes) and sizes[i] <= high:
            if counts[sizes[i]] > chosen.count(sizes[i]):
                return True
            i += 1
        return False

    def extend(top: int, room: int, chosen: list[int]) -> bool:
        nonlocal left
        left -= 1
        fits = False
        for i in range(min(top, bisect_right(sizes, room)) - 1, -1, -1):
            if left <= 0:
                return False
            size = sizes[i]
            if counts[size] > chosen.count(size):
                fits = True
                if not extend(i + 1, room - size, [*chosen, size]):
                    return False
        if not fits and not at_hand(0, room, chosen):
            dominated = any(at_hand(a, a + room, chosen) for a in set(chosen)) or room and any(
                at_hand(a + b - 1, a + b + room, chosen) for i, a in enumerate(chosen) for b in chosen[:i])
            if not dominated:
                found.setdefault(tuple(chosen), room)
        return not (len(found) >= width and min(found.values()) == 0)

    extend(len(sizes), room, [])
    if not found:                                         # the steps ran out: greedy is always at hand
        chosen: list[int] = []
        for size in reversed(sizes):
            while size <= room and counts[size] > chosen.count(size):
                chosen.append(size)
                room -= size
        found[tuple(chosen)] = room
    return sorted(((w, list(c)) for c, w in found.items()), key=lambda x: (x[0], [-s for s in x[1]]))[:width]


def pack_lengths(counts: dict[int, int], capacity: int, width: int = 6, steps: int = 600,
                 nodes: int = 4_000) -> list[Pattern]:
    """Few sequences for so many pieces of each length, by bin completion.

    The search is exact where `nodes` and `steps` suffice; else the best packing found is returned,
    which is never worse than best fit decreasing."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    number, least = sum(t for _, t in best), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    sizes, path, waste, used = sorted(counts), [], 0, 0   # path: [options, next, pattern, times, its waste]

    def change(pattern: dict[int, int], times: int) -> None:
        for size, each in pattern.items():
            had = counts.get(size, 0)
            counts[size] = had + each * times
            if not had:
                sizes.insert(bisect_left(sizes, size), size)
            elif not counts[size]:
                del sizes[bisect_left(sizes, size)], counts[size]

    while number > least and nodes > 0:
        if sizes:
            nodes -= 1
            size = sizes[-1]
            change({size: 1}, -1)
            options = completions(sizes, counts, capacity - size, width, steps)
            change({size: 1}, 1)
            path.append([[(w, [size, *c]) for w, c in options], 0, None, 0, 0])
        elif used < number:
            best = [(tuple(p[2].items()), p[3]) for p in path]
            number = used
            continue
        while path:                                       # the next branch, from the deepest node on
            node = path[-1]
            if node[2] is not None:
                change(node[2], node[3])
                used, waste, node[2] = used - node[3], waste - node[4], None
            if node[1] == len(node[0]):
                path.pop()
                continue
            lost, chosen = node[0][node[1]]
            node[1] += 1
            pattern = {s: chosen.count(s) for s in chosen}
            times = min(counts[s] // each for s, each in pattern.items())
            if waste + lost * times > (number - 1) * capacity - total:
                continue                                  # so much waste allows no fewer sequences
            node[2:] = [pattern, times, lost * times]
            change(pattern, -times)
            used, waste = used + times, waste + lost * times
            break
        else:
            break
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which pieces of each length go where, as ranges of their numbers: sorted by (length, first)."""
    rows, taken, sequence = [], {}, 0
    for pieces, times in patterns:
        offset = 0
        for size, each in pieces:
            first = taken.get(size, 0)
            rows.append((size, first, sequence, each, offset))
            taken[size] = first + each * times
            offset += size * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


_RANK = 1 << 48


def _pieces(docs: DataFrame, file: str, capacity: int, end: int, key: str, text: str) -> DataFrame:
    """One row a piece, with the task that made it and its number among the task's pieces of its length."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batches):
        encode, part = _shared(file), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for block in blocks(texts):
                row, piece, length, crc, nth = [], [], [], [], []
                for i, ids in enumerate(encode.of(texts[block]), block.start):
                    ids += last
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        row.append(i)
                        piece.append(n)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        nth.append(int(seen[len(own) // 4]))
                        seen[len(own) // 4] += 1
                number = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(row, pa.int64())), pa.array(number),
                     pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                    ["_key", "piece", "start", "length", "ids_crc32", "_part", "_nth"])

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(
        make, f"_key {kind}, piece int, start long, length long, ids_crc32 long, _part int, _nth long")


def pack_documents(docs: DataFrame, file: str, capacity: int = 4096, end: int = 1, key: str = "doc_id",
                   text: str = "text", nodes: int = 4_000) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, and its place (sequence_id, offset).

    `file` is the text of a tokenizer file of the kind that `ChunkIds` can cut; `end` follows every document. A null
    or empty text is one piece of the end alone. Only documents of more than `capacity` ids are cut. Repeated rows and
    keys (null ones too) are packed as separate documents; other columns are not read; no row gives no row.
    Sequences are filled from 0 without gaps. `nodes` bounds the search on the driver."""
    pieces = cut_lineage(_pieces(docs, file, capacity, end, key, text))
    parts = pieces.groupBy("length", "_part").agg((F.max("_nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(places(pack_lengths(counts, capacity, nodes=nodes)))
    ranked = pieces.join(parts.select("length", "_part", "_before"), ["length", "_part"])
    kind = docs.schema[key].dataType.simpleString()

    def place(batches):
        table = plan.value
        starts = table["length"] * _RANK + table["first"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_before").to_numpy() + batch.column("_nth").to_numpy()
            at = np.searchsorted(starts, length * _RANK + rank, "right") - 1
            among = rank - table["first"][at]
            each = table["each"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_key", "piece", "start", "length", "ids_crc32")]
                + [pa.array(table["sequence"][at] + among // each),
                   pa.array(table["offset"][at] + among % each * length)],
                ["_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("_key", "piece", "start", "length", "ids_crc32", "_before", "_nth").mapInArrow(
        place, f"_key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("_key", key)
