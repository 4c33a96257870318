"""Repair of the turn structure of conversations at least cost, by Hirschberg's divide and conquer.

A repaired conversation is empty or a system row at most, then user and assistant in turns, ending with the
assistant. What is reached so far is one of four states (nothing, system, user, assistant), and each row moves
between states by one of four edits: Keep, Rerole to user or assistant, Delete; Insert may come before any row.
A row's effect is a 4 x 4 matrix of least costs, and there are only 17 kinds of rows.

Least-cost edits are rebuilt in linear space: a forward vector of four costs from the start and a backward one
from the end meet in the middle, the best crossing state is fixed, and both halves are solved alike. Ties go to the
edits whose initials come first in ASCII. The state determines an audit's continuation and no audit of as many
rows is the start of another, so it suffices that forward vectors carry, beside each cost, the rank of its audit.

Conversations are cut into blocks of rows. Blocks are summed up as matrices, the matrices of a conversation are
composed in a tree, crossing states are chosen from its root down, and each block is then rebuilt by itself; so a
conversation of any length is spread over tasks. Only its repaired text is hashed in one pass, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import number_rows
from ..session import cut_lineage
from .common import SPACES, as_text

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Kinds of rows: 4 * (place in `INITIALS`, 3: another) + fault; the last kind ends a conversation.
NO_FAULT, CUT_OFF, BLANK, DUPLICATE = range(4)
END = 16
FAR = 1 << 40


def _steps(state: int, initial: int) -> int | None:
    """The state after a row of that initial (0 s, 1 u, 2 a), if it may follow."""
    allowed = {START: (0, 1), SYSTEM: (1,), USER: (2,), ASSISTANT: (1,)}[state]
    return initial + 1 if initial in allowed else None


def _tables() -> tuple[np.ndarray, np.ndarray, list]:
    """cost[kind, from, to], rank[kind, from, to] of audits that start alike, and the audits themselves."""
    cost = np.full((END + 1, 4, 4), FAR, np.int64)
    audit = [[[""] * 4 for _ in range(4)] for _ in range(END + 1)]
    inserts = {s: [(s, "")] for s in range(4)}               # (state after, audit) of up to three inserts
    for s in range(4):
        state = s
        for n in range(1, 4):
            state = ASSISTANT if state == USER else USER
            inserts[s].append((state, "I" * n))
    for kind, start in itertools.product(range(END + 1), range(4)):
        for state, audits in inserts[start]:
            initial, fault = divmod(kind, 4)
            found = []
            if kind == END:
                if state in (START, ASSISTANT):
                    found.append((START, 0, ""))
            else:
                found.append((state, DELETE, "D"))
                if fault < BLANK:
                    extra = TRUNCATED if fault == CUT_OFF else 0
                    if initial < 3 and _steps(state, initial) is not None:
                        found.append((_steps(state, initial), KEEP + extra, "K"))
                    found += [(to, REROLE + extra, "R") for i in (1, 2) if (to := _steps(state, i)) is not None]
            for to, price, edit in found:
                new = (price + INSERT * len(audits), audits + edit)
                if new < (cost[kind, start, to], audit[kind][start][to]) or cost[kind, start, to] == FAR:
                    cost[kind, start, to], audit[kind][start][to] = new
    rank = np.zeros((END + 1, 4, 4), np.int64)
    for kind, start in itertools.product(range(END + 1), range(4)):
        for n, to in enumerate(sorted(range(4), key=lambda t: audit[kind][start][t])):
            rank[kind, start, to] = n
    return cost, rank, audit


COST, RANK, AUDIT = _tables()


def forward(cost: np.ndarray, rank: np.ndarray, step_cost: np.ndarray, step_rank: np.ndarray):
    """One step of many vectors at once: [n, 4] of costs and ranks through [n, 4, 4] of them."""
    least = np.minimum(cost[:, :, None] + step_cost, FAR)
    chosen = (least * 4 + rank[:, :, None]).argmin(1)         # the state before each state after
    rows = np.arange(len(cost))[:, None]
    new = np.take_along_axis(least, chosen[:, None, :], 1)[:, 0]
    order = np.take_along_axis(rank, chosen, 1) * 4 + step_rank[rows, chosen, np.arange(4)]
    return new, order.argsort(1, kind="stable").argsort(1, kind="stable")


def compose(cost: np.ndarray, rank: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product [n, 4, 4] of each run of so many matrices, which follow one another in [m, 4, 4]."""
    n, first = len(lengths), np.cumsum(lengths) - lengths
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (n, 4, 4)).copy()
    order = np.broadcast_to(np.arange(4), (n, 4, 4)).copy()
    for t in range(lengths.max(initial=0)):
        on = np.flatnonzero(lengths > t)
        at, many = first[on] + t, len(on) * 4                 # each start state is a vector of its own
        new = forward(out[on].reshape(many, 4), order[on].reshape(many, 4),
                      cost[at].repeat(4, 0), rank[at].repeat(4, 0))
        out[on], order[on] = (x.reshape(-1, 4, 4) for x in new)
    return out, order


def crossings(cost: np.ndarray, rank: np.ndarray, lengths: np.ndarray, starts, ends) -> np.ndarray:
    """The states before, between and after the matrices of each run, on its audit-least best way: one
    more state than matrices a run, one run after the other.

    All runs are halved level by level: forward vectors over the first halves and backward ones over
    the second halves meet at the best crossing, and of those at the one whose audit comes first."""
    first = np.cumsum(lengths) - lengths
    shift = np.arange(len(lengths))                           # run i's matrix j is followed by state j + i + 1
    out = np.full(lengths.sum() + len(lengths), -1)
    out[first + shift + lengths] = ends
    out[first + shift] = starts
    a, b = first[lengths > 1], (first + lengths)[lengths > 1]
    shift = shift[lengths > 1]
    while len(a):
        n, middle = len(a), (a + b) // 2
        every = np.arange(n)
        ahead, order = np.full((n, 4), FAR, np.int64), np.tile(np.arange(4), (n, 1))
        back = np.full((n, 4), FAR, np.int64)
        ahead[every, out[a + shift]] = back[every, out[b + shift]] = 0
        for t in range((middle - a).max()):
            on = np.flatnonzero(middle - a > t)
            ahead[on], order[on] = forward(ahead[on], order[on], cost[a[on] + t], rank[a[on] + t])
        for t in range((b - middle).max()):
            on = np.flatnonzero(b - middle > t)
            back[on] = np.minimum((cost[b[on] - 1 - t] + back[on][:, None, :]).min(2), FAR)
        out[middle + shift] = ((ahead + back) * 4 + order).argmin(1)
        a, b, shift = np.concatenate([a, middle]), np.concatenate([middle, b]), np.concatenate([shift, shift])
        a, b, shift = (x[b - a > 1] for x in (a, b, shift))
    return out


def audits(kinds: np.ndarray, lengths: np.ndarray, starts, ends) -> list[list[str]]:
    """Per run of kinds, the edits of each row (inserts come with the row they precede)."""
    states = crossings(COST[kinds], RANK[kinds], lengths, starts, ends).tolist()
    out, row = [], 0
    kinds = kinds.tolist()
    for i, n in enumerate(lengths.tolist()):
        out.append([AUDIT[kinds[j]][states[j + i]][states[j + i + 1]] for j in range(row, row + n)])
        row += n
    return out


# -- damage and faults ---------------------------------------------------------------------------------

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32 of `conv:turn` names; nulls are one space."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    part = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    hurt = F.when(part == 1, "").when(part == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return rows.where(part != 0).select(
        rows[conv].alias("conv"), rows[turn].alias("turn"),
        F.when(part == 4, "user").otherwise(blank(role)).alias("role"), hurt.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(part == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _print() -> Column:
    return F.sha2("text", 256)


def _kind(initial: Column, fault: Column) -> Column:
    return (F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12) + fault).cast("int")


def _faults(there: DataFrame) -> DataFrame:
    """(conv, turn, role, print, n, kind): distinct rows with how often they come and the first one's kind."""
    last = F.regexp_extract("text", f"(?s)([^{SPACES}])[{SPACES}]*\\z", 1)
    lines = cut_lineage(there.groupBy("conv", "turn", "role", _print().alias("print")).agg(
        F.count(F.lit(1)).alias("n"), F.first(last).alias("last")))
    lines = lines.withColumn("_order", F.struct(F.col("turn").isNotNull(), "turn"))
    firsts = lines.groupBy("conv", "role", "print").agg(F.min("_order").alias("_first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv", "role", "print")]
    joined = lines.alias("l").join(firsts.alias("f"), same[0] & same[1] & same[2])
    fault = (F.when(F.col("l.last") == "", BLANK).when(F.col("l._order") > F.col("f._first"), DUPLICATE)
             .when(~F.col("l.last").isin(".", "!", "?"), CUT_OFF).otherwise(NO_FAULT))
    return joined.select(*[F.col(f"l.{c}") for c in ("conv", "turn", "role", "print", "n")],
                         _kind(F.col("l.role").substr(1, 1), fault).alias("kind"))


# -- blocks --------------------------------------------------------------------------------------------

_SUMMARY = "cost array<long>, rank array<long>, illegal long, head int, tail int"


def _pairs_illegal(initials: np.ndarray) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


def _parts(batch: pd.DataFrame, column: str, each: int = 1, rows: int = 100_000):
    """The batch in parts of about so many rows or matrices, whose lists lie one after the other."""
    lengths = np.array([len(v) for v in batch[column]], np.int64) // each
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // rows)) + 1
    for part in np.split(np.arange(len(batch)), cuts):
        if len(part):
            yield batch.iloc[part], lengths[part]


def _flat(column) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.int64) for v in column])


def _summed(node, cost, rank, illegal, heads, tails) -> pd.DataFrame:
    return pd.DataFrame({"node": node, "cost": list(cost.reshape(-1, 16)), "rank": list(rank.reshape(-1, 16)),
                         "illegal": illegal, "head": heads, "tail": tails})


def _summed_blocks(batches):
    for whole in batches:
        for batch, lengths in _parts(whole, "kinds"):
            kinds = _flat(batch["kinds"])
            initials = [k[k < END] >> 2 for k in np.split(kinds, np.cumsum(lengths)[:-1])]
            yield _summed(batch["node"].array, *compose(COST[kinds], RANK[kinds], lengths),
                          [_pairs_illegal(i) for i in initials], [int(i[0]) if len(i) else -1 for i in initials],
                          [int(i[-1]) if len(i) else -1 for i in initials])


def _summed_nodes(batches):
    for whole in batches:
        for batch, lengths in _parts(whole, "costs", 16):
            cost, rank = (_flat(batch[c]).reshape(-1, 4, 4) for c in ("costs", "ranks"))
            illegal, heads, tails = [], [], []
            for own, head, tail in zip(batch["illegals"], batch["heads"], batch["tails"], strict=True):
                ends = [(h, t) for h, t in zip(head, tail, strict=True) if h >= 0]
                seams = sum(_pairs_illegal(np.array([a[1], b[0]])) for a, b in itertools.pairwise(ends))
                illegal.append(int(sum(own)) + seams)
                heads.append(ends[0][0] if ends else -1)
                tails.append(ends[-1][1] if ends else -1)
            yield _summed(batch["node"].array, *compose(cost, rank, lengths), illegal, heads, tails)


def _crossed_nodes(batches):
    for whole in batches:
        for batch, lengths in _parts(whole, "costs", 16):
            cost, rank = (_flat(batch[c]).reshape(-1, 4, 4) for c in ("costs", "ranks"))
            states = crossings(cost, rank, lengths, batch["from"].to_numpy(), batch["to"].to_numpy())
            yield pd.DataFrame({"node": batch["node"].array,
                                "states": np.split(states, np.cumsum(lengths + 1)[:-1])})


def _rebuilt_blocks(batches):
    for whole in batches:
        for batch, lengths in _parts(whole, "kinds"):
            yield pd.DataFrame({"node": batch["node"].array, "edits": audits(
                _flat(batch["kinds"]), lengths, batch["from"].to_numpy(), batch["to"].to_numpy())})


def _children(level: DataFrame) -> DataFrame:
    """The summaries of each parent's children, in order; a parent has a bounded number of them."""
    rows = level.groupBy(F.col("node.conv").alias("conv"), F.col("node.parent").alias("up")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("node.at").alias("at"), *[
            F.col(c) for c in ("cost", "rank", "illegal", "head", "tail")]))).alias("c"))
    return rows.select("conv", "up", F.flatten("c.cost").alias("costs"), F.flatten("c.rank").alias("ranks"),
                       F.col("c.illegal").alias("illegals"), F.col("c.head").alias("heads"),
                       F.col("c.tail").alias("tails"), F.col("c.at").alias("ats"))


def _node(at: Column, fan: int, conv: str = "conv") -> Column:
    return F.struct(F.col(conv).alias("conv"), at.cast("long").alias("at"), F.floor(at / fan).cast("long").alias("parent"))


def _solved(blocks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """(node, edits) of all blocks, and (conv, cost, illegal) of all conversations."""
    node = "node struct<conv:string,at:bigint,parent:bigint>"
    levels = [cut_lineage(blocks.mapInPandas(_summed_blocks, f"{node}, {_SUMMARY}"))]
    parents = []
    while not parents or levels[-1].agg(F.max("node.at") - F.min("node.at")).first()[0]:
        # one root a conversation: numbers of blocks are halved by `fan` until all are the same
        children = cut_lineage(_children(levels[-1]))
        parents.append(children)
        levels.append(cut_lineage(children.withColumn("node", _node(F.col("up"), fan)).mapInPandas(
            _summed_nodes, f"{node}, {_SUMMARY}")))
    # cost from the start to the end, whose state is again the first one
    totals = levels[-1].select(F.col("node.conv").alias("conv"), F.col("cost")[0].alias("cost"), "illegal")
    ways = None
    for children in reversed(parents):
        here = children.withColumn("node", _node(F.col("up"), fan))
        if ways is None:
            here = here.withColumns({"from": F.lit(START), "to": F.lit(START)})
        else:
            here = here.join(ways, F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("up") == F.col("w_at")))
        states = here.select("node", "costs", "ranks", "from", "to").mapInPandas(
            _crossed_nodes, f"{node}, states array<int>")
        both = states.alias("s").join(children.alias("c"), F.col("s.node.conv").eqNullSafe(F.col("c.conv"))
                                      & (F.col("s.node.at") == F.col("c.up")))
        ways = cut_lineage(both.select(F.col("c.conv").alias("w_conv"), F.posexplode("c.ats").alias("_i", "w_at"), "s.states")
                           .select("w_conv", "w_at", F.col("states")[F.col("_i")].alias("from"),
                                   F.col("states")[F.col("_i") + 1].alias("to")))
    framed = blocks.join(ways, F.col("node.conv").eqNullSafe(F.col("w_conv")) & (F.col("node.at") == F.col("w_at")))
    edits = framed.select("node", "kinds", "from", "to").mapInPandas(_rebuilt_blocks, f"{node}, edits array<string>")
    return edits, totals


# -- the repaired text ---------------------------------------------------------------------------------

class _Repaired:
    """One conversation as its rows pass by: audit and hash."""

    def __init__(self):
        self.hash, self.audit, self.state, self.first = hashlib.sha256(), [], START, True

    def row(self, edits: str, role: str | None, text: str | None) -> None:
        self.audit.append(edits)
        for edit in edits:
            if edit == "D":
                continue
            if edit != "K":
                self.state = ASSISTANT if self.state == USER else USER
                line = f"{'user' if self.state == USER else 'assistant'}:{'' if edit == 'I' else text}"
            else:
                line = f"{role}:{text}"
                self.state = INITIALS.index(role[0]) + 1
            self.hash.update(("" if self.first else "\n").encode() + line.encode("utf-8", "replace"))
            self.first = False


def _stream(batches):
    conv, now, waiting, done = None, None, [], 0
    out: tuple[list, list, list] = ([], [], [])

    def finish():
        for edits in waiting[done:]:                      # what follows the last row
            now.row(edits, None, None)
        for column, value in zip(out, (conv, "".join(now.audit), now.hash.hexdigest()), strict=True):
            column.append(value)

    def flush():
        frame = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                                            pa.array(out[2], pa.string())], ["conv", "audit", "repaired_sha256"])
        for column in out:
            column.clear()
        return frame

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "role", "text", "edits")]
        for key, role, text, edits in zip(*columns, strict=True):
            if now is None or key != conv:
                if now is not None:
                    finish()
                conv, now, waiting, done = key, _Repaired(), [], 0
            if edits is not None:
                del waiting[:done]
                done = 0
                waiting += edits
            else:
                now.row(waiting[done], role, text)
                done += 1
        yield flush()
    if now is not None:
        finish()
        yield flush()


def repair_conversations(rows: DataFrame, width: int = 1024, fan: int = 256, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", damage=damaged) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    `damage` maps the rows to (conv, turn, role, text); the default applies the contract's damage, `as_is`
    none. Nulls in role and text are one space; a null conversation is a conversation. Rows of one turn are taken by
    role and then by the SHA-256 of the text, null turns first. Roles are known by their first letter; one of another
    letter, or an empty one, can only be deleted or reroled. A conversation without rows has zeros, an
    empty audit and the hash of the empty string; an empty table gives an empty table. Other columns are not read.
    `width` rows are a block, `fan` blocks (or nodes) a node of the tree. SHA-256 reads a whole conversation in one
    task, batch by batch; everything else of a long conversation is spread."""
    kind = rows.schema[conv].dataType
    there = damage(rows, conv, turn, role, text).withColumn("conv", as_text(F.col("conv")))
    lines = cut_lineage(_faults(there))
    listed = cut_lineage(lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        "conv", "turn", "role", "print", "copy",
        # a blank row stays blank when repeated; what else comes again is a duplicate
        F.when((F.col("copy") > 1) & (F.col("kind") % 4 != BLANK), F.col("kind") - F.col("kind") % 4 + DUPLICATE)
        .otherwise(F.col("kind")).alias("kind")))
    fault = F.col("kind") % 4
    seen = listed.groupBy("conv").agg(
        F.count_if(fault == BLANK).alias("blank"), F.count_if(fault == DUPLICATE).alias("duplicate"),
        F.count_if(fault == CUT_OFF).alias("truncated"))
    spans = lines.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1).alias("_span"), F.countDistinct("turn").alias("_turns"))
    every = cut_lineage(rows.select(as_text(rows[conv]).alias("conv")).distinct())

    # rows of a conversation and its end, numbered in order over the whole table
    ends = every.select("conv", F.lit(1).alias("last"), F.lit(None).cast(listed.schema["turn"].dataType).alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("print"), F.lit(0).alias("copy"), F.lit(END).alias("kind"))
    ordered = number_rows(ends.unionByName(listed.withColumn("last", F.lit(0))),
                          ["conv", "last", "turn", "role", "print", "copy"], "place")
    blocks = cut_lineage(ordered.groupBy("conv", F.floor(F.col("place") / width).alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("place", "kind"))).alias("rows"),
        F.min(F.struct("place", "last", "turn", "role", "print")).alias("lead")))
    shaped = blocks.select(_node(F.col("at"), fan).alias("node"), F.col("rows.kind").alias("kinds"))
    edits, totals = _solved(shaped, fan)
    first = blocks.select(F.col("conv").alias("b_conv"), F.col("at").alias("b_at"), "lead")
    orders = edits.join(first, F.col("node.conv").eqNullSafe(F.col("b_conv")) & (F.col("node.at") == F.col("b_at")))
    orders = orders.select(
        F.col("node.conv").alias("conv"), F.col("lead.last").alias("last"), F.col("lead.turn").alias("turn"),
        F.col("lead.role").alias("role"), F.col("lead.print").alias("print"), F.lit(0).alias("is_row"),
        F.col("node.at").alias("at"), F.lit(None).cast("string").alias("text"), "edits")
    texts = there.select("conv", F.lit(0).alias("last"), "turn", "role", _print().alias("print"), F.lit(1).alias("is_row"),
                         F.lit(0).cast("long").alias("at"), "text", F.lit(None).cast("array<string>").alias("edits"))
    # a block's edits come before its rows: all rows before them belong to earlier blocks
    stream = orders.unionByName(texts).repartition("conv").sortWithinPartitions(
        "conv", "last", "turn", "role", "print", "is_row", "at")
    repaired = stream.select("conv", "role", "text", "edits").mapInArrow(
        _stream, "conv string, audit string, repaired_sha256 string")

    out = every.alias("e")
    for name, part in (("s", seen), ("g", spans), ("t", totals), ("r", repaired)):
        out = out.join(part.alias(name), F.col("e.conv").eqNullSafe(F.col(f"{name}.conv")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        F.col("e.conv").cast(kind).alias(conv), (number("_span") - number("_turns")).alias("gaps"),
        *[number(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], "audit", "repaired_sha256")


def as_is(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Undamaged rows in the form `repair_conversations` takes."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    return rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), blank(role).alias("role"),
                       blank(text).alias("text"))
