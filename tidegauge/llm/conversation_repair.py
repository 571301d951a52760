"""Least-cost repair of conversations on an automaton that all conversations share from their ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_facts, shuffle_parts

# Turns of a block at least; longer conversations are cut into blocks of the root of the longest one's turns.
BLOCK_TURNS = 256
# Rows of a signature table that one task walks, about.
WALK_ROWS = 200_000

# Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
NEEDS = (2, 2, 3, 2)  # the state after the user or assistant turn that fits in a state
KEEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
DELETE, INSERT, KEEP, REROLE = "DIKR"  # in ASCII order
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
# Cost to go in each state where no row is left: an empty conversation and one ending with the assistant are whole.
END = (0, 4, 2, 0)
FAR = 1 << 40


def node(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(cost, move) of a row in each state: the least cost from here to the end, and the (edit letter, next state).

    ``symbol`` is ``d`` for a row that must go, else the role's initial (``x`` for a role the grammar lacks), upper case
    if truncated; ``after`` is the cost to go of the next node. Edits that start differently have different letters, so
    the least cost and then the least letter give the string that is ASCII-least among the cheapest.
    """
    cost, move = [], []
    role, cut = symbol.lower(), TRUNCATED_COST if symbol.isupper() else 0
    for state in range(STATES):
        ways = [(DELETE_COST + after[state], DELETE, state)]
        if symbol != "d":
            kept = KEEPS[role][state]
            if kept is not None:
                ways.append((cut + after[kept], KEEP, kept))
            ways.append((REROLE_COST + cut + after[NEEDS[state]], REROLE, NEEDS[state]))
        least = min(ways)
        cost.append(least[0])
        move.append(least[1:])
    # Then insertions before the row. Two in a row from a state come back to a state already weighed, so states 2 and 3
    # look at each other's cost without insertions, and 0 and 1 at the settled state 2.
    two, three = cost[2], cost[3]
    for state, other in ((2, three), (3, two), (0, None), (1, None)):
        way = (INSERT_COST + (cost[2] if other is None else other), INSERT)
        if way < (cost[state], move[state][0]):
            cost[state], move[state] = way[0], (INSERT, NEEDS[state])
    return tuple(cost), tuple(move)


def end_moves(state: int) -> str:
    """The insertions that finish a conversation without rows left."""
    return INSERT * (END[state] // INSERT_COST)


class Suffixes:
    """The nodes from the end of the signature walked last, kept as far as the next one shares them.

    Signatures come sorted by (context, reversed signature), so a node that several share is made once: two signatures
    that end alike, in the same context, are one path from there on. Only the path at hand is in memory.
    """

    def __init__(self):
        self.context, self.path, self.nodes, self.made = None, "", [], 0

    def walk(self, context: tuple[int, ...], backwards: str) -> list:
        """The nodes of a signature given from its last symbol to its first."""
        shared = 0
        if context == self.context:
            most = min(len(self.path), len(backwards))
            while shared < most and self.path[shared] == backwards[shared]:
                shared += 1
        del self.nodes[shared:]
        for symbol in backwards[shared:]:
            self.nodes.append(node(symbol, self.nodes[-1][0] if self.nodes else context))
            self.made += 1
        self.context, self.path = context, backwards
        return self.nodes


def audit(nodes: list, state: int) -> tuple[str, int]:
    """(letters, state behind the last row) along the best moves from a state; the end's insertions are not in it."""
    letters = []
    for _, move in reversed(nodes):
        while move[state][0] == INSERT:
            letters.append(INSERT)
            state = move[state][1]
        letter, state = move[state]
        letters.append(letter)
    return "".join(letters), state


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per signature and context: cost to go, audit and end state for each state at its start."""
    suffixes = Suffixes()
    for batch in batches:
        rows = []
        for context, backwards in zip(batch.column("context").to_pylist(), batch.column("backwards").to_pylist()):
            nodes = suffixes.walk(tuple(context), backwards)
            cost = nodes[-1][0] if nodes else tuple(context)
            ways = [audit(nodes, state) for state in range(STATES)]
            rows.append((context, backwards, cost, [w[0] for w in ways], [w[1] for w in ways], suffixes.made))
            suffixes.made = 0
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64())
        names = ["context", "backwards", "cost", "audits", "ends", "new_nodes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


FACTS = "context array<long>, backwards string, cost array<long>, audits array<string>, ends array<int>, new_nodes long"


def solved(signatures: DataFrame) -> DataFrame:
    """Distinct (context, backwards) with their costs, audits and end states, one row each.

    ``new_nodes`` is how many automaton nodes a row added to those of the rows before it. Sorting by the reversed
    signature deals whole subtrees to a task; only the path at a task's border is made twice.
    """
    distinct = checkpointed(signatures.groupBy("context", "backwards").agg(F.count(F.lit(1)).alias("uses")))
    parts = max(1, -(-distinct.count() // WALK_ROWS))
    ranged = distinct.repartitionByRange(parts, "context", "backwards").sortWithinPartitions("context", "backwards")
    return ranged.select("context", "backwards").mapInArrow(_facts, FACTS).join(distinct, ["context", "backwards"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per signature the least cost from each state at its start to each state behind its last row."""
    walks = [Suffixes() for _ in range(STATES)]
    for batch in batches:
        found = []
        for backwards in batch.column("backwards").to_pylist():
            ends = [w.walk(tuple(0 if s == e else FAR for s in range(STATES)), backwards) for e, w in enumerate(walks)]
            found.append([ends[e][-1][0][s] for s in range(STATES) for e in range(STATES)])
        yield pa.RecordBatch.from_arrays([batch.column("backwards"), pa.array(found, pa.list_(pa.int64()))], ["backwards", "matrix"])


def _contexts(pairs: pd.DataFrame) -> pd.DataFrame:
    """The cost to go behind each block of one long conversation, from its last block to its first."""
    pairs = pairs.sort_values("block", ascending=False)
    context, found = END, []
    for matrix in pairs["matrix"]:
        base = min(context)
        found.append(([int(c - base) for c in context], int(base)))
        context = tuple(min(int(matrix[s * STATES + e]) + context[e] for e in range(STATES)) for s in range(STATES))
    return pairs[["key", "block"]].assign(context=[c for c, _ in found], base=[b for _, b in found])


def _starts(pairs: pd.DataFrame) -> pd.DataFrame:
    """The grammar state before each block of one long conversation, from its first block to its last."""
    pairs, state, found = pairs.sort_values("block"), 0, []
    for ends in pairs["ends"]:
        found.append(state)
        state = int(ends[state])
    return pairs[["key", "block"]].assign(start=found)


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """One row per row of ``df``: key, conv, turn, role, text, here, place (from 0 in its conversation) and first fault.

    Rows are in order of (turn with nulls first, role, text); rows that are not present come last and have no fault.
    One shuffle by conversation serves the order, the repeats, the gaps and the role changes.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))).alias("here"),
    )
    order = (F.col("here").desc(), F.col("turn").asc_nulls_first())
    whole = Window.partitionBy("key").orderBy(*order, "role", "text")
    alike = Window.partitionBy("key", "role", "text").orderBy(*order)
    initial = F.substring("role", 1, 1)
    ordered = rows.withColumns(
        {
            "place": F.row_number().over(whole) - 1,
            "change": F.concat(F.lag(initial).over(whole), initial),
            "known": F.coalesce(F.lag("turn").over(whole) == F.col("turn"), F.lit(False)),
            "again": F.row_number().over(alike) > 1,
        }
    )
    fault = (
        F.when(~F.col("here"), None)
        .when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return ordered.withColumn("fault", fault)


def blocks(turns: DataFrame, size: int) -> DataFrame:
    """Conversations in blocks of ``size`` turns: their rows in order, their reversed signature and their counts."""
    initial, here = F.substring("role", 1, 1), F.col("here")
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    )
    # Rows that are not here are counted with the first block, so that a conversation without rows has one too.
    number = F.when(here, F.floor(F.col("place") / size)).otherwise(0).cast("long")
    grouped = (
        turns.withColumn("block", number)
        .groupBy("key", "block")
        .agg(
            F.first("conv").alias("conv"),
            F.sort_array(F.collect_list(F.when(here, F.struct("place", symbol.alias("symbol"), "role", "text")))).alias("rows"),
            *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
            F.count_if(here & ~F.col("change").isin("su", "ua", "au")).alias("illegal"),
            F.min(F.when(here, F.col("turn"))).alias("low"),
            F.max(F.when(here, F.col("turn"))).alias("high"),
            F.count_if(here & F.col("turn").isNotNull() & ~F.col("known")).alias("distinct"),
        )
    )
    return grouped.withColumns(
        {
            "backwards": F.reverse(F.array_join(F.transform("rows", lambda r: r["symbol"]), "")),
            "rows": F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))),
        }
    )


def _behind(names: DataFrame) -> DataFrame:
    """``names`` (key, block, last, backwards) with context and base: the cost to go behind each block, and its least."""
    end = F.array(*[F.lit(c).cast("long") for c in END])
    short = names.where("last = 0").select("key", "block", "last", "backwards", end.alias("context"), F.lit(0).cast("long").alias("base"))
    long = names.where("last > 0")
    if long.isEmpty():
        return short
    distinct = long.select("backwards").distinct()
    matrices = distinct.sortWithinPartitions("backwards").mapInArrow(_matrices, "backwards string, matrix array<long>")
    cut = long.join(matrices, "backwards").select("key", "block", "matrix").groupBy("key")
    found = cut.applyInPandas(_contexts, "key string, block long, context array<long>, base long")
    return short.unionByName(long.join(found, ["key", "block"]))


def edits(names: DataFrame) -> DataFrame:
    """(key, block, start, audit, cost) for the blocks in ``names`` (key, block, last, backwards)."""
    behind = _behind(names).withColumn("sig", F.concat_ws(":", F.array_join("context", ","), "backwards"))
    behind = checkpointed(behind)
    sig = F.concat_ws(":", F.array_join("context", ","), "backwards").alias("found_sig")
    facts = solved(behind.select("context", "backwards")).select(sig, "cost", "audits", "ends", "uses")
    known = checkpointed(join_facts(behind.drop("context", "backwards"), facts, "sig", "found_sig", "uses"))
    long = known.where("last > 0")
    starts = long.select("key", "block", "ends").groupBy("key").applyInPandas(_starts, "key string, block long, start int")
    placed = known.where("last = 0").withColumn("start", F.lit(0)).unionByName(long.join(starts, ["key", "block"]))
    closing = F.element_at(F.array(*[F.lit(end_moves(s)) for s in range(STATES)]), F.get("ends", F.col("start")) + 1)
    return placed.select(
        "key",
        "block",
        "start",
        F.concat(F.get("audits", F.col("start")), F.when(F.col("block") == F.col("last"), closing).otherwise("")).alias("audit"),
        F.when(F.col("block") == 0, F.get("cost", F.lit(0)) + F.col("base")).otherwise(0).alias("cost"),
    )


def repaired_blocks(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
    block_turns: int | None = None,
) -> DataFrame:
    """Every conversation of ``df`` in blocks of bounded length, with its faults and its cheapest repair.

    Returns key, conv, block, rows (array of role, text), blank, duplicate, truncated, illegal, low, high, distinct
    (turns), start (grammar state before the block), audit (its edits; the last block's include the insertions at the
    end) and cost (of the whole conversation on its block 0, else 0).

    A row's symbol is its role's initial and fault. Conversations become strings of symbols; of equal strings one is
    solved, and strings that end alike share the automaton's nodes, whose costs and moves are made once per node and
    grammar state for all conversations. A conversation longer than a block is cut; what follows a block enters as the
    four costs behind it, which come from one 4 x 4 matrix of least costs per distinct block. Blocks hold
    max(256, root of the longest conversation) turns, so neither a block nor the list of a conversation's blocks grows
    in step with its length. ``block_turns`` sets another size; the result is the same.

    Rows are read in order of (turn with nulls first, role, text), since ties in turn have no order of their own. Null
    roles and texts are one space, a null conversation is one conversation, and rows whose ``present`` is not true only
    name theirs. Roles that begin otherwise than s, u or a can be reroled or deleted. Repeated rows are duplicates. An
    empty table gives no rows. Other columns are ignored.
    """
    if block_turns is None:
        longest = df.groupBy(conv).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        block_turns = max(BLOCK_TURNS, int(longest**0.5) + 1)
    whole = checkpointed(blocks(turns(df, conv, turn, role, text, present), block_turns))
    last = F.max("block").over(Window.partitionBy("key")).alias("last")
    found = edits(whole.select("key", "block", last, "backwards"))
    return whole.drop("backwards").join(found, ["key", "block"])


def applied(rows: list[dict], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that ``audit`` leaves or puts in, from a grammar state on."""
    at = 0
    for letter in audit:
        role, text = ("user" if NEEDS[state] == 2 else "assistant"), ""
        if letter != INSERT:
            row, at = rows[at], at + 1
            if letter == DELETE:
                continue
            role, text = (row["role"] if letter == KEEP else role), row["text"]
        state = KEEPS[role[0]][state] if letter == KEEP else NEEDS[state]
        yield letter, role, text


def repaired(blocks: DataFrame) -> DataFrame:
    """The repaired turns of ``repaired_blocks``: conv, block, position (in its block), edit (K, R or I), role, text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = enumerate(applied(row["rows"], row["audit"], row["start"]))
                out += [(row["conv"], row["block"], n, *turn) for n, turn in found]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    kind = blocks.schema["conv"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = pa.schema(
        [("conv", to_arrow_type(blocks.schema["conv"].dataType)), ("block", pa.int64()), ("position", pa.int32())]
        + [(n, pa.string()) for n in ("edit", "role", "text")]
    )
    return blocks.select("conv", "block", "rows", "audit", "start").mapInArrow(
        emit, f"conv {kind}, block long, position int, edit string, role string, text string"
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired_blocks``: conv, gaps, the counts, cost, audit, repaired_sha256.

    The hash covers the repaired ``role:text``, joined by newlines. A hash over a conversation is taken in order, so its
    blocks pass through one task, sorted; of its text that task holds a batch at a time, whatever its length.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if state is not None:
                        out.append(close(state))
                    key = row["key"]
                    state = {"conv": row["conv"], "cost": 0, "distinct": 0, "low": None, "high": None, "audit": [], "empty": True}
                    state |= {"hash": hashlib.sha256()} | dict.fromkeys(COUNTS, 0)
                for name in (*COUNTS, "cost", "distinct"):
                    state[name] += row[name]
                for name, pick in (("low", min), ("high", max)):
                    if row[name] is not None:
                        state[name] = row[name] if state[name] is None else pick(state[name], row[name])
                state["audit"].append(row["audit"])
                for _, role, text in applied(row["rows"], row["audit"], row["start"]):
                    state["hash"].update(f"{'' if state['empty'] else chr(10)}{role}:{text}".encode())
                    state["empty"] = False
            yield table(out)
        if state is not None:
            yield table([close(state)])

    def close(state: dict) -> tuple:
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["distinct"]
        return (state["conv"], gaps, *[state[c] for c in COUNTS], state["cost"], "".join(state["audit"]), state["hash"].hexdigest())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 9, kinds)], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    conv = blocks.schema["conv"].dataType
    names = ("gaps", *COUNTS, "cost")
    kinds = pa.schema(
        [("conv", to_arrow_type(conv)), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )
    schema = f"conv {conv.simpleString()}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"
    wanted = blocks.select("key", "conv", "block", "rows", "audit", "start", "cost", "distinct", "low", "high", *COUNTS)
    return wanted.repartition("key").sortWithinPartitions("key", "block").mapInArrow(fold, schema)
