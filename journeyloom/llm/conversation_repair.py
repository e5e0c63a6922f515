"""Cheapest repair of the turns of a conversation.

A conversation is brought into the form (s?(ua)+)? of role initials by keeping, re-roling, deleting and
inserting turns.  Rows passed and state of the form span a lattice with small whole costs.  The
shortest way is found by an auction: nodes have prices, a path is extended along an arc whose cost
equals the difference of prices, and contracts after raising a price where there is none.  In the
end the prices are feasible duals, so every shortest way runs over tight arcs only; the edits are
read off by following, of the tight arcs that lead on to the end, the one that is first in ASCII order.

Rows are put into order by a range partitioning, which cuts a conversation of any length into pieces;
only the kind of each row (one letter) goes into a piece.  Pieces are solved in blocks of rows from the
end, prices of a border being the end costs of the block before.  A conversation that is cut by
partition borders exchanges four numbers per piece for that, at most one piece per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from journeyloom.llm.common import prepare_workers, table
from journeyloom.sources.workspace import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 32
# States of the form: nothing yet, behind s, behind u, behind a.  Next role and state for an added turn.
NEXT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
# State behind a kept turn, by its role initial.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
END = (0, None, None, 0)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
# One letter per row: role initial (x: any other); upper case where truncated, a digit where it has to go.
PLAIN, CUT_OFF, GONE = "suax", "SUAX", "0123"

Terminal = tuple[int | None, ...]


def initials(kinds: str) -> str:
    return kinds.translate(str.maketrans(CUT_OFF + GONE, 2 * PLAIN))


class Block:
    """The lattice of some rows, its prices and the ways that the tight arcs leave.

    ``terminal`` is the cost behind the block for every state it may be left in (None: not at all).
    Turns are inserted in front of a row; behind the last row only where the conversation ends.
    """

    def __init__(self, kinds: str, terminal: Terminal, last: bool, entries: tuple[int, ...] = (0, 1, 2, 3)):
        n = len(kinds)
        self.goal = 4 * (n + 1)
        # Arcs (edit, cost, node) of every node, edits in ASCII order.
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i in range(n + 1):
            for state in range(4):
                arcs = []
                if i < n:
                    kind, below = kinds[i], 4 * (i + 1)
                    arcs.append(("D", DELETE, below + state))
                    arcs.append(("I", INSERT, 4 * i + NEXT[state][0]))
                    if kind not in GONE:
                        extra = TRUNCATED if kind in CUT_OFF else 0
                        kept = KEPT[kind.lower()].get(state)
                        if kept is not None:
                            arcs.append(("K", KEEP + extra, below + kept))
                        arcs.append(("R", REROLE + extra, below + NEXT[state][0]))
                else:
                    if terminal[state] is not None:
                        arcs.append(("", terminal[state], self.goal))
                    if last:
                        arcs.append(("I", INSERT, 4 * i + NEXT[state][0]))
                self.arcs.append(arcs)
        self.n = n
        self.price = self._auction(entries)
        self.values = tuple(self.price[e] if e in entries else None for e in range(4))
        self._live = self._leading_on()
        self._ways: dict[int, tuple[list[tuple[str, str, str]], int]] = {}

    def _auction(self, entries: tuple[int, ...]) -> list[int]:
        """Prices with price(i) <= cost(i, j) + price(j) on all arcs, tight on a way from every entry."""
        price = [0] * (self.goal + 1)
        for origin in entries:
            path = [origin]
            while path[-1] != self.goal:
                node = path[-1]
                best, ahead = None, -1
                for _, cost, to in self.arcs[node]:
                    if best is None or cost + price[to] < best:
                        best, ahead = cost + price[to], to
                if best is None:
                    # No way on: shut the node for good.
                    best, ahead = 1 << 40, -1
                if price[node] < best:
                    price[node] = best
                    if node != origin:
                        path.pop()
                    elif best >= 1 << 40:
                        raise ValueError("an entry has no way to the end")
                else:
                    path.append(ahead)
        return price

    def _tight(self, node: int) -> list[tuple[str, int]]:
        return [(edit, to) for edit, cost, to in self.arcs[node] if self.price[node] == cost + self.price[to]]

    def _leading_on(self) -> list[bool]:
        live = [False] * self.goal + [True]
        for i in range(self.n, -1, -1):
            # Inserts stay among the rows' four states: a second look sees what the first one found.
            for _ in range(3):
                for node in range(4 * i, 4 * i + 4):
                    live[node] = live[node] or any(live[to] for _, to in self._tight(node))
        return live

    def way(self, entry: int) -> tuple[list[tuple[str, str, str]], int]:
        """Per row (roles inserted before, edit, roles inserted behind), and the state at the end.

        An edit is D, K or the initial of the new role.  A block without rows has one entry with no edit.
        """
        if entry not in self._ways:
            rows: list[tuple[str, str, str]] = []
            node, pending = entry, ""
            while True:
                edit, to = next((e, t) for e, t in self._tight(node) if self._live[t])
                if edit == "":
                    break
                if edit == "I":
                    pending += NEXT[node % 4][1]
                else:
                    rows.append((pending, NEXT[node % 4][1] if edit == "R" else edit, ""))
                    pending = ""
                node = to
            if pending:
                before, edit, _ = rows.pop() if rows else ("", "", "")
                rows.append((before, edit, pending))
            self._ways[entry] = rows, node % 4
        return self._ways[entry]


_block = lru_cache(maxsize=5_000)(Block)


def _cuts(kinds: str) -> list[str]:
    return [kinds[a : a + BLOCK] for a in range(0, max(1, len(kinds)), BLOCK)]


def _blocks(kinds: str, terminal: Terminal, last: bool) -> tuple[list[Block], list[int], Terminal]:
    """Blocks of a piece in order, what each is lowered by, and the costs from the piece's beginning."""
    blocks, lows = [], []
    for k, cut in enumerate(reversed(_cuts(kinds))):
        low = min(v for v in terminal if v is not None)
        # Shifted ends: equal blocks anywhere in a conversation are solved once.
        block = _block(cut, tuple(None if v is None else v - low for v in terminal), last and k == 0)
        terminal = tuple(v + low for v in block.values)
        blocks.append(block)
        lows.append(low)
    return blocks[::-1], lows[::-1], terminal


def edits_of(kinds: str, terminal: Terminal = END, last: bool = True, entry: int = 0) -> tuple[list[tuple[str, str, str]], int]:
    """The edits of a piece entered in state ``entry``, and the state it is left in."""
    rows: list[tuple[str, str, str]] = []
    for block in _blocks(kinds, terminal, last)[0]:
        way, entry = block.way(entry)
        rows += way
    return rows, entry


def audit_of(rows: list[tuple[str, str, str]]) -> str:
    letter = {"u": "R", "a": "R"}
    return "".join("I" * len(b) + letter.get(e, e) + "I" * len(a) for b, e, a in rows)


def cost_of(kinds: str, rows: list[tuple[str, str, str]]) -> int:
    price = {"D": DELETE, "K": KEEP, "u": REROLE, "a": REROLE, "": 0}
    undeleted = sum(TRUNCATED for kind, (_, e, _) in zip(kinds, rows) if kind in CUT_OFF and e != "D")
    return undeleted + sum(price[e] + INSERT * (len(b) + len(a)) for b, e, a in rows)


def _exits(kinds: str, entry: int) -> set[int]:
    states = {entry}
    for kind in kinds:
        while more := {NEXT[s][0] for s in states} - states:
            states |= more
        kept = {} if kind in GONE else KEPT[kind.lower()]
        states |= {kept[s] for s in states if s in kept}
    return states


def crossing_costs(kinds: str) -> list[list[int | None]]:
    """Cheapest cost of a piece that is not the last, from each entry state to each exit state."""
    total: list[list[int | None]] = [[0 if i == j else None for j in range(4)] for i in range(4)]
    for cut in _cuts(kinds):
        through = [[None] * 4 for _ in range(4)]
        for out in range(4):
            entries = tuple(e for e in range(4) if out in _exits(cut, e))
            if entries:
                block = _block(cut, tuple(0 if s == out else None for s in range(4)), False, entries)
                for e in entries:
                    through[e][out] = block.values[e]
        total = [[_least(a + through[k][j] for k, a in enumerate(row) if a is not None and through[k][j] is not None) for j in range(4)] for row in total]
    return total


def _least(costs: Iterable[int]) -> int | None:
    return min(costs, default=None)


# ---- on Spark ----------------------------------------------------------------------------------

_KEY = ["conv_id", "turn", "role", "digest"]


def _plain(rows: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", "turn", *filled).withColumn("digest", F.unhex(F.sha2("text", 256)))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """One row per turn with its fault and its place ``at``: conv_id, turn, role, digest, fault, at.

    Turns of a conversation go by turn (nulls first), those of one turn by role and the text's SHA-256.
    The places of a conversation rise in that order, without gap inside a partition.  The text
    itself stays behind; the frame is written to the shared folder.
    """
    solid = r"[^\x20\x09-\x0D]"
    facts = _plain(rows).select(
        *_KEY,
        (~F.col("text").rlike(solid)).alias("_blank"),
        F.regexp_extract("text", rf"({solid})[\x20\x09-\x0D]*\z", 1).rlike(r"[^.!?]").alias("_open"),
    )
    # Copies of a row are one row with a number before anything is dealt out.
    counted = facts.groupBy(*_KEY, "_blank", "_open").agg(F.count(F.lit(1)).alias("_copies"))
    # The earliest turn of equal role and text, found again by its whole key, so no key is crowded.
    earliest = facts.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    seen = earliest.select(*[F.col(c).alias(f"_{c}") for c in _KEY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "turn")] + [F.col(c) == F.col(f"_{c}") for c in ("role", "digest")]
    marked = counted.join(seen, same, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    fault = (
        F.when(F.col("_blank"), "blank")
        .when((F.col("_copy") > 1) | F.col("_role").isNull(), "duplicate")
        .when(F.col("_open"), "truncated")
        .otherwise("")
    )
    order = [*_KEY, "_copy"]
    placed = (
        marked.select(*_KEY, "_copy", fault.alias("fault"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    return settle(placed.drop("_copy"), "turns")


def _kind() -> Column:
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    gone = F.translate(initial, PLAIN, GONE)
    return F.when(F.col("fault").isin("blank", "duplicate"), gone).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)


def _pieces(placed: DataFrame) -> DataFrame:
    """Per conversation and partition: the first place and the kinds of its rows, one letter each."""
    letters = F.transform(F.sort_array(F.collect_list(F.struct("at", _kind().alias("kind")))), lambda x: x["kind"])
    at = F.shiftright("at", 33)
    return placed.groupBy("conv_id", at.alias("_part")).agg(F.min("at").alias("first_at"), F.array_join(letters, "").alias("kinds"))


def _borders(cut: DataFrame) -> DataFrame:
    """For conversations of several pieces: first_at, entry, terminal and last of every piece."""
    crossed_type = "conv_id {}, first_at bigint, kinds string, costs array<bigint>".format(cut.schema["conv_id"].dataType.simpleString())

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [[-1 if c is None else c for row in crossing_costs(k) for c in row] for k in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "first_at", "kinds", "costs"])

    crossed = settle(cut.mapInArrow(cross, crossed_type), "crossed_pieces")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        # One row of 16 numbers per partition the conversation reaches into.
        group = group.sort_values("first_at")
        behind, out = list(END), []
        for k, (at, costs) in enumerate(zip(group["first_at"][::-1], group["costs"][::-1])):
            out.append((at, [-1 if v is None else v for v in behind], k == 0))
            if k == 0:
                # The last piece may end in any state that inserts can complete.
                behind = [0, 6, 3, 0]
            behind = [min(c + behind[j] for j, c in enumerate(costs[4 * e : 4 * e + 4]) if c >= 0) for e in range(4)]
        return pd.DataFrame(out, columns=["first_at", "terminal", "last"])

    small = crossed.select("conv_id", "first_at", "costs")
    ended = small.groupBy("conv_id").applyInPandas(ends, "first_at bigint, terminal array<bigint>, last boolean")
    ended = settle(crossed.select("conv_id", "first_at", "kinds").join(ended, "first_at"), "piece_ends")
    left_type = "conv_id {}, first_at bigint, states array<int>".format(cut.schema["conv_id"].dataType.simpleString())

    def leave(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [
                [edits_of(kinds, _read(terminal), last, e)[1] for e in range(4)]
                for kinds, terminal, last in zip(*(batch.column(c).to_pylist() for c in ("kinds", "terminal", "last")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("first_at"), pa.array(states, pa.list_(pa.int32()))], ["conv_id", "first_at", "states"])

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for at, states in group.sort_values("first_at")[["first_at", "states"]].itertuples(index=False):
            out.append((at, state))
            state = int(states[state])
        return pd.DataFrame(out, columns=["first_at", "entry"])

    columns = ["conv_id", "first_at", "kinds", "terminal", "last"]
    entered = ended.select(*columns).mapInArrow(leave, left_type).groupBy("conv_id").applyInPandas(enter, "first_at bigint, entry int")
    return ended.join(entered, "first_at").select(*columns, "entry")


def _read(terminal: list[int]) -> Terminal:
    return tuple(None if v < 0 else v for v in terminal)


def _edits(placed: DataFrame) -> DataFrame:
    """Per piece: conv_id, first_at, audit, cost, illegal pairs inside, first and last initial, rows of edits."""
    prepare_workers(placed.sparkSession)
    pieces = settle(_pieces(placed), "pieces")
    counted = pieces.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    ends = F.array(*[F.lit(-1 if v is None else v).cast("bigint") for v in END])
    whole = counted.where("_n = 1").select(
        "conv_id", "first_at", "kinds", ends.alias("terminal"), F.lit(True).alias("last"), F.lit(0).alias("entry")
    )
    ready = whole.unionByName(_borders(counted.where("_n > 1").select("conv_id", "first_at", "kinds")))
    rows_type = pa.list_(pa.struct([("before", pa.string()), ("edit", pa.string()), ("behind", pa.string())]))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kinds, terminal, last, entry in zip(*(batch.column(c).to_pylist() for c in ("kinds", "terminal", "last", "entry"))):
                rows, _ = edits_of(kinds, _read(terminal), last, entry)
                own = initials(kinds)
                illegal = sum(own[k : k + 2] not in LEGAL for k in range(len(own) - 1))
                out.append((audit_of(rows), cost_of(kinds, rows), illegal, own[:1], own[-1:], [dict(zip(("before", "edit", "behind"), r)) for r in rows]))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), rows_type)
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    added = "first_at bigint, audit string, cost bigint, illegal bigint, head string, tail string, edits array<struct<before:string,edit:string,behind:string>>"
    schema = StructType([placed.schema["conv_id"], *StructType.fromDDL(added)])
    names = schema.names
    return settle(ready.mapInArrow(solve, schema), "edits")


class Repair:
    """Plan of the repairs of ``rows`` (conv_id, turn, role, text); further columns are left out.

    A null role or text counts as one blank, rows with a null conv_id are one conversation, rows without
    turn come first.  Repeated rows are rows of their own (and duplicates).  The initial of a role
    decides whether a turn may be kept.  An empty frame has no conversations.  Starts jobs.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.placed = ordered_rows(rows)
        self.edits = _edits(self.placed)

    def conversations(self) -> DataFrame:
        """Per conversation: gaps, blank, duplicate, truncated, illegal, cost (all bigint) and audit."""
        fault = lambda name: F.count_if(F.col("fault") == name)
        per_turn = self.placed.groupBy("conv_id", "turn").agg(*[fault(x).alias(x) for x in ("blank", "duplicate", "truncated")])
        faults = per_turn.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
            *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
        )
        # A conversation has one piece for each partition it reaches into.
        follows = F.lag("tail").over(Window.partitionBy("conv_id").orderBy("first_at"))
        joint = F.when(follows.isNotNull() & ~F.concat(follows, "head").isin(*LEGAL), 1).otherwise(0)
        parts = F.transform(F.sort_array(F.collect_list(F.struct("first_at", "audit"))), lambda x: x["audit"])
        planned = (
            self.edits.withColumn("_joint", joint)
            .groupBy("conv_id")
            .agg(F.sum(F.col("illegal") + F.col("_joint")).alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts, "").alias("audit"))
        )
        return one_row_each(faults, planned)

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, at, slot, role, text, edit (K, R or I), in the order of (at, slot)."""
        each = self.edits.select("first_at", F.posexplode("edits")).select((F.col("first_at") + F.col("pos")).alias("at"), "col.*")
        edited = self.placed.select(*_KEY, "at").join(each, "at")
        texts = _plain(self.rows).groupBy(*_KEY).agg(F.first("text").alias("text"))
        found = texts.select(*[F.col(c).alias(f"_{c}") for c in _KEY], "text")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "turn")] + [F.col(c) == F.col(f"_{c}") for c in ("role", "digest")]
        # A row that stays is the first of its kind: its key meets one text.
        stays = edited.where("edit <> 'D'").join(found, same)
        named = lambda c: F.when(c == "u", ROLES["u"]).otherwise(ROLES["a"])
        new_role = F.when(F.col("edit") == "K", F.col("role")).otherwise(named(F.col("edit")))
        kept = stays.select("conv_id", "at", F.length("before").alias("slot"), new_role.alias("role"), "text", F.when(F.col("edit") == "K", "K").otherwise("R").alias("edit"))
        inserted = edited.select(
            "conv_id", "at", F.explode(F.concat(_slots("before", F.lit(0)), _slots("behind", F.length("before") + 1))).alias("_new")
        ).select("conv_id", "at", "_new.slot", named(F.col("_new.letter")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
        return kept.unionByName(inserted)


def _slots(column: str, base: Column) -> Column:
    letters = F.filter(F.split(column, ""), lambda c: c != "")
    return F.transform(letters, lambda c, k: F.struct((base + k).alias("slot"), c.alias("letter")))


def one_row_each(*frames: DataFrame) -> DataFrame:
    """Frames with at most one row per conv_id side by side; a null conv_id is a key like any other."""
    columns = [c for f in frames for c in f.columns if c != "conv_id"]
    together = frames[0]
    for f in frames[1:]:
        together = together.unionByName(f, allowMissingColumns=True)
    return together.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its turns as ``role:text`` lines, joined by line feeds.

    A hash runs over a conversation from its first byte to its last, so all its turns pass one task, in
    order and one batch at a time; the task holds no more of them than that.
    """
    prepare_workers(turns.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "repaired_sha256"]
        key, digest = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0), batch.column(1).to_pylist()):
                if digest is None or conv != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if done:
                keys = pa.array([k.as_py() for k, _ in done], batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array([d for _, d in done])], names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([digest.hexdigest()])], names)

    line = F.concat_ws(":", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "slot").select("conv_id", line.alias("line"))
    return dealt.mapInArrow(run, StructType([turns.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string")]))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the checksum of ``conv_id:turn`` modulo 20 (nulls: one blank).

    0 drops the row, 1 empties the text, 2 takes its full stops, exclamation and question marks, 3 has
    the row twice, 4 makes the role user.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("_way") == 4, "user").otherwise(text_of("role"))
    return (
        rows.select("conv_id", "turn", "role", "text", way.alias("_way"))
        .where("_way <> 0")
        .withColumn("_copy", F.explode(F.when(F.col("_way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", role.alias("role"), text.alias("text"))
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(rows))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = one_row_each(rows.select("conv_id").distinct(), repair.conversations(), turn_digests(repair.turns()))
    return both.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
