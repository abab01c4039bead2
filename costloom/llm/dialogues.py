"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Edits: keep (K, no
cost), change the role (R, 3), delete (D, 4), insert an empty user or assistant turn (I, 3); a blank or repeated row must
be deleted, and a row that ends without ``.``, ``!`` or ``?`` and stays costs 3 more. The cheapest edits win, and among
those the string of initials that sorts first.

Rows are sorted over the whole table by conversation and turn into ranges, so a conversation of any length spreads over
many tasks. Costs-to-go are four numbers, one for each state of the wanted pattern. Each range starts from a speculative
vector at its end; passes run again with the vector that the next range has found until the two differ by a constant
only, which is after few rows as a rule. With the costs of all ranges in place, edits are traced forward.

Nulls in role or text read as one space; a null conversation id is an id like others; rows of null turn come first. Ties
in turn are ordered by a hash of role and text, equal rows one after the other. Texts of any length are read whole. A
table without rows gives none. Only the four named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from costloom.llm.storage import stored
from costloom.operators.joins import lookup

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # what a role begins with
BLANK, DUPLICATE, CUT = 1, 2, 3  # first fault of a row; a row's kind is its role's number + 4 * its fault
# States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
USER_NEXT, NEXT = (True, True, False, True), (2, 2, 3, 2)
FINAL = (0, 2 * INSERT, INSERT, 0)  # costs to end in each state
UNKNOWN = (0, 0, 0, 0)
CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20  # of a stored piece of a conversation
RANGE_ROWS, RANGE_BYTES = 500_000, 64 << 20  # of the rows that one task sorts
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True

Vector = tuple[int, int, int, int]


class Steps:
    """Steps of the search over one row, remembered by the vector behind it and the row's kind; both are few."""

    def __init__(self) -> None:
        self.known: dict[tuple[Vector, int], tuple[Vector, list[tuple[str, int, int]]]] = {}

    def over(self, after: Vector, kind: int) -> tuple[Vector, list[tuple[str, int, int]]]:
        """The vector before the row less its minimum, and per state the initials, next state and cost of its edits."""
        found = self.known.get((after, kind))
        if found is None:
            found = self.known[after, kind] = self._over(after, kind)
        return found

    @staticmethod
    def _over(after: Vector, kind: int) -> tuple[Vector, list[tuple[str, int, int]]]:
        role, fault = kind % 4, kind // 4
        extra = TRUNCATED if fault == CUT else 0

        def moves(state: int) -> Iterator[tuple[str, int, int]]:
            yield "D", state, DELETE
            if fault not in (BLANK, DUPLICATE):
                if (role == USER and USER_NEXT[state]) or (role == ASSISTANT and not USER_NEXT[state]):
                    yield "K", NEXT[state], extra
                if role == SYSTEM and state == 0:
                    yield "K", 1, extra
                yield "R", NEXT[state], REROLE + extra

        base = [min(cost + after[to] for _, to, cost in moves(s)) for s in range(4)]
        costs = list(base)
        for _ in range(2):  # a second insertion may follow the first
            costs = [min(base[s], INSERT + costs[NEXT[s]]) for s in range(4)]
        tables = []
        for start in range(4):
            letters, state, spent = "", start, 0
            while True:
                options = [(letter, to, cost) for letter, to, cost in moves(state) if cost + after[to] == costs[state]]
                if INSERT + costs[NEXT[state]] == costs[state]:
                    options.append(("I", state, INSERT))
                letter, to, cost = min(options)
                letters, spent = letters + letter, spent + cost
                if letter != "I":
                    tables.append((letters, to, spent))
                    break
                state = NEXT[state]
        least = min(costs)
        return tuple(c - least for c in costs), tables

    def backward(self, kinds: bytes, after: Vector) -> list[Vector]:
        """Vectors behind each row, and the one before all of them at the front."""
        vectors = [after]
        for kind in reversed(kinds):
            after, _ = self.over(after, kind)
            vectors.append(after)
        vectors.reverse()
        return vectors

    def trace(self, kinds: bytes, vectors: list[Vector], state: int) -> tuple[list[str], int, int]:
        """Initials of each row's edits, the state behind them and their cost."""
        letters, spent = [], 0
        for kind, after in zip(kinds, vectors[1:]):
            some, state, cost = self.known[after, kind][1][state]
            letters.append(some)
            spent += cost
        return letters, state, spent


def ending(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (FINAL[state] // INSERT)


def edited(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    row, new_roles, new_texts = 0, [], []
    for letter in letters:
        role = "user" if USER_NEXT[state] else "assistant"
        if letter == "I":
            new_roles.append(role)
            new_texts.append("")
            state = NEXT[state]
            continue
        if letter != "D":
            new_roles.append(roles[row] if letter == "K" else role)
            new_texts.append(texts[row])
            state = 1 if letter == "K" and state == 0 and roles[row][:1] == "s" else NEXT[state]
        row += 1
    return new_roles, new_texts


def _kind(role: Column, text: Column, repeated: Column) -> Column:
    """Number of a row's role and first fault."""
    first = F.substring(role, 1, 1)
    number = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(repeated, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    return number + 4 * fault


def judged_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``id``, ``turn``, ``role``, ``text``, ``kind`` and what orders them.

    Groups of equal rows are counted with map-side combine, and only groups of several rows are joined back: by broadcast
    if they are measured to be few, else by a shuffle that cuts hot groups into slices.
    """
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text")
    rows = conversations.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role, text)
    content = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    rows = stored(rows.withColumns({"content": content, "place": F.monotonically_increasing_id()}), "turns")
    key = F.struct(F.col("id").isNull(), "id")  # a null id is joined like others
    rows = rows.withColumn("whose", F.sha2(F.to_json(key), 256))
    groups = rows.groupBy("whose", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "place")).alias("first"))
    several = stored(groups.where("n > 1").drop("n"), "repeated")
    met = lookup(rows, several, ["whose", "content"], "left", spread_by=["place"])
    repeated = F.col("first").isNotNull() & (F.col("first.place") != F.col("place"))
    return met.select("id", "turn", "content", "place", "role", "text", _kind(F.col("role"), F.col("text"), repeated).cast("byte").alias("kind"))


CHUNK = (
    "part int, seg long, n long, opens boolean, closes boolean, kinds binary, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, roles array<string>, texts array<string>"
)


class _Cutter:
    """Cuts the sorted rows of one task into pieces of conversations."""

    def __init__(self, part: int, names: list[str]) -> None:
        self.part, self.names = part, names
        self.n, self.seg, self.open = 0, 0, False  # whether the last conversation goes on

    def cut(self, rows: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Pieces of all rows but the end of the last conversation, and those rows; all rows if ``final``."""
        codes = pc.dictionary_encode(rows["id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        stops = np.append(starts[1:], len(codes))
        total = np.concatenate([[0], np.cumsum(pc.binary_length(rows["text"]).to_numpy().astype(np.int64))])
        edges, meta = [], []
        for at, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist())):
            whole = final or at < len(starts) - 1
            while start < stop:
                end = min(start + CHUNK_ROWS, int(np.searchsorted(total, total[start] + CHUNK_BYTES, side="right")) - 1, stop)
                end = max(end, start + 1)
                if end == stop and not whole:
                    break
                edges.append((start, end))
                meta.append((self.seg, not self.open, whole and end == stop))
                self.open, start = end < stop, end
            if whole:
                self.open = False
                self.seg += 1
        done = edges[-1][1] if edges else 0
        return (self._pieces(rows.slice(0, done), np.array(edges), meta) if edges else None), rows.slice(done)

    def _pieces(self, rows: pa.Table, edges: np.ndarray, meta: list[tuple[int, bool, bool]]) -> pa.RecordBatch:
        first, last = edges[:, 0], edges[:, 1]
        inner = np.ones(len(rows), bool)
        inner[first] = False
        kinds = rows["kind"].to_numpy().astype(np.uint8)
        fault, role = kinds // 4, kinds % 4
        legal = np.concatenate([[True], _LEGAL[role[:-1], role[1:]]])
        known = pc.is_valid(rows["turn"]).to_numpy()
        turn = pc.fill_null(rows["turn"], 0).to_numpy()
        again = np.concatenate([[False], (turn[1:] == turn[:-1]) & known[:-1]]) & inner
        summed = [np.add.reduceat(v.astype(np.int64), first) for v in (known & ~again, *(fault == f for f in (BLANK, DUPLICATE, CUT)), ~legal & inner)]
        raw = kinds.tobytes()
        # Nulls come first, so a piece's last turn is its greatest and its first known one the least.
        least = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), first)
        some = summed[0] > 0
        places = pa.array(np.append(first, last[-1]), pa.int32())
        lists = [pa.ListArray.from_arrays(places, rows[c].combine_chunks()) for c in ("role", "text")]
        number = np.arange(self.n, self.n + len(edges))
        self.n += len(edges)
        columns = [
            rows["id"].combine_chunks().take(pa.array(first)), pa.array(np.full(len(edges), self.part, np.int32)),
            *(pa.array([m[0] for m in meta], pa.int64()), pa.array(number), pa.array([m[1] for m in meta]), pa.array([m[2] for m in meta])),
            pa.array([raw[i:j] for i, j in edges.tolist()], pa.binary()),
            pa.array(least, mask=~some), pa.array(turn[last - 1], mask=~some), *(pa.array(v) for v in summed), *lists,
        ]
        return pa.RecordBatch.from_arrays(columns, self.names)


def cut_conversations(rows: DataFrame) -> DataFrame:
    """Pieces of conversations of at most ``CHUNK_ROWS`` rows and about ``CHUNK_BYTES``, stored: their range (``part``),
    conversation inside it (``seg``) and number (``n``), whether they open and close the conversation in that range."""
    spark = rows.sparkSession
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(CHUNK)])
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS), -(-(n_bytes or 0) // RANGE_BYTES))
    order = ["id", "turn", "content", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = _Cutter(TaskContext.get().partitionId(), schema.names), None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                pieces, held = cutter.cut(table if held is None else pa.concat_tables([held, table]), False)
                if pieces is not None:
                    yield pieces
        if held is not None and held.num_rows:
            yield cutter.cut(held, True)[0]

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.select("id", "turn", "role", "text", "kind").mapInArrow(run, schema), "pieces")


def linked_ranges(pieces: DataFrame) -> list[tuple[int, int, int]]:
    """(range, number of its last conversation, next range) where a conversation goes on in the next range.

    The driver receives one row per range, that is, per task.
    """
    ends = pieces.groupBy("part").agg(F.min_by("id", "n").alias("first"), F.max_by("id", "n").alias("last"), F.max("seg").alias("seg"))
    ranges = sorted(ends.collect(), key=lambda r: r["part"])
    return [(p["part"], p["seg"], q["part"]) for p, q in zip(ranges, ranges[1:]) if p["last"] == q["first"]]


def _by_range(kinds: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(part, [(seg, n, kinds)])`` for the pieces of each range; a task holds a byte per row of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and row[0] != part:
                    yield solve(part, rows)
                    rows = []
                part = row[0]
                rows.append(row[1:])
        if rows:
            yield solve(part, rows)

    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kinds.select("part", "seg", "n", "kinds").repartition(parts, "part").sortWithinPartitions("part", "n")
    return dealt.mapInArrow(run, schema)


def _segments(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    first = 0
    for at in range(1, len(rows) + 1):
        if at == len(rows) or rows[at][0] != rows[first][0]:
            yield rows[first][0], [(n, kinds) for _, n, kinds in rows[first:at]]
            first = at


def converge(kinds: DataFrame, links: list[tuple[int, int, int]]) -> tuple[dict[int, Vector], dict[int, int]]:
    """For each linked range the vector behind its last conversation (up to a constant), and the state in which the next
    range takes that conversation over.

    All linked ranges run at once from ``UNKNOWN``; those whose vector was not the next range's, up to a constant, run
    again. A pass tells the driver one vector and one map of states per linked range.
    """
    seg_of, follower = {p: seg for p, seg, _ in links}, {p: q for p, _, q in links}
    ends: dict[int, Vector] = {p: UNKNOWN for p in seg_of}
    starts: dict[int, Vector] = {}
    exits: dict[int, list[int]] = {}
    heads = set(follower.values())
    due = set(seg_of) | heads
    while due:
        behind = {p: ends[p] for p in due if p in ends}

        def solve(part: int, rows: list[tuple[int, int, bytes]], behind=behind) -> pa.RecordBatch:
            steps, out = Steps(), []
            for seg, pieces in _segments(rows):
                if seg == 0 or seg == seg_of.get(part):
                    whole = b"".join(kinds for _, kinds in pieces)
                    goes_on = seg == seg_of.get(part)
                    vectors = steps.backward(whole, behind[part] if goes_on else FINAL)
                    out.append((part, seg == 0, goes_on, list(vectors[0]), [steps.trace(whole, vectors, s)[1] for s in range(4)]))
            names = ["part", "heads", "goes_on", "start", "exits"]
            types = [pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        schema = "part int, heads boolean, goes_on boolean, start array<int>, exits array<int>"
        for row in _by_range(kinds.where(F.col("part").isin(sorted(due))), solve, schema).collect():
            if row["heads"]:
                starts[row["part"]] = tuple(row["start"])
            if row["goes_on"]:
                exits[row["part"]] = row["exits"]
        due = {p for p, q in follower.items() if ends[p] != starts[q]}
        ends |= {p: starts[follower[p]] for p in due}
    states: dict[int, int] = {}
    for p, seg, q in sorted(links):
        states[q] = exits[p][states.get(p, 0) if seg == 0 else 0]
    return ends, states


def trace_long(kinds: DataFrame, links: list[tuple[int, int, int]]) -> DataFrame:
    """``part``, ``n``, ``state`` before the piece, initials of its edits (``audit``) and their ``cost``."""
    ends, states = converge(kinds, links) if links else ({}, {})
    seg_of = {p: seg for p, seg, _ in links}

    def solve(part: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        steps, out = Steps(), []
        for seg, pieces in _segments(rows):
            goes_on = seg == seg_of.get(part)
            whole = b"".join(piece for _, piece in pieces)
            vectors = steps.backward(whole, ends[part] if goes_on else FINAL)
            state, first = states.get(part, 0) if seg == 0 else 0, 0
            for at, (n, piece) in enumerate(pieces):
                letters, after, cost = steps.trace(piece, vectors[first : first + len(piece) + 1], state)
                last = ending(after) if at == len(pieces) - 1 and not goes_on else ""
                out.append((part, n, state, "".join(letters) + last, cost + INSERT * len(last)))
                state, first = after, first + len(piece)
        types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "state", "audit", "cost"])

    return _by_range(kinds, solve, "part int, n long, state int, audit string, cost long")


def _edited(rows: DataFrame, known: bool) -> DataFrame:
    """Pieces with their edits applied; without ``known`` edits, each row is a whole conversation."""
    schema = T.StructType([*rows.schema, *([] if known else T.StructType.fromDDL("audit string, cost long"))])
    names, given = schema.names, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in given}
            if known:
                states, audits = columns["state"].to_pylist(), columns["audit"].to_pylist()
            else:
                states, audits, costs = [0] * batch.num_rows, [], []
                for kinds in columns["kinds"].to_pylist():
                    letters, state, cost = steps.trace(kinds, steps.backward(kinds, FINAL), 0)
                    audits.append("".join(letters) + ending(state))
                    costs.append(cost + INSERT * len(ending(state)))
                columns |= {"audit": pa.array(audits, pa.string()), "cost": pa.array(costs, pa.int64())}
            new = [edited(*row) for row in zip(audits, states, columns["roles"].to_pylist(), columns["texts"].to_pylist())]
            columns |= {c: pa.array([r[k] for r in new], pa.list_(pa.string())) for k, c in enumerate(("roles", "texts"))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return rows.mapInArrow(run, schema)


@dataclass
class Repair:
    pieces: DataFrame  # id, part, n, audit, cost, repaired roles and texts, and counts of faults

    @property
    def messages(self) -> DataFrame:
        """``id``, ``part``, ``n``, ``at`` (which order the turns), ``role`` and ``text`` after the repair."""
        turns = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn")
        return self.pieces.select("id", "part", "n", turns).select(
            "id", "part", "n", "at", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")
        )

    @property
    def report(self) -> DataFrame:
        """Per conversation with rows: ``id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
        ``audit`` and ``repaired_sha256`` (of ``role:text`` lines).

        Conversations in one piece are answered where they lie. The hash of a longer one needs its bytes in order: its
        pieces, already joined to lines, are sorted into one task and read one by one.
        """
        lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
        whole = self.pieces.where("opens and closes").select(
            "id", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
            "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"),
        )
        return whole.unionByName(_joined(self.pieces.where("not (opens and closes)").withColumn("lines", lines), whole.schema))


def _joined(pieces: DataFrame, schema: T.StructType) -> DataFrame:
    """Reports of conversations in several pieces."""
    columns = ["id", "part", "n", "kinds", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def finish() -> pa.RecordBatch:
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["first"] is not None else 0
            values = [now["id"], gaps, *now["counts"], "".join(now["audit"]), now["hash"].hexdigest()]
            arrow = pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema=target)
            return arrow

        target = None
        for batch in batches:
            kind = batch.schema.field(0).type
            target = target or pa.schema([("id", kind), *((c, pa.int64()) for c in schema.names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if now is None or now["id"] != row["id"]:
                    if now is not None:
                        yield finish()
                    now = {"id": row["id"], "first": None, "last": None, "turns": 0, "counts": [0] * 5, "audit": [], "hash": hashlib.sha256(), "role": None, "empty": True}
                counts = [row[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
                if now["role"] is not None and not _LEGAL[now["role"], row["kinds"][0] % 4]:
                    counts[3] += 1
                now["counts"] = [x + y for x, y in zip(now["counts"], counts)]
                now["role"] = row["kinds"][-1] % 4
                if row["first_turn"] is not None:
                    now["turns"] += row["turns"] - (now["last"] == row["first_turn"])
                    now["first"] = row["first_turn"] if now["first"] is None else now["first"]
                    now["last"] = row["last_turn"]
                now["audit"].append(row["audit"])
                if row["some"]:
                    now["hash"].update((b"" if now["empty"] else b"\n") + row["lines"].encode())
                    now["empty"] = False
        if now is not None:
            yield finish()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select(*columns, "lines", (F.size("roles") > 0).alias("some")).repartition(parts, "id").sortWithinPartitions("id", "part", "n")
    return dealt.mapInArrow(run, schema)


def repaired(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """Repair every conversation at the least cost."""
    judged = judged_rows(conversations, id_col, turn_col, role_col, text_col)
    pieces = cut_conversations(judged)
    links = linked_ranges(pieces)
    going_on = F.lit(False)
    if links:
        # One row per range at most, so the list is as short as the list of tasks.
        ends = [(p, seg) for p, seg, _ in links] + [(q, 0) for _, _, q in links]
        marks = F.broadcast(pieces.sparkSession.createDataFrame(sorted(set(ends)), "part int, seg long").withColumn("goes_on", F.lit(True)))
        pieces = pieces.join(marks, ["part", "seg"], "left")
        going_on = F.coalesce("goes_on", F.lit(False))
    marked = pieces.withColumn("closes", F.col("closes") & ~going_on).drop("goes_on")
    short = _edited(marked.where("opens and closes"), known=False)
    long = marked.where("not (opens and closes)")
    traced = trace_long(long, links)
    both = _edited(long.join(traced, ["part", "n"]), known=True).drop("state")
    return Repair(stored(short.unionByName(both), "repaired"))
