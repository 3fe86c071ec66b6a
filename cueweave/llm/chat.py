"""Chat formatting: conversations repaired at least cost, then rendered.

A legal conversation is accepted by a small automaton: perhaps a system turn,
then user and assistant in turn, ending with the assistant. For each turn a
dynamic program over its states chooses to keep or relabel it, to merge it with
the turn before, and to insert empty turns. The cost of a stretch of turns is a
matrix (state before, state after) and stretches join by the min-plus product,
so a conversation of any length is cut into blocks: matrices per block, one
small row each; one pass forward and one back over those rows; then each block
is traced between its two states on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import stored

STATES = ("start", "system", "user", "assistant")
#: Legal next turns of each state; the last one may end a conversation.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
FAR = 1 << 40
#: Turn numbers per block, and rows beyond which a block is cut at every turn and within one.
WIDTH, CROWDED = 512, 4096
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n"


def _routes() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest insertions that lead from one state to another, for all pairs."""
    found = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in list(found.items()):
            for c in NEXT[b]:
                if (a, c) not in found or len(path) + 1 < len(found[a, c]):
                    found[a, c] = (*path, c)
    return found


ROUTES = _routes()


def moves(role: str | None) -> list[list[tuple[int, str, tuple[int, ...]] | None]]:
    """Cheapest (cost, action, inserted turns) of a turn, by state before and after; ties go to the first listed."""
    own = STATES.index(role) if role in STATES[1:] else None
    wrong = RELABEL_UNKNOWN if own is None else RELABEL
    table: list[list[tuple[int, str, tuple[int, ...]] | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        for after in range(1, 4):
            label = 0 if after == own else wrong
            options = []
            if before == after:
                options.append((MERGE + label, "merge" if after == own else "merge relabelled", ()))
            for through in range(4):
                path = ROUTES.get((before, through))
                if path is not None and after in NEXT[through]:
                    options.append((INSERT * len(path) + label, "keep" if after == own else "relabel", path))
            if options:
                table[before][after] = min(options, key=lambda o: o[0])
    return table


MOVES = {r: moves(r) for r in (*STATES[1:], None)}
ENDINGS = [INSERT * len(ROUTES[s, FINAL]) for s in range(4)]


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in STATES[1:] else None


def product(vector: list[int], matrix: list[int]) -> list[int]:
    return [min(vector[a] + matrix[4 * a + b] for a in range(4)) for b in range(4)]


def block_matrix(roles: list[str | None]) -> list[int]:
    rows = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        step = [FAR if m is None else m[0] for line in MOVES[_known(role)] for m in line]
        rows = [product(v, step) for v in rows]
    return [min(FAR, x) for v in rows for x in v]


def trace(roles: list[str | None], start: int, end: int) -> list[tuple[int, str, tuple[int, ...], int]]:
    """(state, action, inserted, cost) of each turn on the cheapest way from `start` to `end`."""
    best = [[FAR] * 4]
    best[0][start] = 0
    back = []
    for role in roles:
        table, last = MOVES[_known(role)], best[-1]
        line, choice = [FAR] * 4, [0] * 4
        for after in range(4):
            for before in range(4):
                m = table[before][after]
                if m is not None and last[before] + m[0] < line[after]:
                    line[after], choice[after] = last[before] + m[0], before
        best.append(line)
        back.append(choice)
    out, state = [], end
    for role, choice in zip(reversed(roles), reversed(back)):
        before = choice[state]
        cost, action, inserted = MOVES[_known(role)][before][state]
        out.append((state, action, inserted, cost))
        state = before
    return out[::-1]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a sorted partition as tuples, grouped by their first columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def render(frame: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id`, `place`, `turn`, `action`, `role`, `cost`, `fragment` per repaired turn.

    The fragments of a conversation in order of `place` are its rendering; they
    stay rows, as a conversation may be too long for one. Turns go by number,
    null numbers last, equal ones by a hash of role and text. Rows that repeat
    another in all four columns are one turn. An unknown, empty or null role is
    relabelled cheaply; a null text is an empty one; rows without a conversation
    are one conversation, with a null id. An inserted turn has a null `turn` and
    an empty text. Ties between repairs go to merging before keeping, and to the
    earlier state of `STATES`. An empty table gives none. Other columns are not
    read.
    """
    last = (1 << 62)
    rows = frame.select(
        F.col(conv).cast("bigint").alias("c"), F.coalesce(F.col(turn).cast("bigint"), F.lit(last)).alias("t"),
        F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).distinct()
    rows = rows.withColumn("h", F.xxhash64("r", "x")).withColumn("b1", F.floor(F.col("t") / WIDTH).cast("bigint"))
    crowded = rows.groupBy("c", "b1").count().where(F.col("count") > CROWDED).select(
        F.col("c").alias("c_"), F.col("b1").alias("b_"), F.lit(True).alias("crowded"))
    rows = rows.join(crowded, F.col("c").eqNullSafe(F.col("c_")) & (F.col("b1") == F.col("b_")), "left").drop("c_", "b_")
    rows = rows.withColumn("b2", F.when(F.col("crowded"), F.col("t")).otherwise(0)).withColumn(
        "b3", F.when(F.col("crowded"), F.shiftright("h", 52)).otherwise(0))
    keys, order = ["c", "b1", "b2", "b3"], ["c", "b1", "b2", "b3", "t", "h", "r", "x"]
    rows = stored(rows.select(*order), "turns")
    key_schema = [(k, pa.int64()) for k in keys]

    def summarise(batches):
        schema = pa.schema([*key_schema, ("m", pa.list_(pa.int64()))])
        yield from _batches(((*k, block_matrix([r[4] for r in g])) for k, g in _grouped(batches, 4)), schema)

    def forward(batches):
        schema = pa.schema([*key_schema, ("m", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))])

        def run():
            for _, blocks in _grouped(batches, 1):
                v = [0, FAR, FAR, FAR]
                for *k, m in blocks:
                    yield (*k, m, v)
                    v = [min(FAR, x) for x in product(v, m)]
        yield from _batches(run(), schema)

    def backward(batches):
        schema = pa.schema([*key_schema, ("s", pa.int32()), ("e", pa.int32()), ("last", pa.bool_())])

        def run():
            for _, blocks in _grouped(batches, 1):
                state = None
                for *k, m, v in blocks:
                    final = state is None
                    if final:
                        ends = product(v, m)
                        state = min(range(4), key=lambda s: ends[s] + ENDINGS[s])  # noqa: B023
                    before = min(range(4), key=lambda s: v[s] + m[4 * s + state])  # noqa: B023
                    yield (*k, before, state, final)
                    state = before
        yield from _batches(run(), schema)

    def write(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.list_(pa.int64())), ("turn", pa.int64()), ("action", pa.string()),
                            ("role", pa.string()), ("cost", pa.int32()), ("fragment", pa.string())])

        def run():
            for (c, b1, b2, b3), group in _grouped(batches, 4):
                group = list(group)
                start, end, final = group[0][8:]
                state, n = start, 0

                def opened(to):
                    return (CLOSE if state else "") + OPEN.format(STATES[to])  # noqa: B023

                for row, (to, action, inserted, cost) in zip(group, trace([r[6] for r in group], start, end)):
                    for extra in inserted:
                        yield c, [b1, b2, b3, n], None, "insert", STATES[extra], INSERT, opened(extra)
                        state, n, cost = extra, n + 1, cost - INSERT
                    fragment = JOIN + row[7] if action.startswith("merge") else opened(to) + row[7]
                    yield c, [b1, b2, b3, n], None if row[4] == last else row[4], action, STATES[to], cost, fragment
                    state, n = to, n + 1
                if final:
                    for extra in ROUTES[state, FINAL]:
                        yield c, [b1, b2, b3, n], None, "insert", STATES[extra], INSERT, opened(extra)
                        state, n = extra, n + 1
                    yield c, [b1, b2, b3, n], None, "end", None, 0, CLOSE
        yield from _batches(run(), schema)

    def dealt(frame, by, order):
        n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return frame.repartition(n, *by).sortWithinPartitions(*order)

    block = "c bigint, b1 bigint, b2 bigint, b3 bigint"
    sums = dealt(rows.select(*keys, "r", "t", "h"), keys, [*keys, "t", "h", "r"]).select(*keys, "r").mapInArrow(summarise, f"{block}, m array<bigint>")
    ahead = dealt(sums, ["c"], keys).mapInArrow(forward, f"{block}, m array<bigint>, v array<bigint>")
    down = [F.col("c"), *[F.col(b).desc() for b in keys[1:]]]
    states = stored(dealt(ahead, ["c"], down).mapInArrow(backward, f"{block}, s int, e int, last boolean"), "states")
    states = states.toDF("c_", "b1_", "b2_", "b3_", "s", "e", "last")
    same = F.col("c").eqNullSafe(F.col("c_")) & (F.col("b1") == F.col("b1_")) & (F.col("b2") == F.col("b2_")) & (F.col("b3") == F.col("b3_"))
    placed = rows.join(states, same).select(*keys, "t", "h", "r", "x", "s", "e", "last")
    return dealt(placed, keys, order).mapInArrow(
        write, "conv_id bigint, place array<bigint>, turn bigint, action string, role string, cost int, fragment string")
