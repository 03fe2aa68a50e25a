"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

s, u and a are the initials of system, user and assistant. Keeping a turn costs 0, another role 2, deleting it 3, an
inserted empty turn 2; blank and repeated turns have to be deleted, truncated ones that stay cost 1 more. Of equally
cheap edits the least string of initials (D, I, K, R) is taken.

**Run-length dynamic programme.** Between two turns a conversation is in one of four states: at its start, after s,
after u, after a. A turn is a symbol of its role's initial and its fault, and a symbol a 4 by 4 matrix over (min, +).
Equal symbols in a row are one run, passed in a few products by the cached powers M, M^2, M^4, ... of its matrix. The
costs to the end that come out of this from the back decide each choice from the front: of the edits that keep to
the least cost, the first letter. State and letter leave one way on, so the choice is exact.

**Blocks.** Conversations have any length, so turns are dealt by ranges of (conversation, turn, role, text), and what a
task holds of one conversation is cut into blocks. Faults that need the whole conversation (repeated turns) come from
the least place of each digest; the matrices of blocks are multiplied from the last to the first in a stream of
one short row a block, and a second stream, in order, unrolls the choices with the state it has reached. Repeated
turns are told by 128-bit digests of role and text. A task never holds more than some blocks.

Null ids are one conversation. Null turns come first, ties by role and text, so repeated rows are neighbours. Null
roles and texts are one space. A role's initial is case-sensitive, and an empty role has none: it cannot be kept.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from ..sources.storage import written

START, S, U, A = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
FAR = 1 << 60
#: Bounds of a block, so that a batch of blocks stays small; they change no result.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 16
#: Leading characters of a text that range bounds are made of.
KEY_CHARS = 256
_visible, _wanted = re.compile(r"[^\x20\x09-\x0D]"), {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
_legal = {"su", "ua", "au"}

Matrix = tuple[tuple[int, ...], ...]


def _product(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a + y[k][j] for k, a in enumerate(row))) for j in range(4)) for row in x)


def _applied(x: Matrix, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(a + b for a, b in zip(row, after))) for row in x)


IDENTITY: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
#: Inserted turns alone: u where one is due, a after u. Two are enough to reach every state that can be reached.
_ONE = tuple(tuple(0 if i == j else INSERT if _wanted["u"].get(i) == j or _wanted["a"].get(i) == j else FAR for j in range(4)) for i in range(4))
INSERTS = _product(_ONE, _ONE)
#: Costs at the end of a conversation: it may end at its start and after a.
END = _applied(INSERTS, (0, FAR, FAR, 0))


def _letters(symbol: str) -> dict[str, tuple[int, dict[int, int]]]:
    """What can be done with a turn: letter -> (cost, state before -> state after). ``d`` is a turn that has to go,
    else the role's initial (``o``: any other), upper case when truncated."""
    if symbol == "d":
        return {"D": (DELETE, {q: q for q in range(4)})}
    more = TRUNCATED if symbol.isupper() else 0
    return {"D": (DELETE, {q: q for q in range(4)}), "K": (more, _wanted.get(symbol.lower(), {})), "R": (REROLE + more, _wanted["u"] | _wanted["a"])}


@functools.cache
def _power(symbol: str, bit: int) -> Matrix:
    """The matrix of 2**bit turns of one symbol, insertions before them included."""
    if bit:
        half = _power(symbol, bit - 1)
        return _product(half, half)
    one = [[FAR] * 4 for _ in range(4)]
    for cost, moves in _letters(symbol).values():
        for q, to in moves.items():
            one[q][to] = min(one[q][to], cost)
    return _product(INSERTS, tuple(map(tuple, one)))


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def advanced(runs: list[tuple[str, int]]) -> Matrix:
    """The matrix of runs (symbol, length)."""
    out = IDENTITY
    for symbol, n in runs:
        for b in _bits(n):
            out = _product(out, _power(symbol, b))
    return out


def before(runs: list[tuple[str, int]], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end at the start of ``runs``, from those behind them."""
    for symbol, n in reversed(runs):
        for b in _bits(n):
            after = _applied(_power(symbol, b), after)
    return after


def _inserted(state: int) -> int:
    return A if state == U else U


def unrolled(runs: list[tuple[str, int]], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters of the cheapest edits of ``runs`` from ``state``, and the state behind them.

    Costs inside a run are taken by single steps of its matrix from its end, whose costs the powers give.
    """
    ends = [after]
    for run in reversed(runs[1:]):
        ends.append(before([run], ends[-1]))
    out = []
    for (symbol, n), end in zip(runs, reversed(ends)):
        costs = [end]
        for _ in range(n - 1):
            costs.append(_applied(_power(symbol, 0), costs[-1]))
        letters, turn = _letters(symbol), _power(symbol, 0)
        for to_go in reversed(costs):
            here = _applied(turn, to_go)
            while True:
                best = {x: (cost, moves[state]) for x, (cost, moves) in letters.items() if state in moves and cost + to_go[moves[state]] == here[state]}
                if INSERT + here[_inserted(state)] == here[state] and "D" not in best:
                    out.append("I")
                    state = _inserted(state)
                    continue
                letter = min(best)
                out.append(letter)
                state = best[letter][1]
                break
    return "".join(out), state


def finished(state: int) -> str:
    """Insertions at the end of a conversation."""
    out = ""
    while END[state]:
        out, state = out + "I", _inserted(state)
    return out


def _role_symbol(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "o"


def _keep_roles(edits: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str], list[int]]:
    """Roles, texts and row numbers (-1: inserted) of the repaired turns of a block."""
    out, k = ([], [], []), 0
    for letter in edits:
        if letter == "D":
            k += 1
            continue
        if letter == "K":
            role = roles[k]
            state = _wanted[role[0]][state]
        else:
            state = _inserted(state)
            role = "user" if state == U else "assistant"
        for column, value in zip(out, (role, "" if letter == "I" else texts[k], -1 if letter == "I" else k)):
            column.append(value)
        k += letter != "I"
    return out


@dataclass
class _Block:
    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    chars: int = 0


BLOCKS = "block long, turns array<long>, roles array<string>, texts array<string>, symbols string, digests array<struct<place int, digest binary>>"


def _blocked(batches: Iterable[pa.RecordBatch], most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv, turn, role, text, gone) as one row per block, with the symbols that a row alone decides."""
    out: list[tuple] = []
    number = None

    def close(conv, block: _Block) -> None:
        nonlocal number
        symbols, digests, seen = [], [], set()
        for k, (role, text) in enumerate(zip(block.roles, block.texts)):
            end = text.rstrip(" \t\n\v\f\r")
            symbols.append(" " if not end else _role_symbol(role) if end[-1] in ".!?" else _role_symbol(role).upper())
            raw = role.encode()
            digest = hashlib.blake2b(b"%d:" % len(raw) + raw + text.encode(), digest_size=16).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append({"place": k, "digest": digest})
        out.append((conv, number, block.turns, block.roles, block.texts, "".join(symbols), digests))
        number += 1

    def batch(kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())]))]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", *(x.split()[0] for x in BLOCKS.replace("<place int, ", "<").split(", "))])
        out.clear()
        return made

    now, block, kind = None, None, None
    for rows in batches:
        kind = rows.schema.field("conv").type
        if number is None and rows.num_rows:
            number = rows.column(0)[0].as_py() << 33
        for _, conv, turn, role, text, gone in zip(*(c.to_pylist() for c in rows.columns)):
            if block is None or conv != now or len(block.turns) >= most_rows or block.chars >= most_chars:
                if block is not None:
                    close(now, block)
                now, block = conv, _Block()
            if not gone:
                block.turns.append(turn)
                block.roles.append(role)
                block.texts.append(text)
                block.chars += len(text)
        if len(out) >= 1000:
            yield batch(kind)
    if block is not None:
        close(now, block)
    if out:
        yield batch(kind)


RUNS = "runs array<struct<symbol string, n long>>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, rows long, first string, last string, low long, high long, distinct long"


def _in_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks (conv, block, turns, roles' and faults' symbols, places of first turns) as runs with their matrix and counts."""
    out = []
    for conv, number, turns, initials, symbols, firsts in zip(*(c.to_pylist() for c in batch.columns)):
        firsts, faults, final = set(firsts or ()), [0, 0, 0], []
        for k, x in enumerate(symbols):
            blank, again = x == " ", x != " " and k not in firsts
            faults[0] += blank
            faults[1] += again
            faults[2] += not blank and not again and x.isupper()
            final.append("d" if blank or again else x)
        runs = [(x, len(list(g))) for x, g in groupby(final)]
        roles = initials.lower()
        known = [t for t in turns if t is not None]
        out.append((
            conv, number, [{"symbol": x, "n": n} for x, n in runs], [x for row in advanced(runs) for x in row], *faults,
            sum(a + b not in _legal for a, b in zip(roles, roles[1:])), len(symbols), roles[:1] or None, roles[-1:] or None,
            min(known, default=None), max(known, default=None), len(set(known)),
        ))
    types = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.struct([("symbol", pa.string()), ("n", pa.int64())])), pa.list_(pa.int64()), *[pa.int64()] * 5, *[pa.string()] * 2, *[pa.int64()] * 3]
    names = ["conv", "block", "runs", "matrix", "blank", "duplicate", "truncated", "illegal", "rows", "first", "last", "low", "high", "distinct"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)


def _from_the_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first, with the costs to the end behind each and before its first."""
    now, after, begun = None, END, False
    for batch in batches:
        behind, ahead = [], []
        for conv, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist()):
            if not begun or conv != now:
                now, after, begun = conv, END, True
            behind.append(after)
            after = _applied(tuple(tuple(matrix[i : i + 4]) for i in range(0, 16, 4)), after)
            ahead.append(after[START])
        yield batch.drop_columns(["matrix"]).append_column("after", pa.array(behind, pa.list_(pa.int64()))).append_column("cost", pa.array(ahead, pa.int64()))


PIECES = "block long, edits string, roles array<string>, texts array<string>, places array<int>, turns array<long>, cost long, gaps long, blank long, duplicate long, truncated long, illegal long, last boolean"


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces of repaired conversations in order, from pairs of rows a block: its costs and counts, then its turns."""
    head, now, state, held, total, reach, cost = None, None, START, None, None, None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if not row["content"]:
                head = row
                continue
            if held is None or row["conv"] != now:
                if held is not None:
                    yield _last(held, state, total, reach)
                now, state, total, reach, cost = row["conv"], START, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), [None, None, 0, None], head["cost"]
            else:
                yield held
            for k in total:
                total[k] += head[k]
            if reach[3] is not None and head["first"] is not None and reach[3] + head["first"] not in _legal:
                total["illegal"] += 1
            reach[2] += head["distinct"] - (head["low"] is not None and head["low"] == reach[1])
            reach[0] = head["low"] if reach[0] is None else reach[0]
            reach[1] = reach[1] if head["high"] is None else head["high"]
            reach[3] = head["last"] or reach[3]
            edits, to = unrolled([(r["symbol"], r["n"]) for r in head["runs"]], tuple(head["after"]), state)
            roles, texts, places = _keep_roles(edits, row["roles"], row["texts"], state)
            held = {"conv": now, "block": row["block"], "edits": edits, "roles": roles, "texts": texts, "places": places, "turns": [None if k < 0 else row["turns"][k] for k in places], "cost": cost, "gaps": 0, "last": False, **dict.fromkeys(total, 0)}
            state = to
    if held is not None:
        yield _last(held, state, total, reach)


def _last(piece: dict, state: int, total: dict, reach: list) -> dict:
    """The last piece of a conversation, with insertions at its end and the counts of the whole."""
    for _ in finished(state):
        state = _inserted(state)
        piece["edits"] += "I"
        piece["roles"].append("user" if state == U else "assistant")
        piece["texts"].append("")
        piece["places"].append(-1)
        piece["turns"].append(None)
    low, high, distinct = reach[:3]
    return piece | total | {"gaps": 0 if low is None else high - low + 1 - distinct, "last": True}


def _pieces_out(kind: pa.DataType):
    types = [kind, pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 6, pa.bool_()]
    names = ["conv", *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]):
        rows, chars = [], 0
        for piece in _repaired(batches):
            rows.append(piece)
            chars += sum(map(len, piece["texts"]))
            if len(rows) >= 2000 or chars > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    return run


def _digests_out(kind: pa.DataType):
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        rows, digest, audit, first = [], hashlib.sha256(), [], True
        for piece in _repaired(batches):
            audit.append(piece["edits"])
            if piece["roles"]:
                lines = "\n".join([f"{r}:{t}" for r, t in zip(piece["roles"], piece["texts"])])
                digest.update((lines if first else "\n" + lines).encode())
                first = False
            if piece["last"]:
                rows.append((*(piece[n] for n in names[:7]), "".join(audit), digest.hexdigest()))
                digest, audit, first = hashlib.sha256(), [], True
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): faults by CRC-32 of ``conv:turn`` modulo 20 (nulls: one space).

    0 drops the row (``gone``, so that its conversation is still known), 1 empties its text, 2 takes out ``.!?``,
    3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(k == 1, "").when(k == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space(role)).alias("role"), said.alias("text"), (k == 0).alias("gone"), F.when(k == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) of conversations as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(False).alias("gone"))


def _stream(rows: DataFrame) -> DataFrame:
    """Two rows a block, in order: costs and counts (``content`` false), then turns. Rows of a conversation share a task."""
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.substring("text", 1, KEY_CHARS)]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, F.asc("tie"))
    dealt = dealt.sortWithinPartitions(*order[:3], F.asc("text")).select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "gone")
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = written(dealt.mapInArrow(tx.trimmed(functools.partial(_blocked, most_rows=BLOCK_ROWS, most_chars=BLOCK_CHARS)), f"conv {kind}, {BLOCKS}"), "conversations")

    digests = blocks.select("conv", "block", F.explode("digests").alias("d"))
    firsts = digests.groupBy("conv", "d.digest").agg(F.min(F.struct("block", "d.place")).alias("at")).groupBy(F.col("at.block").alias("block")).agg(F.collect_list("at.place").alias("firsts"))
    initials = F.array_join(F.transform("roles", lambda r: F.when(F.substring(r, 1, 1).isin("s", "u", "a"), F.substring(r, 1, 1)).otherwise("o")), "")
    narrow = blocks.select("conv", "block", "turns", initials.alias("initials"), "symbols").join(firsts, "block", "left").select("conv", "block", "turns", "initials", "symbols", "firsts")
    runs = tx.mapped(narrow, _in_runs, f"conv {kind}, block long, {RUNS}")
    back = runs.repartition("conv").sortWithinPartitions(F.asc("conv"), F.desc("block"))
    schema = f"conv {kind}, block long, {RUNS}".replace("matrix array<long>, ", "") + ", after array<long>, cost long"
    heads = back.mapInArrow(tx.trimmed(_from_the_back), schema).withColumn("content", F.lit(False))
    both = heads.unionByName(blocks.select("conv", "block", "turns", "roles", "texts").withColumn("content", F.lit(True)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "block", "content")


def _arrow_kind(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv"].dataType)


def repaired_pieces(rows: DataFrame) -> DataFrame:
    """Repaired conversations from rows (conv, turn, role, text, gone), in pieces (conv, block) of bounded size.

    ``edits`` are the letters of a piece; roles, texts, places (row in the block, -1: inserted) and turns those of what
    stays; ``last`` marks the piece with the counts of the whole conversation. Long conversations have several pieces.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    return _stream(rows).mapInArrow(tx.trimmed(_pieces_out(_arrow_kind(rows))), f"conv {kind}, {PIECES}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv, block, place, turn, role, text) of every turn that stays or is inserted (turn null); (block, place) orders them."""
    p = repaired_pieces(rows).select("conv", "block", F.posexplode(F.arrays_zip("turns", "roles", "texts")).alias("place", "t"))
    return p.select("conv", "block", "place", F.col("t.turns").alias("turn"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def repair_audit(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv, turn, role, text, gone): gaps, faults, cost, audit and the repaired text's SHA-256.

    The digest of a text is made from its first byte to its last, so this step is one stream per conversation; it reads
    one row per block and holds a block at a time.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _stream(rows).mapInArrow(tx.trimmed(_digests_out(_arrow_kind(rows))), schema)


def conversation_repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair_audit`` of damaged conversations, for every conversation of the table."""
    return repair_audit(damaged(conversations, conv, turn, role, text)).withColumnRenamed("conv", conv)
