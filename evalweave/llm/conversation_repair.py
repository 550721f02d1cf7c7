"""Repair of the turn structure of conversations by generalised LR parsing with weighted edits.

The role grammar's LR automaton is derived from its rules. A frontier holds the tops of a
graph-structured stack: a node is a state on another node, equal nodes are one node, and each top keeps
the least (cost, audit) of all edits that lead to it. A row is kept or reroled (shifted), or deleted;
turns may be inserted anywhere. Two equal tops have consumed the same rows, so the lesser of their
(cost, audit) stays the lesser whatever follows: equal costs mean equally many insertions, and neither
audit is a prefix of the other.

A long conversation is cut into blocks of rows. The grammar leaves few stacks, so a block is parsed from
each of them on its own, and a block's result is the least edits from stack to stack. A conversation
folds these results in order; only its digest reads all of its texts in one sequence, as SHA-256 asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents, written

# The grammar of role initials, the costs of edits, pairs of neighbours that are in order.
GRAMMAR = [("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua")]
RESULT = "C"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
IN_ORDER = {"su", "ua", "au"}
SIGNS = ("s", "u", "a")
BLANKS = " \t\n\x0b\x0c\r"

BLOCK_ROWS = 512

# ---- automaton and stacks ----------------------------------------------------------------------


def automaton() -> tuple[list[frozenset], list[dict[str, int]]]:
    """LR(0) states, as sets of (rule, dot), and their transitions."""

    def closed(items: set) -> frozenset:
        items, work = set(items), list(items)
        while work:
            rule, dot = work.pop()
            ahead = GRAMMAR[rule][1][dot : dot + 1]
            new = {(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == ahead} - items
            items |= new
            work.extend(new)
        return frozenset(items)

    states = [closed({(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == RESULT})]
    moves: list[dict[str, int]] = []
    for state in states:  # grows while it runs
        out = {}
        for sign in sorted({GRAMMAR[r][1][d] for r, d in state if d < len(GRAMMAR[r][1])}):
            target = closed({(r, d + 1) for r, d in state if GRAMMAR[r][1][d : d + 1] == sign})
            if target not in states:
                states.append(target)
            out[sign] = states.index(target)
        moves.append(out)
    return states, moves


STATES, MOVES = automaton()
Node = tuple  # (state, node below)
ROOT: Node = (0, None)


def shift(node: Node, sign: str) -> Node | None:
    """The stack after ``sign`` and all reductions that follow, or None where it can't stand."""
    return _shift(node, sign) if sign in SIGNS else None


@cache
def _shift(node: Node, sign: str) -> Node | None:
    target = MOVES[node[0]].get(sign)
    if target is None:
        return None
    node = (target, node)
    while done := [r for r, d in STATES[node[0]] if d == len(GRAMMAR[r][1]) and GRAMMAR[r][0] != RESULT]:
        left, right = GRAMMAR[done[0]]
        for _ in right:
            node = node[1]
        node = (MOVES[node[0]][left], node)
    return node


def accepts(node: Node) -> bool:
    return any(GRAMMAR[r][0] == RESULT and d == len(GRAMMAR[r][1]) for r, d in STATES[node[0]])


def _stacks() -> list[Node]:
    found = [ROOT]
    for node in found:  # grows while it runs
        found.extend(n for s in SIGNS if (n := shift(node, s)) is not None and n not in found)
    return found


STACKS = _stacks()

# ---- parsing with edits ------------------------------------------------------------------------

Weight = tuple[int, str]


def _offer(tops: dict[Node, Weight], node: Node | None, cost: int, audit: str) -> bool:
    if node is None or (node in tops and tops[node] <= (cost, audit)):
        return False
    tops[node] = (cost, audit)
    return True


def inserted(tops: dict[Node, Weight]) -> dict[Node, Weight]:
    """The frontier with all insertions that lower some top."""
    work = list(tops)
    while work:
        node = work.pop()
        cost, audit = tops[node]
        for sign in ROLES:
            if _offer(tops, target := shift(node, sign), cost + INSERT, audit + "I"):
                work.append(target)
    return tops


def after_row(tops: dict[Node, Weight], initial: str, dead: bool, truncated: bool) -> dict[Node, Weight]:
    """The frontier after one row; a ``dead`` row has to go."""
    out: dict[Node, Weight] = {}
    more = TRUNCATED if truncated else 0
    for node, (cost, audit) in tops.items():
        _offer(out, node, cost + DELETE, audit + "D")
        if not dead:
            _offer(out, shift(node, initial), cost + more, audit + "K")
            for sign in ROLES:
                _offer(out, shift(node, sign), cost + REROLE + more, audit + "R")
    return inserted(out)


def parse(rows: Iterable[tuple[str, bool, bool]], entry: Node = ROOT) -> dict[Node, Weight]:
    """The least edits of ``rows`` (initial, dead, truncated) from ``entry`` to each stack."""
    tops = inserted({entry: (0, "")})
    for row in rows:
        tops = after_row(tops, *row)
    return tops


class Renderer:
    """Feeds the repaired ``role:text`` lines of a conversation to a digest, row by row."""

    def __init__(self) -> None:
        self.digest, self.node, self.lines = hashlib.sha256(), ROOT, 0
        self.edits, self.at = "", 0

    def _line(self, role: str, text: str, sign: str) -> None:
        self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1
        self.node = shift(self.node, sign)

    def _made(self, text: str) -> None:
        sign = next(s for s in ROLES if shift(self.node, s))
        self._line(ROLES[sign], text, sign)

    def insertions(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._made("")
            self.at += 1

    def block(self, edits: str) -> None:
        self.insertions()
        self.edits, self.at = edits, 0

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self._line(role, text, role[:1])
        elif edit == "R":
            self._made(text)

    def done(self) -> str:
        self.insertions()
        return self.digest.hexdigest()


# ---- Spark steps -------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Neighbouring rows of equal ``key``, also across batches."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != rows[-1][key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, n``: damaged rows, equal ones as one row with their number ``n``.

    Nulls count as one space in ids, roles and texts; null ids and turns stay null in the result.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv, turn, role, text))
    written_id = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    code = F.crc32(F.concat(written_id[0], F.lit(":"), written_id[1])) % 20
    text = F.coalesce(text, F.lit(" "))
    text = F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(F.coalesce(role, F.lit(" ")))
    left = rows.where(code != 0).select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("n"))
    return left.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order, with ``block`` (ascending in order, of one conversation), ``pos`` in it, and ``head``."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["conv", "turn", "role", "text", "n"]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", block long, pos int, head boolean"
    ordered = rows.repartitionByRange(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions(
        F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, at, head, first = (TaskContext.get().partitionId() << 32) - 1, None, 0, False, True
        for batch in batches:
            places = []
            for conv in batch.column("conv").to_pylist():
                if first or conv != last or at == BLOCK_ROWS:
                    head = not first and conv != last
                    block, at, first, last = block + 1, 0, False, conv
                places.append((block, at, head))
                at += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*places), (pa.int64(), pa.int32(), pa.bool_()))] if places else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "block", "pos", "head"])

    return written(ordered.select(*names).mapInArrow(run, schema), "placed-turns")


def _block_moves(flagged: DataFrame) -> DataFrame:
    """Per block its counts, its first and last role initials, and the least edits from stack to stack."""
    key = flagged.schema["conv"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal"]
    moves = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
    schema = f"conv {key}, block long, {', '.join(f'{c} long' for c in counts)}, first string, last string, moves {moves}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for rows in _runs(batches, "block"):
            single: list[tuple[str, bool, bool]] = []
            total = dict.fromkeys(counts, 0)
            for r in rows:
                blank, duplicate = r["blank"], r["later"] and not r["blank"]
                cut = r["cut"] and not blank and not duplicate
                single += [(r["initial"], blank or duplicate, cut)] + [(r["initial"], True, False)] * (r["n"] - 1)
                total["blank"] += r["n"] if blank else 0
                total["duplicate"] += 0 if blank else r["n"] - 1 + duplicate
                total["truncated"] += cut
            total["illegal"] = sum(a[0] + b[0] not in IN_ORDER for a, b in zip(single, single[1:]))
            entries = [ROOT] if rows[0]["head"] else STACKS
            found = [
                {"entry": e, "exit": STACKS.index(node), "cost": cost, "audit": audit}
                for e, entry in enumerate(entries)
                for node, (cost, audit) in parse(single, entry).items()
            ]
            ends = {"first": single[0][0], "last": single[-1][0], "moves": found}
            out.append({"conv": rows[0]["conv"], "block": rows[0]["block"], **total, **ends})
            if len(out) == 256:
                yield from _batch(out, schema_of)
                out = []
        yield from _batch(out, schema_of)

    schema_of = flagged.sparkSession.createDataFrame([], schema).schema
    return flagged.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(run, schema)


def _batch(rows: list[dict], schema) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    if rows:
        yield from pa.Table.from_pylist(rows, to_arrow_schema(schema)).combine_chunks().to_batches()


def _fold(moves: DataFrame) -> DataFrame:
    """Per block its edits; on a conversation's first block also its counts, cost and audit."""
    key = moves.schema["conv"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal"]
    schema = f"conv {key}, block long, edits string, {', '.join(f'{c} long' for c in counts)}, cost long, audit string"
    schema_of = moves.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for blocks in _runs(batches, "conv"):
            # Per stack: cost, audit, and the audits of the blocks as a list linked backwards.
            tops: dict[int, tuple] = {STACKS.index(ROOT): (0, "", None)}
            total, last = dict.fromkeys(counts, 0), None
            for b in blocks:
                new: dict[int, tuple] = {}
                for move in b["moves"]:
                    if move["entry"] in tops:
                        cost, audit, trail = tops[move["entry"]]
                        weight = (cost + move["cost"], audit + move["audit"])
                        if move["exit"] not in new or weight < new[move["exit"]][:2]:
                            new[move["exit"]] = (*weight, (trail, move["audit"]))
                tops = new
                for c in counts:
                    total[c] += b[c]
                total["illegal"] += last is not None and last + b["first"] not in IN_ORDER
                last = b["last"]
            cost, audit, trail = min((t for s, t in tops.items() if accepts(STACKS[s])), key=lambda t: t[:2])
            parts = []
            while trail:
                trail, part = trail
                parts.append(part)
            rows = [{"conv": b["conv"], "block": b["block"], "edits": part} for b, part in zip(blocks, reversed(parts))]
            rows[0] |= total | {"cost": cost, "audit": audit}
            out += rows
            if len(out) >= 256:
                yield from _batch(out, schema_of)
                out = []
        yield from _batch(out, schema_of)

    return written(moves.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, schema), "repairs")


def _digests(placed: DataFrame, repairs: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired lines; its rows stream through one task, in order."""
    key = placed.schema["conv"].dataType.simpleString()
    edits = repairs.select("block", "edits", F.lit(0).alias("pos"))
    lines = placed.select("conv", "block", "pos", "role", "text", "n").join(edits, ["block", "pos"], "left")
    schema = f"conv {key}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Renderer | None = None
        last = None
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if now is None or row["conv"] != last:
                    if now is not None:
                        done.append((last, now.done()))
                    now, last = Renderer(), row["conv"]
                if row["pos"] == 0:
                    now.block(row["edits"])
                for _ in range(row["n"]):
                    now.row(row["role"], row["text"])
            yield result(done, batch.schema.field("conv").type)
        if now is not None:
            yield result([(last, now.done())], batch.schema.field("conv").type)

    def result(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "block", "pos").mapInArrow(run, schema)


def repair(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``convs`` (its column ``conv``).

    ``rows`` has ``conv, turn, role, text, n``, without repeated rows and without nulls in ``role, text, n``.
    They stand in the order of turns, nulls first, then of role and text; a row with ``n`` above 1 stands
    there that often. A row is blank (white space only), a duplicate (its role and text stand earlier) or
    truncated (its last visible character is none of ``.!?``), the first of these. Blank rows and duplicates
    are deleted; costs and edits are as stated at the top of this module. Of equally cheap repairs the
    one whose audit comes first in ASCII is taken; it fixes all roles.

    Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    A conversation without rows has zeros, an empty audit and the hash of nothing; a null id is one
    conversation. Without conversations the result is empty. Rows of a long conversation are parsed in blocks of ``BLOCK_ROWS``
    spread over all tasks; its texts pass through one task, batch by batch, for the digest.
    """
    placed = _placed(rows)
    visible = F.rtrim("text", F.lit(BLANKS))
    narrow = placed.select(
        "conv", "block", "pos", "head", "n",
        F.substring("role", 1, 1).alias("initial"),
        (visible == "").alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
    )
    place = F.struct("block", "pos")
    first = narrow.groupBy(F.col("conv").alias("__conv"), F.col("said").alias("__said")).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    flagged = narrow.join(first, _same(F.col("conv"), F.col("__conv")) & (F.col("said") == F.col("__said")), "left")
    flagged = flagged.withColumn("later", F.coalesce(place > F.col("__first"), F.lit(False))).drop("__conv", "__said", "__first", "__n", "said")
    repairs = _fold(_block_moves(flagged))
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy(F.col("conv").alias("g_conv")).agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))
    figures = repairs.where("cost IS NOT NULL").drop("block", "edits").withColumnRenamed("conv", "f_conv")
    hashes = _digests(placed, repairs).withColumnRenamed("conv", "h_conv")
    out = convs.select("conv").distinct()
    for part, key in ((gaps, "g_conv"), (figures, "f_conv"), (hashes, "h_conv")):
        out = out.join(part, _same(F.col("conv"), F.col(key)), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("conv").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of the damaged conversations."""
    rows = documents(spark, sf_dir, "conversations")
    return repair(damage(rows), rows.select(F.col("conv_id").alias("conv")))


QUERIES = {"op11_turn_repair": op11_turn_repair}
ORACLE: dict[str, str] = {}
