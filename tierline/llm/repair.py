"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation is a row of turns whose role initials should read `(s?(ua)+)?`. The items of the hypergraph are
`turn(i, edit)`, an axiom for each edit that row i allows, and `rest(i, q)`: rows i, i + 1, ... can be brought to an
end from state q. Deductions build the rest of a conversation from the right:

    rest(i, p)  <-  turn(i, edit), rest(i + 1, q)     where the edited turn leads from p to q
    rest(i, p)  <-  rest(i, q)                        where an inserted turn leads from p to q

An item's weight is (cost, audit): costs add up and the edit's initial goes before the audit. Put before, not
after, an initial keeps the order of two audits, so the functions are monotone. They are superior in the key
(cost, rows covered, audit): a deduction never lowers the cost, and a free one covers a row more. The agenda pops
items by that key; the first pop of an item is its lightest derivation, and the pop of the goal ends the work.

A conversation of many rows is cut into chunks. A chunk has one item per pair of states, with inserts only before
its rows, so that no audit of a chunk is the beginning of another and chunks compose: the lightest path over the
chunks, compared by cost and then chunk by chunk by the rank of the audit, is that of the whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import small_batches
from tierline.operators.ordered import in_ranges
from tierline.sources.sink import stage

#: States: at the start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BACK = [[(p, symbol) for (p, symbol), q in STEPS.items() if q == state] for state in range(4)]
#: The turn that a state calls for where one is inserted or its role is changed.
CALLED = {p: symbol for (p, symbol) in STEPS if symbol != "s"}
ROLES = {"u": "user", "a": "assistant"}
#: Fixed values of the contract.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
FAULTS = ("blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a chunk, and bytes of a conversation that one task may hold.
CHUNK = 1000
BYTES = 8 << 20

Weight = tuple[int, str]


def turn_edits(initial: str, fault: str | None) -> list[tuple[str, str, int]]:
    """Axioms of a row: (edit, symbol it gives or none, cost)."""
    edits = [("D", "", COST["D"])]
    if fault in ("blank", "duplicate"):
        return edits
    more = TRUNCATED_COST if fault == "truncated" else 0
    if initial in ("s", "u", "a"):
        edits.append(("K", initial, COST["K"] + more))
    return edits + [("R", symbol, COST["R"] + more) for symbol in "ua"]


def lightest(
    turns: Sequence[list[tuple[str, str, int]]], ends: dict[int, Weight], goals: Sequence[int], insert_last: bool
) -> dict[int, Weight]:
    """Lightest weight of rest(0, goal) for each goal that can be derived. `ends` are the axioms rest(n, q);
    `insert_last` allows inserts after the last row."""
    n = len(turns)
    agenda = [(cost, 0, audit, q) for q, (cost, audit) in ends.items()]
    heapq.heapify(agenda)
    done: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while agenda and len(found) < len(goals):
        cost, covered, audit, q = heapq.heappop(agenda)
        if (covered, q) in done:
            continue
        done.add((covered, q))
        if covered == n and q in goals:
            found[q] = cost, audit
        if covered or insert_last:
            for p, symbol in BACK[q]:
                if symbol != "s" and (covered, p) not in done:
                    heapq.heappush(agenda, (cost + COST["I"], covered, "I" + audit, p))
        if covered < n:
            for edit, symbol, price in turns[n - 1 - covered]:
                before = [p for p, s in BACK[q] if s == symbol] if symbol else [q]
                for p in before:
                    if (covered + 1, p) not in done:
                        heapq.heappush(agenda, (cost + price, covered + 1, edit + audit, p))
    return found


def repair(turns: Sequence[list[tuple[str, str, int]]]) -> Weight:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    return lightest(turns, {START: (0, ""), ASSISTANT: (0, "")}, [START], True)[START]


def repaired_lines(audit: str, rows: Sequence[tuple[str, str]], state: int = START) -> Iterator[tuple[int, str]]:
    """(row, `role:text`) of what the edits leave of (role, text) rows; an inserted turn counts to the row after it."""
    at = 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        if edit != "D":
            symbol = role[:1] if edit == "K" else CALLED[state]
            state = STEPS[state, symbol]
            yield at, f"{role if edit == 'K' else ROLES[symbol]}:{text}"
        at += edit != "I"


def fault_of(role: str, text: str, seen: bool) -> str | None:
    kept = text.rstrip(BLANKS)
    if not kept:
        return "blank"
    if seen:
        return "duplicate"
    return None if kept[-1] in ".!?" else "truncated"


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


# The damage.


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage that a hash of conv_id and turn decides. A dropped
    row has no copies and no text, a repeated one has two."""
    role, text = _text(F.col("role")), _text(F.col("text"))
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn")))) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _arrow(rows: list[tuple], names: Sequence[str], schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)


_ARROW_OUT = pa.schema(
    [(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _NAMES]
)


def _conversation(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """Result of one conversation: rows (turn, role, text) in order."""
    counts = dict.fromkeys(FAULTS, 0)
    seen: set[tuple[str, str]] = set()
    turns = []
    for _, role, text in rows:
        fault = fault_of(role, text, (role, text) in seen)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append(turn_edits(role[:1], fault))
    cost, audit = repair(turns)
    lines = [line for _, line in repaired_lines(audit, [(r, t) for _, r, t in rows])]
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(not legal(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return conv_id, gaps, *(counts[f] for f in FAULTS), illegal, cost, audit, sha


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of bounded size, whose rows come one after the other."""
    now: tuple | None = None
    rows: list[tuple] = []
    for batch in batches:
        out = []
        for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv_id,):
                if now is not None:
                    out.append(_conversation(now[0], rows))
                now, rows = (conv_id,), []
            rows += [(turn, role, text)] * copies
        yield _arrow(out, _NAMES, _ARROW_OUT)
    if now is not None:
        yield _arrow([_conversation(now[0], rows)], _NAMES, _ARROW_OUT)


# Long conversations: chunks over all tasks.

_KEY = ["conv_id", "_range", "_block"]
_PATH = "array<struct<p: int, q: int, cost: long, rank: int, audit: string>>"
_CHUNK = (
    "conv_id long, _range int, _block long, blank long, duplicate long, truncated long, illegal long, _from long, "
    f"initials array<string>, paths {_PATH}"
)


def _chunk_row(key: tuple, rows: list[tuple[int, str, str | None]]) -> dict:
    """Counts of a chunk and the lightest weights from state to state; rows are (place, initial, fault)."""
    turns = [turn_edits(initial, fault) for _, initial, fault in rows]
    found = [(p, q, *w) for q in range(4) for p, w in lightest(turns, {q: (0, "")}, range(4), False).items()]
    ranks = {audit: i for i, audit in enumerate(sorted({f[3] for f in found}))}
    out = dict(zip(_KEY, key)) | {f: sum(r[2] == f for r in rows) for f in FAULTS}
    return out | {
        "illegal": sum(not legal(a[1], b[1]) for a, b in zip(rows, rows[1:])),
        "_from": rows[0][0],
        "initials": [r[1] for r in rows],
        "paths": [{"p": p, "q": q, "cost": c, "rank": ranks[a], "audit": a} for p, q, c, a in found],
    }


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that are sorted by their first `width` columns."""
    key: tuple | None = None
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None and row[:width] != key:
                yield key, rows
                rows = []
            key = row[:width]
            rows.append(row[width:])
    if key is not None:
        yield key, rows


_ARROW_PATH = pa.list_(
    pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
)
_ARROW_CHUNK = pa.schema(
    [("conv_id", pa.int64()), ("_range", pa.int32()), ("_block", pa.int64())]
    + [(n, pa.int64()) for n in (*FAULTS, "illegal", "_from")]
    + [("initials", pa.list_(pa.string())), ("paths", _ARROW_PATH)]
)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lightest weights of each chunk: rows (conv_id, _range, _block, _at, initial, fault), a bounded number per key."""
    for key, rows in _runs(batches, 3):
        yield pa.RecordBatch.from_pylist([_chunk_row(key, rows)], schema=_ARROW_CHUNK)


_PICK = "conv_id long, _range int, _block long, p int, q int, cost long, border long, tail int"
_ARROW_PICK = pa.schema(
    [("conv_id", pa.int64()), ("_range", pa.int32()), ("_block", pa.int64()), ("p", pa.int32()), ("q", pa.int32()),
     ("cost", pa.int64()), ("border", pa.int64()), ("tail", pa.int32())]
)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path over the chunks of each conversation, last chunk first: rows (conv_id, _range, _block, first, last,
    paths of p, q, cost, rank). Kept per chunk are four steps. `rest` holds cost and the place of the audit."""

    def finish(conv_id: int | None) -> pa.RecordBatch:
        out, state, cost = [], START, rest[START][0]
        for (range_, block), border, step in reversed(chunks):
            out.append((conv_id, range_, block, state, step[state], cost, border, 0))
            state = step[state]
        out[-1] = (*out[-1][:-1], tails[state][1])
        return _arrow(out, _ARROW_PICK.names, _ARROW_PICK)

    # inserts after the last row, and the place of their audits ("" before "I" before "II")
    tails = {START: (0, 0), ASSISTANT: (0, 0), USER: (COST["I"], 1), SYSTEM: (2 * COST["I"], 2)}
    now: tuple | None = None
    rest: dict[int, tuple[int, int]] = {}
    chunks: list[tuple] = []
    border = 0
    for batch in batches:
        for conv_id, range_, block, first, last, paths in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != (conv_id,):
                if now is not None:
                    yield finish(now[0][0])
                rest, chunks = dict(tails), []
                border = 0
            else:  # with the chunk after it
                border = int(not legal(last, now[1]))
            best: dict[int, tuple] = {}
            for path in paths:
                if path["q"] in rest:
                    cost, place = rest[path["q"]]
                    weight = (cost + path["cost"], path["rank"], place, path["q"])
                    best[path["p"]] = min(best.get(path["p"], weight), weight)
            places = {w: i for i, w in enumerate(sorted({w[1:3] for w in best.values()}))}
            rest = {p: (w[0], places[w[1:3]]) for p, w in best.items()}
            chunks.append(((range_, block), border, {p: w[3] for p, w in best.items()}))
            now = ((conv_id,), first)
    if now is not None:
        yield finish(now[0][0])


_EDIT = "_r int, _a long, before array<string>, as string"
_ARROW_EDIT = pa.schema([("_r", pa.int32()), ("_a", pa.int64()), ("before", pa.list_(pa.string())), ("as", pa.string())])
#: Stands for a role that is kept.
_SAME = "="


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a chunk (_range, _from, initials, p, audit) the turns inserted before it and the role that it
    keeps or gets, null where it is deleted."""
    for batch in batches:
        out = []
        for range_, at, initials, state, audit in zip(*(c.to_pylist() for c in batch.columns)):
            before: list[str] = []
            kept = iter(initials)
            for edit in audit:
                symbol = CALLED[state] if edit in "IR" else next(kept)
                if edit == "R":
                    next(kept)
                if edit != "D":
                    state = STEPS[state, symbol]
                if edit == "I":
                    before.append(ROLES[symbol])
                    continue
                out.append((range_, at, before, {"D": None, "K": _SAME}.get(edit, ROLES.get(symbol))))
                at, before = at + 1, []
        yield _arrow(out, _ARROW_EDIT.names, _ARROW_EDIT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, as they stream by: rows (conv_id, lines) in order."""
    now: tuple | None = None
    names, schema = ["conv_id", "repaired_sha256"], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    digest, lead = hashlib.sha256(), b""
    for batch in batches:
        out = []
        for conv_id, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv_id,):
                if now is not None:
                    out.append((now[0], digest.hexdigest()))
                now, digest, lead = (conv_id,), hashlib.sha256(), b""
            for line in lines:
                digest.update(lead + line.encode())
                lead = b"\n"
        yield _arrow(out, names, schema)
    if now is not None:
        yield _arrow([(now[0], digest.hexdigest())], names, schema)


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """Results of conversations of any size: rows (conv_id, turn, role, text) lie in ordered ranges over all tasks,
    a chunk has `chunk` rows of a range at most, and only four steps per chunk meet in one task. The digest has to
    read a conversation in order, so its text streams through one task; nothing of it is held there. The audit
    is one value per conversation, as long as the conversation has rows."""
    numbered = rows.select("*", F.col("turn").isNotNull().alias("_known"), F.monotonically_increasing_id().alias("_row"))
    order = [(c, "asc") for c in ("conv_id", "_known", "turn", "role", "text", "_row")]
    ranged = in_ranges(numbered, order).drop("_known", "_row")
    firsts = (
        ranged.groupBy("conv_id", "role", F.sha2("text", 256).alias("h"))
        .agg(F.min(F.struct("_range", "_at")).alias("f"))
        .select(F.col("f._range").alias("_r"), F.col("f._at").alias("_a"))
    )
    same_row = (F.col("_range") == F.col("_r")) & (F.col("_at") == F.col("_a"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(bare == "", FAULTS[0]).when(F.col("_r").isNull(), FAULTS[1])
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    )
    chunks = (
        ranged.join(firsts, same_row, "left")
        .select(
            "conv_id", "_range", F.floor(F.col("_at") / chunk).alias("_block"), "_at",
            F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
        )
        .repartition(*_KEY).sortWithinPartitions(*_KEY, "_at").mapInArrow(_chunk, _CHUNK)
    )
    chunks = stage(chunks, "chunks")
    light = F.transform("paths", lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), x["cost"].alias("cost"), x["rank"].alias("rank")))
    picks = (
        chunks.select(*_KEY, F.col("initials")[0].alias("first"), F.element_at("initials", -1).alias("last"), light.alias("paths"))
        .repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_range"), F.desc("_block"))
        .mapInArrow(_compose, _PICK)
        .select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), F.col("_block").alias("_b"), "p", "q", "cost", "border", "tail")
    )
    same_chunk = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")) & (F.col("_block") == F.col("_b"))
    chosen = chunks.join(picks, same_chunk).withColumn("audit", F.expr("filter(paths, x -> x.p = p and x.q = q)[0].audit"))
    chosen = stage(chosen.drop("paths", "_c", "_r", "_b"), "chosen")
    edits = chosen.select("_range", "_from", "initials", "p", "audit").mapInArrow(_edits, _EDIT)
    inserted = F.transform("before", lambda role: F.concat(role, F.lit(":")))
    own = F.when(F.col("as").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.when(F.col("as") == _SAME, F.col("role")).otherwise(F.col("as")), F.lit(":"), F.col("text")))
    )
    lines = ranged.join(edits, same_row).select("conv_id", "_range", "_at", F.concat(inserted, own).alias("lines"))
    ending = F.when(F.col("tail") == 1, F.array(F.lit("assistant:"))).otherwise(F.array(F.lit("user:"), F.lit("assistant:")))
    last = chosen.where("tail > 0").select("conv_id", F.lit(2**31 - 1).alias("_range"), F.lit(0).cast("long").alias("_at"), ending.alias("lines"))
    digests = (
        lines.union(last).repartition("conv_id").sortWithinPartitions("conv_id", "_range", "_at")
        .select("conv_id", "lines").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("_range", "_block", "audit"))), lambda x: x["audit"])
    totals = chosen.groupBy("conv_id").agg(
        *[F.sum(f).alias(f) for f in FAULTS],
        F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
        F.max("cost").alias("cost"),
        F.concat(F.array_join(pieces, ""), F.repeat(F.lit("I"), F.sum("tail").cast("int"))).alias("audit"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = ranged.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    parts = [totals, gaps.withColumnRenamed("conv_id", "_g"), digests.withColumnRenamed("conv_id", "_d")]
    joined = parts[0].join(parts[1], F.col("conv_id").eqNullSafe(F.col("_g"))).join(parts[2], F.col("conv_id").eqNullSafe(F.col("_d")))
    return joined.select(_NAMES)


def repaired(conversations: DataFrame, chunk: int = CHUNK, most_bytes: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of
    `conversations` (conv_id, turn, role, text; other columns are ignored), after the damage.

    Null roles and texts are one blank, in the damage's key too; null turns come first; rows of one turn go by role
    and text, in order of code points. Null conv_ids are one conversation. Equal rows are duplicates but for the
    first. A conversation of which the damage leaves nothing has zeros, an empty audit and the hash of an empty
    string. No conversations give no rows. Results do not depend on `chunk` (rows) and `most_bytes`, up to which a
    conversation is repaired by one task in one piece.
    """
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    size = F.sum(F.octet_length("text") * F.col("copies"))
    large = (
        rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), size.alias("b"))
        .where((F.col("n") > chunk) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("_large"))
    )
    large = stage(large, "large")
    any_large = not large.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    short = (
        (rows.join(large, same, "left_anti") if any_large else rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        .mapInArrow(_short, _OUT)
    )
    if not any_large:
        return short
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    long = rows.join(large, same, "left_semi").where("copies > 0").withColumn("_copy", copies)
    return short.union(_long(long.select("conv_id", "turn", "role", "text"), chunk))
