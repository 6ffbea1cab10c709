"""Conversation structure repair by the cheapest edits, read off a graph of tight arcs.

A conversation's rows in order of their turns are the layers of a graph; its nodes are (rows read, state of the role pattern
``(s?(ua)+)?``). Arcs are edits: Keep, Rerole to user or assistant, Delete a row, or Insert an empty turn inside a layer. The
least costs from the start and to the end are computed forward and backward; an arc is on a cheapest way if both and its own cost
add up to the whole cost. The walk from the start keeps the set of states that the letters so far lead to and takes the least
letter that any tight arc of the set has, so of all cheapest audits the one that sorts first comes out. (A letter leads from
a state to one state only, so the set has one member, and roles follow from the letters.)

* Rows are dealt by ranges of (conversation, turn, role, text) and packed to segments of at most ``SEGMENT`` rows. A conversation of
  any length is many segments in many tasks; nearly all are one, which is repaired where it lies.
* For the others a segment's costs between the four states are a min-plus matrix. Products over a partition's segments, then over the
  partitions of the conversation, give every segment its costs from the start and to the end; in the same way each segment's walk
  is a map of four states, and its first state follows from the maps before it. Only matrices and maps meet, no rows.
* Earlier copies are found by a grouped minimum of (conversation, digest of role and text), pre-aggregated before the shuffle.
* The digest of a repaired conversation of several segments streams through one task piece by piece, as a sha256 must.

Defined cases: a null role or text is one space, so a null text is blank; null turns come first and count for no gap; a null
conv_id is a conversation like any; equal turns are ordered by role and text; repeated rows are duplicates of the first; a role with another initial
than s, u or a is never kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import Stored, lean, slices

#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 4096, 4_000_000
#: Costs of edits; a truncated row that isn't deleted adds CUT.
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a. What the initials s, u, a (others: never) lead to, and what the next u or a does.
KEEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
NEXT = (2, 2, 3, 2)
#: Inserts after the last row until a state may end, times their cost.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
LEGAL = {(0, 1), (1, 2), (2, 1)}
SEGMENTS = "conv_id long, pid int, idx int, codes binary, roles array<string>, texts array<string>, turns array<long>, illegal long"
PIECE = "conv_id long, pid int, idx int, several boolean, first int, last int, min_turn long, max_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, repaired_sha256 string"
TURNS = "conv_id long, pid int, idx int, seq int, edit string, role string, text string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(maxsize=16)
def arcs(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits (letter, cost, next state) of a row, by its initial (code % 4) and fault (code // 4); letters ascend."""
    initial, fault = code & 3, code >> 2
    extra = CUT if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault in (SOUND, TRUNCATED):
            if initial in KEEPS[state]:
                edits.append(("K", extra, KEEPS[state][initial]))
            edits.append(("R", REROLE + extra, NEXT[state]))
        out.append(tuple(edits))
    return tuple(out)


def inserted(costs: list[int]) -> list[int]:
    """Least costs from the start to the states of a layer, inserts inside it included."""
    out = list(costs)
    for state, cost in enumerate(costs):
        for n in (1, 2):
            state = NEXT[state]
            out[state] = min(out[state], cost + n * INSERT)
    return out


def forward(codes: bytes, entry: list[int]) -> list[list[int]]:
    """Least costs from the start to each layer's states, before inserts."""
    layers = [list(entry)]
    for code in codes:
        at, to = inserted(layers[-1]), [FAR] * 4
        for state, edits in enumerate(arcs(code)):
            for _, cost, target in edits:
                to[target] = min(to[target], at[state] + cost)
        layers.append(to)
    return layers


def backward(codes: bytes, leave: list[int]) -> list[list[int]]:
    """Least costs from each layer's states to the end; ``leave``: those of the last layer, inserts there included."""
    layers = [list(leave)]
    for code in reversed(codes):
        after = layers[-1]
        row = [min(cost + after[target] for _, cost, target in edits) for edits in arcs(code)]
        layers.append([min(row[s], row[NEXT[s]] + INSERT, row[NEXT[NEXT[s]]] + 2 * INSERT) for s in range(4)])
    return layers[::-1]


def walk(codes: bytes, state: int, entry: list[int], leave: list[int]) -> tuple[str, int]:
    """The least letters along tight arcs from ``state`` to the last layer, and the state there."""
    ahead, behind = [inserted(x) for x in forward(codes, entry)], backward(codes, leave)
    total = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
    frontier, letters = {state}, []
    for i, code in enumerate(codes):
        options = arcs(code)
        while True:
            tight = [(letter, to) for s in frontier for letter, cost, to in options[s] if ahead[i][s] + cost + behind[i + 1][to] == total]
            tight += [("I", NEXT[s]) for s in frontier if ahead[i][s] + INSERT + behind[i][NEXT[s]] == total]
            least = min(letter for letter, _ in tight)
            letters.append(least)
            frontier = {to for letter, to in tight if letter == least}
            if least != "I":
                break
    return "".join(letters), min(frontier)


def apply_edits(audit: str, state: int, roles: list[str], texts: list[str], codes: bytes) -> list[tuple[str, str]]:
    """The rows that the letters leave or make."""
    out, i = [], 0
    for letter in audit:
        if letter in "IR":
            state = NEXT[state]
            out.append(("user" if state == 2 else "assistant", "" if letter == "I" else texts[i]))
        elif letter == "K":
            state = KEEPS[state][codes[i] & 3]
            out.append((roles[i], texts[i]))
        i += letter != "I"
    return out


def _fault(text: str) -> int:
    bare = text.rstrip(SPACES)
    return BLANK if not bare else SOUND if bare[-1] in ".!?" else TRUNCATED


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments of ``most`` rows, one row each."""
    schema = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("idx", pa.int32()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("illegal", pa.int64())])
    pid, idx, chars, before = TaskContext.get().partitionId(), 0, 0, None
    codes, rows = bytearray(), []
    done: list[dict] = []

    def segment() -> dict:
        initials = [c & 3 for c in codes]
        return {"conv_id": rows[0][0], "pid": pid, "idx": idx, "codes": bytes(codes), "roles": [r[2] for r in rows], "texts": [r[3] for r in rows], "turns": [r[1] for r in rows], "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))}

    for batch in slices(batches, 1024):
        for *row, later in zip(*(batch[k].to_pylist() for k in ("conv_id", "turn", "role", "text", "later")), strict=True):
            if rows and (row[0] != rows[0][0] or len(rows) >= most or chars >= SEGMENT_CHARS):
                done.append(segment())
                codes, rows, chars, idx = bytearray(), [], 0, idx + 1
            fault = _fault(row[3])
            fault = DUPLICATE if fault != BLANK and (later or row == before) else fault
            codes.append("sua".find(row[2][:1] or "?") % 4 | fault << 2)
            rows.append(row)
            chars += len(row[3])
            before = row
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if rows:
        yield pa.RecordBatch.from_pylist([segment()], schema)


def segments(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """conv_id, pid, idx (their order), codes, roles, texts, turns, illegal: each conversation's rows in order, packed."""
    long = lambda c: F.col(c).cast("long").alias(c)
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(long("conv_id"), long("turn"), string("role"), string("text"))
    # length first, so that no two pairs of role and text make the same key
    rows = rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy("conv_id", "key").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    ready = joined.select("conv_id", "turn", "role", "text", F.coalesce(when > F.col("first"), F.lit(False)).alias("later"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return ready.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(partial(_pack, most=most)), SEGMENTS)


# --- conversations of several segments ----------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [[c for s in range(4) for c in forward(codes, [0 if t == s else FAR for t in range(4)])[-1]] for codes in batch["codes"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["pid"], batch["idx"], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "pid", "idx", "m"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a segment's walk from each state ends; a state off all cheapest ways stays, nobody comes to it."""
    for batch in slices(batches):
        out = []
        for codes, entry, leave in zip(*(batch[k].to_pylist() for k in ("codes", "entry", "leave")), strict=True):
            ahead, back = inserted(entry), backward(codes, leave)[0]
            total = min(a + b for a, b in zip(ahead, back, strict=True))
            out.append([walk(codes, s, entry, leave)[1] if entry[s] + back[s] == total else s for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["pid"], batch["idx"], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "pid", "idx", "m"])


def times(a: list[int], b: list[int]) -> list[int]:
    """Product of two matrices (16 numbers, least sums) or of two maps (4 numbers, one after the other)."""
    if len(a) == 4:
        return [b[s] for s in a]
    return [min(min(a[4 * i + k] + b[4 * k + j] for k in range(4)), FAR) for i in range(4) for j in range(4)]


def through(vector: list[int], m: list[int]) -> list[int]:
    """A vector of costs (or one state) behind a matrix (or a map)."""
    if len(m) == 4:
        return [m[vector[0]]]
    return [min(min(vector[i] + m[4 * i + j] for i in range(4)), FAR) for j in range(4)]


def before(m: list[int], vector: list[int]) -> list[int]:
    return vector if len(m) == 4 else [min(min(m[4 * i + j] + vector[j] for j in range(4)), FAR) for i in range(4)]


def swept(nodes: DataFrame, start: list[int], end: list[int]) -> DataFrame:
    """conv_id, pid, idx, entry, leave of every segment, from the ``m`` of all. Groups: a partition's segments; a conversation's partitions."""
    import pandas as pd

    key = "conv_id long, pid int, idx int"

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        m = rows["m"].iloc[0].tolist()
        for other in rows["m"].iloc[1:]:
            m = times(m, other.tolist())
        return pd.DataFrame({"conv_id": [rows["conv_id"].iloc[0]], "pid": [rows["pid"].iloc[0]], "m": [m]}).astype({"conv_id": "Int64"})

    def sides(rows: pd.DataFrame, by: str, enter: list[int], leave: list[int]) -> pd.DataFrame:
        rows = rows.sort_values(by)
        ms = [m.tolist() for m in rows["m"]]
        entries, leaves = [enter], [leave]
        for m in ms[:-1]:
            entries.append(through(entries[-1], m))
        for m in ms[:0:-1]:
            leaves.append(before(m, leaves[-1]))
        return rows.drop(columns="m").assign(entry=entries, leave=leaves[::-1]).astype({"conv_id": "Int64"})

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return sides(rows, "pid", start, end)

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        return sides(rows.drop(columns=["entry", "leave"]), "idx", rows["entry"].iloc[0].tolist(), rows["leave"].iloc[0].tolist())

    parts = nodes.groupBy("conv_id", "pid").applyInPandas(product, "conv_id long, pid int, m array<long>")
    outer = Stored(parts.groupBy("conv_id").applyInPandas(across, "conv_id long, pid int, entry array<long>, leave array<long>")).df
    joined = nodes.join(outer.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), "entry", "leave"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).drop("c", "p")
    return joined.groupBy("conv_id", "pid").applyInPandas(down, f"{key}, entry array<long>, leave array<long>")


def bounds(several: DataFrame) -> DataFrame:
    """pid, idx, entry, leave (costs), state (where the walk starts), final: of each segment of conversations of several."""
    costs = Stored(swept(several.mapInArrow(lean(_matrices), "conv_id long, pid int, idx int, m array<long>"), [0, FAR, FAR, FAR], list(END))).df.drop("conv_id")
    maps = several.join(costs, ["pid", "idx"]).mapInArrow(lean(_maps), "conv_id long, pid int, idx int, m array<long>")
    states = swept(Stored(maps).df, [0], [0]).select("pid", "idx", F.get("entry", F.lit(0)).cast("int").alias("state"))
    return costs.join(states, ["pid", "idx"]).join(several.select("pid", "idx", "final"), ["pid", "idx"])


def placed(turns: DataFrame, most: int = SEGMENT) -> tuple[DataFrame, bool]:
    """The segments with where each starts, and whether a conversation has several; state is null for those that are alone."""
    segs = Stored(segments(turns, most)).df
    ends = segs.groupBy("conv_id").agg(F.max(F.struct("pid", "idx")).alias("end"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), "end")
    several = Stored(segs.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "pid", "idx", "codes", (F.struct("pid", "idx") == F.col("end")).alias("final"))).df
    if several.isEmpty():
        none = F.lit(None)
        return segs.withColumns({"entry": none.cast("array<long>"), "leave": none.cast("array<long>"), "state": none.cast("int"), "final": F.lit(True)}), False
    return segs.join(Stored(bounds(several)).df, ["pid", "idx"], "left").withColumn("final", F.coalesce("final", F.lit(True))), True


# --- reports ------------------------------------------------------------------------------------


def _arrow(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _edited(seg: dict) -> tuple[str, list[tuple[str, str]], int]:
    """A segment's audit, the rows that it leaves, and its cost."""
    codes, alone = seg["codes"], seg["state"] is None
    state, entry, leave = (0, [0, FAR, FAR, FAR], list(END)) if alone else (seg["state"], seg["entry"], seg["leave"])
    audit, last = walk(codes, state, entry, leave)
    if seg["final"]:
        audit += "I" * (END[last] // INSERT)
    cost, i = 0, 0
    for letter in audit:
        if letter == "I":
            cost += INSERT
            continue
        cost += DELETE if letter == "D" else (REROLE if letter == "R" else 0) + (CUT if codes[i] >> 2 == TRUNCATED else 0)
        i += 1
    return audit, apply_edits(audit, state, seg["roles"], seg["texts"], codes), cost


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's figures, audit and repaired rows. The text of a whole conversation becomes its digest at once."""
    for batch in slices(batches, 64):
        out = []
        for seg in batch.to_pylist():
            audit, made, cost = _edited(seg)
            text, alone = "\n".join(f"{role}:{text}" for role, text in made), seg["state"] is None
            faults, turns = [c >> 2 for c in seg["codes"]], [t for t in seg["turns"] if t is not None]
            out.append(
                {"conv_id": seg["conv_id"], "pid": seg["pid"], "idx": seg["idx"], "several": not alone, "first": seg["codes"][0] & 3, "last": seg["codes"][-1] & 3, "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "n_turns": len(set(turns))}
                | {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": seg["illegal"], "cost": cost, "audit": audit}
                | {"repaired": text if made and not alone else None, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest() if alone else None}
            )
        yield pa.RecordBatch.from_pylist(out, _arrow(PIECE))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        out = []
        for seg in batch.to_pylist():
            audit, made, _ = _edited(seg)
            place = {k: seg[k] for k in ("conv_id", "pid", "idx")}
            out += [place | {"seq": i, "edit": e, "role": role, "text": text} for i, (e, (role, text)) in enumerate(zip(audit.replace("D", ""), made, strict=True))]
        yield pa.RecordBatch.from_pylist(out, _arrow(TURNS))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place come in; one conversation's sums and digest are held at a time."""
    counted = ("blank", "duplicate", "truncated", "illegal", "cost")
    at, sums, audit, digest, previous, lines = None, {}, [], None, None, False

    def row() -> dict:
        gaps = 0 if sums["min"] is None else sums["max"] - sums["min"] + 1 - sums["n"]
        return {"conv_id": at[0], "gaps": gaps, **{k: sums[k] for k in counted}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in slices(batches, 16):
        out = []
        for p in batch.to_pylist():
            if at != (p["conv_id"],):
                if at is not None:
                    out.append(row())
                at, audit, digest, previous, lines = (p["conv_id"],), [], hashlib.sha256(), None, False
                sums = dict.fromkeys(("n", *counted), 0) | {"min": None, "max": None}
            for k in counted:
                sums[k] += p[k]
            sums["illegal"] += previous is not None and (previous, p["first"]) not in LEGAL
            previous = p["last"]
            if p["min_turn"] is not None:  # turns ascend: a turn on both sides of a cut counts once
                sums["n"] += p["n_turns"] - (sums["max"] == p["min_turn"])
                sums["min"] = p["min_turn"] if sums["min"] is None else sums["min"]
                sums["max"] = p["max_turn"]
            audit.append(p["audit"])
            if p["repaired"] is not None:
                digest.update(("\n" if lines else "").encode() + p["repaired"].encode())
                lines = True
        if out:
            yield pa.RecordBatch.from_pylist(out, _arrow(REPORT))
    if at is not None:
        yield pa.RecordBatch.from_pylist([row()], _arrow(REPORT))


def repair(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation."""
    segs, several = placed(turns, most)
    pieces = segs.mapInArrow(lean(_repair), PIECE)
    pieces = Stored(pieces).df if several else pieces
    gaps = F.when(F.col("min_turn").isNull(), 0).otherwise(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns")).cast("long").alias("gaps")
    alone = pieces.where("not several").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    if not several:
        return alone
    rest = pieces.where("several").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "idx")
    return alone.unionByName(rest.mapInArrow(lean(_report), REPORT))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pid, idx, seq (order of the rows), edit (K, R or I), role, text: the conversations as the edits leave them."""
    return placed(turns)[0].mapInArrow(lean(_turns), TURNS)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by digest of ``conv_id:turn``: dropped, emptied, cut, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    role = F.when(h == 4, "user").otherwise(text_of("role"))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    return rows.drop("one")


def audit_damaged(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The report of the damaged rows, with every conversation of ``turns``, also one of which no row is left."""
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    report = repair(damaged(turns), most).withColumnRenamed("conv_id", "c")
    joined = ids.join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
