"""Conversation structure repair: the cheapest edits that give a well-formed conversation.

A repaired conversation is nothing, or an optional system row and then pairs of a user and
an assistant row.  Rows are kept (0), given the role user or assistant (1), deleted (2), or
rows without text are inserted (5); blank rows and repeats must be deleted, and a truncated
row that isn't deleted costs 5 more.  Of the cheapest audits (one letter K, R, D or I an
edit) the least is taken: see ``repair_paths`` for the cost DP and the ranking by prefix
doubling.

Distributed: repeats are found by the hash of (conversation, role, text), pre-aggregated;
rows are sorted by range over conversation, turn, role and text, so a conversation may
cover any number of partitions.  A task repairs the conversations that lie inside its
partition, a batch at a time.  Those at the edges of a partition, and long ones, are cut
into segments of at most ``SEGMENT`` rows or ``SEGMENT_BYTES``: each gives a matrix of
costs between states, the matrices' products give the costs behind every segment, each
segment then gives the least audit from each state it may begin in, and following the
states from the first segment on picks one.  What one task holds of a conversation is a
segment's rows, or a few numbers per segment; its text is hashed as a stream.

Defined results: a null ``conv_id`` is a conversation of its own, a null role or text is one
space, null turns come first.  Rows of one turn are ordered by role and text; equal rows are
repeats.  A conversation without rows has zeros, an empty audit and the hash of no text.
Extra columns are ignored, an empty table gives no rows, a text of any length is kept whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import repair_paths as paths
from .common import ready, staged

SEGMENT = 1 << 16
SEGMENT_BYTES = 32 << 20
CLOSED = 2048  # a conversation of more rows is cut into segments wherever it lies
SPACES = " \t\n\x0b\x0c\r"
LEGAL = frozenset(("su", "ua", "au"))
NO_TEXT = hashlib.sha256(b"").hexdigest()

_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SORTED = (f"whole boolean, conv_id long, {_COUNTS}, audit string, repaired_sha256 string, "
           "part int, seg int, at long, turn long, role string, text string, times long, first boolean, blank_row boolean, cut_row boolean")
_ROWS = "conv_id long, part int, seg int, at long, turn long, role string, times long, first boolean, blank_row boolean, cut_row boolean"
_SEGMENTS = ("conv_id long, part int, seg int, costs array<long>, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
             "first_initial string, last_initial string, low long, high long, turns long")
_ENDS = "conv_id long, part int, seg int, behind array<long>, final boolean"
_PATHS = "conv_id long, part int, seg int, entry int, leaves int, steps string, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with known damage: by a hash of id and turn a row is dropped
    (``times`` 0), emptied, loses its sentence marks, is repeated, or is said by the user."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(what == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(what.isin(0, 1), "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long").alias("times"))


def flagged(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with their number ``times`` (0: it only names its
    conversation), whether the row is the first of its role and text, and its own faults."""
    bare = F.rtrim("text", F.lit(SPACES))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "times", (bare == "").alias("blank_row"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut_row"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.char_length("role").cast("string"),
                          F.concat("role", "text")).cast("binary")).alias("mark"))
    # What occurs in one row only is the first of its kind.
    repeated = staged(rows.filter("times > 0").groupBy("mark").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("has_null"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"), "conversations-repeated")
    met = rows.join(repeated, "mark", "left")
    plain = met.filter("has_null IS NULL").select("conv_id", "turn", "role", "text", "times", F.lit(True).alias("first"), "blank_row", "cut_row")
    first = F.when(F.col("has_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    some = (met.filter("has_null IS NOT NULL").groupBy("conv_id", "turn", "role", "text", first.alias("first"), "blank_row", "cut_row")
            .agg(F.sum("times").alias("times")))
    return plain.unionByName(some)


def _initials(role: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(role, 0, 1)


def _rows(table: pa.Table, bounds: np.ndarray) -> paths.Rows:
    initial = pc.index_in(_initials(table.column("role")), pa.array(["s", "u", "a"])).fill_null(3).to_numpy().astype(np.int64)
    blank, first, cut = (table.column(c).to_numpy().astype(bool) for c in ("blank_row", "first", "cut_row"))
    must_go = blank | ~first
    return paths.Rows(initial, must_go, cut & ~must_go, table.column("times").to_numpy() - 1, bounds)


def _faults(table: pa.Table) -> tuple[int, int, int]:
    """Blank, duplicate and truncated rows."""
    blank, first, cut = (table.column(c).to_numpy().astype(bool) for c in ("blank_row", "first", "cut_row"))
    times = table.column("times").to_numpy()
    return (int(times[blank].sum()), int((times - first)[~blank].sum()), int((~blank & first & cut).sum()))


def _illegal(initials: list[str], times: list[int]) -> int:
    return (sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            + sum(n - 1 for n in times))  # a role beside itself


def rebuilt(steps: str, state: int, roles: list[str], texts: list[str] | None, times: list[int]) -> tuple[str, list[str]]:
    """The whole audit and the repaired lines of rows, from the letters of their edits."""
    audit, lines, i = [], [], 0
    for step in steps:
        audit.append(step)
        new = "assistant" if state == paths.AFTER_U else "user"
        if step == "I":
            lines.append(new + ":")
            state = paths.NEXT[state]
            continue
        if step != "D":
            role = roles[i] if step == "K" else new
            if texts is not None:
                lines.append(f"{role}:{texts[i]}")
            state = paths.AFTER_S if role[:1] == "s" else paths.AFTER_U if role[:1] == "u" else paths.AFTER_A
        if times[i] > 1:
            audit.append("D" * (times[i] - 1))
        i += 1
    return "".join(audit), lines


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _whole(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """The results of complete conversations that begin at ``starts`` of a table of rows."""
    live = table.column("times").to_numpy() > 0
    ends = np.append(starts[1:], table.num_rows)
    count = np.concatenate([[0], np.cumsum(live)])
    bounds = np.append(count[starts], count[-1])
    conv = table.column("conv_id").take(pa.array(starts)).to_pylist()
    table = table.filter(pa.array(live))
    rows = _rows(table, bounds)
    cost = paths.costs_to_go(rows, paths.final_costs(len(starts)))
    steps, _ = paths.least_audits(rows, cost, np.zeros(len(starts), np.int64), True)
    roles, texts, times, turns = (table.column(c).to_pylist() for c in ("role", "text", "times", "turn"))
    out = []
    for c in range(len(ends)):
        a, b = bounds[c], bounds[c + 1]
        audit, lines = rebuilt(steps[c], paths.START, roles[a:b], texts[a:b], times[a:b])
        known = {t for t in turns[a:b] if t is not None}
        out.append({"whole": True, "conv_id": conv[c], "gaps": _gaps(min(known, default=None), max(known, default=None), len(known)),
                    **dict(zip(("blank", "duplicate", "truncated"), _faults(table.slice(a, b - a)))),
                    "illegal": _illegal([r[:1] for r in roles[a:b]], times[a:b]), "cost": int(cost[a + c, paths.START]),
                    "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()})
    return pa.RecordBatch.from_pylist(out, schema=_arrow(_SORTED))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def _walk(batches):
    """One sorted partition: complete conversations become results; the rows of the first
    and the last conversation, and of long ones, become rows of segments."""
    part, schema = TaskContext.get().partitionId(), _arrow(_SORTED)
    held: list[pa.RecordBatch] = []  # rows of the last conversation so far
    edge, seg, rows_in, bytes_in, at = True, 0, 0, 0, 0

    def segments(chunks):
        """Rows of an unfinished or long conversation."""
        nonlocal seg, rows_in, bytes_in, at
        for chunk in chunks:
            sizes = pc.binary_length(chunk.column(3)).to_numpy()
            begin = 0
            while begin < chunk.num_rows:
                if rows_in >= SEGMENT or bytes_in >= SEGMENT_BYTES:
                    seg, rows_in, bytes_in = seg + 1, 0, 0
                room = int(np.searchsorted(np.cumsum(sizes[begin:]), SEGMENT_BYTES - bytes_in, "right"))
                end = min(chunk.num_rows, begin + max(1, min(SEGMENT - rows_in, room)))
                n = end - begin
                some = chunk.slice(begin, n)
                columns = {"whole": pa.array([False] * n), "part": pa.array([part] * n, pa.int32()), "seg": pa.array([seg] * n, pa.int32()),
                           "at": pa.array(range(at, at + n), pa.int64()), **dict(zip(some.schema.names, some.columns))}
                rows_in, bytes_in, at = rows_in + n, bytes_in + int(sizes[begin:end].sum()), at + n
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
                begin = end

    def next_conversation():
        nonlocal edge, seg, rows_in, bytes_in
        if edge:
            seg, rows_in, bytes_in = seg + 1, 0, 0
        edge = False

    for rows in batches:
        conv = rows.column(0)
        if not rows.num_rows:
            continue
        ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
        if held or edge and at:
            before = held[-1].column(0)[-1].as_py() if held else last
            if before != conv[0].as_py():
                new = np.concatenate([[0], new])
        last = conv[-1].as_py()
        if not len(new):
            held.append(rows)
        else:
            held.append(rows.slice(0, new[0]))
            if edge:
                yield from segments(held)
                held = []
            next_conversation()
            rest = rows.slice(new[0], new[-1] - new[0])
            table = pa.Table.from_batches([*held, rest])
            if table.num_rows:
                lead = sum(h.num_rows for h in held)
                starts = np.concatenate([[0] if lead else np.zeros(0, int), lead + new[:-1] - new[0]]).astype(np.int64)
                yield _whole(table.combine_chunks(), starts)
            held = [rows.slice(new[-1])]
        if edge or sum(h.num_rows for h in held) > CLOSED:
            edge = True
            yield from segments(held)
            held = []
    yield from segments(held)


def _summary(segment: pa.Table) -> pa.Table:
    """What the chain needs of a segment: costs between states, counts, its edges."""
    segment = segment.sort_by("at")
    head = {c: segment.column(c)[0].as_py() for c in ("conv_id", "part", "seg")}
    segment = segment.filter(pc.greater(segment.column("times"), 0))
    rows = _rows(segment, np.array([0, segment.num_rows]))
    initials, times = _initials(segment.column("role")).to_pylist(), segment.column("times").to_pylist()
    turns = [t for t in segment.column("turn").to_pylist() if t is not None]
    blank, duplicate, truncated = _faults(segment)
    return pa.Table.from_pylist([{
        **head, "costs": paths.matrix_of(rows).ravel().tolist(), "n_blank": blank, "n_duplicate": duplicate, "n_truncated": truncated,
        "n_illegal": _illegal(initials, times), "first_initial": initials[0] if initials else None,
        "last_initial": initials[-1] if initials else None, "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns))}], schema=_arrow(_SEGMENTS))


def _in_order(segments: pa.Table) -> list[dict]:
    return segments.sort_by([("part", "ascending"), ("seg", "ascending")]).to_pylist()


def _costs_behind(segments: pa.Table) -> pa.Table:
    """Costs to go behind each segment of one conversation."""
    behind, out = paths.final_costs(1)[0], []
    for i, s in enumerate(reversed(_in_order(segments))):
        out.append({"conv_id": s["conv_id"], "part": s["part"], "seg": s["seg"], "behind": behind.tolist(), "final": i == 0})
        matrix = np.array(s["costs"]).reshape(4, 4)
        behind = np.minimum((matrix + behind[None, :]).min(1), paths.NEVER)
    return pa.Table.from_pylist(out, schema=_arrow(_ENDS))


def _totals(segments: pa.Table) -> pa.Table:
    """Counts and cost of one conversation from those of its segments."""
    ordered = _in_order(segments)
    out = {c: sum(s["n_" + c] for s in ordered) for c in ("blank", "duplicate", "truncated", "illegal")}
    edges = [s for s in ordered if s["first_initial"] is not None]
    out["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(edges, edges[1:]))
    known = [s for s in ordered if s["low"] is not None]
    turns = sum(s["turns"] for s in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    behind = paths.final_costs(1)[0]
    for s in reversed(ordered):
        behind = np.minimum((np.array(s["costs"]).reshape(4, 4) + behind[None, :]).min(1), paths.NEVER)
    out |= {"conv_id": ordered[0]["conv_id"], "cost": int(behind[paths.START]),
            "gaps": _gaps(known[0]["low"] if known else None, known[-1]["high"] if known else None, turns)}
    return pa.Table.from_pylist([out], schema=_arrow(f"conv_id long, {_COUNTS}"))


def _from_each_state(segment: pa.Table, ends: pa.Table) -> pa.Table:
    """The least audit of a segment from each state that it can begin in."""
    if not segment.num_rows or not ends.num_rows:
        return _arrow(_PATHS).empty_table()
    segment, end = segment.sort_by("at"), ends.to_pylist()[0]
    segment = segment.filter(pc.greater(segment.column("times"), 0))
    rows = _rows(segment, np.array([0, segment.num_rows]))
    cost = paths.costs_to_go(rows, np.array([end["behind"]]))
    roles, times, out = segment.column("role").to_pylist(), segment.column("times").to_pylist(), []
    for entry in np.flatnonzero(cost[0] < paths.NEVER):
        steps, leaves = paths.least_audits(rows, cost, np.array([entry]), end["final"])
        out.append({"conv_id": end["conv_id"], "part": end["part"], "seg": end["seg"], "entry": int(entry), "leaves": int(leaves[0]),
                    "steps": steps[0], "audit": rebuilt(steps[0], int(entry), roles, None, times)[0]})
    return pa.Table.from_pylist(out, schema=_arrow(_PATHS))


def _followed(segments: pa.Table) -> pa.Table:
    """The state that each segment of one conversation begins in."""
    leaves = {(s["part"], s["seg"], s["entry"]): s["leaves"] for s in segments.to_pylist()}
    state, out = paths.START, []
    for part, seg in sorted({k[:2] for k in leaves}):
        out.append({"part": part, "seg": seg, "entry": state})
        state = leaves[part, seg, state]
    return pa.Table.from_pylist(out, schema=_arrow("part int, seg int, entry int"))


def _pieces(segment: pa.Table, chosen: pa.Table) -> pa.Table:
    """The repaired lines of a segment."""
    schema = _arrow("conv_id long, part int, seg int, piece binary")
    if not segment.num_rows or not chosen.num_rows:
        return schema.empty_table()
    segment, path = segment.sort_by("at"), chosen.to_pylist()[0]
    segment = segment.filter(pc.greater(segment.column("times"), 0))
    roles, texts, times = (segment.column(c).to_pylist() for c in ("role", "text", "times"))
    lines = rebuilt(path["steps"], path["entry"], roles, texts, times)[1]
    return pa.Table.from_pylist([{"conv_id": path["conv_id"], "part": path["part"], "seg": path["seg"],
                                  "piece": "\n".join(lines).encode()}] if lines else [], schema=schema)


def _hashes(batches):
    """The hash of each conversation's pieces, which come in order."""
    schema, open_, running = _arrow("conv_id long, repaired_sha256 string"), False, None
    conv = None
    for rows in batches:
        out = []
        for row in rows.to_pylist():
            if open_ and row["conv_id"] == conv:
                running.update(b"\n")
            else:
                if open_:
                    out.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
                open_, conv, running = True, row["conv_id"], hashlib.sha256()
            running.update(row["piece"])
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if open_:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": running.hexdigest()}], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired text of every conversation.  ``rows``:
    ``conv_id``, ``turn``, ``role``, ``text`` (none of the last two null) and ``times``, the
    number of equal rows it stands for (0: it only names its conversation)."""
    ready(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    walked = staged(flagged(rows).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
                    .sortWithinPartitions(*order).mapInArrow(_walk, _SORTED), "conversations")
    results = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rest = walked.filter("NOT whole")
    light = rest.select("conv_id", "part", "seg", "at", "turn", F.substring("role", 1, 1).alias("role"), "times", "first", "blank_row", "cut_row")
    segments = staged(light.groupBy("part", "seg").applyInArrow(_summary, _SEGMENTS), "conversations-segments")
    ends = segments.groupBy("conv_id").applyInArrow(_costs_behind, _ENDS)
    found = staged(light.groupBy("part", "seg").cogroup(ends.groupBy("part", "seg")).applyInArrow(_from_each_state, _PATHS),
                   "conversations-paths")
    begun = (found.select("conv_id", "part", "seg", "entry", "leaves").groupBy("conv_id")
             .applyInArrow(_followed, "part int, seg int, entry int"))
    chosen = staged(found.join(begun, ["part", "seg", "entry"]), "conversations-chosen")
    pieces = rest.select("conv_id", "part", "seg", "at", "role", "text", "times").groupBy("part", "seg").cogroup(
        chosen.select("conv_id", "part", "seg", "entry", "steps").groupBy("part", "seg")).applyInArrow(
        _pieces, "conv_id long, part int, seg int, piece binary")
    hashes = (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
              .mapInArrow(_hashes, "conv_id long, repaired_sha256 string"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("part", "seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    totals = segments.groupBy("conv_id").applyInArrow(_totals, f"conv_id long, {_COUNTS}").alias("t")
    joined = (totals.join(audits.alias("a"), F.expr("t.conv_id <=> a.conv_id"), "left")
              .join(hashes.alias("h"), F.expr("t.conv_id <=> h.conv_id"), "left")
              .select("t.conv_id", *[f"t.{c}" for c in results[1:7]], F.coalesce("a.audit", F.lit("")).alias("audit"),
                      F.coalesce("h.repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256")))
    return walked.filter("whole").select(results).unionByName(joined)
