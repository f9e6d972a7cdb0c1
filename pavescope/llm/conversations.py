"""Conversation structure repair: the cheapest edits that give a conversation its turn grammar, by Dijkstra's algorithm.

The lattice is implicit. A node is (rows read, grammar state); an edge keeps, reroles or deletes the next row, or inserts
a turn before it. The priority is (cost, audit), where the audit holds the initials of the edits so far, so the first
popped node that has read all rows in an accepting state is the cheapest, the least in ASCII among ties.

Longer conversations are cut into pieces of PIECE rows. A piece's own lattice gives the least (cost, audit) from each
state to each; a second lattice, of pieces, joins them. That is exact: of two audits between the same nodes at one
cost neither is a prefix of the other, so the lesser stays the lesser whatever follows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import text as tx
from .importance import CRC32

#: Rows of a piece.
PIECE = 512
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn; those that may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: States by the initial of the next role.
STEPS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What Rerole and Insert make in each state: user, or assistant after a user.
MADE = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"

Edges = Callable[[int, int], Iterable[tuple[int, str, int, int]]]


def dijkstra(start: int, edges: Edges, ends: Callable[[int, int], bool]) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) of the nodes that end, as they are popped; nodes are (place, state), edges give (cost, edits, place, state)."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    best: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if best[at, state] != (cost, audit):
            continue
        if ends(at, state):
            yield cost, audit, state
        for more, edits, to, into in edges(at, state):
            label = (cost + more, audit + edits)
            if (to, into) not in best or label < best[to, into]:
                best[to, into] = label
                heapq.heappush(heap, (*label, to, into))


def lattice(codes: str) -> Edges:
    """Edges of rows. codes has two characters a row: the role's initial (x: none of the grammar's), and - (sound), t (truncated) or d (must go)."""

    def edges(at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        made = STEPS[state][MADE[state]]
        yield INSERT, "I", at, made
        if 2 * at == len(codes):
            return
        initial, fault = codes[2 * at : 2 * at + 2]
        yield DELETE, "D", at + 1, state
        if fault != "d":
            short = CUT_SHORT if fault == "t" else 0
            yield REROLE + short, "R", at + 1, made
            if initial in STEPS[state]:
                yield KEEP + short, "K", at + 1, STEPS[state][initial]

    return edges


@functools.lru_cache(maxsize=20_000)
def repair(codes: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    n = len(codes) // 2
    return next(dijkstra(EMPTY, lattice(codes), lambda at, state: at == n and state in ENDS))[:2]


def crossing(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a piece, for all pairs of states that edits join."""
    n = len(codes) // 2
    return [(a, b, cost, audit) for a in range(4) for cost, audit, b in dijkstra(a, lattice(codes), lambda at, state: at == n)]


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The least (cost, audit) of a conversation in pieces."""
    by = [{a: [(cost, audit, k + 1, b) for x, b, cost, audit in piece if x == a] for a in range(4)} for k, piece in enumerate(pieces)]
    edges = lambda at, state: by[at][state] if at < len(by) else ()
    return next(dijkstra(EMPTY, edges, lambda at, state: at == len(by) and state in ENDS))[:2]


def walked(codes: str, audit: str) -> list[list[str]]:
    """For each row what comes out in its place: a role (an inserted turn), K (itself), or R and a role (itself as that role).

    Insertions before a row are its own; those after the last row are the last row's.
    """
    state, at, out, now = EMPTY, 0, [], []
    for edit in audit:
        if edit in "IR":
            now.append(("R" if edit == "R" else "") + ROLES[MADE[state]])
            state = STEPS[state][MADE[state]]
        elif edit == "K":
            now.append("K")
            state = STEPS[state][codes[2 * at]]
        if edit != "I":
            out.append(now)
            now, at = [], at + 1
    out[-1] += now
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of the rows after damage by crc32 of conv_id:turn; nulls are one space, but for conv_id and turn themselves."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    k, text = F.col("_kind"), F.col("text")
    text = F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(0), F.when(k == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copy) with pos in their conversation, fault, code, and whether turn is new and the roles' order illegal.

    Rows stand by turn (nulls first), then role, text and copy. A conversation is sorted in one task, which spills and holds none of it.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    initial = F.substring("role", 1, 1)
    out = rows.select("conv_id", "turn", "role", "text", (F.row_number().over(order) - 1).alias("pos"), same.alias("_same"), initial.alias("_initial"), F.lag("turn").over(order).alias("_turn"), F.lag(initial).over(order).alias("_before"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "_same").orderBy("pos")) > 1
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    out = out.withColumn("fault", fault)
    code = F.concat(F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("x"), F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("-"))
    illegal = (F.col("pos") > 0) & ~F.concat("_before", "_initial").isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    return out.select("conv_id", "turn", "role", "text", "pos", "fault", code.alias("code"), illegal.alias("illegal"), fresh.alias("fresh"))


_CROSSING = "array<struct<a:int,b:int,cost:long,audit:string>>"


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        made = [[dict(zip(("a", "b", "cost", "audit"), x)) for x in crossing(codes)] if long else [] for codes, long in zip(batch.column("codes").to_pylist(), batch.column("long").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "piece", "codes")), pa.array(made, kind)], ["conv_id", "piece", "codes", "crossing"])


def _decided(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 256):
            costs, audits, outs = [], [], []
            for pieces in batch.column("pieces").to_pylist():
                codes = "".join(p["codes"] for p in pieces)
                cost, audit = repair(codes) if len(pieces) == 1 else joined([[tuple(x.values()) for x in p["crossing"]] for p in pieces])
                rows = walked(codes, audit)
                costs.append(cost)
                audits.append(audit)
                outs.append([rows[a : a + size] for a in range(0, len(rows), size)])
            kinds = pa.list_(pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(outs, kinds)], ["conv_id", "cost", "audit", "out"])

    return run


def decisions(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, cost, audit and out (by piece and row, see walked()) of each conversation of judged rows. Only codes, two characters a row, meet in a task."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    part = F.expr(f"pos div {piece}").cast("int")
    pieces = rows.groupBy("conv_id", part.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_rows"))
    pieces = pieces.select("conv_id", "piece", F.array_join("_rows.code", "").alias("codes"))
    long = F.max("piece").over(Window.partitionBy("conv_id")) > 0
    crossed = pieces.withColumn("long", long).mapInArrow(_crossings, f"conv_id {kind}, piece int, codes string, crossing {_CROSSING}")
    whole = crossed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "codes", "crossing"))).alias("pieces"))
    return whole.mapInArrow(_decided(piece), f"conv_id {kind}, cost long, audit string, out array<array<array<string>>>")


def repaired(rows: DataFrame, decided: DataFrame, piece: int = PIECE) -> DataFrame:
    """The turns of the repaired conversations: conv_id, pos and nth (their order), role, text and edit."""
    outs = decided.select(F.col("conv_id").alias("_conv"), F.posexplode("out").alias("_piece", "_out"))
    both = rows.join(outs, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.expr(f"pos div {piece}") == F.col("_piece")))
    turns = both.select("conv_id", "pos", "role", "text", F.posexplode(F.get("_out", F.expr(f"pos % {piece}").cast("int"))).alias("nth", "_do"))
    do = F.col("_do")
    edit = F.when(do == "K", "Keep").when(do.startswith("R"), "Rerole").otherwise("Insert")
    role = F.when(do == "K", F.col("role")).when(do.startswith("R"), F.expr("substring(_do, 2)")).otherwise(do)
    return turns.select("conv_id", "pos", "nth", role.alias("role"), F.when(edit == "Insert", "").otherwise(F.col("text")).alias("text"), edit.alias("edit"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its turns as role:text, joined by newlines. Turns stream by: a task holds a hash, not a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, ids, out = None, None, None, []

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([open_.hexdigest()])], ["conv_id", "sha"])

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if open_ is None or conv != now:
                    if open_ is not None:
                        out.append(ended())
                    now, open_ = conv, hashlib.sha256(line.encode())
                else:
                    open_.update(b"\n" + line.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if open_ is not None:
            yield ended()

    lines = turns.select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_ = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "line")
    return sorted_.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha string")


def conversation_repair(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Nulls of role and text are one space; null turns come first and null conv_ids are one conversation. Repeated rows are
    duplicates after the first; rows of one turn stand by role and text. A conversation without rows after damage has
    zeros, an empty audit and the hash of an empty string. Other columns are not looked at; an empty table gives no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    with tx.text_batches(conversations.sparkSession):
        rows = tx.written(judged(damaged(conversations.select("conv_id", "turn", "role", "text"))), "repair-rows")
        decided = tx.written(decisions(rows, piece), "repair-decisions")
        hashed = tx.written(digests(repaired(rows, decided, piece)), "repair-digests")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("fresh"))
    stats = rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if(F.col("illegal")).alias("illegal"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select("conv_id").distinct(), stats, decided.select("conv_id", "cost", "audit"), hashed]
    empty = parts[0].select("conv_id", *[F.lit(None).cast("long").alias(c) for c in numbers], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("sha"))
    all_ = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [empty, *parts[1:]])
    out = all_.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *numbers, "audit", "repaired_sha256")


def _oracle() -> str:
    """DuckDB SQL of conversation_repair over conversations: layer by layer in a recursive query, every state's least (cost, audit, repaired lines)."""
    label = lambda x, cost, edit, line="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {line}}} END"
    line = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    user, assistant = line("'user'"), line("'assistant'")
    m2 = "list_min([l2, " + ", ".join(label(x, 2, "I", user) for x in ("l0", "l1", "l3")) + "])"
    m3 = "list_min([l3, " + label("m2", 2, "I", assistant) + "])"
    drop = lambda x: label(x, 3, "D")
    keep = lambda x, i: f"CASE WHEN NOT bad AND ini = '{i}' AND {x} IS NOT NULL THEN {{'c': {x}.c + short, 'a': {x}.a || 'K', 't': {x}.t || {line('role', 'text')}}} END"
    change = lambda x, role: f"CASE WHEN NOT bad AND {x} IS NOT NULL THEN {{'c': {x}.c + 2 + short, 'a': {x}.a || 'R', 't': {x}.t || {line(repr(role), 'text')}}} END"
    l1 = f"list_min([{drop('l1')}, {keep('l0', 's')}])"
    l2 = f"list_min([{drop('m2')}, " + ", ".join(change(x, "user") + ", " + keep(x, "u") for x in ("l0", "l1", "m3")) + "])"
    l3 = f"list_min([{drop('m3')}, {change('m2', 'assistant')}, {keep('m2', 'a')}])"
    crc = CRC32.format("key")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 d AS (SELECT *, {crc} % 20 AS kind FROM k),
 e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
 r AS (SELECT *, bare = '' OR seen AS bad, CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS short FROM f),
 z AS (SELECT NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS none),
 p AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS l0, none AS l1, none AS l2, none AS l3 FROM (SELECT DISTINCT conv_id FROM r), z
       UNION ALL
       SELECT conv_id, i, {drop('l0')}, {l1}, {l2}, {l3} FROM (SELECT *, {m3} AS m3 FROM (SELECT r.conv_id, r.i, r.role, r.text, r.ini, r.bad, r.short, l0, l1, l2, l3, {m2} AS m2 FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
 n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (bare = '') AS blank, count(*) FILTER (bare <> '' AND seen) AS duplicate,
              count(*) FILTER (NOT bad AND short = 1) AS truncated, count(*) FILTER (i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
 best AS (SELECT conv_id, list_min([l0, m3]) AS best FROM (SELECT *, {m3} AS m3 FROM (SELECT p.*, {m2} AS m2 FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n.n)))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
