"""Conversation structure repair: the cheapest edits that give every conversation its order of roles back.

Turns are cut into chunks of the order (conversation, turn, role, text), dealt by ranges, so that a conversation of any length
is many chunks and many short ones are one task. A row says how its chunk's four costs-to-go (at the start, after a system,
user or assistant turn) follow from those behind it; what counts of such a vector is its differences. A conversation that ends
within its range is solved there. One that reaches a range's edge is solved by rank convergence: every chunk starts from a
speculative vector, then chunks whose right neighbour turned out otherwise are rerun from their end until old and new vectors
differ only by a constant, round after round until no chunk changes. With exact vectors at its end each chunk is traced from
all four states, exits are chained over the chunks, and the chosen trace writes edits and turns.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5; a truncated turn that stays
costs 5 more; blank and duplicate turns must go. Of cheapest edits the ASCII-least string of initials counts; it fixes the turns.

Defined results: a null role or text is one space, and so is a null in the damage's key; a null conv_id is a conversation of its
own; rows of one turn follow each other by role and text as bytes, and equal rows count as often as they come. A conversation
without rows after damage gives zeros, an empty audit and the hash of nothing. An empty table gives no rows; other columns are
ignored. A result is one row a conversation: its audit and its hash are read chunk by chunk in one task, a chunk in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads.
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn leads, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, CUT_SHORT, GONE = range(3)
#: Costs behind the last turn, and the turns inserted there.
AT_END, LAST = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
SPECULATIVE = (0, 0, 0, 0)

Vector = tuple[int, ...]


@lru_cache(maxsize=100_000)
def step(code: int, behind: Vector) -> tuple[Vector, tuple[tuple[str, int, int], ...]]:
    """Costs before a turn, less their least, and for each state the edits made there, the state they lead to and their cost. Vectors are few: no two costs are over 10 apart."""
    initial, kind = "sua?"[code % 4], code // 4
    more = TRUNCATED if kind == CUT_SHORT else 0
    stay = kind != GONE
    take: list[dict[str, tuple[int, int]]] = []
    for s in range(4):
        ways = {"D": (DELETE, s)}
        if stay and s in KEPT.get(initial, {}):
            ways["K"] = (KEEP + more, KEPT[initial][s])
        if stay:
            ways["R"] = (REROLE + more, FORCED[s])
        take.append(ways)
    here = [min(c + behind[t] for c, t in ways.values()) for ways in take]
    for _ in range(2):
        here = [min(x, INSERT + here[FORCED[s]]) for s, x in enumerate(here)]
    moves = []
    for s in range(4):
        at, letters, cost = s, "", 0
        while True:
            ways = take[at]
            best = {k for k, (c, t) in ways.items() if c + behind[t] == here[at]}
            if INSERT + here[FORCED[at]] == here[at]:
                best.add("I")
            letter = min(best)
            letters += letter
            if letter != "I":
                moves.append((letters, ways[letter][1], cost + ways[letter][0]))
                break
            at, cost = FORCED[at], cost + INSERT
    least = min(here)
    return tuple(x - least for x in here), tuple(moves)


def backward(codes: bytes, right: Vector) -> Vector:
    """Costs before a chunk, less their least."""
    for code in reversed(codes):
        right = step(code, right)[0]
    return right


def fixed_up(codes: bytes, was: Vector, left: Vector, right: Vector) -> Vector:
    """Costs before a chunk that was run from `was` to `left`, now from `right`: rerun only until both agree but for a constant."""
    for code in reversed(codes):
        if was == right:
            return left
        was, right = step(code, was)[0], step(code, right)[0]
    return right


def traced(codes: bytes, right: Vector, start: int) -> tuple[list[str], int, int]:
    """The edits at each turn from a state, where they lead, and their cost."""
    stack = []
    for code in reversed(codes):
        right, moves = step(code, right)
        stack.append(moves)
    edits, cost = [], 0
    for moves in reversed(stack):
        letters, start, paid = moves[start]
        edits.append(letters)
        cost += paid
    return edits, start, cost


def exits(codes: bytes, right: Vector) -> list[int]:
    stack = []
    for code in reversed(codes):
        right, moves = step(code, right)
        stack.append(moves)
    out = list(range(4))
    for moves in reversed(stack):
        out = [moves[s][1] for s in out]
    return out


def repaired(turns: list[tuple[str, str]], edits: Iterable[str], state: int) -> list[str]:
    """What the edits leave of (role, text)."""
    out = []
    for (role, text), letters in zip(turns, edits, strict=True):
        for x in letters:
            if x == "K":
                out.append(f"{role}:{text}")
                state = KEPT[role[:1]][state]
            elif x != "D":
                state = FORCED[state]
                out.append(f"{NAMES[state]}:{text if x == 'R' else ''}")
    return out


class Chunk:
    """Turns in their order as codes, and what is counted of them. rows: (turn, role, text, how many, whether an earlier chunk has it)."""

    def __init__(self, rows: Iterable[tuple[int | None, str, str, int, bool]]):
        self.turns: list[tuple[str, str]] = []
        self.numbers: list[int] = []
        codes, seen = bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        for turn, role, text, n, before in rows:
            end = text.rstrip(SPACE)
            for _ in range(n):
                if not end:
                    kind, self.blank = GONE, self.blank + 1
                elif before or (role, text) in seen:
                    kind, self.duplicate = GONE, self.duplicate + 1
                elif end[-1] not in ".!?":
                    kind, self.truncated = CUT_SHORT, self.truncated + 1
                else:
                    kind = FINE
                seen.add((role, text))
                codes.append(kind * 4 + max(0, "sua?".find(role[:1] or "?")) if role[:1] in ("s", "u", "a") else kind * 4 + 3)
                if self.turns:
                    self.illegal += is_illegal(self.turns[-1][0], role)
                self.turns.append((role, text))
            if n and turn is not None and (not self.numbers or self.numbers[-1] != turn):
                self.numbers.append(turn)
        self.codes = bytes(codes)


def is_illegal(before: str, after: str) -> bool:
    return before[:1] + after[:1] not in ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: what the contract's damage leaves; n is 0 where it takes the row away."""
    hit = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("n"),
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTS = ", ".join(f"{c} long" for c in COUNTS)
#: A row of a chunk at a range's edge.
_EDGE = "part int, at long, turn long, role string, text string, n long"
_EDGE_ARROW = [("part", pa.int32()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]
_RESULT_ARROW = [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def repair(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, COUNTS, audit, repaired_sha256 of conversations given as conv_id, turn, role, text, n (how often the row counts).

    `ranges` is the number of ranges that rows are dealt to; spark.sql.shuffle.partitions if it isn't given.
    """
    order = ["conv_id", "turn", "role", "text"]
    conv = rows.schema["conv_id"].dataType.simpleString()
    summed = rows.groupBy(*order).agg(F.sum("n").alias("n"))  # equal rows can't be told apart by any range
    dealt = summed.repartitionByRange(ranges, *order) if ranges else summed.repartitionByRange(*order)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's conversations in order: those within it are solved, the first and the last are handed on."""
        kind = [("conv_id", None), *_RESULT_ARROW, *_EDGE_ARROW]
        first = True
        held: list[tuple] = []

        def edge(rows: list[tuple]) -> pa.RecordBatch:
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_pylist([{"conv_id": r[0], "part": part, "at": i, **dict(zip(("turn", "role", "text", "n"), r[1:], strict=True))} for i, r in enumerate(rows)], schema=schema)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *kind[1:]])
            out = []
            for _, group in groupby(zip(*(batch.column(c).to_pylist() for c in (*order, "n")), strict=True), key=lambda r: r[0]):
                group = list(group)
                if held and held[0][0] == group[0][0]:
                    held += group
                    continue
                if held and first:
                    yield edge(held)
                    first = False
                elif held:
                    out.append(_whole(held))
                held = group
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield edge(held)

    x = cut(dealt.sortWithinPartitions(*order).select(*order, "n").mapInArrow(solve, f"conv_id {conv}, {_COUNTS}, audit string, repaired_sha256 string, {_EDGE}"))
    edges = x.where("part IS NOT NULL").select(F.concat(F.when(F.col("conv_id").isNull(), "").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("of"), "conv_id", "part", "at", "turn", "role", "text", "n")
    return x.where("part IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256").unionByName(_stitched(edges, conv))


def _whole(rows: list[tuple]) -> dict:
    """The result of a conversation that lies in one chunk."""
    chunk = Chunk((*r[1:], False) for r in rows)
    edits, state, cost = traced(chunk.codes, AT_END, START)
    turns = repaired(chunk.turns, edits, START) + _inserted(state)
    return {"conv_id": rows[0][0], "gaps": chunk.numbers[-1] - chunk.numbers[0] + 1 - len(chunk.numbers) if chunk.numbers else 0, "blank": chunk.blank, "duplicate": chunk.duplicate, "truncated": chunk.truncated, "illegal": chunk.illegal, "cost": cost + AT_END[state], "audit": "".join(edits) + LAST[state], "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest()}


def _inserted(state: int) -> list[str]:
    out = []
    for _ in LAST[state]:
        state = FORCED[state]
        out.append(f"{NAMES[state]}:")
    return out


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in columns.split(", ")])


def _batches(rows: Iterable[dict], columns: str) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pylist(list(rows), schema=_arrow(columns))


_CHUNK = "of string, part int, codes binary, blank long, duplicate long, truncated long, illegal long, opens string, closes string, numbers long, lowest long, highest long"
_VECTORS = "of string, part int, following int, codes binary, right array<int>, left array<int>"
_STARTS = "of string, part int, start int"
_PIECE = "of string, part int, audit string, turns string, cost long, leads int"
_END = "of string, audit string, repaired_sha256 string, cost long"


def _converged(chunks: DataFrame) -> DataFrame:
    """_VECTORS with exact costs at each chunk's end: a round reruns the chunks whose right neighbour has other differences than they were run from."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r | {"right": AT_END if r["following"] is None else SPECULATIVE} for r in b.to_pylist()]
            yield from _batches((r | {"left": backward(r["codes"], r["right"])} for r in rows), _VECTORS)

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches((r | {"left": fixed_up(r["codes"], tuple(r["right"]), tuple(r["left"]), tuple(r["true"])), "right": r["true"]} for r in b.to_pylist()), _VECTORS)

    x = cut(chunks.select("of", "part", "following", "codes").mapInArrow(begin, _VECTORS))
    while True:
        neighbour = x.select("of", F.col("part").alias("following"), F.col("left").alias("true"))
        met = x.join(neighbour, ["of", "following"], "left").withColumn("true", F.coalesce("true", "right"))
        if met.where(F.col("right") != F.col("true")).isEmpty():
            return x
        x = cut(met.mapInArrow(rerun, _VECTORS))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose chunks come in order, one chunk in memory."""
    of, rows = None, []

    def ended() -> dict:
        for turn in _inserted(state):
            spelled(turn)
        return {"of": of, "audit": "".join(audit) + LAST[state], "repaired_sha256": sha.hexdigest(), "cost": cost + AT_END[state]}

    def spelled(turns: str) -> None:
        nonlocal begun
        sha.update(("\n" if begun else "").encode() + turns.encode())
        begun = True

    for batch in batches:
        for r in batch.to_pylist():
            if r["of"] != of:
                if of is not None:
                    rows.append(ended())
                of, sha, audit, cost, begun = r["of"], hashlib.sha256(), [], 0, False
            if r["turns"] is not None:
                spelled(r["turns"])
            audit.append(r["audit"])
            cost, state = cost + r["cost"], r["leads"]
        yield from _batches(rows, _END)
        rows = []
    if of is not None:
        yield from _batches([ended()], _END)


def _stitched(edges: DataFrame, conv: str) -> DataFrame:
    """The results of conversations whose chunks may lie in several ranges. of: the conversation, told by a string that is never null."""
    # A turn that an earlier chunk has: the first chunk with its role and text, summed up before it is joined.
    edges = edges.withColumn("told", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    has = edges.where("n > 0").groupBy("of", "told").agg(F.min("part").alias("has"))
    seen = F.coalesce(F.col("has") < F.col("part"), F.lit(False)).alias("seen")
    rows = cut(edges.join(has, ["of", "told"], "left").select("of", "part", "at", "turn", "role", "text", "n", seen))

    def read(group: pa.Table) -> Chunk:
        group = group.sort_by("at")
        return Chunk(zip(*(group[c].to_pylist() for c in ("turn", "role", "text", "n", "seen")), strict=True))

    def coded(group: pa.Table) -> pa.Table:
        c = read(group)
        ends = {"opens": c.turns[0][0], "closes": c.turns[-1][0]} if c.turns else {}
        spans = {"lowest": c.numbers[0], "highest": c.numbers[-1]} if c.numbers else {}
        row = {"of": group["of"][0].as_py(), "part": group["part"][0].as_py(), "codes": c.codes, "blank": c.blank, "duplicate": c.duplicate, "truncated": c.truncated, "illegal": c.illegal, "numbers": len(c.numbers), **ends, **spans}
        return pa.Table.from_pylist([row], schema=_arrow(_CHUNK))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(({"of": r["of"], "part": r["part"], "exits": exits(r["codes"], tuple(r["right"]))} for r in b.to_pylist()), "of string, part int, exits array<int>")

    def chained(group: pa.Table) -> pa.Table:
        out, state = [], START
        for r in group.sort_by("part").to_pylist():
            out.append({"of": r["of"], "part": r["part"], "start": state})
            state = r["exits"][state]
        return pa.Table.from_pylist(out, schema=_arrow(_STARTS))

    def written(group: pa.Table, plan: pa.Table) -> pa.Table:
        c, p = read(group), plan.to_pylist()[0]
        edits, state, cost = traced(c.codes, tuple(p["right"]), p["start"])
        turns = repaired(c.turns, edits, p["start"])
        return pa.Table.from_pylist([{"of": p["of"], "part": p["part"], "audit": "".join(edits), "turns": "\n".join(turns) if turns else None, "cost": cost, "leads": state}], schema=_arrow(_PIECE))

    place = Window.partitionBy("of").orderBy("part")
    chunks = cut(rows.groupBy("of", "part").applyInArrow(coded, _CHUNK).withColumn("following", F.lead("part").over(place)))
    vectors = _converged(chunks)
    # Four small numbers a chunk are chained: the state before a chunk is where all chunks before it lead.
    starts = vectors.select("of", "part", "codes", "right").mapInArrow(led, "of string, part int, exits array<int>").groupBy("of").applyInArrow(chained, _STARTS)
    plans = vectors.select("of", "part", "right").join(starts, ["of", "part"])
    pieces = rows.groupBy("of", "part").cogroup(plans.groupBy("of", "part")).applyInArrow(written, _PIECE)
    ends = pieces.repartition("of").sortWithinPartitions("of", "part").mapInArrow(_joined, _END)

    before = place.rowsBetween(Window.unboundedPreceding, -1)
    pair = F.concat(F.substring(F.last("closes", ignorenulls=True).over(before), 1, 1), F.substring("opens", 1, 1))
    same = F.last("highest", ignorenulls=True).over(before) == F.col("lowest")
    counted = chunks.select("of", "blank", "duplicate", "truncated", "lowest", "highest", (F.col("illegal") + F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("illegal"), (F.col("numbers") - F.coalesce(same.cast("long"), F.lit(0))).alias("numbers"))
    sums = counted.groupBy("of").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "numbers")), (F.max("highest") - F.min("lowest") + 1).alias("span"))
    ids = edges.groupBy("of").agg(F.first("conv_id").alias("conv_id"))
    gaps = F.coalesce(F.col("span") - F.col("numbers"), F.lit(0)).alias("gaps")
    return ends.join(sums, "of").join(ids, "of").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The same rules over one turn after another, cost vectors and edits by recursion.
SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keys AS (SELECT k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hit
  FROM (SELECT DISTINCT k FROM raw)),
hurt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw JOIN keys USING (k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
judged AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM placed),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged),
turns AS (SELECT *, left(role, 1) AS r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e FROM faulty),
back AS (SELECT conv_id, n + 1 AS i, 0 AS b0, 10 AS b1, 5 AS b2, 0 AS b3 FROM turns WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(a0, 5 + a2, 10 + a3), least(a1, 5 + a2, 10 + a3), least(a2, 5 + a3), least(a3, 5 + a2) FROM (
    SELECT t.conv_id, t.i,
      least(2 + b0, CASE WHEN NOT gone THEN e + least(1 + b2, CASE r WHEN 's' THEN b1 WHEN 'u' THEN b2 END) END) AS a0,
      least(2 + b1, CASE WHEN NOT gone THEN e + least(1 + b2, CASE r WHEN 'u' THEN b2 END) END) AS a1,
      least(2 + b2, CASE WHEN NOT gone THEN e + least(1 + b3, CASE r WHEN 'a' THEN b3 END) END) AS a2,
      least(2 + b3, CASE WHEN NOT gone THEN e + least(1 + b2, CASE r WHEN 'u' THEN b2 END) END) AS a3
    FROM back AS b JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1) AS one),
costs AS (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM back),
ways AS (SELECT t.conv_id, t.i, t.n, role, text, gone, e, h.b AS here, f.b AS behind,
    CASE r WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE CAST([NULL, NULL, NULL, NULL] AS INT[]) END AS kept
  FROM turns AS t JOIN costs AS h ON h.conv_id IS NOT DISTINCT FROM t.conv_id AND h.i = t.i JOIN costs AS f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1
  UNION ALL SELECT conv_id, n + 1, n, NULL, NULL, TRUE, 0, [0, 10, 5, 0], NULL, NULL FROM turns WHERE i = n),
walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS made, 0 AS cost FROM turns WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END, CASE x WHEN 'D' THEN s WHEN 'K' THEN kept[s + 1] ELSE forced END, audit || x,
    CASE x WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) ELSE list_append(made, CASE forced WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE x WHEN 'R' THEN text ELSE '' END) END,
    cost + CASE x WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN e ELSE 1 + e END
  FROM (SELECT w.conv_id, w.i, w.s, w.audit, w.made, w.cost, y.role, y.text, y.kept, y.e, [2, 2, 3, 2][w.s + 1] AS forced,
      CASE WHEN y.i <= y.n AND 2 + behind[w.s + 1] = here[w.s + 1] THEN 'D' WHEN 5 + here[[2, 2, 3, 2][w.s + 1] + 1] = here[w.s + 1] THEN 'I'
        WHEN NOT gone AND e + behind[kept[w.s + 1] + 1] = here[w.s + 1] THEN 'K' ELSE 'R' END AS x
    FROM walk AS w JOIN ways AS y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i WHERE y.i <= y.n OR w.s IN (1, 2)) AS one),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(made, length(audit)) AS made, max(cost) AS cost FROM walk GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id
"""
