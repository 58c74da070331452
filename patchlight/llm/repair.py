"""Repairing the structure of conversations: the cheapest edits after which roles follow the grammar (s?(ua)+)?."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import materialise, scratch

#: Costs of deleting, inserting and changing the role of a turn, and of leaving a truncated one.
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 2, 5, 1, 5
#: Turns of a conversation are searched in segments of so many turn numbers (a power of two), and in pieces of so many rows or bytes at most.
SEGMENT_BITS, PIECE_ROWS, PIECE_BYTES = 10, 256, 1 << 22
WHITE = " \t\n\x0b\f\r"

#: What the grammar can have had last: nothing, the system's turn, the user's, the assistant's. By each: what a user's or assistant's turn makes of it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}


def moves() -> list[tuple[str, int, int, int, str, bool]]:
    """(initial, before, after, cost, edits, leaves): all that can be done up to and with a row of an initial; "-" is a row that has to go."""
    out = []
    for before in range(4):
        state = before
        for inserted in range(3):  # a third one would be where the first was
            edits, cost = "I" * inserted, INSERT * inserted
            for initial in "sua?-":
                out.append((initial, before, state, cost + DELETE, edits + "D", False))
                if initial != "-":
                    out.append((initial, before, NEXT[state], cost + REROLE, edits + "R", True))
                if (initial, state) in KEEPS:
                    out.append((initial, before, KEEPS[initial, state], cost, edits + "K", True))
            state = NEXT[state]
    return out


#: One recursion takes one row of every piece, from each state that the piece may begin with: of all ways to a state the cheapest stays, of those the one of the least edits.
SEARCH = f"""
WITH RECURSIVE best(piece, start, state, place, cost, edits) USING KEY (piece, start, state) AS (
  SELECT DISTINCT piece, s, s, 0, 0::BIGINT, '' FROM turns, range(4) r(s)
  UNION
  SELECT piece, start, after, place + 1, way.cost, way.edits FROM (
    SELECT b.piece, b.start, m.after, b.place, min({{'cost': b.cost + m.cost + CASE WHEN m.leaves AND t.truncated THEN {LEFT_TRUNCATED} ELSE 0 END, 'edits': b.edits || m.edits}}) AS way
    FROM best b JOIN turns t ON t.piece = b.piece AND t.place = b.place JOIN moves m ON m.initial = t.initial AND m.before = b.state GROUP BY ALL)
)
SELECT piece, list(start ORDER BY start, state) AS starts, list(state ORDER BY start, state) AS states, list(cost ORDER BY start, state) AS costs, list(edits ORDER BY start, state) AS edits
FROM best JOIN (SELECT piece, count(*) AS n FROM turns GROUP BY piece) USING (piece) WHERE place = n GROUP BY piece ORDER BY piece
"""


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as a checksum of conversation and turn damages them; null roles and texts are one space, as nulls are in the checksum."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    return conversations.where(kind != 0).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with equal ones made one, and what is wrong with the first copy: blank, duplicate, truncated.

    A row is a duplicate if its conversation has role and text in an earlier turn; all copies but the first are duplicates or blank anyway.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumns({"place": place, "same": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))})
    # only of what stands in several turns; summed before it is dealt out
    several = rows.groupBy(F.col("conv_id").alias("of"), F.col("same").alias("what")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(several, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("what")), "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    blank, again = last == "", F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"), (~blank & again).alias("duplicate"), (~blank & ~again & ~last.isin(".", "!", "?")).alias("truncated"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, a row for each piece: its rows, and the cheapest edits between any two states."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("CREATE TABLE moves(initial VARCHAR, before INT, after INT, cost INT, edits VARCHAR, leaves BOOLEAN)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    last, number = None, 0
    for b in batches:
        if not len(b):
            continue
        names = ["conv_id", "segment"]
        keys = np.stack([b.column(n).dictionary_encode("encode").indices.to_numpy() for n in names], 1)
        begins = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        size = np.cumsum(b.column("size").to_numpy()) // PIECE_BYTES
        run = np.flatnonzero(begins)[np.cumsum(begins) - 1]  # where each row's run began
        place = np.arange(len(b)) - run
        cut = begins | (place % PIECE_ROWS == 0) | np.r_[True, size[1:] != size[:-1]]
        piece, starts = np.cumsum(cut) - 1, np.flatnonzero(cut)
        turns = pa.table({"piece": piece, "place": np.arange(len(b)) - starts[piece], "initial": b.column("initial"), "truncated": b.column("truncated")})
        con.register("turns", turns)
        found = con.execute(SEARCH).to_arrow_table().combine_chunks()
        con.unregister("turns")
        # pieces of a run are numbered in order, over batches as well
        numbers = np.arange(len(starts)) - piece[run[starts]]
        first = tuple(b.column(n)[0].as_py() for n in names)
        if first == last:
            numbers[run[starts] == 0] += number + 1
        last, number = tuple(b.column(n)[len(b) - 1].as_py() for n in names), int(numbers[-1])
        bounds = pa.array(np.r_[starts, len(b)].astype(np.int32))
        of = [pa.ListArray.from_arrays(bounds, b.column(n)) for n in ("role", "text", "copies")]
        ways = [found.column(n).combine_chunks() if isinstance(found.column(n), pa.ChunkedArray) else found.column(n) for n in ("starts", "states", "costs", "edits")]
        ways = [w.cast(t) for w, t in zip(ways, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())))]
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(starts)) for n in names), pa.array(numbers), *of, *ways], [*names, "piece", "roles", "texts", "copies", "starts", "states", "costs", "edits"])


Ways = dict[tuple[int, int], tuple[int, str]]


def then(a: Ways, b: Ways) -> Ways:
    """The cheapest ways through two pieces, by (state before, state after): (cost, edits)."""
    out: Ways = {}
    for (x, y), (cost, edits) in a.items():
        for (y2, z), (more, further) in b.items():
            if y == y2:
                way = (cost + more, edits + further)
                if (x, z) not in out or way < out[x, z]:
                    out[x, z] = way
    return out


def finish(ways: Ways) -> tuple[int, str]:
    """The cheapest way from nothing to an end that the grammar allows, with the turns inserted that it lacks."""
    ends = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    return min((cost + INSERT * ends[y], edits + "I" * ends[y]) for (x, y), (cost, edits) in ways.items() if x == NOTHING)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order, a row for each conversation. Pieces are joined two and two, those joined again, so that edits are copied as often as the logarithm of their number."""
    held: list[tuple[int, Ways]] = []  # numbers of pieces, falling, and the ways through them
    last, any_yet = None, False

    def whole() -> tuple[int, str]:
        ways = held[-1][1]
        for _, w in held[-2::-1]:
            ways = then(w, ways)
        return finish(ways)

    for b in batches:
        ids, costs, edits = [], [], []
        for conv, *of in zip(*(b.column(n).to_pylist() for n in ("conv_id", "starts", "states", "costs", "edits"))):
            if any_yet and conv != last:
                cost, letters = whole()
                ids.append(last), costs.append(cost), edits.append(letters)
                held.clear()
            last, any_yet = conv, True
            n, ways = 1, {(x, y): (c, e) for x, y, c, e in zip(*of)}
            while held and held[-1][0] == n:
                n, ways = 2 * n, then(held.pop()[1], ways)
            held.append((n, ways))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("conv_id").type), pa.array(costs, pa.int64()), pa.array(edits, pa.string())], ["conv_id", "cost", "edits"])
        kind = b.schema.field("conv_id").type
    if any_yet:
        cost, letters = whole()
        yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([cost], pa.int64()), pa.array([letters], pa.string())], ["conv_id", "cost", "edits"])


class _Written:
    """A conversation as its edits make it, written piece by piece."""

    def __init__(self, conv: object, cost: int, edits: str):
        self.conv, self.cost, self.edits, self.at, self.state = conv, cost, edits, 0, NOTHING
        self.hash, self.lines, self.audit, self.illegal, self.initial = hashlib.sha256(), 0, [], 0, None

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self.audit.append("I")
            self._line(ROLE[self.state], "")

    def add(self, roles: list[str], texts: list[str], copies: list[int]) -> None:
        for role, text, n in zip(roles, texts, copies):
            initial = role[:1]
            self.illegal += (n - 1) + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
            self.initial = initial
            self._inserts()
            edit = self.edits[self.at]
            if edit == "K":
                self.state = KEEPS[initial, self.state]
                self._line(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                self._line(ROLE[self.state], text)
            self.at, self.cost = self.at + 1, self.cost + DELETE * (n - 1)
            self.audit.append(edit + "D" * (n - 1))

    def row(self) -> tuple[object, int, int, str, str]:
        self._inserts()
        return self.conv, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's edits and then its pieces, in order, its row; of texts only a piece's are held."""
    now: _Written | None = None
    names, kind = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"], pa.int64()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for b in batches:
        done, kind = [], b.schema.field("conv_id").type
        for conv, cost, edits, *of in zip(*(b.column(n).to_pylist() for n in ("conv_id", "cost", "edits", "roles", "texts", "copies"))):
            if edits is not None:
                if now is not None:
                    done.append(now.row())
                now = _Written(conv, cost, edits)
            else:
                now.add(*of)
        if done:
            yield batch(done)
    if now is not None:
        yield batch([now.row()])


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copies) with no null role or text.

    Turns are in order of number (null first), of one number by role and text. A row with no text but white space is blank, one
    whose role and text an earlier row has a duplicate, one whose text doesn't end with . ! or ? truncated; the first of these
    counts. Of all edits after which the roles' initials are (s?(ua)+)?, the cheapest are made, of those the ones whose letters
    (Keep, Rerole, Delete, Insert) are least. An empty role can't be kept. A null conv_id is a conversation.

    Conversations are searched in pieces that hash partitions hold, so a long one is spread over tasks, of which each finds
    the best ways between all states; these are joined by conversation without any text, and the edits go back to the pieces,
    whose texts are hashed as they pass. In memory stand a batch, and for one conversation some letters a row.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    with scratch(spark):
        found = materialise(faults(rows), "repair-faults")
        extra = F.col("copies") - 1
        turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        of_each = found.groupBy("conv_id").agg(
            F.coalesce(turns, F.lit(0)).cast("bigint").alias("gaps"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(extra + F.col("duplicate").cast("int"))).alias("duplicate"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"),
        )
        initial = F.when(F.col("blank") | F.col("duplicate"), "-").when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?")
        parts = found.select("conv_id", F.shiftright("turn", SEGMENT_BITS).alias("segment"), "turn", "role", "text", "copies", "truncated", initial.alias("initial"), (F.octet_length("text") + F.octet_length("role")).cast("bigint").alias("size"))
        order = [F.col(c).asc_nulls_first() for c in ("conv_id", "segment", "turn", "role", "text")]
        parts = parts.repartition("conv_id", "segment").sortWithinPartitions(*order).drop("turn")
        pieces = parts.mapInArrow(_pieces, f"conv_id {kind}, segment bigint, piece bigint, roles array<string>, texts array<string>, copies array<bigint>, starts array<int>, states array<int>, costs array<bigint>, edits array<string>")
        pieces = materialise(pieces, "repair-pieces")
        by_piece = [F.col(c).asc_nulls_first() for c in ("conv_id", "segment", "piece")]
        chosen = pieces.select("conv_id", "segment", "piece", "starts", "states", "costs", "edits").repartition("conv_id").sortWithinPartitions(*by_piece)
        chosen = chosen.mapInArrow(_choose, f"conv_id {kind}, cost bigint, edits string")
        both = chosen.withColumn("kind", F.lit(0)).unionByName(pieces.select("conv_id", "segment", "piece", "roles", "texts", "copies", F.lit(1).alias("kind")), allowMissingColumns=True)
        both = both.repartition("conv_id").sortWithinPartitions(by_piece[0], "kind", *by_piece[1:])
        written = both.mapInArrow(_write, f"conv_id {kind}, illegal bigint, cost bigint, audit string, repaired_sha256 string")
        written = written.withColumnRenamed("conv_id", "of")
        out = of_each.join(written, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
        return materialise(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "repair", keep=True)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """What repair() finds and does after damage(), for every conv_id of the table: of one that loses all rows, zeros, no edits and the hash of nothing.

    Null conv_ids are one conversation, repeated rows repeated turns; texts are taken whole; an empty table gives no rows; other columns don't matter.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    done = repair(damage(rows)).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    out = every.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.select("conv_id", *(F.coalesce(c, none.get(c, F.lit(0).cast("bigint"))).alias(c) for c in out.columns[1:]))


#: CRC-32 byte by byte over a table of the 256 remainders; then every conversation from its first row, with the text that edits make carried along.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hx FROM conversations
), h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS d FROM o, tab
), r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) c(i) WHERE d <> 0 AND (i = 0 OR d = 3)
), n AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin FROM r
), f AS MATERIALIZED (
  SELECT *, CASE WHEN fin = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY g ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS odd, max(i) OVER (PARTITION BY g) AS rows FROM n
), ins(x, z, c, e, o) AS (
  VALUES ('n', 'n', 0, '', ''), ('n', 'u', 5, 'I', chr(10) || 'user:'), ('n', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', chr(10) || 'user:')
), best(g, i, s, w) AS (
  SELECT DISTINCT g, 0::BIGINT, 'n', {'c': 0::BIGINT, 'e': '', 'o': ''} FROM f
  UNION ALL
  SELECT g, i + 1, y, min(w) FROM (
    SELECT b.g, b.i, CASE op WHEN 'D' THEN z WHEN 'K' THEN ini WHEN 'R' THEN CASE z WHEN 'u' THEN 'a' ELSE 'u' END END AS y,
      {'c': b.w.c + ins.c + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 't' THEN 5 ELSE 0 END, 'e': b.w.e || ins.e || op,
       'o': b.w.o || ins.o || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE z WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || text END} AS w
    FROM best b JOIN f ON f.g = b.g AND f.i = b.i + 1 JOIN ins ON ins.x = b.s, (VALUES ('D'), ('K'), ('R')) ops(op)
    WHERE op = 'D' OR fault NOT IN ('b', 'd') AND (op = 'R' OR z || ini IN ('ns', 'nu', 'su', 'au', 'ua'))
  ) GROUP BY g, i, y
), ends AS (
  SELECT b.g, min({'c': b.w.c + ins.c, 'e': b.w.e || ins.e, 'o': b.w.o || ins.o}) AS w FROM best b JOIN (SELECT DISTINCT g, rows FROM f) USING (g) JOIN ins ON ins.x = b.s
  WHERE b.i = rows AND ins.z IN ('n', 'a') GROUP BY b.g
), s AS (
  SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM f GROUP BY conv_id, g
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(substr(w.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends USING (g)
"""
