"""Operator 13: cheapest repair of a conversation's structure by iterative-deepening A*.

A repaired conversation has the role initials ``(s?(ua)+)?``: an optional system turn, then user
and assistant by turns. An automaton of four states reads them, and at every state one role only
can be inserted or given to a row, so a string of edits (D delete, I insert, K keep, R rerole)
decides the whole repair. The search goes depth first, edits in ASCII order, under a bound that
starts at a lower bound of the cost and grows to the least estimate that went beyond it. A table of
failed states (row, automaton state, budget left) keeps it from trying one twice. The first
accepting path is the cheapest, and of the cheapest the least in ASCII.

A long conversation is cut into blocks. The search runs for each pair of states before and after
a block, and the cheapest way to each state is carried on, with the hash of its text so far. Strings
of edits that end with the same row are free of prefixes, so ties are decided as in one search. A task
thus holds one block of a conversation, whatever its length, and a digest of each row seen.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.llm.common import table

#: Rows of one search; longer conversations are cut.
BLOCK = 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Next state by role initial, and the one role that can be inserted or given in a state.
MOVES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
GIVEN = ["user", "user", "assistant", "user"]
ACCEPTING = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
#: What a row's code says besides the initial.
SOUND, CUT_OFF, BAD = 0, 1, 2

REPAIRED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def lower_bounds(codes: list[tuple[str, int]], goal: int | None = None) -> list[list[int]]:
    """For each row on, and the end, by state: a cost that the rest can't go below.

    A row pays alone for its fault and for a role that no state takes. Of the rows that may stay, two
    neighbours whose initials never follow each other pay at least the cheapest of a delete, an
    insert and a rerole beyond that, and so do the state with the first of them and the last of
    them with the end; pairs without a common row add up.
    """
    n = len(codes)
    if goal in (START, SYSTEM):  # all rows go, but for one system row if it isn't read yet
        one = [0, 4 * n + 99, 4 * n + 99, 4 * n + 99] if goal == START else [-DELETE, 0, 4 * n + 99, 4 * n + 99]
        return [[max(0, DELETE * (n - i) + x) for x in one] for i in range(n + 1)]
    ends = {"a"} if goal is None else {" sua"[goal]}
    at_end = [0 if q == goal or goal is None and q in ACCEPTING else INSERT for q in range(4)]
    bound = [at_end] * (n + 1)
    alone = rest = rest_after = 0  # pairs from the next row that may stay, and from the one after it
    after, last = "", False  # its initial, and whether it's truncated
    for i in range(n - 1, -1, -1):
        initial, fault = codes[i]
        if fault == BAD:
            bound[i] = [x + DELETE for x in bound[i + 1]]
            alone += DELETE
            continue
        known, cut = initial in ("s", "u", "a"), fault == CUT_OFF
        alone += min(DELETE, (TRUNCATED if cut else 0) + (0 if known else REROLE))
        fits = not known or (initial + after in LEGAL or after not in ("s", "u", "a") if after else initial in ends)
        weight = 0 if fits else DELETE - TRUNCATED if cut or last else INSERT
        rest, rest_after = max(rest, weight + rest_after), rest
        mend = DELETE - TRUNCATED if cut else INSERT
        bound[i] = [alone + max(rest, rest_after + (mend if known and initial not in MOVES[q] else 0)) for q in range(4)]
        after, last = initial or " ", cut
    return bound


def cheapest(codes: list[tuple[str, int]], state: int, goal: int | None) -> tuple[int, str] | None:
    """``(cost, edits)`` of the cheapest way through the rows from ``state`` to ``goal``, ending
    with the last row; without a goal, to an accepting state, inserts at the end allowed."""
    n, bound = len(codes), lower_bounds(codes, goal)
    most = DELETE * n + 2 * INSERT + TRUNCATED
    if goal == START and state != START or goal == SYSTEM and state > SYSTEM:
        return None
    if goal == SYSTEM and state == START and all(c[0] != "s" or c[1] == BAD for c in codes):
        return None
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []
    beyond = math.inf

    def search(i: int, q: int, left: int) -> bool:
        nonlocal beyond
        if bound[i][q] > left:
            beyond = min(beyond, bound[i][q] - left)
            return False
        if i == n:
            if q == goal or goal is None and q in ACCEPTING:
                return True
            if goal is not None:
                return False
        if failed.get((i, q), -1) >= left:
            return False
        initial, fault = codes[i] if i < n else ("", BAD)
        extra = TRUNCATED if fault == CUT_OFF else 0
        given = MOVES[q][GIVEN[q][0]]
        edits = [("D", i + 1, q, DELETE)] if i < n else []
        edits.append(("I", i, given, INSERT))
        if fault != BAD:
            if initial in MOVES[q]:
                edits.append(("K", i + 1, MOVES[q][initial], extra))
            edits.append(("R", i + 1, given, REROLE + extra))
        for letter, j, r, cost in edits:
            if cost > left:
                beyond = min(beyond, cost + bound[j][r] - left)
                continue
            path.append(letter)
            if search(j, r, left - cost):
                return True
            path.pop()
        failed[i, q] = left
        return False

    budget = bound[0][state]
    while budget <= most:
        failed.clear()
        beyond = math.inf
        if search(0, state, budget):
            return budget, "".join(path)
        if beyond == math.inf:
            return None
        budget += int(beyond)
    return None


class Repair:
    """One conversation, given row by row; ``result`` ends it. Memory: a block of rows, four
    partial repairs and a digest of each distinct row."""

    def __init__(self, memo: dict):
        self.memo = memo
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.turn = None
        self.before: str | None = None
        self.seen: set[bytes] = set()
        self.codes: list[tuple[str, int]] = []
        self.lines: list[tuple[str, str]] = []
        # state -> (cost, rank among the partial repairs in ASCII order, chain of edits, lines so far, hash)
        self.ways = {START: (0, 0, None, 0, hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if len(self.codes) == BLOCK:
            self._advance(final=False)
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.distinct += 1
        initial = role[:1]
        if self.rows:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.rows += 1
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        bare, fault = text.strip(_SPACE), SOUND
        if not bare:
            self.blank += 1
            fault = BAD
        elif key in self.seen:
            self.duplicate += 1
            fault = BAD
        elif bare[-1] not in ".!?":
            self.truncated += 1
            fault = CUT_OFF
        self.seen.add(key)
        self.codes.append((initial, fault))
        self.lines.append((role, text))

    def _advance(self, final: bool) -> None:
        best: dict[int | None, tuple] = {}
        for q, (cost, rank, *_) in self.ways.items():
            for goal in [None] if final else range(4):
                key = (tuple(self.codes), q, goal)
                if key not in self.memo:
                    if len(self.memo) >= 4096:
                        self.memo.clear()
                    self.memo[key] = cheapest(self.codes, q, goal)
                found = self.memo[key]
                if found is not None:
                    way = (cost + found[0], rank, found[1], q)
                    if goal not in best or way < best[goal]:
                        best[goal] = way
        order = sorted((rank, edits) for _, rank, edits, _ in best.values())
        ways = {}
        for goal, (cost, rank, edits, q) in best.items():
            _, _, chain, n, digest = self.ways[q]
            digest = digest.copy()
            n = self._write(edits, q, n, digest)
            ways[goal] = (cost, order.index((rank, edits)), (chain, edits), n, digest)
        if not final:  # from user or assistant on, all else is at most a delete and an insert cheaper
            most = min((ways[q][0] for q in (USER, ASSISTANT) if q in ways), default=math.inf) + DELETE + INSERT
            ways = {q: way for q, way in ways.items() if way[0] <= most}
        self.ways, self.codes, self.lines = ways, [], []

    def _write(self, edits: str, state: int, n: int, digest) -> int:
        rows = iter(self.lines)
        for letter in edits:
            role, text = (GIVEN[state], "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = GIVEN[state]
            state = MOVES[state][role[:1]]
            digest.update((("\n" if n else "") + f"{role}:{text}").encode())
            n += 1
        return n

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        self._advance(final=True)
        cost, _, chain, _, digest = self.ways[None]
        audit = []
        while chain:
            chain, edits = chain
            audit.append(edits)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return *counts, "".join(reversed(audit)), digest.hexdigest()


def repair_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation to one row per conversation; a conversation may span batches."""
    memo: dict = {}
    now, repair, out, key_type = None, None, [], None

    def batch_of() -> pa.RecordBatch:
        names = ["conv_id", *(c.split()[0] for c in REPAIRED.split(", "))]
        types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in batches:
        key_type = batch.schema.field(0).type
        for conv, lost, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    out.append((now, *repair.result()))
                now, repair = conv, Repair(memo)
                if len(out) >= 10_000:
                    yield batch_of()
                    out = []
            if not lost:
                repair.add(turn, role, text)
    if repair is not None:
        out.append((now, *repair.result()))
        yield batch_of()


def damaged(turns: DataFrame) -> DataFrame:
    """The stated damage by ``crc32(conv_id:turn) % 20``: 0 loses the row (``lost``, kept here so that
    its conversation is known), 1 empties the text, 2 takes its ``[.!?]``, 3 repeats the row, 4 sets
    the role user. NULLs count as one space, also in the key; a NULL turn stays NULL in order and gaps."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        (kind == 0).alias("lost"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def as_given(turns: DataFrame) -> DataFrame:
    """The rows undamaged; NULL roles and texts count as one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select("conv_id", F.lit(False).alias("lost"), F.col("turn").cast("bigint").alias("turn"), role, text)


def repair_conversations(turns: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text, ...)`` with its faults and the
    cheapest repair.

    Rows are taken by turn, NULL turns first; rows of one turn by role and text. Columns: conv_id; gaps
    (turns missing between the least and the greatest, 0 if all are NULL); blank, duplicate and truncated
    (each row's first fault); illegal (neighbours whose role initials aren't su, ua, au); cost; audit
    (edits D, I, K, R; of the cheapest the ASCII-least); repaired_sha256 of the lines ``role:text``.
    An empty role takes part like one that no state reads. ``damage`` applies the stated
    damage first. NULL ids form one conversation; a conversation that lost all rows has
    zeros, an empty audit and the empty string's hash. Other columns are not read.

    One shuffle by conv_id. A conversation is hashed in its order, so one task reads it, as a stream.
    """
    rows = damaged(turns) if damage else as_given(turns)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(repair_kernel, f"conv_id {id_type}, {REPAIRED}")


#: Damage, faults and the dynamic programme over (conversation, rows read, state), which keeps the least
#: (cost, edits) of each; at most one insert before a row is ever of use, and two at the end.
ORACLE = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
keys AS (SELECT DISTINCT k FROM keyed),
kinds AS (
  SELECT k, xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind
  FROM keys, crc_table),
d AS (
  SELECT conv_id, turn,
    CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN kinds USING (k), range(2) c(copy)
  WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, role[1:1] AS c, lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS next_c,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM o),
moves(q, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(q, role, r) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
way AS (
  SELECT conv_id, 0::BIGINT AS i, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS w, 0 AS q FROM n
  UNION ALL
  SELECT conv_id, i, min(w), q FROM (
    SELECT b.conv_id, b.i + 1 AS i, e.q,
      {'cost': b.cost + e.cost, 'audit': b.audit || e.letter, 'lines': CASE WHEN e.line IS NULL THEN b.lines ELSE list_append(b.lines, e.line) END} AS w
    FROM (
      SELECT conv_id, i, q, w.cost AS cost, w.audit AS audit, w.lines AS lines FROM way
      UNION ALL
      SELECT conv_id, i, r, w.cost + 3, w.audit || 'I', list_append(w.lines, g.role || ':') FROM way JOIN given g USING (q)) b
    JOIN LATERAL (
      SELECT f.conv_id, f.i, b.q, 'D' AS letter, 4 AS cost, NULL AS line FROM f WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
      UNION ALL
      SELECT f.conv_id, f.i, m.r, 'K', CASE WHEN fault IS NULL THEN 0 ELSE 3 END, role || ':' || text
      FROM f JOIN moves m ON m.c = f.c
      WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 AND m.q = b.q AND coalesce(fault, '') NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT f.conv_id, f.i, g.r, 'R', 3 + CASE WHEN fault IS NULL THEN 0 ELSE 3 END, g.role || ':' || text
      FROM f, given g
      WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 AND g.q = b.q AND coalesce(fault, '') NOT IN ('blank', 'duplicate')) e ON true)
  GROUP BY conv_id, i, q),
ends AS (
  SELECT way.conv_id, q, w FROM way JOIN n ON way.conv_id IS NOT DISTINCT FROM n.conv_id AND way.i = n.n),
closed AS (
  SELECT conv_id, w FROM ends WHERE q IN (0, 3)
  UNION ALL SELECT conv_id, {'cost': w.cost + 3, 'audit': w.audit || 'I', 'lines': list_append(w.lines, 'assistant:')} FROM ends WHERE q = 2
  UNION ALL SELECT conv_id, {'cost': w.cost + 6, 'audit': w.audit || 'II', 'lines': w.lines || ['user:', 'assistant:']} FROM ends WHERE q = 1),
best AS (SELECT conv_id, min(w) AS w FROM closed GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_c IS NOT NULL AND c || next_c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)
