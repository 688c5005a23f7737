"""Operator 13, conversation structure repair: A* on the lattice of edits that make a conversation's roles alternate.

A lattice node is (rows done, state): nothing yet, after a system row, after a user row, after an assistant row. Edits are
its edges; the heuristic is the suffix sum of what no path avoids, 3 for a row that must go and 1 for a truncated row,
and the queue's key is (cost + heuristic, audit). States follow from the audit alone, so of two cheapest ways to a
node neither audit begins the other, and what follows keeps their order: the first way that leaves the queue is the
cheapest and, among those, the one of the least audit.

One conversation may hold a third of all rows. Rows are sorted by ranges of (conversation, turn, ...), not dealt by
conversation, and cut into segments of bounded rows and bytes. A conversation of one segment is searched where it lies.
For a longer one each segment gives a 4 x 4 matrix of cheapest costs from state to state; a walk over matrices, from the
last to the first, gives what is left to pay after each segment, which is the exact heuristic at the segment's end. Each segment
is searched from its four entries, a walk over the exits says which entry is real, and no task ever holds a conversation.
A segment's audit ends with a row's edit (insertions at its end belong to the next), so no segment's audit begins another
and least parts make the least whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import as_bytes
from loomgrade.operators.walks import walk
from loomgrade.session import materialise, ship, table

SEGMENT_ROWS = 1024
SEGMENT_BYTES = 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
BLANKS = b" \t\n\x0b\x0c\r"
#: What the end costs in each state, and the insertions that it takes.
LEFT, TAIL = (0, 4, 2, 0), ("", "II", "I", "")
_NEXT = (USER, USER, ASSISTANT, USER)  # the state that an inserted or a renamed row leads to
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _edges(kind: str) -> list[list[tuple[str, int, int]]]:
    """Edits of a row of a kind (initial, fault) from each state: letter, next state, cost."""
    initial, fault = kind
    out: list[list[tuple[str, int, int]]] = [[("D", state, 3)] for state in range(4)]
    if fault in "bd":
        return out
    extra = int(fault == "t")
    for state in range(4):
        if initial == "s" and state == START:
            out[state].append(("K", SYSTEM, extra))
        if (initial == "u" and state != USER) or (initial == "a" and state == USER):
            out[state].append(("K", _NEXT[state], extra))
        out[state].append(("R", _NEXT[state], 2 + extra))
    return out


EDGES = {i + f: _edges(i + f) for i in "suax" for f in "bdtk"}
_CHARGE = {"b": 3, "d": 3, "t": 1, "k": 0}


def _kinds(code: str) -> list[str]:
    return [code[i : i + 2] for i in range(0, len(code), 2)]


def search(kinds: list[str], entry: int, left: tuple[int, ...] = LEFT) -> tuple[str, int]:
    """The least of the cheapest audits of rows from a state, and the state it ends in; `left`: what each end state costs."""
    n, floor = len(kinds), min(left)
    rest = [floor] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + _CHARGE[kinds[i][1]]
    heap = [(rest[0] if n else left[entry], "", 0, entry)]
    done = set()
    while True:
        f, audit, i, state = heapq.heappop(heap)
        if i == n:
            return audit, state
        if (i, state) in done:
            continue
        done.add((i, state))
        g = f - rest[i]
        if (i, _NEXT[state]) not in done:
            heapq.heappush(heap, (f + 2, audit + "I", i, _NEXT[state]))
        for letter, to, cost in EDGES[kinds[i]][state]:
            heapq.heappush(heap, (g + cost + (left[to] if i + 1 == n else rest[i + 1]), audit + letter, i + 1, to))


def _row_costs(kind: str) -> list[list[int]]:
    """Cheapest costs of a row, insertions before it included, from state to state."""
    out = [[NEVER] * 4 for _ in range(4)]
    for entry in range(4):
        state, paid = entry, 0
        for _ in range(3):  # no, one or two insertions; a third one only leads back
            for _, to, cost in EDGES[kind][state]:
                out[entry][to] = min(out[entry][to], paid + cost)
            state, paid = _NEXT[state], paid + 2
    return out


ROW_COSTS = {kind: _row_costs(kind) for kind in EDGES}


def matrix(kinds: list[str]) -> list[int]:
    """Cheapest costs of a run of rows from state to state, 4 x 4 as one list."""
    held = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for kind in kinds:
        step = ROW_COSTS[kind]
        held = [[min(row[k] + step[k][j] for k in range(4)) for j in range(4)] for row in held]
    return [min(x, NEVER) for row in held for x in row]


def apply_audit(audit: str, entry: int, roles: list[str], texts: list) -> tuple[list[str], list]:
    """The roles and texts of the repaired rows."""
    state, i, out_roles, out_texts = entry, 0, [], []
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out_roles.append(_ROLE[state])
            out_texts.append("")
            continue
        role, text, i = roles[i], texts[i], i + 1
        if letter == "K":
            state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        elif letter == "R":
            state = _NEXT[state]
            role = _ROLE[state]
        if letter != "D":
            out_roles.append(role)
            out_texts.append(text)
    return out_roles, out_texts


def audit_cost(audit: str, kinds: list[str]) -> int:
    cost, i = 0, 0
    for letter in audit:
        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[letter]
        if letter != "I":
            cost += letter != "D" and kinds[i][1] == "t"
            i += 1
    return cost


_SEGMENT = "conv_id bigint, seg bigint, roles array<string>, texts array<string>, code string, digests array<binary>, turn_first bigint, turn_last bigint, turns bigint"


def segments(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) sorted and cut: a row a segment, numbered in the order of all rows.

    code: two letters a row, its role's initial (x if it is none of s, u, a) and its first fault within the segment: b blank,
    d duplicate, t truncated, k none. digests: of rows that are neither blank nor duplicates. A conversation whose
    rows are all gone keeps an empty segment.
    """
    ship(rows.sparkSession)
    digest = F.unhex(F.sha2(F.concat_ws(":", "role", "text"), 256))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("__lg_digest"), F.asc("__lg_salt")]
    keyed = rows.select("conv_id", "turn", "role", "text", "gone", digest.alias("__lg_digest"), F.monotonically_increasing_id().alias("__lg_salt"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__lg_salt")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        conv, begun, size, held, made, made_size = None, False, 0, [], [], 0

        def close():
            nonlocal held, size, number, made_size
            roles, texts, code, digests, seen, turns = [], [], [], [], set(), []
            for turn, role, text, digest in held:
                roles.append(role)
                texts.append(text)
                tail = text.rstrip(BLANKS)
                fault = "b" if not tail else "d" if digest in seen else "k" if tail[-1:] in (b".", b"!", b"?") else "t"
                seen.add(digest)
                code.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
                digests.append(digest if fault in "tk" else None)
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
            made.append((conv, number, roles, texts, "".join(code), digests, turns[0] if turns else None, turns[-1] if turns else None, len(turns)))
            made_size += size
            number, held, size = number + 1, [], 0

        def out():
            nonlocal made, made_size
            columns = [pa.array([m[k] for m in made], pa.list_(pa.binary()) if k == 3 else f.type) for k, f in enumerate(schema)]
            columns[3] = columns[3].cast(schema.field(3).type)
            batch = pa.RecordBatch.from_arrays(columns, names=schema.names)
            made, made_size = [], 0
            return batch

        for batch in batches:
            convs, turns, roles, gones, digests = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "__lg_digest"))
            for c, turn, role, text, gone, digest in zip(convs, turns, roles, as_bytes(batch.column("text")), gones, digests, strict=True):
                if begun and c != conv:
                    close()
                elif held and (len(held) >= most_rows or size + len(text) > most_bytes):
                    close()
                conv, begun = c, True
                if not gone:
                    held.append((turn, role, text, digest))
                    size += len(text) + 64
                if made_size > most_bytes or len(made) >= 2048:
                    yield out()
        if begun:
            close()
        if made:
            yield out()

    return ranged.mapInArrow(run, _SEGMENT)


def _by_row(df: DataFrame, keep: list[str], f, ddl: str) -> DataFrame:
    """Columns `keep` of df, and those that f makes of each row (a dict of all columns)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(ddl)
    schema = StructType([df.schema[c] for c in keep] + new.fields)
    kinds = [x.type for x in to_arrow_schema(new)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [f(**r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array([m[k] for m in made], kinds[k]) for k in range(len(kinds))], names=keep + new.names)

    return df.mapInArrow(run, schema)


def _with_late(code: str, late: list[int] | None) -> list[str]:
    kinds = _kinds(code)
    for i in late or ():
        kinds[i] = kinds[i][0] + "d"
    return kinds


class _Left:
    """From the last segment to the first: what is left to pay after a segment, in each state."""

    def __init__(self):
        self.left, self.last = LEFT, True

    def __call__(self, costs, **_):
        after, last, self.last = self.left, self.last, False
        self.left = tuple(min(NEVER, min(costs[4 * i + j] + after[j] for j in range(4))) for i in range(4))
        return list(after), last


class _Entry:
    """From the first segment to the last: the state in which the cheapest repair enters a segment."""

    def __init__(self):
        self.state = START

    def __call__(self, exits, **_):
        entry, self.state = self.state, exits[self.state]
        return (entry,)


def plan(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The cheapest repair of each conversation, a row a segment (conv_id, seg, code, audit, ...; written once).

    rows: conv_id, turn, role, text, and optionally gone (a row that only says that its conversation exists); other columns are left out.
    Null roles and texts count as one space. Rows go by turn, nulls first, then by role and the hash of role and text, so
    that repeated rows stand together; rows that are equal in all of these are the same. Roles count by their first
    letter; one that is none of s, u, a (none at all, too) can't be kept. A null conv_id is a conversation.
    Empty tables give no rows.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    segs = materialise(segments(clean, most_rows, most_bytes), "segments")
    several = segs.groupBy(F.col("conv_id").alias("__lg_conv")).agg(F.count("*").alias("n")).where("n > 1").select("__lg_conv")
    long = materialise(segs.join(several, F.col("conv_id").eqNullSafe(F.col("__lg_conv")), "left_semi").select("conv_id", "seg", "code", "digests"), "long")
    # rows that an earlier segment of their conversation has, by the digests of each segment's own first ones
    firsts = long.select("conv_id", "seg", F.posexplode("digests").alias("i", "digest")).where("digest IS NOT NULL")
    least = firsts.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("seg").alias("first"))
    again = firsts.join(least, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("seg") > F.col("first")))
    late = again.groupBy("seg").agg(F.collect_list("i").alias("late"))  # at most a segment's rows
    coded = materialise(long.drop("digests").join(late, "seg", "left"), "coded")
    costs = _by_row(coded, ["conv_id", "seg"], lambda code, late, **_: (matrix(_with_late(code, late)),), "costs array<bigint>").withColumn("back", -F.col("seg"))
    left = walk(costs, "conv_id", ["back"], _Left, "left array<bigint>, last boolean").select("seg", "left", "last")
    paid = materialise(coded.join(left, "seg"), "left")
    exits = _by_row(paid, ["conv_id", "seg"], lambda code, late, left, **_: ([search(_with_late(code, late), s, left)[1] for s in range(4)],), "exits array<int>")
    entry = walk(exits, "conv_id", ["seg"], _Entry, "entry int").select("seg", "entry")
    hints = paid.select("seg", "late", "left", "last").join(entry, "seg")

    def repair(roles, texts, code, late, left, last, entry, **_):
        kinds, entry = _with_late(code, late), START if entry is None else entry
        audit, state = search(kinds, entry, tuple(left) if left else LEFT)
        audit += TAIL[state] if last is not False else ""
        out_roles, out_texts = apply_audit(audit, entry, roles, texts)
        return "".join(kinds), audit, audit_cost(audit, kinds), out_roles, out_texts

    keep = ["conv_id", "seg", "turn_first", "turn_last", "turns", "several"]
    joined = segs.join(hints, "seg", "left").withColumn("several", F.col("entry").isNotNull())
    made = "code string, audit string, cost bigint, out_roles array<string>, out_texts array<string>"
    return materialise(_by_row(joined, keep, repair, made), "repairs")


def repaired(plan: DataFrame) -> DataFrame:
    """conv_id, seg, place, role, text of the repaired rows; those of a conversation go by seg and place."""
    return plan.select("conv_id", "seg", F.posexplode(F.arrays_zip("out_roles", "out_texts")).alias("place", "r")).select("conv_id", "seg", "place", F.col("r.out_roles").alias("role"), F.col("r.out_texts").alias("text"))


_REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """What is known of a conversation, a segment after the other."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.cost = conv_id, [], 0
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = {f: 0 for f in "bdtk"}
        self.before, self.hash, self.lines = "", hashlib.sha256(), 0

    def add(self, turn_first, turn_last, turns, code, audit, cost, out_roles, out_texts, **_):
        if turns:
            self.turns += turns - (turn_first == self.last)
            self.first, self.last = turn_first if self.first is None else self.first, turn_last
        for i in range(0, len(code), 2):
            self.faults[code[i + 1]] += 1
            self.illegal += bool(self.before) and self.before + code[i] not in ("su", "ua", "au")
            self.before = code[i]
        self.audit.append(audit)
        self.cost += cost
        for role, text in zip(out_roles, out_texts, strict=True):
            self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
            self.lines += 1

    def end(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        f = self.faults
        return (self.conv_id, gaps, f["b"], f["d"], f["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _assembled(segs: DataFrame) -> DataFrame:
    """A row a conversation, from segments that stand together and in order; a segment at a time is in memory."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_REPORT))

    def run(batches):
        own = None
        for batch in batches:
            ended = []
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if own is None or r["conv_id"] != own.conv_id:
                        if own:
                            ended.append(own.end())
                        own = _Conversation(r["conv_id"])
                    own.add(**r)
            if ended:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ended], f.type) for k, f in enumerate(schema)], names=schema.names)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(own.end(), schema, strict=True)], names=schema.names)

    return segs.mapInArrow(run, _REPORT)


def report(plan: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired rows.

    gaps: last turn - first turn + 1 - distinct turns, nulls aside; 0 if there are none. A conversation without rows: zeros,
    an empty audit, the hash of nothing. Only conversations of several segments are shuffled; a hash runs over all rows of
    one, so their segments pass through one task, one after the other.
    """
    together = plan.where("several").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return _assembled(plan.where("NOT several")).unionByName(_assembled(together))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: rows with `gone`, of which rows that are dropped keep nothing but their conversation."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("__lg_kind")
    marked = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("__lg_kind"))
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("__lg_copy")
    rows = marked.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (kind == 0).alias("gone"), copies)
    empty = lambda c: F.when(F.col("gone"), F.lit("")).otherwise(F.col(c)).alias(c)
    return rows.select("conv_id", "turn", empty("role"), empty("text"), "gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(plan(damage(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH RECURSIVE step(b, c, k) AS (SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS g FROM conversations),
coded AS (SELECT k.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(g) + 1), lambda i: ord(substr(g, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS kind FROM keyed k, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(sha256(concat(role, ':', text)))) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
judged AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c,
  CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
edits(state, ins, pos, paid) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 3, 4), (1, '', 1, 0), (1, 'I', 2, 2), (1, 'II', 3, 4), (2, '', 2, 0), (2, 'I', 3, 2), (3, '', 3, 0), (3, 'I', 2, 2)),
ways AS (SELECT state, c, fault, ins || letter AS piece, CASE letter WHEN 'D' THEN pos WHEN 'R' THEN renamed ELSE CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS goal,
  paid + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost
  FROM (SELECT *, CASE WHEN pos = 2 THEN 3 ELSE 2 END AS renamed FROM edits), (SELECT unnest(['s', 'u', 'a', 'x']) AS c), (SELECT unnest(['b', 'd', 't', 'k']) AS fault), (SELECT unnest(['D', 'R', 'K']) AS letter)
  WHERE letter = 'D' OR (fault IN ('t', 'k') AND (letter = 'R' OR (c = 's' AND pos = 0) OR (c = 'u' AND pos <> 2) OR (c = 'a' AND pos = 2)))),
paths AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM conversations UNION ALL
  SELECT conv_id, i, goal, arg_min({'cost': cost, 'audit': audit, 'lines': lines}, {'cost': cost, 'audit': audit}) FROM (
    SELECT j.conv_id, j.i, w.goal, p.best.cost + w.cost AS cost, p.best.audit || w.piece AS audit,
      p.best.lines || CASE WHEN w.piece LIKE 'II%' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN w.piece LIKE 'I%' THEN chr(10) || CASE WHEN p.state = 2 THEN 'assistant:' ELSE 'user:' END ELSE '' END
      || CASE right(w.piece, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || CASE w.goal WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text END AS lines
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1 JOIN ways w ON w.state = p.state AND w.c = j.c AND w.fault = j.fault) GROUP BY conv_id, i, goal),
ends AS (SELECT p.conv_id, arg_min({'cost': best.cost + t.paid, 'audit': best.audit || t.ins, 'lines': best.lines || t.more}, {'cost': best.cost + t.paid, 'audit': best.audit || t.ins}) AS b
  FROM paths p JOIN (SELECT conv_id, max(i) AS n FROM paths GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.i
  JOIN (VALUES (0, '', 0, ''), (1, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'I', 2, chr(10) || 'assistant:'), (3, '', 0, '')) t(state, ins, paid, more) ON t.state = p.state GROUP BY p.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(substr(b.lines, 2)) AS repaired_sha256 FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
