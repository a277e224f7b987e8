"""Repair of conversations into what the grammar (system? (user assistant)+)? takes, at the least cost.

Cost layers: layer c holds, for every turn, a bitset of the grammar's states from which the turns that follow can be
repaired at cost c exactly. A layer follows from the few cheaper ones by table lookups on whole sets; the first layer with the start
state before the first turn gives the cost. The trace walks forward with the set of all states that the edits so far may
have led to and takes the least letter that stays within the layers, which gives the least of all cheapest audits.

Layers cost turns times cost, so long conversations are cut into stretches of ``STRETCH`` turns: the least costs of the four
states before a stretch are all that the stretch before it has to know. Turns are dealt by conversation and sorted, and
stream through a task; a conversation costs it two bytes a turn, and texts beyond ``HELD`` characters go through a scratch file of the
task's own until its digest or its turns are written.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, table

SPACE = " \t\n\x0b\x0c\r"
#: Turns of a stretch; characters of a conversation that a task holds in memory.
STRETCH, HELD = 64, 1 << 22
#: What each edit costs; a truncated turn that stays costs ``MEND`` more.
REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3

#: The grammar: before anything, after the system's turn, after a user's, after an assistant's.
START, ACCEPT, ALL = 0b0001, 0b1001, 0b1111
NEXT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})  # by s, u, a


def _sets(step: Callable[[int], list[int]]) -> list[int]:
    """A table over all sixteen sets of states."""
    out = []
    for states in range(16):
        got = 0
        for q in range(4):
            if states >> q & 1:
                for r in step(q):
                    got |= 1 << r
        out.append(got)
    return out


AHEAD = [_sets(lambda q, m=m: [m[q]] if q in m else []) for m in NEXT] + [[0] * 16]
BACK = [_sets(lambda q, m=m: [p for p, r in m.items() if r == q]) for m in NEXT] + [[0] * 16]
EITHER = [a | b for a, b in zip(AHEAD[1], AHEAD[2], strict=True)]  # by a user's or an assistant's turn
BACK_EITHER = [a | b for a, b in zip(BACK[1], BACK[2], strict=True)]
#: A turn's code: the symbol of its role (3: none), whether it is truncated, whether it must go.
TRUNCATED, GOES = 4, 8


def layers(codes: bytes, ends: dict[int, int], last: bool, wanted: int) -> list[list[int]]:
    """Layers of a stretch until all states of ``wanted`` stand before its first turn.

    ``ends``: by cost, the states from which the rest can be repaired at that cost; ``last``: nothing follows, so turns may
    be inserted at the end too. One list a layer, a set for every place between turns."""
    out: list[list[int]] = []
    reached, n, c = 0, len(codes), -1
    none = [0] * (n + 1)
    while reached & wanted != wanted:
        c += 1
        by3, by4, by6 = (out[c - k] if c >= k else none for k in (INSERT, DELETE, REROLE + MEND))
        now = none.copy()
        now[n] = ends.get(c, 0) | (BACK_EITHER[by3[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            found = by4[i + 1] | BACK_EITHER[by3[i]]
            if code < TRUNCATED:
                found |= BACK[code][now[i + 1]] | BACK_EITHER[by3[i + 1]]
            elif code < GOES:
                found |= BACK[code - TRUNCATED][by3[i + 1]] | BACK_EITHER[by6[i + 1]]
            now[i] = found
        out.append(now)
        reached |= now[0]
    return out


def trace(codes: bytes, found: list[list[int]], states: int, left: int, last: bool) -> tuple[bytearray, int, int]:
    """(letters, states, cost left) at the end of a stretch, from ``states`` with ``left`` to spend."""
    at = lambda c, i: found[c][i] if c >= 0 else 0
    out, i, n = bytearray(), 0, len(codes)
    while i < n or last and left:
        if i < n and (s := states & at(left - DELETE, i + 1)):
            letter, states, left, i = b"D", s, left - DELETE, i + 1
        elif s := EITHER[states] & at(left - INSERT, i):
            letter, states, left = b"I", s, left - INSERT
        else:
            code = codes[i]
            more = MEND if code & TRUNCATED else 0
            if s := AHEAD[code & 3][states] & at(left - more, i + 1):
                letter, states, left, i = b"K", s, left - more, i + 1
            else:
                letter, states, left, i = b"R", EITHER[states] & at(left - REROLE - more, i + 1), left - REROLE - more, i + 1
        out += letter
    return out, states, left


def cheapest(codes: bytes) -> tuple[int, bytearray]:
    """(cost, audit) of a whole conversation."""
    starts = list(range(0, len(codes), STRETCH)) or [0]
    cut = lambda s: codes[s : s + STRETCH]
    ends, known, total, found = {0: ACCEPT}, {}, 0, []
    for s in reversed(starts):
        found = layers(cut(s), ends, s == starts[-1], ALL if s else START)
        low = next(c for c, row in enumerate(found) if row[0]) if s else 0
        known[s] = ends, low
        total += low
        fresh, seen = {}, 0
        for c, row in enumerate(found):  # a state counts at its least cost
            if row[0] & ~seen:
                fresh[c - low] = row[0] & ~seen
                seen |= row[0]
        ends = fresh
    left = next(c for c, row in enumerate(found) if row[0] & START)
    total, states, audit = total + left, START, bytearray()
    for s in starts:
        ends, low = known[s]
        last = s == starts[-1]
        if s:
            left += low
            found = layers(cut(s), ends, last, states)
        letters, states, left = trace(cut(s), found, states, left, last)
        audit += letters
    return total, audit


class _Texts:
    """Roles and texts of a conversation in order, in memory up to HELD characters, beyond that in a scratch file."""

    def __init__(self) -> None:
        self.rows, self.chars, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.chars += len(role) + len(text)
        if self.chars > HELD:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            pickle.dump(self.rows, self.file)
            self.rows, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            stop = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < stop:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.rows


class Conversation:
    """One conversation as its turns come by in order."""

    def __init__(self, key: str | None):
        self.key, self.codes, self.texts = key, bytearray(), _Texts()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = self.role = None

    def add(self, turn: int | None, role: str, text: str, digest: bytes, later: bool) -> None:
        """``later``: the same role and text stood in an earlier turn; within a turn equal rows are neighbours."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        body = text.rstrip(SPACE)
        code = max("sua".find(role[:1]), 0) if role[:1] in ("s", "u", "a") else 3
        if not body:
            self.blank += 1
            code |= GOES
        elif later or digest == self.before:
            self.duplicate += 1
            code |= GOES
        elif body[-1] not in ".!?":
            self.truncated += 1
            code |= TRUNCATED
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.codes.append(code)
        self.texts.add(role, text)
        self.before, self.role = digest, role

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def repaired(self) -> tuple[int, str, Iterator[tuple[str, str, str]]]:
        """(cost, audit, turns): turns are (edit, role, text) of all that stays, to be read once."""
        cost, audit = cheapest(bytes(self.codes))
        system = (len(audit) - audit.count(b"D")) % 2  # an odd number of turns begins with the system's

        def turns() -> Iterator[tuple[str, str, str]]:
            rows, place = iter(self.texts), 0
            for letter in audit.decode():
                role, text = ("", "") if letter == "I" else next(rows)
                if letter != "D":
                    yield letter, role if letter == "K" else ("user", "assistant")[(place - system) % 2], text
                    place += 1

        return cost, audit.decode(), turns()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, gone) with their digest and whether an earlier turn said the same, each conversation in one
    partition, in order. First turns of equal words meet in a combined aggregate, so no copy is compared with another."""
    d = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    when = F.coalesce(F.col("turn"), F.lit(-(1 << 63)).cast("long"))
    first = d.where("not gone").groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), when.alias("t"))).alias("lo"), F.max(F.struct(F.col("turn").isNotNull().alias("k"), when.alias("t"))).alias("hi"))
    first = first.where("lo < hi").select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "lo")
    d = d.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")), "left")
    later = F.coalesce(F.col("lo") < F.struct(F.col("turn").isNotNull().alias("k"), when.alias("t")), F.lit(False))
    d = d.select("conv", "turn", "role", "text", "gone", "digest", later.alias("later"))
    return d.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")


def _streamed(rows: DataFrame, write: Callable[[Conversation], Iterator[tuple]], schema: str) -> DataFrame:
    """Every conversation given to ``write`` once its last turn has come by; what that yields, in batches of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def conversations() -> Iterator[Conversation]:
            now = None
            for f in batches:
                for conv, turn, role, text, gone, digest, later in zip(*(f[c] for c in ("conv", "turn", "role", "text", "gone", "digest", "later")), strict=True):
                    if now is None or conv != now.key:
                        if now is not None:
                            yield now
                        now = Conversation(conv)
                    if not gone:
                        now.add(None if turn is None else int(turn), role, text, digest, later)
            if now is not None:
                yield now

        out, size = [], 0
        for c in conversations():
            for row in write(c):
                out.append(row)
                size += 64 + sum(len(v) for v in row if isinstance(v, str))
                if size > HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    # ids and turns pass as text: pandas would turn longs beside a null into doubles
    ordered = _ordered(rows).select(as_text("conv").alias("conv"), as_text("turn").alias("turn"), "role", "text", "gone", "digest", "later")
    return as_long(ordered.mapInPandas(run, schema.replace("conv_id long", "conv_id string", 1)), "conv_id")


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone_") if "gone_" in turns.columns else F.lit(False)
    return turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), gone.alias("gone"))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one a conversation.

    Turns stand in order, nulls first, rows of one turn by role, then text. Null roles and texts count as one space; a null
    conversation is one as any other. Each row has one fault at most: blank, else a repeat of role and text said
    before, else cut off (its last character that is no space ends no sentence). The digest is of the repaired turns as
    ``repaired_turns`` gives them, ``role:text`` joined by newlines. Other columns are not read; an empty table gives no
    rows.
    """

    def write(c: Conversation) -> Iterator[tuple]:
        cost, audit, rest = c.repaired()
        h, gap = hashlib.sha256(), ""
        for _, role, text in rest:
            h.update(f"{gap}{role}:{text}".encode("utf-8", "surrogatepass"))
            gap = "\n"
        yield c.key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, h.hexdigest()

    return _streamed(_rows(turns, conv_col, turn_col, role_col, text_col), write, REPORT)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, edit, role, text): the repaired conversations, turns numbered from 0, with the edit that made each
    (K kept, R role changed, I inserted). Orders, nulls and faults as in ``repair_report``; what is deleted, or a
    conversation of which nothing stays, has no row."""

    def write(c: Conversation) -> Iterator[tuple]:
        for place, (edit, role, text) in enumerate(c.repaired()[2]):
            yield c.key, place, edit, role, text

    return _streamed(_rows(turns, conv_col, turn_col, role_col, text_col), write, "conv_id long, turn long, edit string, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the damage that a crc32 of each row's place asks for; a dropped row keeps its
    place and is marked ``gone_``, so that a conversation without rows is still known. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("harm"))
    body = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("harm") == 0).alias("gone_"), F.explode(times).alias("copy_")).drop("copy_")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, then repaired."""
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


#: The same rows by dynamic programming over (turn, state), states 0 to 3 as above, letters compared as text.
ORACLE = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(place, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
   lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS harm FROM k),
x AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS twin FROM h WHERE harm <> 0),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) > 1 AS again,
   row_number() OVER o AS i, substring(role, 1, 1) AS ini, lag(substring(role, 1, 1)) OVER o AS was FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin)),
r AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
moves(p, sym, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
gain(p, q, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)),
edits AS (SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS letter FROM r, (VALUES (0), (1), (2), (3)) AS s(p)
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K' FROM r JOIN moves ON ini = sym WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R' FROM r JOIN moves ON sym <> 's' WHERE fault IN ('', 't')),
step AS (SELECT e.conv_id, e.i, e.p, g.q, e.cost + 3 * g.n AS cost, letter || repeat('I', g.n) AS letters FROM edits e JOIN gain g ON e.q = g.p),
dp AS (SELECT conv_id, 0::BIGINT AS i, q, (3 * n)::BIGINT AS cost, repeat('I', n) AS audit FROM (SELECT DISTINCT conv_id FROM r) CROSS JOIN gain WHERE p = 0
  UNION ALL SELECT conv_id, i, q, b.cost, b.audit FROM (SELECT s.conv_id, s.i, s.q, min({'cost': dp.cost + s.cost, 'audit': dp.audit || s.letters}) AS b FROM dp JOIN step s ON s.conv_id = dp.conv_id AND s.i = dp.i + 1 AND s.p = dp.q GROUP BY s.conv_id, s.i, s.q)),
size AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
best AS (SELECT conv_id, min({'cost': cost, 'audit': audit}) AS b FROM dp JOIN size USING (conv_id) WHERE i = n AND q IN (0, 3) GROUP BY conv_id),
letters AS (SELECT conv_id, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS pos FROM best),
placed AS (SELECT conv_id, pos, substring(audit, pos, 1) AS letter, length(replace(substring(audit, 1, pos), 'I', '')) AS i, length(replace(substring(audit, 1, pos), 'D', '')) - length(replace(audit, 'D', '')) % 2 AS nth FROM letters),
said AS (SELECT p.conv_id, string_agg(CASE letter WHEN 'K' THEN r.role || ':' || r.text WHEN 'R' THEN CASE WHEN nth % 2 = 1 THEN 'user:' ELSE 'assistant:' END || r.text ELSE CASE WHEN nth % 2 = 1 THEN 'user:' ELSE 'assistant:' END END, chr(10) ORDER BY pos) AS body
  FROM placed p LEFT JOIN r ON r.conv_id = p.conv_id AND r.i = p.i WHERE letter <> 'D' GROUP BY p.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
   count(*) FILTER (was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN said USING (conv_id)
"""
