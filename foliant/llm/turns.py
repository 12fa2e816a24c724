"""Repair of conversations' structure: the cheapest edits after which the roles read (s?(ua)+)?, by a retained-subsequence DP.

Turns are kept, reroled or deleted, and empty turns inserted. What is retained is a subsequence: prefix sums of the
deletions and, for each role, a running minimum over the retained turns price the gap up to the next one; the pair of
roles around a gap says whether a turn must be inserted; of equally cheap edits those with the ASCII-least audit win. The
DP runs from the end, so that a walk from the start can take the least initial that is still cheapest: linear time.

Only one letter of a turn (the initial of its role with its fault) reaches Python. Rows are put in order by a range
partitioning that splits equal rows as well, and cut into segments of at most SEGMENT turns. A conversation in several
segments is composed: a segment gives its costs from state to state (16 numbers), these are folded from the end to the
costs behind each segment, and the segments' walks from each state are folded from the start. So no task holds a long
conversation's turns, and texts move once to meet their edits. Only the digest of a repaired conversation, which is
defined by chaining, is streamed over its turns in order by one task, a batch at a time.

Defined results: a null role or text is one space, so a null text is blank; a null id is one conversation, a null turn
comes before all others; rows that tie in turn are in order of role, then of the MD5 of the text. Of rows that repeat
role and text in a conversation the first stays, the others are duplicates. Roles count by their first sign: one that
isn't s, u or a must be reroled or deleted. A gap beyond 63 bits is null. A conversation without rows has zeros, an empty
audit and the digest of an empty text. An empty table gives an empty table. Other columns are neither read nor needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import picked, shipped, shuffle_partitions, slices, written
from foliant.llm.line_dedup import SPACE

REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Turns of a segment: two to this power.
SEGMENT_BITS = 13
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. CLOSING: the price of an end there.
START, SYSTEM, USER, ASSISTANT = range(4)
CLOSING, NEVER = (0, 2 * INSERT, INSERT, 0), 1 << 40
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLES = {"u": "user", "a": "assistant"}
COLUMNS = ["conv_id", "turn", "role", "text"]


# the DP over a segment's letters


def letters(code: str) -> list[tuple[int, int]]:
    """(initial, fault) of each turn; initials are those of ROLES in the order s, u, a and any other."""
    return [divmod(ord(c) - 97, 4) for c in code]


def costs(code: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The least cost from each turn on, by the state before it; end: by the state behind the segment."""
    turns, n = letters(code), len(code)
    gone = [0, *accumulate(DELETE for _ in turns)]
    rest: list[tuple[int, ...]] = [end] * (n + 1)
    system = user = assistant = NEVER  # running minima of what is retained from here on, the deletions before it added
    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        if fault <= TRUNCATED:
            own = gone[i] + CUT_SHORT * fault
            if initial == 0:
                system = min(system, own + rest[i + 1][SYSTEM])
            user = min(user, own + REROLE * (initial != 1) + rest[i + 1][USER])
            assistant = min(assistant, own + REROLE * (initial != 2) + rest[i + 1][ASSISTANT])
        before, none = gone[i], gone[n] - gone[i]
        as_user = min(user, assistant + INSERT) - before
        as_assistant = min(assistant, user + INSERT) - before
        rest[i] = (min(none + end[0], as_user, system - before), min(none + end[1], as_user), min(none + end[2], as_assistant), min(none + end[3], as_user))
    return rest


def walk(code: str, end: tuple[int, ...], state: int) -> tuple[str, str, int, int]:
    """(audit, edits, cost, state behind) of the ASCII-least cheapest edits. edits: for each turn what is inserted before it, u or a, and what becomes of it: d, k, or its new role u or a."""
    rest, audit, edits, spent = costs(code, end), [], [], 0
    for i, (initial, fault) in enumerate(letters(code)):
        left, onward, added = rest[i][state], rest[i + 1], "-"
        if left == DELETE + onward[state]:
            audit.append("D")
            edits.append("-d")
            spent += DELETE
            continue
        other = ASSISTANT if state == USER else USER
        if left == INSERT + rest[i][other]:
            audit.append("I")
            added, state, spent = ("a" if other == ASSISTANT else "u"), other, spent + INSERT
            left -= INSERT
        fits = {0: SYSTEM if state == START else None, 1: None if state == USER else USER, 2: ASSISTANT if state == USER else None}.get(initial)
        cut = CUT_SHORT * (fault == TRUNCATED)
        if fits is not None and left == cut + onward[fits]:
            audit.append("K")
            edits.append(added + "k")
            state, spent = fits, spent + cut
        else:
            audit.append("R")
            state = ASSISTANT if state == USER else USER
            edits.append(added + ("a" if state == ASSISTANT else "u"))
            spent += REROLE + cut
    return "".join(audit), "".join(edits), spent, state


def closed(code: str, end: tuple[int, ...] | None, state: int) -> tuple[str, str, int, int]:
    """walk(), then the turns that a conversation's end needs if nothing comes behind (end is None), as edits without a turn."""
    audit, edits, spent, last = walk(code, CLOSING if end is None else end, state)
    if end is None:
        need = {SYSTEM: "ua", USER: "a"}.get(last, "")
        audit, edits, spent = audit + "I" * len(need), edits + "".join(f"{r}-" for r in need), spent + INSERT * len(need)
    return audit, edits, spent, last


_short = lru_cache(100_000)(closed)


def illegal(code: str) -> int:
    roles = [initial for initial, _ in letters(code)]
    return sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))


def _walked(code: pd.Series, end: pd.Series, state: pd.Series) -> pd.DataFrame:
    rows = []
    for c, e, s in zip(code, end, state, strict=True):
        e = None if e is None else tuple(map(int, e))
        rows.append((*(_short if len(c) < 64 and e is None else closed)(c, e, int(s)), illegal(c)))
    return pd.DataFrame(rows, columns=["audit", "edits", "cost", "last", "illegal"])


def _matrix(code: pd.Series) -> pd.Series:
    """Costs from state to state, row by row."""
    one = lambda c: [costs(c, tuple(0 if k == to else NEVER for k in range(4)))[0] for to in range(4)]
    return pd.Series([[int(columns[to][at]) for at in range(4) for to in range(4)] for columns in map(one, code)])


def _exits(code: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([[walk(c, tuple(map(int, e)), s)[3] for s in range(4)] for c, e in zip(code, end, strict=True)])


def _from_end(rows: pd.DataFrame) -> pd.DataFrame:
    """What comes behind each segment of a conversation costs, by state."""
    rows, behind, out = rows.sort_values("seg", ascending=False), CLOSING, []
    for m in rows["matrix"]:
        out.append(list(behind))
        behind = tuple(min(int(m[4 * at + to]) + behind[to] for to in range(4)) for at in range(4))
    return pd.DataFrame({"conv_id": rows["conv_id"], "seg": rows["seg"], "end": out})


def _from_start(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each segment, whether it is the last, and whether its first turn's role may not follow the one before."""
    rows, state, states, wrong, before = rows.sort_values("seg"), START, [], [], None
    for exits, first, last in zip(rows["exits"], rows["first"], rows["final"], strict=True):
        states.append(state)
        wrong.append(int(before is not None and (letters(before)[0][0], letters(first)[0][0]) not in LEGAL))
        state, before = int(exits[state]), last
    return pd.DataFrame({"conv_id": rows["conv_id"], "seg": rows["seg"], "end": rows["end"], "state": states, "seam": wrong, "closing": [False] * (len(rows) - 1) + [True]})


# turns and segments


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, rid, initial, fault, pos): every turn but for its text, numbered in order."""
    bare = F.rtrim("text", F.lit(SPACE))
    ends = bare.endswith(".") | bare.endswith("!") | bare.endswith("?")
    fault = F.when(bare == "", BLANK).when(ends, FINE).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "rid", initial.alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("_salt"))
    by = ["conv_id", "turn", "role", "digest", "_salt"]
    ranged = light.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_salt")
    return ranged.withColumn("pos", F.monotonically_increasing_id())


def given(conversations: DataFrame, names: list[str]) -> DataFrame:
    """The four columns under our names, and rid, which is equal for rows equal in all four."""
    base = picked(conversations, *names).toDF(*COLUMNS)
    base = base.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rid = F.unhex(F.md5(F.concat(told("conv_id"), F.lit("\0"), told("turn"), F.lit("\0"), "role", F.lit("\0"), F.md5(F.col("text").cast("binary"))).cast("binary")))
    return base.withColumn("rid", rid)


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, rows, code and counts of faults): the turns of each segment in order; a first occurrence is the least place of its role and text."""
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    known = turns.join(firsts, "pos", "left").withColumn("fault", fault)
    turn = F.struct("pos", F.char(F.col("initial") * 4 + F.col("fault") + 97).alias("code"), "role", "rid")
    counts = [F.count_if(F.col("fault") == k).alias(name) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    whole = known.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("rows"), *counts)
    return whole.withColumn("code", F.array_join(F.transform("rows", lambda x: x["code"]), ""))


def walked(cut: DataFrame) -> DataFrame:
    """segments() with audit, edits, cost and illegal: alone where a conversation is one segment, else composed."""
    names = cut.select("conv_id", "seg", "code")
    several = names.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"))
    split = written(names.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"), "split-conversations")
    matrix = split.select("conv_id", "seg", F.pandas_udf(_matrix, "array<long>")("code").alias("matrix"))
    kind = cut.schema["conv_id"].dataType.simpleString()
    ends = matrix.groupBy("conv_id").applyInPandas(_from_end, f"conv_id {kind}, seg long, end array<long>")
    behind = split.join(ends.select("seg", "end", F.col("conv_id").alias("_conv")), F.col("conv_id").eqNullSafe(F.col("_conv")) & (split["seg"] == ends["seg"])).select("conv_id", split["seg"], "code", "end")
    first, final = F.substring("code", 1, 1).alias("first"), F.substring("code", -1, 1).alias("final")
    exits = behind.select("conv_id", "seg", "end", first, final, F.pandas_udf(_exits, "array<int>")("code", "end").alias("exits"))
    states = exits.groupBy("conv_id").applyInPandas(_from_start, f"conv_id {kind}, seg long, end array<long>, state int, seam int, closing boolean")
    known = states.select(F.col("conv_id").alias("_conv"), F.col("seg").alias("_seg"), F.when(~F.col("closing"), F.col("end")).alias("end"), "state", "seam")
    both = cut.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg")), "left")
    edited = F.pandas_udf(_walked, "audit string, edits string, cost long, last int, illegal long")
    done = both.withColumn("w", edited("code", "end", F.coalesce("state", F.lit(START))))
    return done.select(*cut.columns, "w.audit", "w.edits", "w.cost", (F.col("w.illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"))


class Repair:
    """The repair of conversations, from columns of the given names for id, turn, role and text."""

    def __init__(self, conversations: DataFrame, names: list[str] = COLUMNS) -> None:
        shipped(conversations)
        self.rows = given(conversations, names)
        self.turns = written(ordered(self.rows), "turns")
        self.segments = written(walked(written(segments(self.turns), "segments")), "walked")

    def edits(self) -> DataFrame:
        """(conv_id, place, edit, added, old, role, rid): what is retained or inserted, in the order of place; added: the role of a turn inserted before it."""
        pairs = F.filter(F.split(F.regexp_replace("edits", "(..)", "$1,"), ","), lambda x: x != "")
        each = self.segments.select("conv_id", "seg", "rows", F.posexplode(pairs).alias("i", "pair"))
        new, added = F.substring("pair", 2, 1), F.substring("pair", 1, 1)
        own = F.get("rows", F.col("i"))
        told = lambda c: F.when(c == "u", ROLES["u"]).when(c == "a", ROLES["a"])
        role = F.when(new == "k", own["role"]).otherwise(told(new))
        place = F.shiftleft("seg", SEGMENT_BITS + 1) + F.col("i")
        edit = F.when(new == "k", "keep").when(new == "-", "close").otherwise("rerole")
        return each.where(new != "d").select("conv_id", place.alias("place"), edit.alias("edit"), told(added).alias("added"), role.alias("role"), own["rid"].alias("rid"))

    def repaired(self) -> DataFrame:
        """(conv_id, place, edit, added, role, text): the turns of the repaired conversations; a turn to be inserted is named in added, before the turn of its row, or alone (edit close) at the end."""
        once = self.rows.select("rid", "text").dropDuplicates(["rid"])
        return self.edits().join(once, "rid", "left").drop("rid")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of conversations that keep a turn."""
        own = F.concat("role", F.lit(":"), "text")
        lead = F.concat("added", F.lit(":"))
        line = F.concat_ws("\n", lead, F.when(F.col("edit") != "close", own))
        lines = self.repaired().select("conv_id", "place", line.alias("line"))
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")

    def report(self) -> DataFrame:
        """A row for each conversation: gaps, faults, illegal pairs, cost, audit, repaired_sha256."""
        turns = self.turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
        wide = F.col("turn").cast("decimal(20,0)")
        gaps = turns.groupBy("conv_id").agg((F.max(wide) - F.min(wide) + 1 - F.count("turn")).try_cast("long").alias("gaps"), F.lit(True).alias("_known"))
        pieces = self.segments.select("conv_id", *FAULTS, F.struct("seg", "audit").alias("piece"))
        every = pieces.unionByName(gaps, allowMissingColumns=True).unionByName(self.digests(), allowMissingColumns=True)
        return _summed(every)


FAULTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _summed(parts: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in FAULTS]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["audit"]), "")
    gaps = F.when(F.max("_known").isNull(), F.lit(0).cast("long")).otherwise(F.max("gaps"))
    digest = F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256))
    return parts.groupBy("conv_id").agg(gaps.alias("gaps"), *sums, audit.alias("audit"), digest.alias("repaired_sha256"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each run of rows of a conversation; only its state is held from batch to batch."""
    at, state, kind = None, None, None
    for batch in slices(batches):
        kind, keys, out = batch.schema.field("conv_id").type, [], []
        for key, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if state is not None and key == at:
                state.update(b"\n")
            else:
                if state is not None:
                    keys.append(at), out.append(state.hexdigest())
                at, state = key, hashlib.sha256()
            state.update(line.encode())
        yield pa.record_batch([pa.array(keys, kind), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([at], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame, names: list[str] = COLUMNS) -> DataFrame:
    """Rows damaged by the checksum of conv_id:turn modulo 20: 0 dropped, 1 emptied, 2 without ends of sentences, 3 twice, 4 given to the user."""
    base = picked(conversations, *names).toDF(*COLUMNS)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    rows = base.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    conversations = table(spark, sf_dir, "conversations")
    found = Repair(damaged(conversations)).report()
    every = picked(conversations, "conv_id").groupBy("conv_id").agg(F.lit(1).alias("_one")).drop("_one")
    zero = [F.when(F.col("_seen").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("gaps", *FAULTS)]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    both = every.join(found.withColumnRenamed("conv_id", "_conv").withColumn("_seen", F.lit(True)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by recursion over turns: for each state the least (cost, audit) so far, with the text that it gives."""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"

    def after(x: str, cost: str, initial: str, line: str) -> str:
        text = f"{x}.t" if not line else f"CASE WHEN {x}.t = '' THEN {line} ELSE {x}.t || chr(10) || {line} END"
        return f"CASE WHEN {x} IS NULL THEN {none} ELSE {{'c': CAST({x}.c + {cost} AS BIGINT), 'a': {x}.a || '{initial}', 't': {text}}} END"

    insert = lambda x, role: after(x, "5", "I", f"'{role}:'")
    delete = lambda x: after(x, "2", "D", "")

    def retain(x: str, letter: str, role: str) -> str:
        keep, rerole = after(x, "cut", "K", "role || ':' || text"), after(x, "cut + 1", "R", f"'{role}:' || text")
        return f"CASE WHEN fault > 1 THEN {none} WHEN left(role, 1) = '{letter}' THEN {keep} ELSE {rerole} END"

    return f"""
WITH RECURSIVE bits(v, b, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(b ORDER BY v) AS crcs FROM bits WHERE k = 8),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS k
  FROM conversations
), kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, k), lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1])), 4294967295) % 20 AS kind FROM base, crc_table),
turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM turns)
), known AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN bare = '' THEN 3 WHEN again > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), walk(conv_id, i, b0, bs, bu, ba) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 't': ''}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)), {none}, {none}, {none} FROM known
  UNION ALL
  SELECT conv_id, i, {delete("b0")},
    least({delete("bs")}, CASE WHEN fault <= 1 AND left(role, 1) = 's' THEN {after("b0", "cut", "K", "role || ':' || text")} END),
    least({delete("bu")}, {retain("b0", "u", "user")}, {retain("bs", "u", "user")}, {retain("a1", "u", "user")}),
    least({delete("ba")}, {retain("u1", "a", "assistant")})
  FROM (
    SELECT k.*, CASE fault WHEN 1 THEN 5 ELSE 0 END AS cut, b0, bs, bu, ba, least(ba, {insert("bu", "assistant")}) AS a1, least(bu, {insert("b0", "user")}, {insert("bs", "user")}, {insert("ba", "user")}) AS u1
    FROM walk w JOIN known k ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = w.i + 1
  )
), sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM known GROUP BY conv_id
), ended AS (
  SELECT s.*, least(b0, ba, {insert("bu", "assistant")}, {insert("b1", "assistant")}) AS x
  FROM (SELECT *, {insert("bs", "user")} AS b1 FROM walk) w JOIN sums s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
