"""Repair of damaged conversations: the cheapest edits, by A* on the edit lattice.

A conversation is a sequence of rows; edits keep, rerole or delete each of them and insert empty ones
until the roles read ``(s?(ua)+)?``. A node of the lattice is the number of rows used and one of four
states of that pattern. What blank and repeated rows must cost (they are deleted) and what truncated
ones cannot escape, summed over the rows ahead, never overstates the way that is left, so the first time
a node leaves the queue, which is ordered by (cost plus that sum, edits so far), its edits are the
cheapest and among these the least.

A conversation may be longer than any task should hold. Rows are dealt by ranges of conversation and
position and packed into segments of at most ``ROWS`` rows and about ``BYTES`` of text. Where a segment is a
whole conversation, it is solved at once. Else the search runs from each of the four states to each, and
yields 16 costs and the order of the edits that reach them; from these the states between the segments of
a conversation are chosen, and each segment is then searched again between its own two. Insertions belong to the row that
follows, so that no segment's edits begin with another's, and the order of the whole is the order of the parts.
A conversation's texts meet only in the running hash that the result asks for, one segment at a time.

Defined cases: rows are ordered by turn (nulls first), then role and text after the damage, so rows that
repeat stand together; a null role or text is one space; a role that begins with no ``s``, ``u`` or ``a``, or an
empty one, fits nowhere and cannot be kept; a null ``conv_id`` is a conversation of its own; a conversation
without rows has zeros, no edits and the hash of nothing; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import cut, scratch, small_batches

ROWS = 256
BYTES = 1 << 20
SPACES = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state, what may follow and the state after it.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: By state, the only role that can be given or inserted.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Insertions after the last row.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
GONE = "bd"  # faults of rows that must go: blank, duplicate; a truncated row has t, others have o


def ahead(faults: str) -> list[int]:
    """By position, the least that the rows from there on can cost."""
    out = [0] * (len(faults) + 1)
    for i in range(len(faults) - 1, -1, -1):
        out[i] = out[i + 1] + (DELETE if faults[i] in GONE else min(DELETE, KEEP + TRUNCATED) if faults[i] == "t" else 0)
    return out


def search(roles: str, faults: str, start: int = START, ends: set | None = None) -> dict[int, tuple[int, str]]:
    """Cheapest edits from ``start``: by end state, cost and edits. With ``ends`` None the way ends where a
    conversation may; otherwise at the last row, in each of ``ends`` that can be reached."""
    n, rest = len(roles), ahead(faults)
    wanted = {START, ASSISTANT} if ends is None else set(ends)
    queue = [(rest[0], "", 0, start, 0)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        _, edits, i, state, cost = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in wanted:
            found[state] = (cost, edits)
            if ends is None or len(found) == len(wanted):
                break
        steps = []
        role = NEXT[state]
        if i < n:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] not in GONE:
                more = TRUNCATED if faults[i] == "t" else 0
                if roles[i] in FOLLOWS[state]:
                    steps.append((KEEP + more, "K", i + 1, FOLLOWS[state][roles[i]]))
                steps.append((REROLE + more, "R", i + 1, FOLLOWS[state][role]))
        if i < n or ends is None:
            steps.append((INSERT, "I", i, FOLLOWS[state][role]))
        for price, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + price + rest[j], edits + edit, j, to, cost + price))
    return found


def replay(edits: str, start: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as ``role:text``."""
    out, i, state = [], 0, start
    for e in edits:
        if e == "D":
            i += 1
            continue
        if e == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = FOLLOWS[state][roles[i][0]]
        else:
            role = NEXT[state]
            out.append(f"{NAMES[role]}:{texts[i] if e == 'R' else ''}")
            state = FOLLOWS[state][role]
        i += e != "I"
    return out


class _Segment:
    """Rows of one conversation in order, with what is counted on the way."""

    def __init__(self):
        self.initials, self.faults, self.roles, self.texts = [], [], [], []
        self.size = self.illegal = self.turns = 0
        self.lo = self.hi = None

    def add(self, initial, fault, role, text, turn):
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.hi:
            self.lo, self.hi, self.turns = turn if self.lo is None else self.lo, turn, self.turns + 1
        gone = fault in GONE
        self.initials.append(initial)
        self.faults.append(fault)
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.size += 0 if gone else len(role) + len(text)

    def full(self) -> bool:
        return len(self.initials) >= ROWS or self.size >= BYTES


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "at int, seq long, initials string, faults string, lo long, hi long, turns long, costs array<long>, ranks array<long>, roles array<string>, texts array<string>"
_STREAM = f"whole boolean, {RESULT}, {_PART}"


def _batch(rows: list[dict], names: list[str], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds)}, pa.schema(list(zip(names, kinds))))


def _types(schema: str):
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    pairs = [x.split(" ") for x in schema.split(", ")]
    return [n for n, _ in pairs], [plain[k] for _, k in pairs]


def _solved(conv, s: _Segment) -> dict:
    initials, faults = "".join(s.initials), "".join(s.faults)
    found = search(initials, faults)
    (state, (cost, edits)) = next(iter(found.items()))
    digest = hashlib.sha256("\n".join(replay(edits, START, s.roles, s.texts)).encode()).hexdigest()
    gaps = s.hi - s.lo + 1 - s.turns if s.turns else 0
    return {
        "whole": True, "conv_id": conv, "gaps": gaps, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": s.illegal, "cost": cost, "audit": edits, "repaired_sha256": digest,
    }


def _part(conv, s: _Segment, at: int, seq: int) -> dict:
    initials, faults = "".join(s.initials), "".join(s.faults)
    costs, ranks = [], []
    for a in range(4):
        found = search(initials, faults, a, {0, 1, 2, 3})
        order = sorted(found, key=lambda b: found[b][1])
        costs += [found[b][0] if b in found else -1 for b in range(4)]
        ranks += [order.index(b) if b in found else -1 for b in range(4)]
    return {
        "whole": False, "conv_id": conv, "illegal": s.illegal, "at": at, "seq": seq, "initials": initials, "faults": faults, "lo": s.lo, "hi": s.hi, "turns": s.turns,
        "costs": costs, "ranks": ranks, "roles": s.roles, "texts": s.texts,
    }


def _stream(batches):
    """Rows in order to solved conversations, and to segments of those that are long or may go on in another task."""
    from pyspark import TaskContext

    names, kinds = _types(_STREAM)
    at, out, size = TaskContext.get().partitionId(), [], 0
    conv, segment, seq, n_convs, n_parts = None, None, 0, 0, 0

    def close(last: bool):
        """The first conversation may have begun in another task."""
        nonlocal size, seq, n_parts
        whole = last and n_convs > 1 and n_parts == 0
        out.append(_solved(conv, segment) if whole else _part(conv, segment, at, seq))
        size += segment.size + 1000
        seq += 1
        n_parts += 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")]
        for c, turn, role, text, n, fault in zip(*columns):
            if segment is None or c != conv:
                if segment is not None:
                    close(last=True)
                conv, segment, n_parts, n_convs = c, _Segment(), 0, n_convs + 1
            initial = role[0] if role[:1] in ("s", "u", "a") else "x"
            for k in range(n):
                if segment.full():
                    close(last=False)
                    segment = _Segment()
                segment.add(initial, fault if k == 0 or fault == "b" else "d", role, text, turn)
            if size >= 4 << 20 or len(out) >= 2000:
                yield _batch(out, names, kinds)
                out, size = [], 0
    if segment is not None:
        close(last=False)
    if out:
        yield _batch(out, names, kinds)


def _choose(pdf):
    """The states between the segments of one conversation."""
    import pandas as pd

    pdf = pdf.sort_values(["at", "seq"])
    costs = [c.tolist() for c in pdf["costs"]]
    ranks = [r.tolist() for r in pdf["ranks"]]
    none = float("inf")
    best = [[none] * 4 for _ in costs] + [[INSERT * TAIL[s] for s in range(4)]]
    for k in range(len(costs) - 1, -1, -1):
        for a in range(4):
            best[k][a] = min([costs[k][4 * a + b] + best[k + 1][b] for b in range(4) if costs[k][4 * a + b] >= 0], default=none)
    state, ways = START, []
    for k in range(len(costs)):
        ends = [b for b in range(4) if (c := costs[k][4 * state + b]) >= 0 and c + best[k + 1][b] == best[k][state]]
        end = min(ends, key=lambda b: ranks[k][4 * state + b])
        ways.append((state, end))
        state = end
    return pd.DataFrame({"c_at": pdf["at"].to_numpy(), "c_seq": pdf["seq"].to_numpy(), "start": [a for a, _ in ways], "end": [b for _, b in ways]})


_DONE = "conv_id long, at int, seq long, initials string, faults string, lo long, hi long, turns long, illegal long, cost long, end int, edits string, body string, n_rows long"


def _finish(batches):
    """Each segment between its chosen states."""
    names, kinds = _types(_DONE)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, edits = search(r["initials"], r["faults"], r["start"], {r["end"]})[r["end"]]
            rows = replay(edits, r["start"], r["roles"], r["texts"])
            out.append(r | {"cost": cost, "edits": edits, "body": "\n".join(rows), "n_rows": len(rows)})
        yield _batch(out, names, kinds)


def _join_up(batches):
    """Finished segments in order to conversations: hashes and counts run on."""
    names, kinds = _types(RESULT)
    at = None

    def row():
        state = now["end"]
        for _ in range(TAIL[state]):
            add(f"{NAMES[NEXT[state]]}:")
            state = FOLLOWS[state][NEXT[state]]
        edits.append("I" * TAIL[now["end"]])
        now["cost"] += INSERT * TAIL[now["end"]]
        gaps = now["hi"] - now["lo"] + 1 - now["turns"] if now["turns"] else 0
        return now | {"conv_id": at[0], "gaps": gaps, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}

    def add(body):
        digest.update((("\n" if now["n_rows"] else "") + body).encode())
        now["n_rows"] += 1

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if at is None or at[0] != r["conv_id"]:
                if at is not None:
                    out.append(row())
                at, edits, digest = (r["conv_id"],), [], hashlib.sha256()
                now = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost", "turns", "n_rows"], 0) | {"lo": None, "hi": None, "last": ""}
            if r["n_rows"]:
                add(r["body"])
            edits.append(r["edits"])
            now["illegal"] += r["illegal"]
            if r["initials"]:
                now["illegal"] += bool(now["last"]) and now["last"] + r["initials"][0] not in ("su", "ua", "au")
                now["last"] = r["initials"][-1]
            if r["turns"]:
                now["turns"] += r["turns"] - (now["hi"] == r["lo"])
                now["lo"], now["hi"] = r["lo"] if now["lo"] is None else now["lo"], r["hi"]
            for name, sign in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                now[name] += r["faults"].count(sign)
            now["cost"] += r["cost"]
            now["end"] = r["end"]
        if out:
            yield _batch(out, names, kinds)
    if at is not None:
        yield _batch([row()], names, kinds)


def damaged(convs: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, n)`` as the checksum of ``conv_id:turn`` damages them. Dropped
    rows stay as ``n`` = 0, so that no conversation is lost."""
    one = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), one), F.lit(":"), F.coalesce(turn.cast("string"), one))
    rows = convs.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("code"),
    )
    code = F.col("code")
    text = F.when(code <= 1, "").when(code == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    role = F.when(code == 0, "").when(code == 4, "user").otherwise(F.col("role"))
    n = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return rows.select("conv_id", F.when(code > 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def faulty(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, and the first ``fault`` of the first of them."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("bare", F.rtrim("text", F.lit(SPACES))).withColumn("sum", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = rows.filter("n > 0 and bare <> ''").groupBy("conv_id", "role", "sum").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1")
    seen = seen.select(F.col("conv_id").alias("s_conv"), F.col("role").alias("s_role"), F.col("sum").alias("s_sum"), "first")
    rows = rows.withColumn("place", place).join(
        seen, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("sum") == F.col("s_sum")), "left"
    )
    fault = (
        F.when(F.col("bare") == "", "b").when(F.col("first") < F.col("place"), "d")
        .when(F.substring("bare", -1, 1).isin(".", "!", "?"), "o").otherwise("t")
    )
    return rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows(conv_id, turn, role, text, n)``: what is wrong with it, the
    cheapest edits with their cost, and the hash of what they make of it."""
    spark = rows.sparkSession
    with scratch(spark):
        small_batches(spark)
        rows = faulty(rows)
        near = F.substring("text", 1, 32)  # the order of whole texts, in bounded samples
        rows = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", near)
        rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
        parts = cut(rows.mapInArrow(_stream, _STREAM), "turn-segments", keep=True)
        whole = parts.filter("whole").select(*_types(RESULT)[0])
        parts = parts.filter("not whole")
        ways = parts.select("conv_id", "at", "seq", "costs", "ranks").groupBy("conv_id").applyInPandas(_choose, "c_at int, c_seq long, start int, end int")
        done = parts.join(ways, (F.col("at") == F.col("c_at")) & (F.col("seq") == F.col("c_seq"))).mapInArrow(_finish, _DONE)
        done = done.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq").mapInArrow(_join_up, RESULT)
        done = cut(done, "turn-repairs", keep=True)
    return whole.unionByName(done)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every conversation, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The lattice row by row: for each state of the pattern the cheapest way so far, edits deciding ties.
ORACLE = r"""
with recursive tab as (
  select list(c order by i) as tab
  from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256)) as i))
), n as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as name
  from conversations
), x as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(name, lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as code
  from n, tab
), d as (
  select conv_id, turn, case code when 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case code when 3 then [0, 1] else [0] end) as copy
  from x where code > 0
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from d
), f as (
  select conv_id, i, turn, role, text, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as c,
         case when bare = '' then 'b' when again > 1 then 'd' when right(bare, 1) in ('.', '!', '?') then 'o' else 't' end as fault
  from o
), g as (
  select *, coalesce(lag(c) over (partition by conv_id order by i) || c not in ('su', 'ua', 'au'), false) as bad from f
), s as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
         count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (bad) as illegal, max(i) as n
  from g group by conv_id
), ins as (
  select * from (values (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a'),
                        (0, 3, 'ua'), (1, 3, 'ua'), (3, 3, 'ua'), (2, 2, 'au')) t(a, b, word)
), fit as (
  select * from (values (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (3, 'u', 2, 'K'), (2, 'a', 3, 'K'),
                        (0, 'user', 2, 'R'), (1, 'user', 2, 'R'), (3, 'user', 2, 'R'), (2, 'assistant', 3, 'R'),
                        (0, '', 0, 'D'), (1, '', 1, 'D'), (2, '', 2, 'D'), (3, '', 3, 'D')) t(b, needs, e, edit)
), way as (
  select a, e, needs, edit, repeat('I', length(word)) || edit as edits, 3 * length(word) + case edit when 'K' then 0 when 'R' then 3 else 4 end as price,
         replace(replace(word, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10)) as body
  from ins join fit using (b)
), dp as (
  select distinct conv_id, 0::bigint as i, 0 as a, {'cost': 0::bigint, 'audit': '', 'body': ''} as best from f
  union all
  select dp.conv_id, f.i, way.e, min({
           'cost': dp.best.cost + way.price + case when way.edit <> 'D' and f.fault = 't' then 3 else 0 end,
           'audit': dp.best.audit || way.edits,
           'body': dp.best.body || way.body || case way.edit when 'D' then '' when 'K' then f.role || ':' || f.text || chr(10) else way.needs || ':' || f.text || chr(10) end})
  from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1
  join way on way.a = dp.a and (way.edit = 'D' or f.fault in ('o', 't')) and (way.edit <> 'K' or way.needs = f.c)
  group by dp.conv_id, f.i, way.e
), done as (
  select dp.conv_id, min({'cost': best.cost + 3 * length(word), 'audit': best.audit || repeat('I', length(word)),
           'body': best.body || replace(replace(word, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10))}) as best
  from dp join s on s.conv_id is not distinct from dp.conv_id and dp.i = s.n
  join ins on ins.a = dp.a and ins.b in (0, 3)
  group by dp.conv_id
)
select c.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated,
       coalesce(s.illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
       sha256(coalesce(left(best.body, length(best.body) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join s on s.conv_id is not distinct from c.conv_id left join done on done.conv_id is not distinct from c.conv_id
"""
