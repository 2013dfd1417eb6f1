"""Conversation repair by Wagner-Fischer alignment with the alternating grammar ``(s?(ua)+)?``.

1. A row's faults need only its digest: a text is blank, repeats a role and text seen earlier, or is cut off (its last sign ends
   no sentence).  First occurrences are a pre-aggregated minimum, so a text repeated in one conversation is no hot group.
2. Rows without their texts are sorted by conversation and turn; a task reads them one after another and keeps one sign per row of
   the current conversation: its role's initial, upper case if cut off, or ``x`` where it has to go.
3. The signs are aligned with the grammar's strings.  An edit keeps a row (K, 0), changes its role (R, 3), deletes it (D, 4) or
   inserts an empty turn (I, 3); a cut-off row costs 3 more unless deleted.  Every feasible length is a Wagner-Fischer table,
   nearest lengths first; the best cost so far bounds the table's band (Ukkonen: a path that leaves it costs more) and ends the
   search.  Of the audits backtraced from equally cheap tables, the one that sorts first wins.
   Beyond ``LONG`` rows the tables of all lengths are one: targets are prefixes of one string whose symbols alternate, so costs to
   go are equal two columns apart.  It gives the same audit in time and memory proportional to the rows.
4. Audits meet the texts again in a second pass over rows sorted the same way, which feeds the repaired rows to the hash one by
   one: no conversation is gathered, whatever its length.

Order within a conversation: turn (nulls first), then role, then digest of the text; rows equal in all three are interchangeable.

Cases: null roles and texts count as one blank.  A null conversation id is a conversation.  Roles are judged by their initials;
those that are not s, u or a have to be changed or deleted.  Repeated rows are duplicates.  An empty table gives an empty result.
Very long texts travel once, in the second pass.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import SPACES

KEEP, ROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows up to which every length has a table of its own.
LONG = 48
#: Alignments that a worker remembers.
REMEMBERED = 200_000
_FAR = 1 << 40


def _match(sign: str, target: str) -> tuple[int, str]:
    """Cost and edit of a row that takes the place of ``target``; ``s`` is only ever kept."""
    if sign == "x":
        return _FAR, "K"
    cut = CUT if sign.isupper() else 0
    if sign.lower() == target:
        return KEEP + cut, "K"
    return (ROLE + cut, "R") if target != "s" else (_FAR, "R")


def _greedy(signs: str) -> int:
    """Cost of one repair: the first cost to beat."""
    cost, n = 0, 0
    for c in signs:
        if c == "x":
            cost += DELETE
        else:
            cost += _match(c, "ua"[n % 2])[0]
            n += 1
    return cost + INSERT * (n % 2)


def _align(signs: str, target: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of turning the rows into ``target``, or None where it costs more than ``most``.

    Costs to go, row by row from the end; a cell off the diagonal by more than ``most`` buys in edits costs too much."""
    m, n = len(signs), len(target)
    wide, low = most // INSERT, most // DELETE
    go = [[_FAR] * (n + 1) for _ in range(m + 1)]
    for i in range(m, -1, -1):
        row, below = go[i], go[i + 1] if i < m else None
        for j in range(min(n, i + wide), max(0, i - low) - 1, -1):
            if i == m and j == n:
                row[j] = 0
                continue
            best = _FAR
            if below is not None:
                best = below[j] + DELETE
                if j < n:
                    best = min(best, below[j + 1] + _match(signs[i], target[j])[0])
            if j < n and target[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            row[j] = best
    if go[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (m, n):  # letters in the order of the alphabet: D, I, K, R
        here = go[i][j]
        if i < m and go[i + 1][j] + DELETE == here:
            audit.append("D")
            i += 1
        elif j < n and target[j] != "s" and go[i][j + 1] + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append(_match(signs[i], target[j])[1])
            i, j = i + 1, j + 1
    return go[0][0], "".join(audit)


def _each_length(signs: str) -> tuple[int, str]:
    rows = sum(c != "x" for c in signs)
    lengths = {"": range(0, 2 * len(signs) + 3, 2), "s": range(3, 2 * len(signs) + 6, 2)}
    most, best = _greedy(signs), None
    for length, start in sorted(((n, s) for s, ns in lengths.items() for n in ns), key=lambda x: (abs(x[0] - rows), x)):
        least = INSERT * (length - rows) if length > rows else DELETE * (rows - length)
        if least + DELETE * (len(signs) - rows) > most:
            continue
        found = _align(signs, start + "ua" * (length // 2), most)
        if found and (best is None or found < best):
            best, most = found, found[0]
    return best


def _folded(signs: str) -> tuple[int, str]:
    """The same with the tables of all lengths in one.

    Its columns: 0 expects u and may end, 1 expects a, 2 expects the u of the first pair after s, 3 expects s."""
    m, nxt, target = len(signs), (1, 0, 1, 2), "uaus"
    match = {c: [_match(c, t) for t in target] for c in set(signs)}
    moves = [bytearray(m + 1) for _ in target]
    go = [0, _FAR, _FAR, _FAR]
    for i in range(m, -1, -1):
        base, edit = list(go), [""] * 4  # at the end nothing is left to edit
        if i < m:
            for k in range(4):
                delete, (cost, e) = go[k] + DELETE, match[signs[i]][k]
                base[k], edit[k] = min((delete, "D"), (cost + go[nxt[k]], e))
        here, new = list(edit), list(base)
        for k in (0, 1, 2):
            onward = (base[nxt[k]] if k < 2 else new[1]) + INSERT
            if (onward, "I") < (base[k], edit[k] or "A"):
                new[k], here[k] = onward, "I"
        for k in range(4):
            moves[k][i] = ord(here[k] or "-")
        go = new
    found = []
    for k in (0, 3):
        cost, audit, i = go[k], bytearray(), 0
        while cost < _FAR and not (i == m and k == 0):
            e = moves[k][i]
            audit.append(e)
            i += e != 73  # I
            k = k if e == 68 else nxt[k]  # D
        found.append((cost, audit.decode()))
    return min(found)


def align(signs: str) -> tuple[int, str]:
    """Least cost, and of the audits of that cost the one that sorts first."""
    return _each_length(signs) if len(signs) <= LONG else _folded(signs)


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text")
                        ).withColumn("digest", F.unhex(F.md5("text")))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Tally:
    """One conversation's counts and signs, fed part by part."""

    def __init__(self, conv):
        self.conv, self.signs, self.last = conv, [], ""
        self.low = self.high = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turns: list[int | None], initials: str, signs: str, faults: str) -> None:
        for t in turns:
            if t is not None and t != self.high:
                self.low, self.high, self.turns = t if self.low is None else self.low, t, self.turns + 1
        row = self.last + initials
        self.illegal += sum(p not in ("su", "ua", "au") for p in map("".join, zip(row, row[1:])))
        self.last = initials[-1]
        self.blank, self.duplicate, self.truncated = (n + faults.count(f) for n, f in zip((self.blank, self.duplicate, self.truncated), "bdt"))
        self.signs.append(signs)

    def row(self, aligned: Callable[[str], tuple[int, str]]) -> tuple:
        cost, audit = aligned("".join(self.signs))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _parts(batch: pa.RecordBatch) -> Iterable[tuple[int, int]]:
    conv = batch.column(0).to_pylist()
    at = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return [(a, b) for a, b in zip(at, at[1:]) if a < b]


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, ``gaps, blank, duplicate, truncated, illegal, cost`` and ``audit``."""
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col)
    rows = rows.withColumn("rest", F.rtrim("text", F.lit(SPACES))).select(
        "conv", "turn", "role", "digest", _initial().alias("initial"), (F.col("rest") == "").alias("blank"),
        (~F.substring(F.col("rest"), -1, 1).isin(".", "!", "?")).alias("cut")).repartition("conv")
    seen = F.expr("row_number() over (partition by conv, role, digest order by turn nulls first)")
    rows = rows.withColumn("seen", seen).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest", "seen")
    fault = F.when(F.col("blank"), "b").when(F.col("seen") > 1, "d").when(F.col("cut"), "t").otherwise("-")
    rows = rows.withColumn("fault", fault).select(
        "conv", "turn", "initial", F.when(F.col("fault").isin("b", "d"), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial")).alias("sign"), "fault")
    key = turns.schema[conv_col]
    schema = T.StructType([T.StructField(conv_col, key.dataType), *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("audit", T.StringType())])

    def run(it: Iterable[pa.RecordBatch]):
        known: dict[str, tuple[int, str]] = {}

        def aligned(signs: str) -> tuple[int, str]:
            if signs not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(signs) > LONG:
                    return align(signs)
                known[signs] = align(signs)
            return known[signs]

        def table(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * 8
            kinds = [conv_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], schema.names)

        now, conv_type = None, None
        for batch in it:
            conv_type, done = batch.schema.field(0).type, []
            conv, turn, initial, sign, fault = (c.to_pylist() for c in batch.columns)
            for a, b in _parts(batch):
                if now is None or now.conv != conv[a]:
                    if now is not None:
                        done.append(now.row(aligned))
                    now = _Tally(conv[a])
                now.add(turn[a:b], "".join(initial[a:b]), "".join(sign[a:b]), "".join(fault[a:b]))
            yield table(done)
        if now is not None:
            yield table([now.row(aligned)])

    return rows.mapInArrow(run, schema)


class _Replay:
    """Applies an audit to the rows of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "user"

    def _turn(self, role: str | None, text: str) -> tuple[str, str]:
        """The next repaired row; without a role, the one that is due."""
        if role is None:
            role = self.next
        self.next = "assistant" if role[0] == "u" else "user"
        return role, text

    def inserted(self) -> Iterable[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn(None, "")

    def rows(self, role: str, text: str) -> Iterable[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(role if edit == "K" else None, text)


def _repair(turns: DataFrame, report: DataFrame, names: tuple[str, str, str, str], fields: list[T.StructField], sink: Callable) -> DataFrame:
    """Audits ahead of their rows, in order; ``sink(conv, stream of repaired rows)`` gives the result's rows as they come."""
    conv_col = names[0]
    rows = _prepared(turns, *names).withColumn("kind", F.lit(1))
    heads = report.select(F.col(f"`{conv_col}`").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))
    both = rows.unionByName(heads).repartition("conv").sortWithinPartitions(
        "conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "kind", "role", "text")
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), *fields])

    def run(it: Iterable[pa.RecordBatch]):
        make = state = kinds = None
        for batch in it:
            kinds = batch.schema.field(0).type
            make = make or sink()
            out: list[tuple] = []
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if state:
                        out += make(state[0], state[1].inserted(), True)
                    state = (conv, _Replay(text))
                else:
                    out += make(conv, state[1].rows(role, text), False)
                if len(out) >= 1024:
                    yield _batch(out, schema, kinds)
                    out = []
            yield _batch(out, schema, kinds)
        if state:
            yield _batch(list(make(state[0], state[1].inserted(), True)), schema, kinds)

    return both.mapInArrow(run, schema)


_KINDS = {"string": pa.string(), "bigint": pa.int64()}


def _batch(rows: list[tuple], schema: T.StructType, conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, *[_KINDS[f.dataType.simpleString()] for f in schema.fields[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], schema.names)


def _as_rows():
    place = 0

    def take(conv, rows, last):
        nonlocal place
        for role, text in rows:
            yield conv, place, role, text
            place += 1
        if last:
            place = 0
    return take


def _as_hash():
    state = None

    def take(conv, rows, last):
        nonlocal state
        for role, text in rows:
            if state is None:
                state = hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(role.encode() + b":" + text.encode())
        if last:
            yield conv, (state or hashlib.sha256()).hexdigest()
            state = None
    return take


def repaired(turns: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``role, text``; ``report`` comes from ``audits``."""
    fields = [T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    return _repair(turns, report, (conv_col, turn_col, role_col, text_col), fields, _as_rows)


def repaired_hashes(turns: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` rows joined by newlines: ``conv_id, repaired_sha256``."""
    return _repair(turns, report, (conv_col, turn_col, role_col, text_col), [T.StructField("repaired_sha256", T.StringType())], _as_hash)
