"""Conversation structure repair by generalised LR parsing with edits.

A conversation's roles should read ``(s?(ua)+)?``.  Each row is blank, a duplicate, cut
short or sound; the cheapest edits make the roles fit: keep (0), rerole to user or
assistant (2), delete (3, the only way for blank and duplicate rows), insert an empty
user or assistant turn anywhere (2), and 1 more for a row that stays cut short.

The LR automaton of the role grammar is built from its rules.  A parse goes row by row over a
graph-structured stack: stacks share their tails, every edit shifts a role (and reduces)
from every stack top, and equal tops are merged by the least (cost, audit), the audit
being the edits' initials in order.  What may follow a stack depends on its top alone,
so merging loses no cheaper repair, and a run of rows acts as a table from stack tops to stack
tops.  Tables of neighbouring runs combine like matrices, by the least (cost, audit).

Rows are sorted into ranges of (conversation, turn, role, text).  A conversation inside one task's rows
is repaired there.  One that is cut by a border, or longer than ``PIECE_ROWS`` rows or ``PIECE_BYTES``
characters, is dealt in pieces: tasks make the pieces' tables, one combines them (it holds some characters a
row, as the audit does), and each piece gets its part of the audit back.  Only the digest, sequential by
definition, reads such a conversation in one task, as a sorted stream of its pieces.

Defined results: a null conversation id is one conversation; null roles and texts count as one
space; rows without a turn come first; rows of one turn are taken by role, then text; repeated
rows are duplicates; other roles can be reroled or deleted; turns are whole numbers, any other
text is a null turn; extra columns are not read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}  # what rows are reroled to and inserted as
INK = r"[^\x20\x09-\x0D]"
ENDING = r"[.!?][\x20\x09-\x0D]*\z"

PIECE_ROWS, PIECE_BYTES = 1 << 16, 4 << 20
RUN = 24  # rows of a run whose table is remembered

#: The role grammar, start symbol first; an empty right side is the empty conversation.
GRAMMAR = [("C", ()), ("C", ("P",)), ("C", ("s", "P")), ("P", ("P", "u", "a")), ("P", ("u", "a"))]


class Automaton:
    """LR(0) item sets of a grammar whose start rules are only reduced at the end of input."""

    def __init__(self, grammar):
        self.grammar, start = grammar, grammar[0][0]
        heads = {head for head, _ in grammar}

        def closed(items):
            todo, out = list(items), set(items)
            while todo:
                rule, dot = todo.pop()
                body = grammar[rule][1]
                for k, (head, _) in enumerate(grammar):
                    if dot < len(body) and body[dot] == head and (k, 0) not in out:
                        out.add((k, 0))
                        todo.append((k, 0))
            return frozenset(out)

        first = closed({(k, 0) for k, (head, _) in enumerate(grammar) if head == start})
        self.states, self.step = [first], [{}]
        for at, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
                after = closed({(r, d + 1) for r, d in items if d < len(grammar[r][1]) and grammar[r][1][d] == symbol})
                if after not in self.states:
                    self.states.append(after)
                    self.step.append({})
                self.step[at][symbol] = self.states.index(after)
        done = [[r for r, d in items if d == len(grammar[r][1])] for items in self.states]
        self.accepting = {s for s, rules in enumerate(done) if any(grammar[r][0] == start for r in rules)}
        self.reduce = {s: r for s, rules in enumerate(done) for r in rules if grammar[r][0] in heads - {start}}

    def shift(self, stack, role: str):
        """The stack (state, stack below) after a role and all reductions; None if the role does not fit."""
        to = self.step[stack[0]].get(role)
        if to is None:
            return None
        stack = (to, stack)
        while stack[0] in self.reduce:
            head, body = self.grammar[self.reduce[stack[0]]]
            for _ in body:
                stack = stack[1]
            stack = (self.step[stack[0]][head], stack)
        return stack


LR = Automaton(GRAMMAR)


def _merge(tops: dict, stack, cost: int, audit: str) -> bool:
    """Puts a stack among those kept, one for each top; whether it is better than the one before."""
    old = tops.get(stack[0])
    if old is not None and old[:2] <= (cost, audit):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _with_inserts(tops: dict) -> dict:
    """Tops after any number of inserted turns (each costs, so this ends)."""
    todo = list(tops)
    while todo:
        cost, audit, stack = tops[todo.pop()]
        for role in ROLES:
            after = LR.shift(stack, role)
            if after is not None and _merge(tops, after, cost + INSERT, audit + "I"):
                todo.append(after[0])
    return tops


def _edited(tops: dict, symbol: str) -> dict:
    """Tops after one row and inserts; ``symbol`` is its role's initial (``o``: another role, capital: cut short) or ``x`` (must go)."""
    out: dict = {}
    role, extra = symbol.lower(), CUT * symbol.isupper()
    for cost, audit, stack in tops.values():
        _merge(out, stack, cost + DELETE, audit + "D")
        if symbol == "x":
            continue
        kept = LR.shift(stack, role) if role != "o" else None
        if kept is not None:
            _merge(out, kept, cost + KEEP + extra, audit + "K")
        for new in ROLES:
            after = LR.shift(stack, new) if new != role else None
            if after is not None:
                _merge(out, after, cost + REROLE + extra, audit + "R")
    return _with_inserts(out)


def _tops() -> dict[int, tuple]:
    """One stack for each top that a parse may have between rows (left recursion keeps the stacks few)."""
    found, stacks = {}, [(0, None)]
    for stack in stacks:  # grows while it is read
        found.setdefault(stack[0], stack)
        for role in "sua":
            after = LR.shift(stack, role)
            if after is not None and after not in stacks:
                stacks.append(after)
    return found


TOPS = _tops()
Table = dict[tuple[int, int], tuple[int, str]]  # (top before, top after): (cost, audit)


@lru_cache(maxsize=1 << 15)
def _run(symbols: str) -> Table:
    out = {}
    for top, stack in TOPS.items():
        tops = _with_inserts({top: (0, "", stack)})
        for s in symbols:
            tops = _edited(tops, s)
        out.update({(top, after): best[:2] for after, best in tops.items()})
    return out


def _product(x: Table, y: Table) -> Table:
    out: Table = {}
    for (a, b), (cost, audit) in x.items():
        for to in TOPS:
            more = y.get((b, to))
            if more is not None:
                total = cost + more[0]
                old = out.get((a, to))
                if old is None or total < old[0] or (total == old[0] and audit + more[1] < old[1]):
                    out[a, to] = (total, audit + more[1])
    return out


def combine(tables: list[Table]) -> Table:
    """The table of runs one after another, by halves."""
    while len(tables) > 1:
        tables = [_product(*tables[k: k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return tables[0] if tables else _run("")


def run_table(symbols: str) -> Table:
    return combine([_run(symbols[k: k + RUN]) for k in range(0, len(symbols), RUN)])


def accepted(table: Table) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(best for (top, after), best in table.items() if top == 0 and after in LR.accepting)


class Replay:
    """Roles of an audit's turns: after an optional kept system turn, user and assistant take turns."""

    def __init__(self, made: int = 0, system: bool = False):
        self.made, self.system = made, system

    def turns(self, audit: str, symbols: str) -> list[tuple[str, str]]:
        out, row = [], 0
        for edit in audit:
            symbol = "" if edit == "I" else symbols[row].lower()
            row += edit != "I"
            if edit == "D":
                continue
            if not self.made and edit == "K" and symbol == "s":
                role, self.system = "s", True
            else:
                role = "ua"[(self.made - self.system) % 2]
            self.made += 1
            out.append((edit, role))
        return out


# ---------------------------------------------------------------- rows in order

def key_of(conv_id) -> F.Column:
    """A text key of a conversation id that tells null from any value."""
    return F.when(conv_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), conv_id.cast("string")))


def ordered_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, pos, turn, role, text, n, symbol, blank, duplicate, cut): distinct rows in order of ``pos``, with their copies ``n``."""
    src = rows.select(key_of(F.col(conv_id)).alias("key"), F.col(turn).try_cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    src = src.select("key", F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text")
    place = ["key", "timed", "turn", "role", "text"]
    # copies are counted before any sort, and the first row of each content is found without gathering a content's rows
    distinct = materialize(src.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "conv-rows")
    firsts = distinct.groupBy("key", "role", "text").agg(F.min(F.struct("timed", "turn")).alias("at"))
    firsts = firsts.select("key", F.col("at.timed").alias("timed"), F.col("at.turn").alias("turn"), "role", "text", F.lit(True).alias("first"))
    found = distinct.join(firsts, place, "left")
    blank = ~F.col("text").rlike(INK)
    first = F.coalesce("first", F.lit(False))
    cut = ~blank & first & ~F.col("text").rlike(ENDING)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = F.when(blank | ~first, "x").when(cut, F.upper(initial)).otherwise(initial)
    found = found.select(*place, "n", initial.alias("initial"), symbol.alias("symbol"), F.when(blank, F.col("n")).otherwise(0).alias("blank"),
                         F.when(blank, 0).when(first, F.col("n") - 1).otherwise(F.col("n")).alias("duplicate"), cut.cast("bigint").alias("cut"))
    found = found.repartitionByRange("key", "timed", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*place)
    out = materialize(found.withColumn("pos", F.monotonically_increasing_id()), "conv-order")
    discard(distinct)
    return out


_PIECE = ("key string, pos bigint, whole boolean, n_rows bigint, turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, "
          "blank bigint, duplicate bigint, truncated bigint, illegal bigint, symbols string, copies array<bigint>, froms array<int>, tos array<int>, costs array<bigint>, "
          "audits array<string>, repaired_sha256 string, roles array<string>, texts array<string>")
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]
_LEGAL = {"su", "ua", "au"}


def _pieces(batches, piece_rows: int, piece_bytes: int) -> Iterator[tuple[dict[str, list], bool]]:
    """Runs of rows of one conversation with neighbouring positions, and whether each is a whole conversation.

    A run is whole if rows of other conversations stand right before and right after it.
    """
    run: dict[str, list] | None = None
    before = False  # whether the run's first row follows another conversation's last one
    size = 0
    for batch in batches:
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        for k, (key, pos) in enumerate(zip(columns["key"], columns["pos"], strict=True)):
            next_to = run is not None and pos == run["pos"][-1] + 1
            if run is not None and not (next_to and key == run["key"][-1] and len(run["key"]) < piece_rows and size < piece_bytes):
                other = next_to and key != run["key"][-1]
                yield run, before and other
                before, run = other, None
            if run is None:
                run, size = {name: [] for name in columns}, 0
            for name, values in columns.items():
                run[name].append(values[k])
            size += len(columns["text"][k])
    if run is not None:
        yield run, False


def _symbols(run: dict[str, list]) -> str:
    """One symbol a row, copies included: those after a row's first must go."""
    return "".join(s + "x" * (n - 1) for s, n in zip(run["symbol"], run["n"], strict=True))


def _lines(roles: list[str], texts: list[str], copies: list[int], symbols: str, audit: str, replay: Replay) -> list[tuple[str, str]]:
    """(role, text) of the repaired turns of a run of rows, from its part of the audit."""
    row_of = [k for k, n in enumerate(copies) for _ in range(n)]
    made, row, out = iter(replay.turns(audit, symbols)), 0, []
    for edit in audit:
        if edit != "D":
            _, new = next(made)
            out.append((ROLES[new], "") if edit == "I" else (roles[row_of[row]] if edit == "K" else ROLES[new], texts[row_of[row]]))
        row += edit != "I"
    return out


def _digest(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def _summaries(keep_turns: bool, piece_rows: int, piece_bytes: int):
    def run_over(batches):
        rows: list[tuple] = []
        for run, whole in _pieces(batches, piece_rows, piece_bytes):
            symbols, initials = _symbols(run), run["initial"]
            illegal = sum(n - 1 for n in run["n"]) + sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:]))
            timed = [t for t, ok in zip(run["turn"], run["timed"], strict=True) if ok]
            table, sha, roles, texts = run_table(symbols), None, run["role"], run["text"]
            if whole:
                cost, audit = accepted(table)
                table = {(0, 0): (cost, audit)}
                lines = _lines(roles, texts, run["n"], symbols, audit, Replay())
                sha = _digest(lines)
                roles, texts = ([x for x, _ in lines], [x for _, x in lines]) if keep_turns else (None, None)
            entries = sorted(table.items())
            rows.append((run["key"][0], run["pos"][0], whole, len(symbols), len(set(timed)), min(timed, default=None), max(timed, default=None), initials[0], initials[-1],
                         sum(run["blank"]), sum(run["duplicate"]), sum(run["cut"]), illegal, None if whole else symbols, None if whole else run["n"],
                         [a for (a, _), _ in entries], [b for (_, b), _ in entries], [c for _, (c, _) in entries], [x for _, (_, x) in entries], sha, roles, texts))
            if len(rows) >= 1000 or len(symbols) > 4096 or not whole:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
    return run_over


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def _fields(ddl: str) -> pa.Schema:
    kind = lambda d: pa.list_(_ARROW[d[6:-1]]) if d.startswith("array") else _ARROW[d]
    return pa.schema([(name, kind(d)) for name, d in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str = _PIECE) -> pa.RecordBatch:
    schema = _fields(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """The audit's part for each piece: as many edits of rows as it has, with the inserts behind them (the first also has those before)."""
    marks = np.flatnonzero(np.frombuffer(audit.encode(), dtype=np.uint8) != ord("I"))
    starts = [0, *(int(marks[k]) if k < len(marks) else len(audit) for k in np.cumsum(sizes)[:-1])]
    return [audit[a:b] for a, b in zip(starts, [*starts[1:], len(audit)], strict=True)]


_JOINED = ("key string, pos bigint, turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "part string, made bigint, system boolean")


def _join_pieces(pieces: pa.Table) -> pa.Table:
    """One row a piece with its part of the audit; the first also has the conversation's counts, cost and audit."""
    p = pieces.sort_by("pos").to_pydict()
    tables = [dict(zip(zip(a, b), zip(c, s))) for a, b, c, s in zip(p["froms"], p["tos"], p["costs"], p["audits"], strict=True)]
    cost, audit = accepted(combine(tables))
    n = len(tables)
    joints = range(n - 1)
    illegal = sum(p["illegal"]) + sum(p["last_initial"][k] + p["first_initial"][k + 1] not in _LEGAL for k in joints)
    turns = sum(p["turns"]) - sum(p["last_turn"][k] is not None and p["last_turn"][k] == p["first_turn"][k + 1] for k in joints)
    timed = [t for t in p["first_turn"] + p["last_turn"] if t is not None]
    replay, rows = Replay(), []
    for k, part in enumerate(_cut_audit(audit, p["n_rows"])):
        head = (turns, min(timed, default=None), max(timed, default=None), *(sum(p[name]) for name in ("blank", "duplicate", "truncated")), illegal, cost, audit)
        rows.append((p["key"][k], p["pos"][k], *(head if k == 0 else [None] * len(head)), part, replay.made, replay.system))
        replay.turns(part, p["symbols"][k])
    return pa.Table.from_batches([_batch(rows, _JOINED)])


_TURNS = "key string, pos bigint, roles array<string>, texts array<string>"


def _repaired_pieces(batches):
    """The repaired turns of each piece."""
    for batch in batches:
        for p in batch.to_pylist():
            lines = _lines(p["roles"], p["texts"], p["copies"], p["symbols"], p["part"], Replay(p["made"], p["system"]))
            yield _batch([(p["key"], p["pos"], [x for x, _ in lines], [x for _, x in lines])], _TURNS)


def _stream_digests(batches):
    """The digest of each conversation of a stream of pieces sorted by (key, pos)."""
    key, h, empty = None, None, True
    for batch in batches:
        for k in range(batch.num_rows):
            p = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
            if p["key"] != key:
                if key is not None:
                    yield _batch([(key, h.hexdigest())], "key string, repaired_sha256 string")
                key, h, empty = p["key"], hashlib.sha256(), True
            for role, text in zip(p["roles"], p["texts"], strict=True):
                h.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
    if key is not None:
        yield _batch([(key, h.hexdigest())], "key string, repaired_sha256 string")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _gaps() -> F.Column:
    return F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")


class Repair:
    """The repair of a table of conversation rows: ``summary()`` and, with ``keep_turns``, ``turns()``."""

    def __init__(self, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_turns: bool = True,
                 piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES):
        self.id_type = rows.select(F.col(conv_id).alias("id")).dtypes[0][1]
        self.keep_turns = keep_turns
        ordered = ordered_rows(rows, conv_id, turn, role, text)
        self.pieces = materialize(ordered.mapInArrow(_summaries(keep_turns, piece_rows, piece_bytes), _PIECE), "conv-pieces")
        discard(ordered)
        parts = self.pieces.filter("not whole")
        self.joined = materialize(parts.drop("roles", "texts", "copies").groupBy("key").applyInArrow(_join_pieces, _JOINED), "conv-joined")
        own = self.joined.select("key", "pos", "part", "made", "system")
        # a piece's part meets its rows by its position, which no other piece has
        self.apart = parts.select("key", "pos", "roles", "texts", "copies", "symbols").join(own, ["key", "pos"]).mapInArrow(_repaired_pieces, _TURNS)

    def _id(self) -> F.Column:
        return F.when(F.col("key") != "0", F.substring("key", 2, 1 << 30)).cast(self.id_type).alias("conv_id")

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
        whole = self.pieces.filter("whole").select("key", _gaps(), *_COUNTS[1:5], F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "repaired_sha256")
        digests = self.apart.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_stream_digests, "key string, repaired_sha256 string")
        apart = self.joined.filter("audit is not null").select("key", _gaps(), *_COUNTS[1:], "audit").join(digests, "key")
        out = materialize(whole.unionByName(apart), "conv-repair")
        return out.select(self._id(), *_COUNTS, "audit", "repaired_sha256")

    def turns(self) -> DataFrame:
        """conv_id, pos, place, role and text of every turn of the repaired conversations, in order of (pos, place) within one."""
        if not self.keep_turns:
            raise ValueError("the repair was made without keep_turns")
        every = self.pieces.filter("whole").select("key", "pos", "roles", "texts").unionByName(self.apart)
        line = every.select("key", "pos", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "line"))
        return line.select(self._id(), "pos", "place", F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))

    def discard(self) -> None:
        """Deletes the tables that ``turns`` reads."""
        discard(self.pieces, self.joined)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost and audit, and the digest of the repaired turns."""
    repair = Repair(rows, conv_id, turn, role, text, keep_turns=False)
    out = repair.summary()
    repair.discard()
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with planted faults, by the checksum of their id and turn: a row is dropped, emptied,
    robbed of its sentence ends, repeated, or made a user's."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    src = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return src.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` with the repair of what ``damaged`` leaves of it; zeros and the empty text's digest where that is nothing."""
    found = repair_conversations(damaged(rows)).withColumn("key", key_of(F.col("conv_id"))).drop("conv_id")
    every = rows.select(F.col("conv_id")).distinct().withColumn("key", key_of(F.col("conv_id")))
    zero = [F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in _COUNTS]
    return every.join(found, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                                                   F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
