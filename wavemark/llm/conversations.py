"""Conversations brought back into shape at the least cost.

A conversation is a chain of turns. Weighted finite-state machines say what repairing it costs: an
acceptor of its turns as they are, a transducer of one state that keeps, reroles, deletes or inserts
turns at a price, and an acceptor of the roles that a sound conversation has. Their composition is
made lazily, place by place, and its shortest path is the repair. Weights are (cost, labels), least
cost first and then the least string of labels; as equally dear paths between two states never have
labels of which one begins the other, such weights may be put together in any grouping.

That is what makes it scale. Turns, without their texts, are sorted in ranges over tasks, wherever
conversations begin and end; each stretch of a conversation becomes a small matrix, the best path
from each role state before it to each after it, and a conversation is the product of its matrices.
No task holds a conversation's turns. Then every stretch knows its own labels, and turns that stay
are joined with their texts by key.

Equal turns (same conversation, turn number, role and text) are counted before anything moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written_table

#: Turns of a stretch, at most (equal turns count once).
STRETCH = 4096
SPACE = " \t\n\x0b\f\r"

# The price list, and the roles of a sound conversation, (s?(ua)+)?, by their first letters.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GRAMMAR = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
FINAL = (START, AFTER_ASSISTANT)
LEGAL = {"su", "ua", "au"}

#: A turn that must go. Other symbols are the first letter of a legal role, or OTHER; capital letters: truncated.
GONE, OTHER = "-", "x"


class Arc(NamedTuple):
    """An arc of the edit transducer: its label, its price and the role that comes out, if any."""

    label: str
    cost: int
    out: str | None


INSERTS = tuple(Arc("I", INSERT, r) for r in "ua")


@lru_cache(None)
def arcs(symbol: str) -> tuple[Arc, ...]:
    """What the edit transducer may do with a turn."""
    if symbol == GONE:
        return (Arc("D", DELETE, None),)
    extra = TRUNCATED if symbol.isupper() else 0
    keep = (Arc("K", extra, symbol.lower()),) if symbol.lower() in ROLES else ()
    return (*keep, *(Arc("R", REROLE + extra, r) for r in "ua"), Arc("D", DELETE, None))


Weight = tuple[int, str]


def _relaxed(layer: dict[int, Weight], options: tuple[Arc, ...], onto: dict[int, Weight]) -> dict[int, Weight]:
    """``onto`` with the states that one of the arcs leads to from a layer of the composition."""
    for state, (cost, labels) in layer.items():
        for arc in options:
            after = state if arc.out is None else GRAMMAR.get((state, arc.out))
            if after is not None:
                weight = (cost + arc.cost, labels + arc.label)
                if after not in onto or weight < onto[after]:
                    onto[after] = weight
    return onto


def _with_inserts(layer: dict[int, Weight]) -> dict[int, Weight]:
    """The layer after insertions. More than two in a row come back to a state, for a price."""
    for _ in range(2):
        layer = _relaxed(dict(layer), INSERTS, layer)
    return layer


def best_paths(symbols: str, start: int) -> dict[int, Weight]:
    """The least weight from ``start`` to each state that the grammar can be in after the symbols."""
    layer = _with_inserts({start: (0, "")})
    for symbol in symbols:
        layer = _with_inserts(_relaxed(layer, arcs(symbol), {}))
    return layer


_remembered = lru_cache(1 << 15)(best_paths)


def outputs(labels: str, symbols: str, state: int) -> Iterator[tuple[str, int | None, str]]:
    """What labels make of a stretch entered in ``state``: label, place of the turn (None for an
    inserted one) and first letter of the role, of each turn that comes out. The grammar leaves no
    choice: a kept turn has its own role, after any state only one of the others is legal."""
    at = 0
    for label in labels:
        if label != "D":
            out = symbols[at].lower() if label == "K" else next(r for r in "ua" if (state, r) in GRAMMAR)
            yield label, None if label == "I" else at, out
            state = GRAMMAR[state, out]
        at += label != "I"


def first_letter(role: str) -> str:
    return role[:1] if role[:1] in ROLES else OTHER


class _Stretch:
    """Consecutive turns of a conversation, as they come in."""

    def __init__(self, conv: int | None, opens: bool):
        self.conv, self.opens, self.symbols, self.rows, self.records = conv, opens, [], [], 0
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = self.low = self.high = None

    def add(self, turn: int | None, role: str, key: bytes, blank: bool, truncated: bool, repeated: bool, n: int) -> None:
        letter, stays = first_letter(role), not (blank or repeated)
        if stays:
            self.rows.append({"at": self.size, "turn": turn, "role": role, "key": key})
            symbol = letter.upper() if truncated else letter
            self.symbols.append(symbol + GONE * (n - 1))
            self.truncated += truncated
            self.duplicate += n - 1
        else:
            self.symbols.append(GONE * n)
            self.blank += n * blank
            self.duplicate += n * (not blank)
        if self.last_role is not None and self.last_role + letter not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.first_role, self.last_role = self.first_role or letter, letter
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.size, self.records = self.size + n, self.records + 1

    def record(self, order: int) -> dict:
        symbols = "".join(self.symbols)
        solve = _remembered if len(symbols) <= 64 else best_paths
        starts = (START,) if self.opens else range(4)
        paths = [{"before": p, "after": q, "cost": cost, "labels": labels} for p in starts for q, (cost, labels) in solve(symbols, p).items()]
        names = ("conv", "blank", "duplicate", "truncated", "illegal", "turns", "first_role", "last_role", "low", "high", "rows")
        return {"part": order, "symbols": symbols, "paths": paths} | {k: getattr(self, k) for k in names}


_ROWS = "array<struct<at:long,turn:long,role:string,key:binary>>"
_COUNTS = "conv long, part long, blank long, duplicate long, truncated long, illegal long, turns long, first_role string, last_role string, low long, high long"
STRETCHES = f"{_COUNTS}, symbols string, rows {_ROWS}, paths array<struct<before:int,after:int,cost:long,labels:string>>"
_ARROW_ROW = pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary())])
_ARROW_PATH = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv", "part", "blank", "duplicate", "truncated", "illegal", "turns")]
    + [("first_role", pa.string()), ("last_role", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("symbols", pa.string()), ("rows", pa.list_(_ARROW_ROW)), ("paths", pa.list_(_ARROW_PATH))]
)


def _slices(rows: Iterator[dict], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == most:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _stretches(turns: DataFrame, stretch: int) -> DataFrame:
    """Turns, sorted in ranges, as stretches; ``part`` rises with the order."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        order, own = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "key", "blank", "truncated", "repeated", "n")), strict=True):
                if own is None or own.conv != conv or own.records >= stretch:
                    opens = own is not None and own.conv != conv  # the range may have cut the first one
                    if own is not None:
                        yield own.record(order)
                        order += 1
                    own = _Stretch(conv, opens)
                own.add(*turn)
        if own is not None:
            yield own.record(order)

    sorted_turns = turns.repartitionByRange("conv", "turn", "role", "key").sortWithinPartitions("conv", "turn", "role", "key")
    return sorted_turns.mapInArrow(lambda batches: _slices(records(batches), _ARROW), STRETCHES)


class _Whole:
    """The product of a conversation's matrices, taken from its first stretch on: of each state the
    weight, and the states and labels of the stretches that lead there."""

    def __init__(self, conv: int | None):
        self.conv, self.ends, self.last_role, self.high, self.low = conv, {START: ((0, ""), None)}, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def add(self, s: dict) -> None:
        ends: dict = {}
        for path in s["paths"]:
            if path["before"] in self.ends:
                (cost, labels), way = self.ends[path["before"]]
                weight = (cost + path["cost"], labels + path["labels"])
                if path["after"] not in ends or weight < ends[path["after"]][0]:
                    ends[path["after"]] = weight, (way, s["part"], path["before"], path["labels"])
        self.ends = ends
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + s[c])
        if self.last_role is not None and self.last_role + s["first_role"] not in LEGAL:
            self.illegal += 1
        self.last_role = s["last_role"]
        if s["low"] is not None:
            self.turns -= s["low"] == self.high
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]

    def record(self) -> dict:
        (cost, audit), way = min((v for q, v in self.ends.items() if q in FINAL), key=lambda v: v[0])
        parts, place = [], len(audit) - audit.count("D")
        while way is not None:
            way, part, state, labels = way
            place -= len(labels) - labels.count("D")
            parts.append({"part": part, "state": state, "labels": labels, "place": place})
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "parts": parts}


_WHOLE = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<part:long,state:int,labels:string,place:long>>"
_ARROW_WHOLE = pa.schema(
    [(c, pa.int64()) for c in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int64()), ("state", pa.int32()), ("labels", pa.string()), ("place", pa.int64())])))]
)


def _composed(stretches: DataFrame) -> DataFrame:
    """A row for each conversation. A task meets a conversation's matrices one after another; what
    it holds are its four best paths, of a character for each turn, like the audit itself."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = None
        for batch in batches:
            for at in range(batch.num_rows):
                (s,) = batch.slice(at, 1).to_pylist()
                if own is None or own.conv != s["conv"]:
                    if own is not None:
                        yield own.record()
                    own = _Whole(s["conv"])
                own.add(s)
        if own is not None:
            yield own.record()

    ordered = stretches.drop("rows", "symbols").repartition("conv").sortWithinPartitions("conv", "part")
    return ordered.mapInArrow(lambda batches: _slices(records(batches), _ARROW_WHOLE, 256), _WHOLE)


_EDITS = "conv long, place long, edit string, turn long, role string, key binary"
_ARROW_EDITS = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary())])


def _edits(stretches: DataFrame, whole: DataFrame) -> DataFrame:
    """A row for each turn that comes out, with the key of its text (null for inserted ones)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                (s,) = batch.slice(at, 1).to_pylist()
                rows = {r["at"]: r for r in s["rows"]}
                for i, (label, place, letter) in enumerate(outputs(s["labels"], s["symbols"], s["state"])):
                    own = rows[place] if place is not None else {"turn": None, "role": None, "key": None}
                    yield {"conv": s["conv"], "place": s["place"] + i, "edit": label, "turn": own["turn"], "role": own["role"] if label == "K" else ROLES[letter], "key": own["key"]}

    chosen = whole.select(F.explode("parts").alias("p")).select("p.*")
    joined = stretches.select("conv", "part", "symbols", "rows").join(chosen, "part")
    return joined.mapInArrow(lambda batches: _slices(records(batches), _ARROW_EDITS, 8192), _EDITS)


class Repair(NamedTuple):
    """``audits``: a row for each conversation. ``turns``: a row for each repaired turn."""

    audits: DataFrame
    turns: DataFrame


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that tell turns of a conversation apart by role and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary")))


def repair_conversations(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> Repair:
    """The cheapest repair of each conversation of ``df``.

    ``audits``: ``conv_id``, ``gaps`` (turn numbers missing between the least and the greatest),
    ``blank``, ``duplicate``, ``truncated`` (turns by their first fault), ``illegal`` (neighbours
    whose roles do not follow one another), ``cost`` and ``audit``, the edits' first letters.
    ``turns``: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``turn`` (null if inserted),
    ``role`` and ``text``.

    Turns stand by number, nulls first; ties by role, then by a hash of role and text, so that the
    order of rows in files does not matter. A null role or text counts as one space; rows without
    an id are one conversation. Blank turns and turns whose role and text came before must go; a
    turn that does not end in ``.``, ``!`` or ``?`` costs more to keep. Roles count by their first
    letter; an empty role, like any other, can only be changed or go. Other columns are not read.
    An empty table gives no rows. A conversation has at most 2^31 turns, as its audit is a string."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    plain = df.select(df[id_col].cast("long").alias("conv"), df[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keyed = plain.withColumn("key", turn_key(F.col("role"), F.col("text")))
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    light = keyed.select("conv", "turn", "role", "key", (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    counted = written_table(light.groupBy(*light.columns).agg(F.count("*").alias("n")), "turns")
    said = F.struct("conv", "key").alias("said")
    first = counted.groupBy(said).agg(F.min(F.struct("turn")).alias("first"))
    marked = counted.withColumn("said", said).join(first, "said").withColumn("repeated", F.struct("turn") != F.col("first")).drop("said", "first")
    stretches = written_table(_stretches(written_table(marked, "marked-turns"), stretch), "stretches")
    whole = written_table(_composed(stretches), "repairs")

    edits = written_table(_edits(stretches, whole), "edits")
    own = F.struct("conv", "turn", "key").alias("own")
    texts = keyed.select(own, "text").groupBy("own").agg(F.first("text").alias("text"))
    kept = edits.where("key is not null").withColumn("own", own).join(texts, "own").select(F.col("conv").alias("conv_id"), "place", "edit", "turn", "role", "text")
    added = edits.where("key is null").select(F.col("conv").alias("conv_id"), "place", "edit", "turn", "role", F.lit("").alias("text"))
    return Repair(whole.drop("parts").withColumnRenamed("conv", "conv_id"), kept.union(added))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` (lowercase hex) of the repaired turns as ``role:text``, joined by
    line ends. A task reads its conversations turn by turn and holds a hash's state; this kind of
    hash can be continued only in order, so one conversation is one task's work."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, state = None, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv.as_py() != own:
                    if state is not None:
                        yield {"conv_id": own, "sha256": state.hexdigest()}
                    own, state = conv.as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role.as_buffer() or b"")
                state.update(b":")
                state.update(text.as_buffer() or b"")
        if state is not None:
            yield {"conv_id": own, "sha256": state.hexdigest()}

    ordered = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(lambda batches: _slices(records(batches), schema), "conv_id long, sha256 string")
