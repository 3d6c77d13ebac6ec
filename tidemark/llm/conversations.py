"""Conversation structure repair: the cheapest edits that make roles ``(s?(ua)+)?``, by rank-convergence parallel Viterbi.

A row is kept (0), given the role user or assistant (1) or deleted (2, which blank and duplicate rows have to be); a turn with an empty text
is inserted anywhere for 5; a truncated row that stays costs 5 more. The cost of what follows a row is a vector over four states
(nothing yet, after a system turn, after a user turn, after an assistant turn). It is computed backwards, so that tracing forwards
can choose, of all cheapest edits, the least letter each time.

1. Rows are ordered by conversation and turn over the whole table (range partitioning) and cut into *pieces* of at most ``PIECE_ROWS`` rows.
   A conversation that lies in one piece inside a partition is repaired where it is. All others, however large, are *open*:
2. A row is a duplicate if an earlier piece has its role and text: pieces send the keys of their own first ones, which meet by
   their least piece.
3. Every piece starts from a speculative cost vector, that of an end. What leaves a piece is a vector up to a constant (the shape); shapes
   that differ from the guess are put through all pieces again (fix-up), each only until its vectors differ from those of
   the first pass by a constant alone. There are few shapes, and rounds end when no new one leaves a piece.
4. Shapes are stitched from the last piece to the first, by looking up what a piece makes of a shape; then states from the
   first to the last. Both stream through a conversation's pieces in order, holding one number.
5. Each piece, with its shape and its state, traces its edits.

A step on shapes is a look-up in a table over (shape, class of a row) that is made once from the costs. Nothing goes to the driver but the set of
shapes. Pieces of a conversation are repaired in parallel; only its digest, a hash of the whole text, needs one task, which streams.

Defined results: null roles and texts are one space, whose initial is none of s, u, a; rows of one turn, of null turns too, which
come first, are in order of role and text (their first 64 characters, then a hash of both), so equal rows are neighbours; a null
conv_id is a conversation; an empty text is blank; long texts are kept whole, in pieces of about ``PIECE_BYTES`` bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import checkpoint

PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"

# Costs and states

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: Where a user turn, or behind one an assistant turn, leads to from each state, and which of both it is.
ON = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Where a kept row leads to, by its initial and the state.
KEPT = {(SYSTEM, 0): 1, (USER, 0): 2, (USER, 1): 2, (USER, 3): 2, (ASSISTANT, 2): 3}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What is inserted at the end of a conversation in each state.
LAST_INSERTS = ("", "II", "I", "")
#: Classes of rows: to be deleted, or 1 + 2 * initial + whether it is truncated.
N_CLASSES = 9


def _step(after: tuple[int, ...], kind: int) -> tuple[list[int], list[tuple[str, int]]]:
    """The vector before a row from the one after it, and for each state the edits up to and with the row and the state they lead to."""
    options: list[list[tuple[str, int, int]]] = []
    for q in range(4):
        own = [("D", DELETE + after[q], q)]
        if kind:
            initial, extra = (kind - 1) // 2, TRUNCATED * ((kind - 1) % 2)
            if (initial, q) in KEPT:
                own.append(("K", extra + after[KEPT[initial, q]], KEPT[initial, q]))
            own.append(("R", REROLE + extra + after[ON[q]], ON[q]))
        options.append(own)
    best = [min(c for _, c, _ in own) for own in options]
    for _ in range(2):  # two insertions lead to every state that insertions can reach
        best = [min(best[q], INSERT + best[ON[q]]) for q in range(4)]

    def edits(q: int) -> tuple[str, int]:
        tied = [(letter, to) for letter, c, to in options[q] if c == best[q]]
        if INSERT + best[ON[q]] == best[q]:
            tied.append(("I", ON[q]))
        letter, to = min(tied)
        if letter == "I":
            more, to = edits(to)
            return letter + more, to
        return letter, to

    return best, [edits(q) for q in range(4)]


def _shapes() -> tuple[list[tuple[int, ...]], list[bytes], list[list[list[tuple[str, int]]]]]:
    """All cost vectors up to a constant that an end can lead to; the next one by class of row; the edits by class and state."""
    end = tuple(INSERT * len(x) for x in LAST_INSERTS)
    shapes, to, edits = [end], [], []
    for shape in shapes:  # grows meanwhile
        row, how = [], []
        for kind in range(N_CLASSES):
            best, traced = _step(shape, kind)
            found = tuple(x - min(best) for x in best)
            if found not in shapes:
                shapes.append(found)
            row.append(shapes.index(found))
            how.append(traced)
        to.append(bytes(row))
        edits.append(how)
    return shapes, to, edits


SHAPES, TO, EDITS = _shapes()
END = 0  # the shape behind the last row


def shapes_of(classes: bytes, shape: int) -> bytearray:
    """The shape before each row of a piece and, last, the one behind it."""
    path = bytearray(len(classes) + 1)
    path[-1] = shape
    for i in range(len(classes) - 1, -1, -1):
        shape = TO[shape][classes[i]]
        path[i] = shape
    return path


def fixed_up(classes: bytes, guess: bytes, shape: int) -> int:
    """What leaves a piece that shape reaches; it is followed only until it meets the path of the guess."""
    for i in range(len(classes), -1, -1):
        if i < len(classes):
            shape = TO[shape][classes[i]]
        if shape == guess[i]:
            return guess[0]
    return shape


def traced(classes: bytes, path: bytes, state: int) -> tuple[list[str], int]:
    """The edits for each row of a piece, and the state behind them."""
    out = []
    for i, kind in enumerate(classes):
        edits, state = EDITS[path[i + 1]][kind][state]
        out.append(edits)
    return out, state


# Rows


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with known damage by crc32 of "conv_id:turn": dropped, emptied, without [.!?], repeated, or of role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with their code (initial + 4 if truncated + 8 if blank) and the key of role and text, in order."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"))
    said = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    code = initial + F.when(said == "", 8).when(F.substring(said, -1, 1).isin(".", "!", "?"), 0).otherwise(4)
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    # equal rows can be told apart by salt alone, so a crowd of them is spread over several partitions
    rows = rows.withColumns({"code": code.cast("int"), "same": same, "salt": F.xxhash64(F.monotonically_increasing_id())})
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "same", "salt"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")


def cut(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, piece, open, turns, roles, texts, codes, sames): rows in order, in pieces that are numbered in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, begun = TaskContext.get().partitionId() << 32, None, True  # begun: elsewhere or in an earlier piece

        def pieces(b: pa.RecordBatch, bounds: list[int], is_open: list[bool]) -> pa.RecordBatch:
            nonlocal number
            listed = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), b.column(i)) for i in (1, 2, 3, 4, 5)]
            numbers = pa.array(range(number, number + len(is_open)), pa.int64())
            number += len(is_open)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(bounds[:-1], pa.int64())), numbers, pa.array(is_open, pa.bool_()), *listed], ["conv_id", "piece", "open", "turns", "roles", "texts", "codes", "sames"])

        for b in batches:
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            keys = b.column(0).to_pylist()
            begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            upto = np.r_[0, np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64))]
            bounds, is_open = [0], []
            for begin, end in zip(begins, [*begins[1:], len(keys)], strict=True):
                whole, split = end < len(keys), begun
                while True:
                    stop = min(end, begin + piece_rows, max(begin + 1, int(np.searchsorted(upto, upto[begin] + piece_bytes, side="right")) - 1))
                    if stop == end and not whole:  # goes on, perhaps, in the next batch
                        break
                    split = split or stop < end
                    bounds.append(stop)
                    is_open.append(split)
                    begin = stop
                    if begin == end:
                        break
                begun = split and not whole
            if is_open:
                yield pieces(b.slice(0, bounds[-1]), bounds, is_open)
            held = b.slice(bounds[-1])
        if held is not None and held.num_rows:
            yield pieces(held, [0, held.num_rows], [True])  # it may go on in the next partition

    return _sorted(rows).mapInArrow(run, f"conv_id {kind}, piece long, open boolean, turns array<long>, roles array<string>, texts array<string>, codes array<int>, sames array<binary>")


class Facts:
    """What a piece's rows are: faults, classes, and what its neighbours need to know."""

    def __init__(self, turns: list, codes: list[int], sames: list[bytes], again: set[bytes]):
        seen, classes = set(again), bytearray()
        self.blank = self.duplicate = self.truncated = 0
        self.keys = []
        for code, same in zip(codes, sames, strict=True):
            if code & 8:
                self.blank += 1
                classes.append(0)
            elif same in seen:
                self.duplicate += 1
                classes.append(0)
            else:
                seen.add(same)
                self.keys.append(same)
                self.truncated += code >> 2
                classes.append(1 + 2 * (code & 3) + (code >> 2))
        self.classes = bytes(classes)
        initials = [c & 3 for c in codes]
        self.illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
        self.ends = [initials[0], initials[-1]]
        known = [t for t in turns if t is not None]  # in order
        self.span = [known[0], known[-1], len(set(known))] if known else None

    def row(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "ends": self.ends, "span": self.span}


FACTS = "blank long, duplicate long, truncated long, illegal long, ends array<int>, span array<long>"
REPAIRED = f"piece long, open boolean, {FACTS}, cost long, audit string, roles array<string>, texts array<string>"
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], KINDS[k]) for n, k in fields], [n for n, _ in fields])


def _each(df: DataFrame, fn: Callable[[dict], dict], schema: str, key: str | None = None) -> DataFrame:
    """fn of each row; the column key goes along as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                out = _batch([fn(r) for r in b.to_pylist()], schema)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(key)), *out.columns], [key, *out.schema.names]) if key else out

    return df.mapInArrow(run, (f"{key} {df.schema[key].dataType.simpleString()}, " if key else "") + schema)


def _apply(facts: dict, classes: bytes, path: bytes, state: int, last: bool, roles: list[str], texts: list[str]) -> dict:
    """A piece's repaired turns with their edits and costs."""
    steps, end = traced(classes, path, state)
    out_roles, out_texts, cost = [], [], 0
    for edits, kind, role, text in zip(steps, classes, roles, texts, strict=True):
        for letter in edits:
            if letter == "D":
                cost += DELETE
                continue
            out_roles.append(role if letter == "K" else ROLE[state])
            out_texts.append("" if letter == "I" else text)
            cost += {"K": 0, "R": REROLE, "I": INSERT}[letter]
            if letter != "I" and kind:
                cost += TRUNCATED * ((kind - 1) % 2)
            state = KEPT[(kind - 1) // 2, state] if letter == "K" else ON[state]
    audit = "".join(steps)
    for _ in LAST_INSERTS[end] if last else "":
        out_roles.append(ROLE[end])
        out_texts.append("")
        cost, audit, end = cost + INSERT, audit + "I", ON[end]
    return facts | {"cost": cost, "audit": audit, "roles": out_roles, "texts": out_texts}


def _closed(r: dict) -> dict:
    facts = Facts(r["turns"], r["codes"], r["sames"], set())
    return _apply(facts.row() | {"piece": r["piece"], "open": False}, facts.classes, shapes_of(facts.classes, END), 0, True, r["roles"], r["texts"])


def _in_order(df: DataFrame, *order, fn: Callable[[dict, object], tuple[dict, object]], schema: str) -> DataFrame:
    """fn goes through the pieces of each conversation in order with what it kept of the one before; None at the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, kept = None, None
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                out = []
                for r in whole.slice(begin, 1024).to_pylist():
                    made, kept = fn(r, kept if r["conv"] == conv else None)
                    conv = r["conv"]
                    out.append(made)
                yield _batch(out, schema)

    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)


def _open(pieces: DataFrame) -> DataFrame:
    """REPAIRED rows of the open pieces."""
    pieces = pieces.withColumn("conv", F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("")))
    slim = pieces.select("conv", "piece", "turns", "codes", "sames")
    own = _each(slim, lambda r: {"piece": r["piece"], "keys": Facts(r["turns"], r["codes"], r["sames"], set()).keys}, "piece long, keys array<binary>", "conv").select("conv", "piece", F.explode("keys").alias("same"))
    firsts = own.groupBy("conv", "same").agg(F.min("piece").alias("first"), F.max("piece").alias("last")).where("first < last").drop("last")
    again = own.join(firsts, ["conv", "same"]).where("piece > first").groupBy("piece").agg(F.collect_list("same").alias("again"))  # of one piece's rows

    def guess(r: dict) -> dict:
        facts = Facts(r["turns"], r["codes"], r["sames"], set(r["again"] or ()))
        path = shapes_of(facts.classes, END)
        return facts.row() | {"piece": r["piece"], "classes": facts.classes, "path": bytes(path), "left": [END, path[0]]}

    known = checkpoint(_each(slim.join(again, "piece", "left"), guess, f"piece long, {FACTS}, classes binary, path binary, left array<int>", "conv"))
    done = {END}
    while new := {r[0] for r in known.select(F.explode(F.expr("filter(left, (x, i) -> i % 2 = 1)"))).distinct().collect()} - done:  # len(SHAPES) numbers at most
        done |= new
        fix = lambda r, new=sorted(new): r | {"left": r["left"] + [x for n in new for x in (n, fixed_up(r["classes"], r["path"], n))]}
        known = checkpoint(_each(known, fix, f"piece long, {FACTS}, classes binary, path binary, left array<int>", "conv"))

    def arrive(r: dict, shape: int | None) -> tuple[dict, int]:
        reached = END if shape is None else shape
        return {"piece": r["piece"], "reached": reached, "last": shape is None}, dict(zip(r["left"][::2], r["left"][1::2], strict=True))[reached]

    arrivals = _in_order(known.select("conv", "piece", "left"), F.desc("piece"), fn=arrive, schema="piece long, reached int, last boolean")

    def exits(r: dict) -> dict:
        path = shapes_of(r["classes"], r["reached"])
        return r | {"path": bytes(path), "exits": [traced(r["classes"], path, q)[1] for q in range(4)]}

    paths = checkpoint(_each(known.select("conv", "piece", "classes").join(arrivals, "piece"), exits, "piece long, last boolean, classes binary, path binary, exits array<int>", "conv"))

    def enter(r: dict, state: int | None) -> tuple[dict, int]:
        return {"piece": r["piece"], "state": state or 0}, r["exits"][state or 0]

    states = _in_order(paths.select("conv", "piece", "exits"), "piece", fn=enter, schema="piece long, state int")
    ready = known.drop("conv", "classes", "path", "left").join(paths.drop("conv", "exits"), "piece").join(states, "piece")
    facts = [x.split(" ")[0] for x in FACTS.split(", ")]
    apply = lambda r: _apply({k: r[k] for k in ("piece", "open", *facts)}, r["classes"], r["path"], r["state"], r["last"], r["roles"], r["texts"])
    return _each(pieces.select("conv_id", "piece", "open", "roles", "texts").join(ready, "piece"), apply, REPAIRED, "conv_id")


def repair(pieces: DataFrame) -> DataFrame:
    """(conv_id, ...REPAIRED): each piece's faults, edits, cost and repaired turns, from what cut made, stored."""
    closed = _each(pieces.where("not open"), _closed, REPAIRED, "conv_id")
    return closed.unionByName(_open(pieces.where("open")))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Report:
    """Sums a conversation's pieces in order; audits and texts stream into a list and a hash."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.span, self.before, self.audit, self.hash, self.empty = None, None, [], hashlib.sha256(), True

    def add(self, r: dict) -> Report:
        for k in self.sums:
            self.sums[k] += r[k]
        if self.before is not None and (self.before, r["ends"][0]) not in LEGAL:
            self.sums["illegal"] += 1
        self.before = r["ends"][1]
        if r["span"]:
            lo, hi, n = r["span"]
            self.span = [lo, hi, n] if self.span is None else [self.span[0], hi, self.span[2] + n - (self.span[1] == lo)]
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"], strict=True):
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False
        return self

    def row(self) -> dict:
        gaps = self.span[1] - self.span[0] + 1 - self.span[2] if self.span else 0
        return self.sums | {"gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def report(repaired: DataFrame) -> DataFrame:
    """(conv_id, ...REPORT): a row for each conversation."""
    closed = _each(repaired.where("not open"), lambda r: Report().add(r).row(), REPORT, "conv_id")
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(conv_id: pa.Array, of: Report) -> pa.RecordBatch:
            out = _batch([of.row()], REPORT)
            return pa.RecordBatch.from_arrays([conv_id, *out.columns], ["conv_id", *out.schema.names])

        key, of = None, None
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                if of is not None and b.column(0) != key:
                    yield made(key, of)
                    of = None
                key, of = b.column(0), (of or Report()).add(b.to_pylist()[0])
        if of is not None:
            yield made(key, of)

    # the digest of a whole text can't be put together from parts: one task streams through a conversation's pieces
    streamed = repaired.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return closed.unionByName(streamed.mapInArrow(run, f"conv_id {kind}, {REPORT}"))
