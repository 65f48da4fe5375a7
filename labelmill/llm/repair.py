"""Cheapest repairs of damaged conversations, by an automaton that shares suffixes.

A conversation is valid if the initials of its roles spell ``(s?(ua)+)?``.  Each
row is one symbol: whether it has to go, else its initial and whether it is cut
off.  A conversation's symbols are its signature, and what the best repair of
the rest costs depends on nothing but that rest and the grammar state before it.

So the distinct signatures, sorted from their ends, form an acyclic automaton
in which equal suffixes are one node.  A task walks its range of the sorted
signatures with a stack of open nodes: what a signature shares with the one
before it stays, and only new nodes get their cost-to-go and first edit, for
every grammar state.  Nodes whose costs differ alike between the states repair
alike, so those vectors are minimised once more and looked up.  The best audit
is read along the edges, of any number of conversations with that signature.

Equal costs are decided by the first letter: the edits that are possible at one
node and state all have different letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import SPACE
from labelmill.operators.scale import cut_lineage, join_by_key

#: Grammar states: at the start, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The initial that comes next in each state (at the start ``s`` may as well), the state after it, and where a conversation may end.
NEEDED = ("u", "u", "a", "u")
AFTER = (USER, USER, ASSISTANT, USER)
ENDS = (True, False, False, True)
ROLES = {"u": "user", "a": "assistant"}

#: What the edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Symbol of a row that has to be deleted, and of one whose initial the grammar does not have.
GONE, OTHER = "x", "o"

_STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
_PLANS = "signature string, n long, cost long, audit string"
_TURNS = "conv_id long, place long, edit string, role string, text string"
_DIGESTS = "conv_id long, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` of turns after a rule of damage by a hash of ``conv_id:turn``.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes out its
    ``[.!?]``, 3 repeats it, 4 makes its role ``user``.  Null texts, roles and
    parts of the hashed key are one space.  Dropped rows stay, marked ``gone``,
    so that no conversation is lost.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _prints() -> list[Column]:
    """Two hashes that tell roles with texts apart; rows of one turn are in their order."""
    return [F.xxhash64("role", "text").alias("f1"), F.xxhash64(F.lit(1), "role", "text").alias("f2")]


def statistics(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, signature``.

    ``rows`` are those of :func:`damaged`.  Rows come by turn, nulls first,
    and rows of one turn by a hash of role and text.  Only hashes, initials and
    faults are shuffled, once; repeats are found by a second sort in place.
    A conversation's rows stream through one task, which keeps a character for
    each.  A null ``conv_id`` is one conversation.
    """
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    marked = rows.select(
        "conv_id", "turn", "gone", F.substring("role", 1, 1).alias("initial"), *_prints(),
        F.when(end == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0).alias("fault"),
    ).repartition("conv_id")
    by = [F.col("turn").asc_nulls_first(), "f1", "f2"]
    # The rows of a key are already in one partition, so this sorts and does not shuffle.
    seen = F.row_number().over(_window(["conv_id", "gone", "f1", "f2"], by)) > 1
    faulty = marked.withColumn("fault", F.when(F.col("fault") == 1, 1).when(seen, 2).otherwise(F.col("fault")).cast("byte"))
    return faulty.select("conv_id", "turn", "gone", "initial", "fault", "f1", "f2").sortWithinPartitions("conv_id", *by).select(
        "conv_id", "turn", "gone", "initial", "fault").mapInArrow(_signatures, _STATS)


def _window(keys: list[str], order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


class _Counts:
    """Faults and signature of one conversation, row by row."""

    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.symbols: list[str] = []
        self.illegal = self.distinct = 0
        self.before = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        known = initial if initial and initial in "sua" else OTHER
        self.symbols.append(GONE if fault in (1, 2) else known.upper() if fault == 3 else known)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.faults[1:], self.illegal, "".join(self.symbols)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, counts = None, None
    for batch in batches:
        done = []
        for conv_id, turn, gone, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if counts is None or conv_id != now:
                if counts is not None:
                    done.append((now, *counts.row()))
                now, counts = conv_id, _Counts()
            if not gone:
                counts.add(turn, initial, fault)
        yield _batch(done, _STATS)
    if counts is not None:
        yield _batch([(now, *counts.row())], _STATS)


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


class Automaton:
    """The nodes of one suffix, from its end, with cost-to-go and first edit for every grammar state.

    ``paths[k]`` is the node of the last ``k`` symbols: its edits, its costs
    above the least, and that least cost.
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        costs, edits = self._inserted([0 if end else None for end in ENDS], [""] * 4)
        self.symbols: list[str] = []
        self.paths = [(edits, *self._relative(costs))]

    @staticmethod
    def _relative(costs: list[int]) -> tuple[tuple[int, ...], int]:
        least = min(costs)
        return tuple(c - least for c in costs), least

    @staticmethod
    def _inserted(costs: list[int | None], edits: list[str]) -> tuple[list[int], tuple[str, ...]]:
        """Inserting leads to another state at the same node; two in a row may pay, more never do."""
        for _ in range(3):
            for state, after in enumerate(AFTER):
                if costs[after] is not None and (costs[state] is None or (costs[after] + INSERT, "I") < (costs[state], edits[state])):
                    costs[state], edits[state] = costs[after] + INSERT, "I"
        return costs, tuple(edits)

    def _node(self, symbol: str, below: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[int, ...], int]:
        """A node over one whose costs are known up to a constant; equal ones are found once."""
        if (symbol, below) not in self.known:
            costs, edits = [], []
            cut = TRUNCATED if symbol.isupper() else 0
            for state in range(4):
                able = [(DELETE + below[state], "D")]
                if symbol != GONE:
                    able.append((REROLE + cut + below[AFTER[state]], "R"))
                    to = kept_state(state, symbol.lower())
                    if to is not None:
                        able.append((KEEP + cut + below[to], "K"))
                cost, edit = min(able)
                costs.append(cost)
                edits.append(edit)
            costs, letters = self._inserted(costs, edits)
            self.known[symbol, below] = letters, *self._relative(costs)
        return self.known[symbol, below]

    def open(self, signature: str) -> None:
        """Make this signature's nodes the open ones; those that it shares with the last one stay."""
        symbols = signature[::-1]
        shared = 0
        for a, b in zip(self.symbols, symbols):
            if a != b:
                break
            shared += 1
        del self.paths[shared + 1:]
        self.symbols = list(symbols)
        for symbol in symbols[shared:]:
            _, below, cost = self.paths[-1]
            edits, above, more = self._node(symbol, below)
            self.paths.append((edits, above, cost + more))

    def best(self) -> tuple[int, str]:
        """Cost and audit of the open signature, from the start state."""
        _, above, least = self.paths[-1]
        audit, state, k = [], START, len(self.paths) - 1
        while True:
            edit = self.paths[k][0][state]
            if not edit:
                return least + above[START], "".join(audit)
            audit.append(edit)
            if edit == "K":
                state = kept_state(state, self.symbols[k - 1].lower())
            elif edit != "D":
                state = AFTER[state]
            k -= edit != "I"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn of this initial, or none where the grammar has no such turn."""
    if initial == NEEDED[state]:
        return AFTER[state]
    return SYSTEM if initial == "s" and state == START else None


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = Automaton()
    for batch in batches:
        out = []
        for signature, n in zip(*(c.to_pylist() for c in batch.columns)):
            nodes.open(signature)
            out.append((signature, n, *nodes.best()))
        yield _batch(out, _PLANS)


def plans(signatures: DataFrame) -> DataFrame:
    """``signature, n, cost, audit`` of every distinct ``signature``; ``n`` is how many rows have it.

    Signatures are counted before they move, then dealt into ranges of their
    reversed strings: a range has every signature once, however common it is.
    """
    distinct = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    backwards = F.reverse("signature")
    return distinct.repartitionByRange(n, backwards).sortWithinPartitions(backwards).mapInArrow(_planned, _PLANS)


def planned(stats: DataFrame) -> DataFrame:
    """Rows of :func:`statistics` with ``cost`` and ``audit``."""
    by_signature = cut_lineage(plans(stats))
    return join_by_key(stats, by_signature, "signature", "n").drop("n")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, audit, at, state, place = None, "", 0, START, 0
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((now, place, "I", ROLES[NEEDED[state]], ""))
                at, state, place = at + 1, AFTER[state], place + 1

        for conv_id, plan, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if plan is not None:
                now, audit, at, state, place = conv_id, plan, 0, START, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    role, after = (role, kept_state(state, role[:1])) if edit == "K" else (ROLES[NEEDED[state]], AFTER[state])
                    out.append((now, place, edit, role, text))
                    state, place = after, place + 1
            insert()
        yield _batch(out, _TURNS)


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: what is left of every conversation after the edits of its ``audit``.

    Rows of a conversation are together and in order.  They stream through one
    task behind their audit, so texts of any number take the memory of one batch.
    """
    header = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("f1"),
                           F.lit(0).cast("long").alias("f2"), F.col("audit").alias("plan"), F.lit("").alias("role"), F.lit("").alias("text"))
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", *_prints(), F.lit(None).cast("string").alias("plan"), "role", "text")
    ordered = header.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "f1", "f2")
    return ordered.select("conv_id", "plan", "role", "text").mapInArrow(_repaired, _TURNS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        done = []
        for conv_id, place, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or place == 0:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = conv_id, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield _batch(done, _DIGESTS)
    if digest is not None:
        yield _batch([(now, digest.hexdigest())], _DIGESTS)


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and the letters of its cheapest repair, and a digest of the result.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.  A conversation without rows after damage has zeros, no
    edits and the digest of nothing.  Empty roles and roles of other initials
    can only be renamed or deleted.  Repeated rows are duplicates; other
    columns are not carried; an empty table gives no rows.
    """
    rows = damaged(turns)
    found = cut_lineage(planned(cut_lineage(statistics(rows))))
    # The rows of a conversation come out of one task in order, so its digest needs no other shuffle.
    digests = repaired_turns(rows, found).mapInArrow(_digested, _DIGESTS).withColumnRenamed("conv_id", "__id")
    empty = hashlib.sha256().hexdigest()
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("__id")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
