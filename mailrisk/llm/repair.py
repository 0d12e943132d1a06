"""Conversation structure: faults of every turn and the cheapest edits that make roles alternate.

Turns are symbols: the initial of the role and what is wrong.  A repaired conversation's initials read
``(s?(ua)+)?``, so four states tell all about what has been put out so far, and a symbol is a min-plus matrix between them.
Runs of equal symbols go through binary powers of their matrix.  A conversation is cut into segments where the table's
sorted ranges end: each segment multiplies its own matrices, the products are chained from the end (one row per segment),
and each segment then unrolls its choices.  So a conversation with a third of all rows is many tasks' work; only
its digest, one hash of one text, is read in order by one task, as a stream.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import settled, small

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, KEEP, REROLE = 4, 3, 0, 3
TRUNCATED = 3  # for a truncated turn that stays
FAR = 1 << 50

# States: nothing put out, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = (USER, USER, ASSISTANT, USER)  # where the turn that a state waits for leads
_FINISH = (0, 2 * INSERT, INSERT, 0)  # user and assistant missing after a system turn, assistant after a user


# --- the algebra --------------------------------------------------------------
def kept_state(state: int, symbol: str) -> int | None:
    """The state after the turn stays as it is; null where its role does not fit."""
    initial = symbol[0]
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _steps(state: int, symbol: str) -> list[tuple[str, int, int]]:
    """``(letter, cost, state)`` of what may be done with a turn."""
    steps = [("D", DELETE, state)]
    if symbol[0] != "x":
        extra = TRUNCATED if symbol.endswith("t") else 0
        after = kept_state(state, symbol)
        if after is not None:
            steps.append(("K", KEEP + extra, after))
        steps.append(("R", REROLE + extra, _AFTER[state]))
    return steps


@lru_cache(maxsize=None)
def _matrix(symbol: str) -> tuple:
    """Cheapest cost from each state before a turn to each after it, insertions before it included."""
    rows = []
    for start in range(4):
        best, state, cost = [FAR] * 4, start, 0
        for _ in range(4):  # insertions walk through at most three other states
            for _, price, after in _steps(state, symbol):
                best[after] = min(best[after], cost + price)
            state, cost = _AFTER[state], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def _times(left: tuple, right: tuple) -> tuple:
    return tuple(tuple(min(min(a + b for a, b in zip(row, column)), FAR) for column in zip(*right)) for row in left)


def _apply(matrix: tuple, costs: tuple) -> tuple:
    return tuple(min(min(a + b for a, b in zip(row, costs)), FAR) for row in matrix)


@lru_cache(maxsize=None)
def _power(symbol: str, exponent: int) -> tuple:
    """The matrix of ``2 ** exponent`` equal turns."""
    if exponent == 0:
        return _matrix(symbol)
    half = _power(symbol, exponent - 1)
    return _times(half, half)


def _powers(symbol: str, n: int):
    for exponent in range(n.bit_length()):
        if n >> exponent & 1:
            yield _power(symbol, exponent)


@lru_cache(maxsize=65536)
def _run_matrix(symbol: str, n: int) -> tuple:
    product = None
    for power in _powers(symbol, n):
        product = power if product is None else _times(product, power)
    return product


def _before(symbol: str, n: int, costs: tuple) -> tuple:
    """Costs to go before a run from those after it."""
    for power in _powers(symbol, n):
        costs = _apply(power, costs)
    return costs


_SHORT = 16


@lru_cache(maxsize=65536)
def _unroll_short(symbol: str, n: int, costs: tuple, state: int) -> tuple[str, int]:
    after = [costs]
    for _ in range(n):
        after.append(_apply(_matrix(symbol), after[-1]))
    letters = []
    while len(after) > 1:
        left, following = after[-1][state], after[-2]
        options = [(letter, price, to, following) for letter, price, to in _steps(state, symbol)]
        options.append(("I", INSERT, _AFTER[state], after[-1]))
        for letter, price, to, then in sorted(options, key=lambda o: o[0]):
            if price + then[to] == left:
                letters.append(letter)
                state = to
                if letter != "I":
                    after.pop()
                break
    return "".join(letters), state


def unroll(symbol: str, n: int, costs: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a run that begins in ``state`` and ends before ``costs`` to go.

    The next state follows from the letter, so taking the least letter that loses nothing is exact.  Long
    runs are halved: the costs in the middle come from powers, so memory is logarithmic but for the letters.
    """
    if n <= _SHORT:
        least = min(costs)  # equal differences make equal choices
        return _unroll_short(symbol, n, tuple(c - least for c in costs), state)
    half = 1 << (n.bit_length() - 2)
    first, middle = unroll(symbol, half, _before(symbol, n - half, costs), state)
    second, end = unroll(symbol, n - half, costs, middle)
    return first + second, end


def finish(state: int) -> str:
    return "I" * (_FINISH[state] // INSERT)


def runs_matrix(runs: list[tuple[str, int]]) -> tuple:
    product = None
    for symbol, n in runs:
        step = _run_matrix(symbol, n)
        product = step if product is None else _times(product, step)
    return product


def unroll_runs(runs: list[tuple[str, int]], costs: tuple, state: int) -> tuple[str, int]:
    """Letters of a segment and the state it ends in; ``costs`` are those to go after it."""
    after = [costs]
    for symbol, n in reversed(runs[1:]):
        after.append(_before(symbol, n, after[-1]))
    letters = []
    for symbol, n in runs:
        part, state = unroll(symbol, n, after.pop(), state)
        letters.append(part)
    return "".join(letters), state


# --- rows ----------------------------------------------------------------------
def _key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by the crc32 of ``conv_id:turn``: ``ck, has_turn, turn, role, text, copies``.

    Of the remainders by 20, 0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 sets the
    role ``user``.  Nulls count as one space.  ``ck`` is the conversation's id as a text that is never null.
    """

    def spaced(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return rows.select(
        _key(F.col("conv_id")).alias("ck"), F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(draw == 3, 2).otherwise(1).alias("copies"), draw.alias("draw"),
    ).where(F.col("draw") != 0).drop("draw")


_ORDER = ["ck", "has_turn", "turn", "role", "digest"]


def _turns(rows: DataFrame) -> DataFrame:
    """One row per distinct turn, without text: ``n`` equal ones, and whether it was said in an earlier turn."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    said = rows.groupBy(*_ORDER, F.substring("role", 1, 1).alias("initial"), end.alias("end")).agg(
        F.sum("copies").cast("long").alias("n")
    )
    place = F.struct("has_turn", "turn")
    first = said.groupBy("ck", "digest").agg(F.min(place).alias("f")).select("ck", "digest", "f.*", F.lit(True).alias("new"))
    # the turn belongs to the join's key, so a text that is said a million times is no hot key
    return said.join(first, ["ck", "digest", "has_turn", "turn"], "left").withColumn("new", F.coalesce("new", F.lit(False)))


def _symbol(initial: str, end: str, again: bool) -> str:
    if end == "" or again:
        return "x"
    return (initial if initial in ("s", "u", "a") else "o") + ("" if end in ENDS else "t")


_LEGAL = {"su", "ua", "au"}


def _segments(batches):
    """Rows of one sorted range to one row per conversation in it: runs, their matrix, and counts."""
    current, out = None, []

    def closed():
        runs = current["runs"]
        costs = runs_matrix([(s, n) for s, n in runs])
        return {
            "ck": current["ck"], "part": current["part"], "first": current["first"],
            "runs": " ".join(f"{s}{n}" for s, n in runs), "costs": " ".join(str(c) for row in costs for c in row),
            "last": current["last"],
            **{c: current[c] for c in ("lowest", "highest", "turns", "blank", "duplicate", "truncated", "illegal")},
        }

    schema = pa.schema([
        ("ck", pa.string()), ("part", pa.int64()), ("first", pa.string()), ("runs", pa.string()), ("costs", pa.string()),
        ("last", pa.string()), *[(c, pa.int64()) for c in ("lowest", "highest", "turns", "blank", "duplicate", "truncated", "illegal")],
    ])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ck", "has_turn", "turn", "initial", "end", "n", "new", "part")]
        for ck, has_turn, turn, initial, end, n, new, part in zip(*columns):
            if current is None or current["ck"] != ck:
                if current is not None:
                    out.append(closed())
                current = {
                    "ck": ck, "part": part, "first": initial, "last": None, "runs": [], "lowest": None, "highest": None,
                    "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                }
            if has_turn:
                if current["highest"] != turn:
                    current["turns"] += 1
                current["lowest"] = turn if current["lowest"] is None else current["lowest"]
                current["highest"] = turn
            if current["last"] is not None and current["last"] + initial not in _LEGAL:
                current["illegal"] += 1
            current["illegal"] += n - 1  # equal roles side by side
            current["last"] = initial
            again = [(_symbol(initial, end, not new), 1)]
            if n > 1:
                again.append((_symbol(initial, end, True), n - 1))
            for symbol, count in again:
                if current["runs"] and current["runs"][-1][0] == symbol:
                    current["runs"][-1][1] += count
                else:
                    current["runs"].append([symbol, count])
            if end == "":
                current["blank"] += n
            else:
                fresh = 1 if new else 0
                current["duplicate"] += n - fresh
                current["truncated"] += fresh if end not in ENDS else 0
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if current is not None:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_SEGMENT = (
    "ck string, part long, first string, runs string, costs string, last string,"
    " lowest long, highest long, turns long, blank long, duplicate long, truncated long, illegal long"
)


def segments(rows: DataFrame) -> DataFrame:
    """Conversations cut where sorted ranges of all turns end; nearly all have one segment."""
    lined = _turns(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return settled(lined.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_segments, _SEGMENT), "repair-segments")


def _matrix_of(text: str) -> tuple:
    values = [int(v) for v in text.split(" ")]
    return tuple(tuple(values[i : i + 4]) for i in range(0, 16, 4))


def _runs_of(text: str) -> list[tuple[str, int]]:
    runs = []
    for run in text.split(" "):
        symbol = run.rstrip("0123456789")
        runs.append((symbol, int(run[len(symbol) :])))
    return runs


def _chain(batches):
    """The cost to go after each of a conversation's segments, and the whole cost."""
    for batch in batches:
        cks, parts, togo, whole = [], [], [], []
        for ck, chain in zip(batch.column("ck").to_pylist(), batch.column("chain").to_pylist()):
            costs = _FINISH
            for segment in reversed(chain):
                cks.append(ck)
                parts.append(segment["part"])
                togo.append(" ".join(map(str, costs)))
                costs = _apply(_matrix_of(segment["costs"]), costs)
                whole.append(costs[START])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cks, pa.string()), pa.array(parts, pa.int64()), pa.array(togo, pa.string()), pa.array(whole, pa.int64())],
            ["ck", "part", "togo", "cost"],
        )


def _letters(batches):
    """Letters of each segment and the state it ends in, from every state it may begin in."""
    for whole in batches:
        for batch in small([whole], 256):
            found, ends = [], []
            for runs, togo, head in zip(*[batch.column(c).to_pylist() for c in ("runs", "togo", "head")]):
                costs, parts, states = tuple(int(c) for c in togo.split(" ")), [], []
                for state in range(4):
                    reachable = state == START or not head
                    letters, end = unroll_runs(_runs_of(runs), costs, state) if reachable else ("", state)
                    parts.append(letters)
                    states.append(end)
                found.append(parts)
                ends.append(states)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ck"), batch.column("part"), pa.array(found, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                ["ck", "part", "letters", "ends"],
            )


def _joined(batches):
    """The letters of a conversation's segments, each from the state in which the one before ends."""
    for whole in batches:
        for batch in small([whole], 256):
            audits = []
            for chain in batch.column("chain").to_pylist():
                state, letters = START, []
                for segment in chain:
                    letters.append(segment["letters"][state])
                    state = segment["ends"][state]
                audits.append("".join(letters) + finish(state))
            yield pa.RecordBatch.from_arrays([batch.column("ck"), pa.array(audits, pa.string())], ["ck", "audit"])


def audits(cut: DataFrame) -> DataFrame:
    """``ck, audit, cost``: the cheapest edits of every conversation in order."""
    chained = cut.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("chain"))
    chained = chained.mapInArrow(_chain, "ck string, part long, togo string, cost long")
    firsts = cut.groupBy("ck").agg(F.min("part").alias("part"), F.lit(True).alias("head"))
    joined = cut.select("ck", "part", "runs").join(chained, ["ck", "part"]).join(firsts, ["ck", "part"], "left")
    joined = settled(joined.withColumn("head", F.coalesce("head", F.lit(False))), "repair-chained")
    letters = joined.select("ck", "part", "runs", "togo", "head").mapInArrow(
        _letters, "ck string, part long, letters array<string>, ends array<int>"
    )
    whole = letters.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "ends"))).alias("chain"))
    costs = joined.where("head").select("ck", "cost")
    return whole.mapInArrow(_joined, "ck string, audit string").join(costs, "ck")


def counts(cut: DataFrame) -> DataFrame:
    """Faults of a conversation from its segments; what lies across a cut is judged by the ends beside it."""
    ends = F.array_sort(F.collect_list(F.struct("part", "first", "last", "lowest", "highest")))
    summed = cut.groupBy("ck").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), ends.alias("ends"),
    )
    pairs = F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends")).alias("b"))
    crossing = F.size(F.filter(pairs, lambda p: ~F.concat(p["a"]["last"], p["b"]["first"]).isin(*sorted(_LEGAL))))
    shared = F.size(F.filter(pairs, lambda p: F.coalesce(p["a"]["highest"] == p["b"]["lowest"], F.lit(False))))
    gaps = F.col("highest") - F.col("lowest") + 1 - (F.col("turns") - shared)
    return summed.select(
        "ck", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + crossing).cast("long").alias("illegal"),
    )


class _Digest:
    """SHA-256 of one conversation's repaired text, fed turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def _put(self, role: str, text: str):
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:".encode())
        self.hash.update(text.encode())
        self.empty = False

    def _awaited(self) -> str:
        self.state = _AFTER[self.state]
        return "user" if self.state == USER else "assistant"

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._awaited(), "")
            self.at += 1

    def turn(self, role: str, text: str):
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = kept_state(self.state, role[0])
            self._put(role, text)
        elif letter == "R":
            self._put(self._awaited(), text)

    def close(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def _hashed(batches):
    """Sorted turns, each conversation's audit first, to digests; a turn's text is held only while it is read."""
    ck, digest = None, None
    for whole in batches:
        for batch in small([whole], 256):
            cks, digests = [], []
            columns = [batch.column(c).to_pylist() for c in ("ck", "audit", "role", "text", "copies")]
            for key, audit, role, text, copies in zip(*columns):
                if audit is not None:
                    if digest is not None:
                        cks.append(ck)
                        digests.append(digest.close())
                    ck, digest = key, _Digest(audit)
                    continue
                for _ in range(copies):
                    digest.turn(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(cks, pa.string()), pa.array(digests, pa.string())], ["ck", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ck], pa.string()), pa.array([digest.close()], pa.string())], ["ck", "repaired_sha256"])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``ck, repaired_sha256``.  The digest is one hash over one text, so one task streams a conversation's turns."""
    none = F.lit(None)
    audit = found.select(
        "ck", F.lit(0).alias("kind"), F.lit(False).alias("has_turn"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("digest"), "audit", none.cast("string").alias("text"), none.cast("int").alias("copies"),
    )
    turns = rows.select(
        "ck", F.lit(1).alias("kind"), "has_turn", "turn", "role", "digest", none.cast("string").alias("audit"), "text", "copies"
    )
    lined = audit.unionByName(turns).repartition("ck").sortWithinPartitions("ck", "kind", "has_turn", "turn", "role", "digest")
    return lined.select("ck", "audit", "role", "text", "copies").mapInArrow(_hashed, "ck string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation of a damaged table.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row per
    ``conv_id``, the null one included.  Turns go by number, null first; ties by role and by the digest of role and text,
    so the order never depends on the input's.  Repeated rows are duplicates of the first.  Null roles and texts are one
    space: such texts are blank, such roles fit nowhere.  Texts are hashed whole, however long.  A conversation that loses
    all rows has zeros, an empty audit, and the digest of nothing.  An empty table gives no rows; other columns are ignored.
    """
    rows = damaged(conversations)
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    cut = segments(rows)
    found = settled(audits(cut), "repair-audits")
    every = conversations.select(_key(F.col("conv_id")).alias("ck"), "conv_id").distinct()
    whole = every.join(counts(cut), "ck", "left").join(found, "ck", "left").join(digests(rows, found.select("ck", "audit")), "ck", "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
