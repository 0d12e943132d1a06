import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mailrisk.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    kept = {}

    def spaced(value):
        return " " if value is None else str(value)

    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        draw = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for turns in kept.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    return kept


def cheapest(turns):
    """Uniform-cost search over all edits, least audit first."""
    seen, faults = set(), []
    for _, role, text in turns:
        last = text.rstrip(BLANKS)[-1:]
        faults.append("blank" if last == "" else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
            return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest
        if (i, state) in done:
            continue
        done.add((i, state))
        following, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, following, (*out, f"{name}:")))
        if i == len(turns):
            continue
        _, role, text = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 3 if faults[i] else 0
        if role[:1] == following or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, following, (*out, f"{name}:{text}")))


def some(n, convs):
    pick = random.Random(3).choice
    texts = [None, "", "  \n", "Hi.", "Ok", "Yes! ", "ä?", "Hm...\t", *[f"T{i}." for i in range(60)]]
    return [
        (pick(convs), pick([None, *range(12)]), pick(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), pick(texts))
        for _ in range(n)
    ]


def hot():
    pick = random.Random(4).choice
    rows = [(7, i, pick(["user", "user", "assistant"]), pick(["Same.", f"x{i}.", f"y{i}"])) for i in range(1500)]
    return rows + [(7, 5, "user", "Same.")] * 300 + [(8, 1, "user", "a."), (9, 3, "user", "long " * 300_000 + ".")]


CASES = {
    "empty": [], "nulls_ties_repeats": some(3000, [None, *range(300)]), "hot": hot(),
    "run": [(1, i, "user", f"q{i}.") for i in range(700)] + [(2, None, None, None)] * 3,
}


@pytest.mark.parametrize("name", CASES)
def test_repair_equals_search(spark, name):
    """Without coalescing, long conversations are cut into several segments."""
    rows = CASES[name]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("ck", "digest", "n", "part", "copies")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair(table.repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(str, map(tuple, got))) == sorted(str((conv, *cheapest(turns))) for conv, turns in damage(rows).items())


def test_hot_conversation_is_cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = repair.damaged(spark.createDataFrame(hot(), SCHEMA)).withColumn("digest", F.sha2(F.concat("role", "text").cast("binary"), 256))
        assert repair.segments(rows).where("ck = '=7'").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SYMBOLS = ["x", "s", "u", "a", "o", "st", "ut", "at", "ot"]


def test_powers_equal_single_steps():
    for symbol, n in itertools.product(SYMBOLS, (1, 2, 5, 31, 100)):
        single = repair._matrix(symbol)
        for _ in range(n - 1):
            single = repair._times(single, repair._matrix(symbol))
        assert repair._run_matrix(symbol, n) == single


def test_halved_runs_unroll_like_single_turns():
    for symbol, n, state in itertools.product(SYMBOLS, (17, 50, 333), range(4)):
        whole = repair.unroll_runs([(symbol, n)], repair._FINISH, state)
        assert whole == repair.unroll_runs([(symbol, 1)] * n, repair._FINISH, state)
