"""Document quality by attention over passages, learned from document labels."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import by_bytes, held_out, with_fields

# labelled documents of each class that a fit reads at most, passages it reads of each, and bytes in a passage
SAMPLE = 2000
SAMPLE_PASSAGES = 128
PASSAGE = 512
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE = 6, 64, 0.004
AT_ONCE = 1 << 20

# classes of bytes, whose neighbourhoods describe a passage in any language
GROUPS = ("\n", " \t\r\x0b\x0c", ".", ",", "!", "?", "|", "#$%&*", "'\"`", "-_/\\", "()[]{}<>", ":;", "@=+~^")


def _byte_classes() -> np.ndarray:
    known = np.full(256, len(GROUPS), np.uint8)
    for number, group in enumerate(GROUPS):
        known[list(group.encode())] = number
    base = len(GROUPS)
    for b in range(128):
        if chr(b).isdigit():
            known[b] = base + 1
        elif chr(b).islower():
            known[b] = base + 2
        elif chr(b).isupper():
            known[b] = base + 3
    known[128:] = base + 4
    return known


CLASSES = _byte_classes()
WIDTH = len(GROUPS) + 5
FEATURES = WIDTH * WIDTH + 6
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, first passage of each text); an empty text is one empty passage.

    Shares of neighbouring byte classes, and of words: mean length, distinct ones, those
    equal to the word before, those as the one two before, long ones, and the passage's fill.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts), np.uint8)
    features = np.zeros((total, FEATURES), np.float32)
    if not len(raw):
        return features, first
    passage = (np.repeat(first, size) + (np.arange(len(raw)) - np.repeat(begin, size)) // PASSAGE).astype(np.int32)
    length = np.bincount(passage, minlength=total)
    kinds = CLASSES[raw].astype(np.int32)
    pair = passage[:-1] * (WIDTH * WIDTH) + kinds[:-1] * WIDTH + kinds[1:]
    pairs = np.bincount(pair[passage[:-1] == passage[1:]], minlength=total * WIDTH * WIDTH)
    features[:, : WIDTH * WIDTH] = np.sqrt(pairs.reshape(total, -1) / np.maximum(length, 1)[:, None])
    # words: runs of non-blanks; texts are apart because a word also begins where a text begins
    letter = kinds > 1
    edge = np.zeros(len(raw), bool)
    edge[begin[size > 0]] = True
    start = np.flatnonzero(letter & (edge | np.concatenate([[True], ~letter[:-1]])))
    if len(start):
        word = np.cumsum(np.bincount(start, minlength=len(raw))) - 1
        within = np.arange(len(raw)) - start[np.maximum(word, 0)]
        value = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(within, 63)] * letter
        hashed = np.add.reduceat(value, start)
        letters = np.add.reduceat(letter.astype(np.int64), start)
        of = passage[start]
        text = np.searchsorted(first, of, side="right")
        same = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])])
        two = np.concatenate([[False, False], (hashed[2:] == hashed[:-2]) & (text[2:] == text[:-2])])[: len(hashed)]
        words = np.maximum(np.bincount(of, minlength=total), 1)
        distinct = np.unique(hashed ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        sums = [letters / 10.0, None, same, two, letters > 20]
        for i, v in enumerate(sums):
            found = np.bincount(of[distinct], minlength=total) if v is None else np.bincount(of, weights=v, minlength=total)
            features[:, WIDTH * WIDTH + i] = found / words
    features[:, -1] = np.minimum(length / PASSAGE, 1)
    return features, first


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(passages x features, the text each passage is of)`` in chunks of about ``AT_ONCE`` bytes of text.

    Longer texts are encoded part by part, so a chunk's size does not depend on a text's.
    """
    step = AT_ONCE // PASSAGE * PASSAGE
    now, owner, held = [], [], 0

    def encoded():
        features, first = encode(now)
        return features, np.repeat(owner, np.diff(np.append(first, len(features))))

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text)), step):
            part = text[at : at + step]
            if now and held + len(part) > AT_ONCE:
                yield encoded()
                now, owner, held = [], [], 0
            now.append(part)
            owner.append(number)
            held += len(part)
    if now:
        yield encoded()


def spread_passages(text: bytes, most: int = SAMPLE_PASSAGES) -> np.ndarray:
    """Features of at most ``most`` passages, evenly spread over the text."""
    count = max(1, -(-len(text) // PASSAGE))
    if count <= most:
        return encode([text])[0]
    chosen = np.linspace(0, count - 1, most).astype(int)
    return encode([b"".join(text[i * PASSAGE : (i + 1) * PASSAGE] for i in chosen)])[0][:most]


@dataclass
class Attention:
    """Gated attention over passages: a document is the weighted mean of its encoded passages."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["encode"] + w["shift"])
        t, g = np.tanh(h @ w["content"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        score = (t * g) @ w["attend"]
        count = np.diff(np.append(first, len(features)))
        e = np.exp(score - np.repeat(np.maximum.reduceat(score, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["bias"][0])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "count": count}

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """`forward`'s probabilities, chunk by chunk: sums are kept relative to the largest score so far."""
        w, n = self.weights, len(texts)
        top, mass, z = np.full(n, -np.inf, np.float32), np.zeros(n), np.zeros((n, HIDDEN))
        for features, owner in chunks(texts):
            x = np.clip((features - self.mean) / self.scale, -6, 6)
            h = np.tanh(x @ w["encode"] + w["shift"])
            score = (np.tanh(h @ w["content"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            now = owner[first]
            higher = np.maximum(top[now], np.maximum.reduceat(score, first))
            shrink = np.exp(top[now] - higher)
            e = np.exp(score - np.repeat(higher, np.diff(np.append(first, len(owner)))))
            mass[now] = mass[now] * shrink + np.add.reduceat(e, first)
            z[now] = z[now] * shrink[:, None] + np.add.reduceat(e[:, None] * h, first)
            top[now] = higher
        return 1 / (1 + np.exp(-(z / mass[:, None] @ w["out"] + w["bias"][0])))

    def gradients(self, y: np.ndarray, weight: np.ndarray, first: np.ndarray, f: dict) -> dict[str, np.ndarray]:
        w = self.weights
        wrong = (f["p"] - y) * weight / len(y)
        spread = np.repeat(wrong[:, None] * w["out"], f["count"], axis=0)
        through = (f["h"] * spread).sum(1)
        by_doc = np.add.reduceat(f["a"] * through, first)
        score = f["a"] * (through - np.repeat(by_doc, f["count"]))
        joint = score[:, None] * w["attend"]
        content = joint * f["g"] * (1 - f["t"] ** 2)
        gate = joint * f["t"] * f["g"] * (1 - f["g"])
        h = f["a"][:, None] * spread + content @ w["content"].T + gate @ w["gate"].T
        h *= 1 - f["h"] ** 2
        return {
            "encode": f["x"].T @ h, "shift": h.sum(0), "content": f["h"].T @ content, "gate": f["h"].T @ gate,
            "attend": (f["t"] * f["g"]).T @ score, "out": f["z"].T @ wrong, "bias": np.array([wrong.sum()]),
        }


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Attention:
    """Fit by Adam on documents in small batches; both classes weigh the same."""
    random = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shape = {"encode": (FEATURES, HIDDEN), "content": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION)}
    weights = {k: random.normal(0, s[0] ** -0.5, s).astype(np.float32) for k, s in shape.items()}
    weights |= {"shift": np.zeros(HIDDEN, np.float32), "bias": np.zeros(1, np.float32)}
    weights |= {"attend": random.normal(0, 0.1, ATTENTION).astype(np.float32), "out": random.normal(0, 0.1, HIDDEN).astype(np.float32)}
    model = Attention(every.mean(0), every.std(0) + 0.02, weights)
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            count = np.array([len(bags[i]) for i in chosen])
            first = np.cumsum(count) - count
            f = model.forward(np.concatenate([bags[i] for i in chosen]), first)
            step += 1
            for k, g in model.gradients(labels[chosen], balance[chosen], first, f).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                weights[k] -= RATE * (change + 0.02 * weights[k] * (k != "bias"))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Attention | None:
    """Learn from at most about ``sample`` labelled documents per class, held-out ids left out.

    Ids are chosen by hash among the labels, at a rate that the class counts set; only chosen documents are
    encoded, by the executors, at most ``passages`` passages of each, evenly spread.  Repeated labels of an id are
    averaged; of repeated rows of an id one is read, the least by a hash of its text.  Null and empty
    texts are one empty passage.  None if no label is usable, as in empty tables.
    """
    truth = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in truth.groupBy("y").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, min(1.0, sample / n)).otherwise(rate)
    chosen = truth.where(draw < rate)

    def run(batches):
        for batch in by_bytes(batches, lambda b: b.column(2), AT_ONCE):
            data = [spread_passages((t or "").encode(), passages).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary()), batch.column(3)], ["doc_id", "y", "data", "text_hash"]
            )

    # the sample's ids are bounded by the parameter; beside the texts they are tiny
    encoded = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("doc_id").cast("long"), "y", "text", F.xxhash64("text").alias("text_hash"))
        .mapInArrow(run, "doc_id long, y int, data binary, text_hash long")
    )
    rows = encoded.groupBy("doc_id").agg(F.min(F.struct("text_hash", "y", "data")).alias("r")).select("doc_id", "r.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["data"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return train(bags, np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, model: Attention | None) -> DataFrame:
    """``row, score, predicted`` of every row, ``row`` being a struct of all its columns, whatever their names.

    Whole texts are read, passage by passage, in bounded memory.  Null texts count as empty ones, equal texts have equal
    scores, without a model all score 0.5, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in by_bytes(batches, lambda b: b.column(0).field("text"), 4 * AT_ONCE):
            texts = [(t or "").encode() for t in batch.column(0).field("text").to_pylist()]
            p = learned.pooled(texts).astype(np.float64) if learned else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["row", "score", "predicted"]
            )

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, with_fields(rows, ("score", "double"), ("predicted", "integer")))
