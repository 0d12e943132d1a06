"""Language by cross-parsing: the fewest phrases over suffix automata of labelled text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.shared import by_bytes, held_out, with_fields

UNKNOWN = "und"
# labelled text of each language: so many passages of so many code points at most, and so many of all languages;
# with many languages each has fewer, but one at least
PASSAGES = 120
ALL_PASSAGES = 4000
PASSAGE_CHARS = 400
# texts are parsed in blocks of so many bytes at once, and so many bytes are in memory at once
BLOCK = 2048
AT_ONCE = 2 << 20


def sample(docs: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS, every: int = ALL_PASSAGES) -> dict[str, list[str]]:
    """At most ``passages`` passages of ``chars`` code points of each language's labelled text, ``every`` in all.

    Rows with a language and a letter in their text, held-out ids left out; null ids are held in.  Rows are chosen by
    a hash of the id, ties by a hash of the text, passages by another; the number of rows per language sets the
    rate first, so only a few times the sample is sorted.  Repeated rows may be chosen together.  Every language that has
    such a row is learned; an empty table teaches none.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return {}
    passages = max(1, min(passages, every // len(counts)))
    rate = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (4.0 * passages + 16) / r["count"])]), F.col("lang"))
    chosen = labelled.withColumn("draw", draw).where(F.col("draw") < rate)
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - chars)) + 1
    rows = (
        chosen.select("lang", F.substring(F.col("text"), start.cast("int"), F.lit(chars)).alias("passage"), F.row_number().over(first).alias("place"))
        .where(F.col("place") <= passages)
        .orderBy("lang", "place")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append(row["passage"])
    return found


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the empty one."""
    follow: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = follow[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and follow[at].get(symbol) == target:
                    follow[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return follow


def plain(text: str) -> np.ndarray:
    """Bytes in lower case; runs of ASCII that is no letter become one zero."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    symbols = _LETTER[raw]
    blank = symbols == 0
    return symbols[~(blank & np.concatenate([[False], blank[:-1]]))] if len(symbols) else symbols


_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128][[not chr(i).isalpha() for i in range(128)]] = 0


def packed(follow: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, target, owner``: state ``s`` goes to ``target[first[s] + symbol]`` if ``owner`` there is ``s``.

    Rows of a few entries are laid into each other's gaps, so the table is about as long as there are transitions.
    """
    edges = sum(map(len, follow))
    used = bytearray(edges + 4 * width + 64)
    first = np.zeros(len(follow), np.int64)
    slots, targets, owners = [], [], []
    order = sorted((s for s in range(len(follow)) if follow[s]), key=lambda s: -len(follow[s]))
    low, single = width, False
    for state in order:
        out = follow[state]
        symbols = list(out)
        lead = symbols[0]
        if len(symbols) == 1 and not single:
            low, single = width, True  # these fill the gaps that the others left
        at = low = used.find(0, low)
        tries = 0
        while single or any(used[at - lead + symbol] for symbol in symbols):
            if single:
                break
            tries += 1
            at = used.find(0, at + 1)
            if tries == 8:  # crowded: leave this stretch to single ones
                low = at
        base = at - lead
        first[state] = base
        for symbol, to in out.items():
            used[base + symbol] = 1
            slots.append(base + symbol)
            targets.append(to)
            owners.append(state)
        if len(used) - low < 4 * width:
            used += bytes(len(used))
    size = max(int(first.max(initial=0)), max(slots, default=0)) + width + 1
    target, owner = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    target[slots], owner[slots] = targets, owners
    return first, target, owner


class Parsers:
    """The automata of all languages in one packed table.

    Where an automaton has no transition a phrase ends, and the next one begins with the symbol.  A symbol a language
    never has leads to a state without transitions: it is a phrase of its own.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = [np.concatenate([plain(p + " ") for p in samples[x]]) for x in self.languages]
        known = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.uint8)
        self.width = len(known) + 1
        self.symbol = np.full(256, self.width - 1, np.int64)
        self.symbol[known] = np.arange(len(known))
        first, target, owner, self.roots, alone = [], [], [], [], []
        states = slots = 0
        for text in texts:
            follow = suffix_automaton(self.symbol[text].tolist())
            follow.append({})  # where unknown symbols lead
            here = np.full(self.width, len(follow) - 1)
            for symbol, state in follow[0].items():
                here[symbol] = state
            f, t, o = packed(follow, self.width)
            first.append(f + slots)
            target.append(t + states)
            owner.append(np.where(o < 0, -1, o + states))
            alone.append(here + states)
            self.roots.append(states)
            states, slots = states + len(follow), slots + len(t)
        empty = [np.empty(0, np.int64)]
        self.first, self.target, self.owner = (np.concatenate(x or empty).astype(np.int32) for x in (first, target, owner))
        self.alone = np.array(alone, np.int32).reshape(len(alone), self.width)
        # how well text of other languages can be parsed, in the middle
        self.foreign = 1.0
        if len(texts) > 1:
            rate = self.rates([t.tobytes() for t in texts])
            self.foreign = float(np.median(rate[~np.eye(len(texts), dtype=bool)]))

    def rates(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per symbol, a row for each text (of `plain` bytes) and a column per language."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begin[owner] + nth * BLOCK
        length = np.minimum(size[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        languages = len(self.languages)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(start), axis=1)
        phrases = np.ones((languages, len(start)), np.int64)
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        for step in range(int(length[0]) if len(length) else 0):
            n = active[step]
            here, read = state[:, :n], flat[start[:n] + step]
            at = self.first[here] + read
            broke = self.owner[at] != here
            if step:  # the first phrase of a block has none before it
                phrases[:, :n] += broke
            state[:, :n] = np.where(broke, self.alone[:, read], self.target[at])
        total = np.zeros((languages, len(texts)), np.int64)
        for i in range(languages):
            total[i] = np.bincount(owner[order], weights=phrases[i], minlength=len(texts))
        return (total / np.maximum(size, 1)).T


_PARSERS: dict[int, Parsers] = {}


def parsers(samples: dict[str, list[str]]) -> Parsers:
    """Built once per Python worker from the sample, which is far smaller than the tables."""
    key = hash(tuple((x, tuple(samples[x])) for x in sorted(samples)))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parsers(samples)
    return _PARSERS[key]


def parts(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of neighbouring texts of at most ``AT_ONCE`` code points, or of a single longer one."""
    now, held = [], 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if now and held + size > AT_ONCE:
            yield now
            now, held = [], 0
        now.append(i)
        held += size
    if now:
        yield now


def predict(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """``row, lang_pred, score, rate, known`` of every row; ``row`` is a struct of all its columns.

    ``rate`` is phrases per symbol in the best language, ``score`` the worse of the two best
    rates over their sum (1 if one language is known), ``known`` whether a text is closer to its language than other
    languages' texts commonly are: the same rule for every length, the last phrase, which the text's end cuts off, left
    out.  Ties go to the first language by name.  Null texts and texts without a letter, and all texts if nothing was
    learned, are ``und`` with score 0.  Whole texts are read however long; an empty table gives no rows; columns of any
    name stay in ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        model = parsers(shared.value)
        for batch in by_bytes(batches, lambda b: b.column(0).field("text")):
            texts = batch.column(0).field("text").to_pylist()
            language = np.full(len(texts), UNKNOWN, object)
            score, rate = np.zeros(len(texts)), np.ones(len(texts))
            known = np.zeros(len(texts), bool)
            for places in parts(texts):
                places = [i for i in places if texts[i] and any(map(str.isalpha, texts[i]))]
                if not places or not model.languages:
                    continue
                symbols = [plain(texts[i]).tobytes() for i in places]
                rates = model.rates(symbols)
                best = rates.argmin(1)
                ranked = np.sort(rates, axis=1)
                language[places] = np.array(model.languages, object)[best]
                rate[places] = ranked[:, 0]
                length = np.fromiter(map(len, symbols), np.int64, len(symbols))
                known[places] = ranked[:, 0] - 1 / np.maximum(length, 1) < model.foreign
                score[places] = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if rates.shape[1] > 1 else 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(language.tolist(), pa.string()), pa.array(score), pa.array(rate), pa.array(known)],
                ["row", "lang_pred", "score", "rate", "known"],
            )

    rows = docs.select(F.struct("*").alias("row"))
    out = with_fields(rows, ("lang_pred", "string"), ("score", "double"), ("rate", "double"), ("known", "boolean"))
    return rows.mapInArrow(run, out)


def identify(docs: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> DataFrame:
    """Learn from the labelled rows of ``docs``, then `predict` the language of every row."""
    return predict(docs, sample(docs, passages, chars))


def recognised(prediction: DataFrame) -> Column:
    """What a corpus keeps: texts in a learned language."""
    return (prediction["lang_pred"] != UNKNOWN) & prediction["known"]
