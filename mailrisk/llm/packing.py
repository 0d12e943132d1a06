"""Sequences of bounded length by sum-of-squares packing of tokenised documents."""

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import by_bytes, settled, with_fields

TOKENS = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
# documents packed together by one task, and how full a sequence must be to be closed early
GROUP = 32_768
FULL = 0.995
CACHE = 500_000

_BEFORE_WORD = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" (?:\s|$)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of a blank and the word behind it, as little-endian bytes, remembered under the word.

    Byte-level tokenizers never merge across a blank that a word follows, so a text's ids
    are those of its parts.  Two generations of words are kept: memory stays bounded and
    frequent words stay known.  ``bare`` knows parts that no blank precedes.
    """

    def __init__(self, path: str, blank: str = " ", model=None):
        if model is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
        self.whole, self.model, self.blank = model, model.model, blank
        self.old: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        # the byte alphabet of such vocabularies: printable bytes stand for themselves
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.bare = WordIds(path, "", model) if blank else self

    def letters(self, word: str) -> bytes:
        """Ids of letters, with or without a blank before them: one word for the model."""
        if word.isascii():
            known = "\u0120" + word if self.blank else word
        else:
            known = (self.blank + word).encode().decode("latin-1").translate(self.alphabet)
        return _packed_ids([t.id for t in self.model.tokenize(known)])

    def encode(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "ɐ":
            return self.letters(word)
        # marks and a lone line feed behind a letter, and what follows, are words of their own
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha() and word[-2] < "ɐ":
            return self[word[:-1]] + self.bare[word[-1]]
        line, feed, rest = word.partition("\n")
        if feed and line.strip() and rest and not line[-1].isspace() and not rest[0].isspace():
            return self[line] + self.bare[feed] + self.bare[rest]
        return _packed_ids(self.whole.encode(self.blank + word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        # what spans lines hardly ever comes again
        if len(word) < 200 and "\n" not in word[:-1]:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _LOOSE.search(text):
            first, *words = _BEFORE_WORD.split(text)
        else:
            first, *words = text.split(" ")
        head = self.bare.encode(first) if first else b""
        return head + b"".join(map(self.__getitem__, words))


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def cut(total: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): only longer documents are cut; the first piece takes what is left over."""
    first = total % most or most
    yield 0, 0, first
    for piece, start in enumerate(range(first, total, most), 1):
        yield piece, start, most


def pieces(docs: DataFrame, most: int = TOKENS, tokenizer: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's tokens.

    A null text is an empty one: only the end token.  Very long texts are tokenized whole, a few megabytes or one
    text at a time, and cut.  Repeated rows give repeated pieces, rows with null ids pieces with null ids; other columns
    are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    closing = np.array([end], "<u4").tobytes()

    def run(batches):
        known = word_ids(path)
        for batch in by_bytes(batches, lambda b: b.column(1)):
            out = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = known.ids(text.as_py() or "") + closing
                for piece, start, length in cut(len(data) // 4, most):
                    own = data[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(own), own if with_ids else b"")):
                        column.append(value)
            columns = [
                pa.array([d.as_py() for d in out[0]], pa.int64()),
                pa.array(out[1], pa.int32()),
                *(pa.array(out[i], pa.int64()) for i in (2, 3, 4)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(out[5]), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.array(out[3], np.int64))]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, most: int = TOKENS, order: np.ndarray | None = None, sparing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed one by one, the longest first or in ``order``.

    N(g) is the number of open bins with gap g.  A piece of length s goes where the sum of
    all N(g) squared becomes smallest: into a bin with gap g >= s, or into a new one.  Putting it
    into gap g changes the sum by 2 (N(g - s) - N(g) + 1), into a gap of just s by 1 - 2 N(s), a new
    bin by 2 N(most - s) + 1.  Ties go to the smaller gap, and to an open bin.  If ``sparing``, a new bin is
    no choice where a piece fits into an open one.
    """
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]
    count = np.zeros(most + 1)
    count[0] = -0.5  # full bins are not counted; this makes one formula of the first two
    taken = np.full(most + 1, -1e12)  # N(g) where a bin is open
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    order = np.argsort(-lengths, kind="stable") if order is None else order
    for i in order.tolist():
        s = int(lengths[i])
        gap = most
        if s < most:
            change = count[: most - s] - taken[s:most]
            g = int(change.argmin())
            if change[g] + 1 <= (1e11 if sparing else count[most - s] + 0.5):
                gap = g + s
        if gap == most:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            count[gap] -= 1
            taken[gap] = count[gap] if count[gap] > 0 else -1e12
        bins[i], offsets[i] = number, most - gap
        left = gap - s
        if left:
            open_bins[left].append(number)
            count[left] += 1
            taken[left] = count[left]
    return bins, offsets


def fewest(lengths: np.ndarray, most: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The best of a few orders and rules of `sum_of_squares`, for pieces that no later round packs again."""
    shaken = np.argsort(-lengths * (1 + 0.05 * np.random.default_rng(1).normal(size=len(lengths))), kind="stable")
    tries = (sum_of_squares(lengths, most, order, sparing) for order in (None, shaken) for sparing in (True, False))
    return min(tries, key=lambda found: found[0].max(initial=0))


def _packed(most: int, full: float, last: bool):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = (fewest if last else sum_of_squares)(rows["length"].to_numpy(), most)
        filled = np.bincount(bins, weights=rows["length"].to_numpy())[bins]
        done = (filled >= full * most) | last
        return rows.drop(columns="_group").assign(
            sequence_id=np.where(done, (int(key[0]) << 24) + bins, -1),
            offset=np.where(done, offsets, -1),
        )

    return run


def pack(items: DataFrame, most: int = TOKENS, group: int = GROUP, full: float = FULL) -> DataFrame:
    """``items`` (of `pieces`) with ``sequence_id`` and ``offset``; no sequence exceeds ``most``.

    Pieces of full length are sequences of their own.  The others are dealt by a hash of id and piece
    into groups of about ``group``, each packed by one task.  Sequences less than ``full`` are
    dissolved and their pieces packed anew, in fewer groups, until one group holds the rest, of which several
    packings are tried; each round leaves a small share, so the tails of many groups do not add up.  Null ids
    are ids like others, repeated rows are pieces of their own, other columns are kept, an empty table gives no rows.
    """
    items = settled(items, "pack-pieces")
    whole = items.where(F.col("length") >= most).select(
        "*", (F.lit(-2) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = items.where(F.col("length") < most)
    schema = with_fields(rest, ("sequence_id", "long"), ("offset", "long"))
    base, results = 0, [whole]
    left = None
    while True:
        n = rest.count()
        if not n:
            break
        groups = max(1, round(n / group))
        last = groups == 1 or (left is not None and n > 0.8 * left)
        dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(base)), F.lit(groups)) + base
        done = settled(
            rest.withColumn("_group", dealt).groupBy("_group").applyInPandas(_packed(most, full, last), schema),
            "pack-round",
        )
        results.append(done.where("sequence_id >= 0"))
        if last:
            break
        left, base = n, base + groups
        rest = done.where("sequence_id < 0").drop("sequence_id", "offset")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
