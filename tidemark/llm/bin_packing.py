"""Best-fit decreasing of token sequences: documents are put together in as few sequences of a fixed length as it finds.

Pieces of equal length are alike to best-fit decreasing, so what it does to all documents follows from how many pieces
there are of each length. The pieces are counted on Spark; the lengths, of which there are no more than places in a
sequence, are dealt out longest first by a segment tree over remaining capacities; and each piece finds its place by its
number among those of its length. The sequences are those of the loop over single documents, whatever their number.

Rows: a null or empty text is its end mark alone; a repeated row is packed as often as it stands there, a null doc_id
like any other; other columns are not looked at, whatever their names; no rows give no pieces. A long text is read in
stretches that end before white space, where no token crosses, so it takes its ids and no more.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .tokens import frugal

#: Characters of the texts that are cut into ids together.
STRETCH = 1 << 20
#: A worker remembers the ids of so many words, from task to task; beyond that, of the more used half.
REMEMBERED = 600_000
#: Bytes of ids in one batch of pieces.
BATCH = 1 << 22

# one white space other than a blank; Latin letters after white space, with what stands before them in the word; the rest of a word
_WORD = re.compile(r"[\t\n\v\f\r](?=\S)|\s*+[A-Za-z]++(?![^\x00-\x7f])|\s*+\S*?[A-Za-z](?=[!-@\[-`{-~])|\s*\S+|\s+")
# Python takes these for white space and the tokenizer does not: texts that hold one are not cut into words
_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\w)[ \n]")


class Encoder:
    """Ids of texts. Words, each with the white space before it, go to the tokenizer once and are then remembered.

    No token crosses from a character to white space after it, nor from a Latin letter to a mark or digit after it, nor
    from a single white space that is no blank to what follows, so that the ids of the words make the ids of the text.
    Control strings in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.uses = array("I"), array("q", [0]), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the more used half of the words."""
        words, ids, ends = list(self.known), np.array(self.ids, np.uint32), np.array(self.ends)
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        self.known = {words[i]: at for at, i in enumerate(kept)}
        self.uses = self.uses[kept] // 2
        length = (ends[1:] - ends[:-1])[kept]
        till = np.cumsum(length)
        self.ids = array("I", ids[np.repeat(ends[kept] - till + length, length) + np.arange(till[-1])].tobytes())
        self.ends = array("q", np.r_[0, till].tobytes())

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [[] if _ODD.search(t) else _WORD.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        words, at = list(chain.from_iterable(split)), len(self.known)
        word = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(word < 0).tolist()
        new = list(dict.fromkeys(words[i] for i in lacking))
        for ids in self._ids(new):
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        word[lacking] = [self.known[words[i]] for i in lacking]
        counts = [len(s) for s in split]
        ends, ids = np.array(self.ends), np.array(self.ids, np.uint32)
        uses = np.bincount(word, minlength=len(self.known))
        uses[:at] += self.uses
        self.uses = uses
        length = ends[word + 1] - ends[word]
        till = np.cumsum(length)
        flat = ids[np.repeat(ends[word] - till + length, length) + np.arange(till[-1] if len(till) else 0)]
        cut = np.r_[0, till][np.cumsum(counts)[:-1]]
        out = np.split(flat, cut)
        for i, t in enumerate(texts):
            if t and not split[i]:
                out[i] = np.array(self._ids([t])[0], np.uint32)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in parts of about so many characters; each but the last ends in a letter or digit before a blank or new line."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _encoded(texts: list[str | None], encoder: Encoder, end: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids and the end mark) for every text, in order."""
    tail, at = np.array([end], np.uint32), 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= size):
            chars += len(texts[to] or "")
            to += 1
        if chars > size:
            yield at, np.concatenate([*(encoder.encode([s])[0] for s in stretches(texts[at], size)), tail])
        else:
            for i, ids in enumerate(encoder.encode([t or "" for t in texts[at:to]])):
                yield at + i, np.r_[ids, tail]
        at = to


def cuts(n: int, room: int) -> list[int]:
    """Where the pieces of n ids begin: one piece if they fit, else whole ones after a shorter first one."""
    return [0] if n <= room else [*([0] if n % room else []), *range(n % room, n, room)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, room: int, size: int) -> Iterator[pa.RecordBatch]:
    encoder, seen, part = _encoder(path), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
    names = ["doc_id", "piece", "start", "length", "ids", "_part", "_place"]

    def batch(doc_ids, rows):
        row, piece, start, length, ids, place = zip(*rows, strict=True)
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()
        cells = piece, start, length, ids, [part] * len(row), place
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]], names=names)

    for b in frugal(batches):
        doc_ids, rows, held = b.column(0), [], 0
        for row, ids in _encoded(b.column(1).to_pylist(), encoder, end, size):
            at = cuts(len(ids), room)
            for i, (lo, hi) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                rows.append((row, i, lo, hi - lo, ids[lo:hi].astype("<u4").tobytes(), int(seen[hi - lo])))
                seen[hi - lo] += 1
                held += hi - lo
                if 4 * held > BATCH:
                    yield batch(doc_ids, rows)
                    rows, held = [], 0
        if rows:
            yield batch(doc_ids, rows)


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 2, room: int = 1024, stretch: int = STRETCH) -> DataFrame:
    """Pieces of at most `room` ids, written once: doc_id, piece, start, length, ids (little-endian 32-bit numbers),
    and the task that cut them with the piece's number among its pieces of that length (_part, _place).

    `tokenizer` is the path of the tokenizer's file, which every executor has; `end` the id after each document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, _part int, _place long"
    return durable(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: _pieces(b, tokenizer, end, room, stretch), schema), "pieces")


class Capacities:
    """A segment tree over the remaining capacities of open sequences: the tightest that is wide enough, in logarithmic time."""

    def __init__(self, room: int) -> None:
        self.width = 1 << room.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, count: int) -> None:
        node = self.width + capacity
        while node:
            self.open[node] += count
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that an open sequence has."""
        node = self.width + need
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):  # up, until there is something to the right
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.width


def packing_plan(counts: dict[int, int], room: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces of each length, as runs (length, first, sequence, each, offset).

    The pieces of a length from number `first` on go, `each` to a sequence and one after the other from `offset`, to
    `sequence` and those that follow it; the next run of that length begins where this one ends. A sequence that takes
    a piece stays the tightest for others of that length until it is too narrow, so sequences alike are filled together.
    What remains in a filled one is under half of what was there, and a length splits one set of alike sequences in at
    most three: a plan has some 30 runs for each length at most, however many pieces there are.
    """
    tree, alike, runs, used = Capacities(room), {}, [], 0

    def put(capacity: int, sequence: int, n: int) -> None:
        if n:
            alike.setdefault(capacity, []).append((sequence, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                n = -(-left // (room // length))
                put(room, used, n)
                used += n
                continue
            sequence, n = alike[capacity].pop()
            tree.add(capacity, -n)
            each = capacity // length
            whole = min(n, left // each)
            more = left - whole * each if whole < n else 0
            if whole:
                runs.append((length, first, sequence, each, room - capacity))
            if more:
                runs.append((length, first + whole * each, sequence + whole, more, room - capacity))
            put(capacity - each * length, sequence, whole)
            put(capacity - more * length, sequence + whole, min(more, 1))
            put(capacity, sequence + whole + min(more, 1), n - whole - min(more, 1))
            first, left = first + whole * each + more, left - whole * each - more
    return np.array(runs, np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows, whose last two columns are length and number among those of a length, with sequence_id and offset instead."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    length, first, sequence, each, offset = plan[order].T
    key = (length << 48) + first
    for b in batches:
        n, number = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
        run = np.searchsorted(key, (n << 48) + number, "right") - 1
        at = number - first[run]
        found = [sequence[run] + at // each[run], offset[run] + at % each[run] * n]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], *map(pa.array, found)], names=[*b.schema.names[:-2], "sequence_id", "offset"])


def place_pieces(pieces: DataFrame, room: int = 1024) -> DataFrame:
    """Rows of token_pieces, with any of its columns and of one's own, with sequence_id and offset for _part and _place.

    Numbers within a task become numbers among all by the sums of the tasks before it. Only the columns given are
    shuffled, by task and length, of which no pair has more rows than one task has written.
    """
    spark = pieces.sparkSession
    counts = durable(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")), "piece-counts")
    plan = packing_plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}, room)  # no more rows than places
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    kept = [c for c in pieces.columns if c not in ("_part", "_place")]
    numbered = pieces.join(starts, ["_part", "length"]).select(*kept, F.col("length").alias("_length"), (F.col("_place") + F.col("_before")).alias("_number"))
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    if not len(plan):
        return spark.createDataFrame([], f"{schema}, sequence_id long, offset long")
    return numbered.mapInArrow(lambda b: _placed(b, plan), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, room: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place_pieces(token_pieces(docs, tokenizer, end, room), room)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, its ids as bytes, and its pieces with where they begin; bounded by a sequence's length."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    # a binary array joins through its hexadecimal text
    return got.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("pieces"))
