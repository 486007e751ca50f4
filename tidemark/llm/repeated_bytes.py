"""Removal of byte strings of a least length that occur more than once anywhere in a corpus.

The corpus is cut into blocks that hold all copies of any string of LENGTH bytes, and each block is searched by interval
expansion on its Burrows-Wheeler transform. Prefix lengths of neighbours in suffix order come out by increasing value:
the intervals of all strings of one length are extended backward by every byte before them, and each new right end is a
place where neighbours have just that length in common. The search stops at LENGTH, so that what has no value then is a
pair of neighbours with LENGTH bytes in common at least.

Blocks go by content. Each window of LENGTH bytes names an anchor, the gram of GRAM bytes in it whose hash is least (the
last of equals); equal windows name equal anchors at equal offsets. Consecutive windows with one anchor form a span, and
a block takes all spans of an anchor. Anchors of one place only are left out beforehand. Spans that occur several times
whole are repeated in all of their windows and enter the block once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of, by_block, pack_rows
from .common import durable, release
from .tokens import batch_of, frugal, mix, prefix_hash, span_hash, text_slices

LENGTH = 200
GRAM = 32
#: An anchor with more distinct spans is not held in one task; its windows are dealt out one by one.
HOT = 20_000
#: Bytes of a block's text, about, and spans that are packed together by a task or unpacked together, about.
BLOCK_BYTES, CHUNK, SPANS = 1 << 20, 1 << 18, 1 << 18
_U = np.uint64
ANCHORS = "d long, t long, anchor long, span long, lo int, shape int"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Row, first window, number of windows, offset of the anchor in the first, and hashes of anchor and span."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    s = prefix_hash(data)
    i = np.arange(len(data) - gram + 1)
    g = span_hash(s, i, i + gram)
    least, at, width, wanted = g, i, 1, length - gram + 1
    while width < wanted:  # least hash of twice as many grams, the later of equals
        step = min(width, wanted - width)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(row[: len(at)] == row[length - 1 :])  # windows inside one text
    a, r = at[first], row[first]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]) if len(a) else np.zeros(0, int)
    lo, count, mark = first[begin], np.diff(np.r_[begin, len(a)]), a[begin]
    span = mix(span_hash(s, lo, lo + count - 1 + length) + (mark - lo).astype(np.uint64))
    return r[begin], lo, count, mark - lo, g[mark], span


PACKED = "block int, d binary, t binary, anchor binary, span binary, lo binary, shape binary"


def _packed(batches, length: int, gram: int, blocks: int, chunk: int):
    """The spans of all texts, packed by their anchors: columns d, t, text."""

    def pack(parts):
        columns = dict(zip(("d", "t", "anchor", "span", "lo", "shape"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
        return pack_rows(block_of(columns["anchor"], blocks), columns)

    parts, size = [], 0
    for batch in frugal(batches):
        d, t = (np.asarray(batch.column(i)) for i in (0, 1))
        for at, data, offsets in text_slices(batch.column(2)):
            r, lo, count, off, anchor, span = anchors(data, offsets, length, gram)
            parts.append((d[at + r], t[at + r], anchor, span, (lo - offsets[r]).astype(np.int32), (count * 1024 + off).astype(np.int32)))
            size += len(r)
            if size >= chunk:
                yield pack(parts)
                parts, size = [], 0
    if size:
        yield pack(parts)


def _places(batches):
    """ANCHORS rows of the spans whose anchor has another place."""
    for columns in by_block(batches):
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
        d, t, anchor, span, lo, shape = (np.frombuffer(b"".join(c), kind) for c, kind in zip(columns, kinds, strict=True))
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        twice = np.zeros(len(anchor), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        found = {"d": d, "t": t, "anchor": anchor, "span": span, "lo": lo, "shape": shape}
        yield batch_of(**{name: pa.array(c[twice]) for name, c in found.items()})


CONTEXT = "d long, t long, anchor long, span long, lo int, shape int, lone boolean, context binary"


def _contexts(batches, length: int):
    """The bytes of the spans listed in `want` (anchor, span, lo, shape, lone)."""
    for batch in frugal(batches):
        want, size = batch.column(3), np.diff(np.asarray(batch.column(3).offsets))
        row = np.repeat(np.arange(len(size)), size)
        x = want.flatten()
        lo, shape = np.asarray(x.field("lo")), np.asarray(x.field("shape"))
        text = batch.column(2)
        for r in np.unique(row):
            mine = np.flatnonzero(row == r) if len(size) == 1 else np.arange(*np.searchsorted(row, [r, r + 1]))
            whole = text[int(r)].as_py()
            cut = [whole[lo[k] : lo[k] + shape[k] // 1024 - 1 + length] for k in mine]
            take, some = pa.array(np.full(len(mine), r)), pa.array(mine)
            own = {c: x.field(c).take(some) for c in ("anchor", "span", "lo", "shape", "lone")}
            yield batch_of(d=batch.column(0).take(take), t=batch.column(1).take(take), **own, context=pa.array(cut, pa.binary()))


def _windows(batch, length: int):
    """(rows, windows in them from 0, key of content and offset from the anchor) of a batch of contexts, in slices."""
    shape, anchor = np.asarray(batch.column(5)), np.asarray(batch.column(2)).view(np.uint64)
    for at, data, offsets in text_slices(batch.column(7)):
        n = len(offsets) - 1
        count, off = shape[at : at + n] // 1024, shape[at : at + n] % 1024
        row = np.repeat(np.arange(n), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][row] + j
        h = span_hash(prefix_hash(data), start, start + length)
        yield at + row, j, mix(h + mix(anchor[at : at + n][row] + (j - off[row] + length).astype(np.uint64)))


def _window_rows(batches, length: int):
    for batch in frugal(batches):
        for row, j, key in _windows(batch, length):
            take = pa.array(row)
            lo = pa.array((np.asarray(batch.column(4))[row] + j).astype(np.int32))
            d, t, lone = (batch.column(i).take(take) for i in (0, 1, 6))
            yield batch_of(d=d, t=t, lo=lo, lone=lone, key=pa.array(key.view(np.int64)))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text of numbers under 512 in order of their first `depth` places at least, by prefix doubling.

    Only suffixes that still tie are sorted again. Beyond the end everything is less.
    """
    n, width = len(text), 7
    padded = np.r_[text, np.zeros(width, text.dtype)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key << _U(9) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    rank = np.full(n + 1, -1, np.int64)  # of the first of its equals; the last entry is the end
    at, reach = np.arange(n), width
    while True:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[start, len(key)])
        rank[order[at]] = np.repeat(at[start], many)
        at = at[np.repeat(many > 1, many)]
        if reach >= depth or not len(at):
            return order
        tied = order[at]
        key = rank[tied].astype(np.uint64) << _U(32) | (rank[np.minimum(tied + reach, n)] + 1).astype(np.uint64)
        again = np.argsort(key)
        order[at], key = tied[again], key[again]
        reach *= 2


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Where a string of `length` places starts that also starts elsewhere. text ends with its only 0.

    Breadth-first backward extension over intervals of the suffix order: an interval holds the suffixes that begin with
    one string; extending it by each number before them gives intervals of strings that are one longer. An interval
    whose right end has no prefix length yet gives it, the length before extension, and is extended in turn.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the text's first suffix is preceded by its end
    sorted_by = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # from a suffix to the one that is longer by what stands before it
    step[sorted_by] = np.arange(n)
    same = before[sorted_by][1:] == before[sorted_by][:-1]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and last place of the same number
    following[sorted_by[:-1][same]] = sorted_by[1:][same]
    preceding[sorted_by[1:][same]] = sorted_by[:-1][same]
    open_ends = np.ones(n + 1, bool)  # between suffixes i - 1 and i no prefix length is known yet
    open_ends[0] = open_ends[n] = False
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(length):
        size = right - left + 1
        of = np.repeat(np.arange(len(left)), size)
        place = np.arange(len(of)) + np.repeat(left - (np.cumsum(size) - size), size)
        # intervals of different strings do not overlap, so sorted ends belong together
        low = np.sort(step[place[preceding[place] < left[of]]])
        high = np.sort(step[place[following[place] > right[of]]])
        new = open_ends[high + 1]
        left, right = low[new], high[new]
        open_ends[right + 1] = False
        if not len(left):
            break
    out = np.zeros(n, bool)
    out[order[open_ends[:-1] | open_ends[1:]]] = True
    return out


def _repeats(batches, length: int, block_bytes: int):
    """Spans of repeated windows of lone contexts; rows come by anchor, and a block ends between anchors."""

    def search(rows):
        columns = [pa.concat_arrays([r.column(i) for r in rows]) for i in range(8)]
        d, t, lo, shape = (np.asarray(columns[i]) for i in (0, 1, 4, 5))
        lone = np.asarray(columns[6].to_numpy(zero_copy_only=False), bool)
        # bytes of UTF-8 count from 2, contexts end with 1, and the text with 0
        context = columns[7].cast(pa.large_binary())
        offsets = np.frombuffer(context.buffers()[1], np.int64)[context.offset : context.offset + len(context) + 1]
        data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        begin = offsets[:-1] - offsets[0] + np.arange(len(size))
        text = np.ones(len(data) + len(size) + 1, np.int16)
        text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.int16) + 2
        text[-1] = 0
        twice = repeated_starts(text, length)
        count = np.where(lone, shape // 1024, 0)
        row = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        use = twice[begin[row] + j]
        row, start = row[use], (lo[row] + j)[use]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, int)
        last = np.r_[first[1:], len(row)] - 1 if len(row) else first
        begin, end = start[first].astype(np.int32), (start[last] + length).astype(np.int32)
        return batch_of(d=pa.array(d[row[first]]), t=pa.array(t[row[first]]), start=pa.array(begin), end=pa.array(end))

    rows, size = [], 0
    for batch in frugal(batches):
        anchor = np.asarray(batch.column(2))
        upto = np.cumsum(np.asarray(batch.column(5)) // 1024 + length)
        cuts, at = [], 0
        # a block ends before the first new anchor after so many bytes
        edges = np.flatnonzero(np.r_[not rows or anchor[0] != np.asarray(rows[-1].column(2))[-1], anchor[1:] != anchor[:-1]])
        done = -size
        for e in map(int, edges):
            if (upto[e - 1] if e else 0) - done >= block_bytes:
                cuts.append(e)
                done = upto[e - 1] if e else 0
        for e in cuts:
            if e > at:
                rows.append(batch.slice(at, e - at))
            if rows:
                yield search(rows)
            rows, at = [], e
        if at < len(anchor):
            rows.append(batch.slice(at))
        size = int(upto[-1] - done)
    if rows:
        yield search(rows)


def _cut(batches):
    for batch in frugal(batches):
        text, spans = batch.column(1), batch.column(2)
        kept, runs = [], []
        for x, g in zip(text, spans, strict=True):
            whole = x.as_py() or b""
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in g.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *[e for m in merged for e in m], len(whole)]
            kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            runs.append([{"start": a, "end": b} for a, b in merged])
        size = pa.array([len(x.as_py() or b"") for x in text], pa.int64())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield batch_of(doc_id=batch.column(0), n_bytes=size, kept=pa.array(kept, pa.binary()), spans=pa.array(runs, kind))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, kept (the remaining bytes), spans (removed runs), one row per row.

    A byte of the UTF-8 text goes if a string of `length` bytes (1000 at most) that covers it also starts anywhere else,
    in this text or another; matches never cross texts and are judged on the input. Null and empty texts keep nothing and
    lose nothing. Repeated rows are copies of each other and lose all of their windows, whether or not they have the same
    doc_id. Rows without doc_id are rows like all others. Other columns, whatever their names, are left out. A very long
    text is read by itself, and its spans are dealt out like all others. An empty table gives no rows.
    """
    if not 0 < gram < length <= 1000:
        raise ValueError("length is over gram and 1000 at most")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]
    rows = docs.select(*key, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # about one span for each half window of bytes
    spans_in = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, chunk, block_bytes = 1 + int(spans_in * 2 / (length - gram) / SPANS), CHUNK, BLOCK_BYTES
    packed = rows.mapInArrow(lambda b: _packed(b, length, gram, blocks, chunk), PACKED)
    places = durable(packed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_places, ANCHORS), "places")
    spans = durable(places.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo", "shape")).alias("p")), "spans")
    end = (F.col("lo") + F.floor(F.col("shape") / 1024) - 1 + length).cast("int").alias("end")
    whole = places.join(spans.where("n > 1").select("anchor", "span"), ["anchor", "span"])
    whole = whole.select("d", "t", F.col("lo").alias("start"), end)
    several = spans.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = spans.join(several, "anchor").select("p.d", "p.t", F.struct("anchor", "span", "p.lo", "p.shape", (F.col("n") == 1).alias("lone"), "kinds").alias("w"))
    listed = wanted.groupBy("d", "t").agg(F.collect_list("w").alias("want"))
    texts = rows.join(listed, ["d", "t"]).dropDuplicates(["d", "t"])

    def contexts(of):
        mine = texts.select("d", "t", "text", F.filter("want", of).alias("want")).where(F.size("want") > 0)
        return mine.mapInArrow(lambda b: _contexts(b, length), CONTEXT)

    close = contexts(lambda w: w["kinds"] <= hot).repartition("anchor").sortWithinPartitions("anchor")
    partial = durable(close.mapInArrow(lambda b: _repeats(b, length, block_bytes), "d long, t long, start int, end int"), "partial")
    tables = [places, spans, partial]
    if not several.where(F.col("kinds") > hot).isEmpty():
        large = contexts(lambda w: w["kinds"] > hot)
        one = durable(large.mapInArrow(lambda b: _window_rows(b, length), "d long, t long, lo int, lone boolean, key long"), "windows")
        twice = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        partial = partial.union(one.where("lone").join(twice, "key").select("d", "t", F.col("lo").alias("start"), (F.col("lo") + length).alias("end")))
        tables.append(one)
    gone = durable(whole.union(partial).groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "removed-bytes")
    release(*tables)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(gone, ["d", "t"], "left")
    return got.select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")
