"""Near-duplicate lines across documents by a deletion-neighbourhood join.

Lines are sequences of words and the edit distance counts words put in, taken out or replaced; the bound is one edit for
each `words_per_edit` words of the shorter line, and one at least. Repeats of a line are one group from the start and
stand for themselves by their earliest place.

Where the bound is one edit, a line's variants, it and each form of it with one word deleted, are emitted as hashed keys.
Lines with the same word place deleted and an equal rest differ by a replacement; a line equal to another's variant
differs by an insertion. For each key the earliest line is a grouped minimum, so a line meets one partner per key and
never a whole group. Lines within one edit agree on a run of words at their start or end, and only lines that share such
a run with a different line emit variants at all.

With a larger bound the neighbourhood of all variants is too large, but what deletions leave untouched is not: k edits
destroy at most k * GRAM of a line's runs of GRAM words, so of two lines within the bound one of the first k * GRAM + 1
runs in a global order stands among those of the other. These keys are packed into blocks by key range, and a block task
finds the keys that two lines of fitting lengths share at fitting places. Frequent runs come last in the order. Parities
of the words of two such lines, each word with its number in the line, may differ in two bits for each edit, one where a
word is put in or taken out, and only
pairs that pass are compared, in three steps: each line of a key with the head of its key, an early line, which all of a
group of copies have in common; what stays after that with the middles of its keys of more than FEW lines; and what stays
then with all earlier lines of its keys, each pair of the larger keys at the first of them that it shares. A middle stands for the lines of a key in one of OCTAVES spans of documents, each twice as long as the
one before it: of these lines it shares the most keys with others, as the least edited of a group of near copies does. A
group of any size thus makes few pairs a line in the first two steps, and only lines far from all middles come to the third.

The words of every pair are compared before a line goes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, few_lists, fresh_names, join_few, release
from .tokens import batch_of, frugal, lowered, mix, powers, prefix_hash, span_hash, text_slices, words

#: Lines of fewer words have no variants: they go only as exact repeats.
MIN_WORDS = 5
WORDS_PER_EDIT = 10
#: Words of a run that lines with a larger bound share.
GRAM = 4
#: Runs of many lines come last in their order: at most so many, each in so many lines of CHUNK runs. Any choice of them
#: gives the same pairs; it only spares meetings on common passages.
MOST_FREQUENT, SEEN_OFTEN = 100_000, 8
#: Keys taken together by a task, when frequent ones are counted and when blocks are packed.
CHUNK = 1 << 19
#: Keys of a block, about.
BLOCK = 1 << 20
#: Lengths are told apart by powers of this, where keys are packed; and a place that says nothing.
LENGTH_STEP, ANYWHERE = 1.04, 255
#: Rows of a key that a row is held against in its block at most; larger groups go on undiminished.
LOOK_AHEAD = 256
_U = np.uint64
_LOW = np.uint64((1 << 48) - 1)
#: Of a gram's hash, the bits that a packed key has beside length, place and level of its line.
_KEY = np.uint64((1 << 40) - 1)
#: Documents are told apart by so many levels of their ids where heads are chosen, and by spans where middles are.
LEVELS, OCTAVES = 256, 12
#: Keys of at most so many lines have no middles: a line is held against all earlier ones of them.
FEW = 32
#: So many places tell by the low bits of a gram that it is not a frequent one.
MAYBE = 1 << 20
#: The id that stands for none.
NO_ID = -(1 << 63)
PLACE = ["d", "t", "line"]


def _run(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, wherever they stand; s is the prefix sum over word hashes."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


def _lines(column: pa.Array, least: int):
    """(first row, row, number in the row, first word, last word, prefix sums over word hashes, words) of lines of enough
    words; words are (bytes, start, end, hash)."""
    for at, data, offsets in text_slices(column):
        low = lowered(data)
        start, end, row = words(low, offsets)
        h = span_hash(prefix_hash(low), start, end)
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(len(h) + 1)[0][: len(h)], out=s[1:])
        breaks = np.flatnonzero(data == 10)
        if not len(h):
            continue
        # the first word of each line that has one
        begin = np.unique(np.searchsorted(start, np.r_[offsets[:-1], breaks]))
        begin = begin[begin < len(h)]
        stop = np.r_[begin[1:], len(h)]
        keep = stop - begin >= least
        begin, stop = begin[keep], stop[keep]
        if len(begin):
            # breaks before the line, without those before its row
            number = np.searchsorted(breaks, start[begin]) - np.searchsorted(breaks, offsets[row[begin]])
            yield at, row[begin], number.astype(np.int32), begin, stop, s, (data, start, end, h)


def _full(s: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix(_run(s, begin, stop) + (stop - begin).astype(np.uint64))


PARITY = [f"parity{i}" for i in range(4)]
KEYS = "d long, t long, line int, full long, n int, a long, b long, c long, e long, " + ", ".join(f"{c} long" for c in PARITY)


def _keys(batches, least: int, words_per_edit: int, often_at: int, chunk: int):
    """Each line's hash, words and, by the bound it has, the hashes of its runs or the parities of its words.

    Runs are the first and last h words, h half of the power of two its length has; parities are one bit for each of 256
    groups of words, the second of a word in a line being another word than its first: whether the line has an odd number
    of them. Rows without a line
    tell frequent grams: the gram as `full`, and as `n` how many different lines of a chunk of long lines have it.
    """
    lines, grams, size = [], [], 0  # hashes of long lines; (line from 0, gram)

    def rows(columns, count):
        columns = [columns.get(name, pa.nulls(count, pa.int32() if name in ("line", "n") else pa.int64())) for name in (*PLACE, "full", "n", *"abce", *PARITY)]
        return pa.RecordBatch.from_arrays(columns, names=[*PLACE, "full", "n", *"abce", *PARITY])

    def frequent():
        told = np.concatenate(lines)
        first = np.zeros(len(told), bool)
        first[np.unique(told, return_index=True)[1]] = True  # a repeated line counts once
        of = np.concatenate([b + of for b, (of, _) in zip(np.cumsum([0, *map(len, lines[:-1])]), grams, strict=True)])
        gram = np.concatenate([g for _, g in grams])
        low = (gram & _U(MAYBE - 1)).astype(np.int64)
        some = (np.bincount(low, minlength=MAYBE) >= often_at)[low]  # few are, even by their low bits
        of, gram = of[some], gram[some]
        of, gram = of[first[of]], gram[first[of]]
        order = np.lexsort((of, gram))
        of, gram = of[order], gram[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])][: len(gram)]
        found, seen = np.unique(gram[new], return_counts=True)
        often = seen >= often_at
        return rows({"full": pa.array(found[often].view(np.int64)), "n": pa.array(seen[often].astype(np.int32))}, int(often.sum()))

    for batch in frugal(batches):
        for at, row, number, begin, stop, s, (_, _, _, h) in _lines(batch.column(2), least):
            n = stop - begin
            full = _full(s, begin, stop)
            none = (n < MIN_WORDS) | (n > 2 * words_per_edit)
            runs = []
            for length in (n, n - 1):  # a partner may be one word shorter
                half = np.where(n < MIN_WORDS, 0, 2 ** (np.floor(np.log2(np.maximum(length, 2))).astype(int) - 1))
                salt = mix(half.astype(np.uint64))
                runs.append((mix(_run(s, begin, begin + half) + salt), mix(_run(s, stop - half, stop) + ~salt), half))
            same = runs[0][2] == runs[1][2]
            null = lambda x, gone: pa.array(x.view(np.int64), mask=gone)
            take = pa.array(at + row)
            short = n < 2 * words_per_edit
            columns = {"d": batch.column(0).take(take), "t": batch.column(1).take(take), "line": pa.array(number)}
            columns |= {"full": pa.array(full.view(np.int64)), "n": pa.array(n.astype(np.int32))}
            columns |= {"a": null(runs[0][0], none), "b": null(runs[0][1], none), "c": null(runs[1][0], none | same), "e": null(runs[1][1], none | same)}
            for name, told in zip(PARITY, _parities(h, begin[~short], stop[~short]), strict=True):
                whole = np.zeros(len(n), np.uint64)
                whole[~short] = told
                columns[name] = null(whole, short)
            yield rows(columns, len(n))
            for begin, stop, of, _, gram in _grams(s, begin[~short], stop[~short]):
                lines.append(_full(s, begin, stop))
                grams.append((of, gram))
                size += len(gram)
            if size >= chunk:
                yield frequent()
                lines, grams, size = [], [], 0
    if lines:
        yield frequent()


def _parities(h: np.ndarray, all_begin: np.ndarray, all_stop: np.ndarray) -> list[np.ndarray]:
    """The parities of lines as four numbers of 64 bits each."""
    out = [np.zeros(len(all_begin), np.uint64) for _ in PARITY]
    for lo in range(0, len(all_begin), 1 << 16):
        begin, count = all_begin[lo : lo + (1 << 16)], (all_stop - all_begin)[lo : lo + (1 << 16)]
        of = np.repeat(np.arange(len(begin)), count)
        at, first = np.arange(len(of)), np.cumsum(count) - count
        cell = np.sort(of.astype(np.uint64) << _U(48) | h[begin[of] + at - first[of]] >> _U(16))
        again = at - np.maximum.accumulate(np.where(np.r_[True, cell[1:] != cell[:-1]], at, 0))
        told = mix(cell & _LOW | again.astype(np.uint64) << _U(48))
        bit, part = _U(1) << (told & _U(63)), (told >> _U(6)) & _U(3)
        for k, whole in enumerate(out):
            whole[lo : lo + len(begin)] = np.bitwise_xor.reduceat(np.where(part == _U(k), bit, _U(0)), first)
    return out


def _variants(batches):
    """The variants of the listed lines, and their words: columns d, t, text, lines."""
    for batch in frugal(batches):
        for at, row, number, begin, stop, s, use, texts in _listed(batch):
            down = powers(len(s))[1]
            out = []
            for i in use:
                b, e = int(begin[i]), int(stop[i])
                p = np.arange(b, e)
                gone = (s[p] - s[b : b + 1]) * down[b] + (s[e : e + 1] - s[p + 1]) * down[b + 1]
                own = (s[e : e + 1] - s[b : b + 1]) * down[b : b + 1]
                out.append(mix(np.r_[own + _U(e - b), gone + _U(e - b - 1)]))
            ends = np.cumsum([0, *map(len, out)])
            take = pa.array(at + row[use])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array(number[use]), texts,
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).view(np.int64))),
            ], names=[*PLACE, "words", "variants"])


def _listed(batch):
    """What _lines gives, the listed ones of these lines and their words: columns d, t, text, lines (numbers)."""
    wanted = batch.column(3)
    for at, row, number, begin, stop, s, (data, start, end, _) in _lines(batch.column(2), 1):
        lists = {r: set(wanted[int(at + r)].as_py()) for r in np.unique(row)}
        use = [i for i in range(len(row)) if int(number[i]) in lists[row[i]]]
        if use:
            texts = [data[start[begin[i]] : end[stop[i] - 1]].tobytes().decode() for i in use]
            yield at, row, number, begin, stop, s, use, pa.array(texts, pa.string())


def _said(batches):
    """The hash and words of the listed lines: columns d, t, text, lines."""
    for batch in frugal(batches):
        for _, _, _, begin, stop, s, use, texts in _listed(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_full(s, begin, stop)[use].view(np.int64)), texts], names=["full", "words"])


def _grams(s: np.ndarray, all_begin: np.ndarray, all_stop: np.ndarray):
    """(first and last words, line of each gram from 0, its place in the line, 39 bits of its hash) of at most 65,536 lines
    at a time."""
    hashes = mix((s[GRAM:] - s[:-GRAM]) * powers(len(s))[1][: max(0, len(s) - GRAM)]) >> _U(25)
    for lo in range(0, len(all_begin), 1 << 16):
        begin, stop = all_begin[lo : lo + (1 << 16)], all_stop[lo : lo + (1 << 16)]
        count = stop - begin - GRAM + 1
        of = np.repeat(np.arange(len(begin)), count)
        at = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        yield begin, stop, of, at, hashes[begin[of] + at]


def _ordered_grams(s: np.ndarray, all_begin: np.ndarray, all_stop: np.ndarray, frequent: np.ndarray, maybe: np.ndarray):
    """(line of each gram from 0, 40 bits of its hash, its place, hashes of the lines, words of the lines), sorted and
    distinct.

    The highest of the 40 bits says whether the gram is a frequent one; maybe tells by its low bits whether it can be. Places
    are 256ths of the line, rounded down, and ANYWHERE for grams that a line has twice.
    """
    for begin, stop, of, at, gram in _grams(s, all_begin, all_stop):
        some = np.flatnonzero(maybe[gram & _U(MAYBE - 1)])
        if len(some):
            found = np.minimum(np.searchsorted(frequent, gram[some]), len(frequent) - 1)
            gram[some[frequent[found] == gram[some]]] |= _U(1) << _U(39)
        place = np.minimum(at * 256 // (stop - begin)[of], 254)
        both = np.sort((of.astype(np.uint64) << _U(40) | gram) << _U(8) | place.astype(np.uint64))
        place, both = (both & _U(255)).astype(np.int64), both >> _U(8)
        new = np.r_[True, both[1:] != both[:-1]]
        again = np.flatnonzero(~new)
        place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]] = ANYWHERE
        both, place = both[new], place[new]
        yield (both >> _U(40)).astype(np.int64), both & _KEY, place, _full(s, begin, stop), stop - begin


def _maybe(frequent: np.ndarray) -> np.ndarray:
    """By the low bits of a gram, whether it can be a frequent one."""
    out = np.zeros(MAYBE, bool)
    out[frequent & _U(MAYBE - 1)] = True
    return out


def _long_grams(batch: pa.RecordBatch, words_per_edit: int, frequent: np.ndarray, maybe: np.ndarray, levels: np.ndarray):
    """What _ordered_grams gives of the long lines of a batch (d, text), and the levels of these lines."""
    level = np.searchsorted(levels, batch.column(0).to_numpy(zero_copy_only=False)).astype(np.uint64)
    for at, row, _, begin, stop, s, _ in _lines(batch.column(1), 2 * words_per_edit):
        lo, own = 0, level[at + row]
        for of, key, place, full, n in _ordered_grams(s, begin, stop, frequent, maybe):
            yield of, key, place, full, n, own[lo : lo + len(n)]
            lo += len(n)


def _blocks(batches, words_per_edit: int, blocks: int, frequent: np.ndarray, levels: np.ndarray, chunk: int):
    """The first grams of each line, packed by key range: block, keys and line hashes as bytes."""

    def pack(keys, fulls):
        key, full = np.concatenate(keys), np.concatenate(fulls)
        block = _block_of(key, blocks)
        # whole numbers of 16 bits are sorted by their bytes
        order = np.argsort(block.astype(np.uint16 if blocks <= 1 << 16 else np.uint32), kind="stable")
        at = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        ends = np.r_[at, len(order)] * 8
        cells = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x[order])]) for x in (key, full)]
        return pa.RecordBatch.from_arrays([pa.array(block[order][at].astype(np.int32)), *cells], names=["block", "keys", "fulls"])

    keys, fulls, size, maybe = [], [], 0, _maybe(frequent)
    for batch in frugal(batches):
        for of, key, place, full, n, level in _long_grams(batch, words_per_edit, frequent, maybe, levels):
            rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(full)))[of]
            use = rank <= (n // words_per_edit * GRAM)[of]
            line = _length_class(n).astype(np.uint64) << _U(16) | level
            keys.append(key[use] & _KEY | (line[of[use]] | place[use].astype(np.uint64) << _U(8)) << _U(40))
            fulls.append(full[of[use]])
            size += int(use.sum())
            if size >= chunk:
                yield pack(keys, fulls)
                keys, fulls, size = [], [], 0
    if size:
        yield pack(keys, fulls)


def _block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(key & _KEY) >> _U(33)) % _U(blocks)


def _length_class(n: np.ndarray) -> np.ndarray:
    """Lengths by powers of LENGTH_STEP, in a byte."""
    return np.minimum(np.log(n) / np.log(LENGTH_STEP), 255).astype(np.int64)


def _bounds(words_per_edit: int) -> tuple[int, int]:
    """By how much the length classes of lines within the bound may differ, and the places of a gram they share.

    Lengths differ by one word in words_per_edit at most, and so does the place of a gram from its line's start and end
    taken together; one more for the rounding down of both.
    """
    return int(np.ceil(np.log(1 + 1 / words_per_edit) / np.log(LENGTH_STEP))), 256 // words_per_edit + 2


SHARED = "key long, full long, other long, place int, lines int"


def _shared(batches, words_per_edit: int):
    """What the lines of each key mean for each other, in blocks whose rows stand together in their partition.

    The head of a key is the line of the lowest level, and of those the one with the least hash. It makes a pair with each
    other line of fitting length and place: rows (null, full, other, null), the lesser hash first. Where a key has more
    lines than two, all but the head follow as (key, full, null, place, lines of the key). Lines without a partner of fitting length and
    place are left out.
    """
    far, away = _bounds(words_per_edit)

    def found(keys, fulls):
        key, full = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(fulls), np.uint64)
        # most keys are of one line: those that even their low bits tell go first
        slot = (key & _U((1 << 22) - 1)).astype(np.int64)
        some = np.bincount(slot, minlength=1 << 22)[slot] > 1
        key, full = key[some], full[some]
        if not len(key):
            return
        meta, key = (key >> _U(40)).astype(np.int64), key & _KEY
        # lines by their first 24 bits: one told twice stands beside itself but for rare ties, which do no harm
        order = np.argsort(key << _U(24) | full >> _U(40))
        key, full, meta = key[order], full[order], meta[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (full[1:] != full[:-1])])
        level = np.minimum.reduceat(meta & 255, first)
        key, full, size, place = key[first], full[first], meta[first] >> 16, meta[first] >> 8 & 255
        order = np.flatnonzero(_members(key) > 1)
        order = order[np.lexsort((size[order], key[order]))]
        order = order[_with_partner(key[order], size[order], place[order], words_per_edit)]
        order = order[np.lexsort((full[order], level[order], key[order]))]
        key, full, size, place = key[order], full[order], size[order], place[order]
        members = _members(key)
        lead = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        near = (np.abs(place - place[head]) <= away) | (place == ANYWHERE) | (place[head] == ANYWHERE)
        near &= (np.abs(size - size[head]) <= far) & (full != full[head])
        one, two = full[near], full[head][near]
        one, two = np.minimum(one, two), np.maximum(one, two)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        once = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
        none = pa.nulls(int(once.sum()), pa.int64())
        yield batch_of(key=none, full=pa.array(one[once].view(np.int64)), other=pa.array(two[once].view(np.int64)), place=none.cast(pa.int32()), lines=none.cast(pa.int32()))
        rest = ~lead & (members > 2)
        key, full, place = key[rest].view(np.int64), full[rest].view(np.int64), place[rest].astype(np.int32)
        yield batch_of(key=pa.array(key), full=pa.array(full), other=pa.nulls(len(key), pa.int64()), place=pa.array(place), lines=pa.array(members[rest].astype(np.int32)))

    now, keys, fulls = None, [], []
    for batch in frugal(batches):
        for block, key, full in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if block != now and keys:
                yield from found(keys, fulls)
                keys, fulls = [], []
            now = block
            keys.append(key.as_py())
            fulls.append(full.as_py())
    if keys:
        yield from found(keys, fulls)


def _members(key: np.ndarray) -> np.ndarray:
    """How many rows have the key of each row, of rows sorted by key."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(key)])
    return np.repeat(count, count)


def _with_partner(key: np.ndarray, size: np.ndarray, place: np.ndarray, words_per_edit: int) -> np.ndarray:
    """Which rows may have a partner, of rows sorted by (key, size): all that have one, and any not looked at to the end.

    Each is held against the LOOK_AHEAD rows after it at most.
    """
    far, away = _bounds(words_per_edit)
    use = np.zeros(len(key), bool)
    left = np.arange(len(key))
    for step in range(1, LOOK_AHEAD + 1):
        left = left[left + step < len(key)]
        left = left[(key[left] == key[left + step]) & (size[left + step] - size[left] <= far)]
        if not len(left):
            return use
        other = left + step
        near = (np.abs(place[left] - place[other]) <= away) | (place[left] == ANYWHERE) | (place[other] == ANYWHERE)
        use[left[near]] = use[other[near]] = True
    # groups of more rows of one length stay whole
    for i in np.unique(key[left]):
        use[np.searchsorted(key, i) : np.searchsorted(key, i, "right")] = True
    return use


def within_edits(a: str, b: str, words_per_edit: int = WORDS_PER_EDIT) -> bool:
    """Whether word sequences differ by at most one edit for each words_per_edit words of the shorter, or by one; A-Z
    equals a-z."""
    x, y = (s.encode().lower().split() for s in (a, b))  # bytes part at ASCII white space only
    bound = max(1, min(len(x), len(y)) // words_per_edit)
    if abs(len(x) - len(y)) > bound:
        return False
    p, q = Counter(x), Counter(y)
    return max((p - q).total(), (q - p).total()) <= bound and _edited(x, y, bound)


def _edited(x: list, y: list, bound: int) -> bool:
    """Whether at most bound edits lead from one sequence to the other."""
    # what both begin and end with has no part in the distance
    least = min(len(x), len(y))
    begin = next((i for i in range(least) if x[i] != y[i]), least)
    end = next((i for i in range(least - begin) if x[-1 - i] != y[-1 - i]), least - begin)
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    n, m = len(x), len(y)
    if max(n, m) <= bound:
        return True

    def along(i: int, d: int) -> int:
        while i < n and i + d < m and x[i] == y[i + d]:
            i += 1
        return i

    # how far into x each diagonal reaches with the edits so far
    far = {0: along(0, 0)}
    for e in range(1, bound + 1):
        if far.get(m - n) == n:
            return True
        now = {}
        for d in range(-e, e + 1):
            i = max(far.get(d, -n - m) + 1, far.get(d - 1, -n - m), far.get(d + 1, -n - m) + 1)
            now[d] = along(min(i, n, m - d), d) if i + d >= 0 else -n - m
        far = now
    return far.get(m - n) == n


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the lowered words of some texts, and the text of each from 0."""
    for _, data, offsets in text_slices(texts, 1 << 62):
        low = lowered(data)
        start, end, row = words(low, offsets)
        return span_hash(prefix_hash(low), start, end) >> _U(16), row
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


def near_pairs(one: pa.Array, two: pa.Array, words_per_edit: int, of: list | None = None, done: set | None = None) -> np.ndarray:
    """within_edits for each pair of two text columns: exactly for those whose bags of words differ by no more.

    With `of` telling what each pair is of, pairs of what is done are passed over as not near, and a near pair makes its own done.
    """
    out = np.zeros(len(one), bool)
    for lo in range(0, len(one), 256):
        a, b = one.slice(lo, 256), two.slice(lo, 256)
        (ha, ra), (hb, rb) = _hashed(a), _hashed(b)
        na, nb = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(a))
        bound = np.maximum(1, np.minimum(na, nb) // words_per_edit)
        cell = np.concatenate([ra.astype(np.uint64) << _U(48) | ha, rb.astype(np.uint64) << _U(48) | hb])
        order = np.argsort(cell)
        cell, sign = cell[order], np.where(order < len(ha), 1, -1)
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        more = np.add.reduceat(sign, begin) if len(cell) else np.zeros(0, int)
        row = (cell[begin] >> _U(48)).astype(np.int64)
        maybe = np.abs(na - nb) <= bound
        for side in (more, -more):
            maybe &= np.bincount(row, np.maximum(side, 0), len(a)) <= bound
        for i in np.flatnonzero(maybe):
            if of is None or of[lo + i] not in done:
                out[lo + i] = _edited(*(t[int(i)].as_py().encode().lower().split() for t in (a, b)), int(bound[i]))
                if of is not None and out[lo + i]:
                    done.add(of[lo + i])
    return out


def _near(batches, words_per_edit: int):
    """Rows whose first two columns, words of lines, are within the bound, without these columns; of equal ones in the third,
    the line, one or more."""
    done: set = set()
    for batch in frugal(batches):
        use = pa.array(near_pairs(batch.column(0), batch.column(1), words_per_edit, batch.column(2).to_pylist(), done))
        yield batch.select(range(2, batch.num_columns)).filter(use)


def _near_short(rows: DataFrame, first: DataFrame, words_per_edit: int) -> tuple[DataFrame, list[DataFrame]]:
    """d, t, line of lines with an earlier one within one edit, and the tables to release once they are written."""
    short = first.where(F.col("n").between(MIN_WORDS, 2 * words_per_edit))
    runs = short.select("p", F.explode(F.array(*"abce")).alias("run")).where("run is not null")
    shared = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    near = durable(runs.join(shared, "run").select("p.*").groupBy("d", "t").agg(F.collect_set("line").alias("lines")), "near-lines")
    some = durable(_texts(rows, near).mapInArrow(_variants, "d long, t long, line int, words string, variants array<long>"), "variants")
    # place 0 is the line itself, place p + 1 its form without word p
    twice = some.select(F.explode("variants").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = durable(some.select(F.struct(*PLACE).alias("p"), F.posexplode("variants").alias("gap", "key")).join(twice, "key"), "shared-variants")
    least = keyed.groupBy("key", "gap").agg(F.min("p").alias("first"), F.count("*").alias("n"))
    swapped = keyed.where("gap > 0").join(least.where("gap > 0 and n > 1").drop("n"), ["key", "gap"]).where("p > first").select("p", "first")
    whole, cut = F.min(F.when(F.col("gap") == 0, F.col("first"))), F.min(F.when(F.col("gap") > 0, F.col("first")))
    either = least.groupBy("key").agg(whole.alias("whole"), cut.alias("cut")).where("whole is not null and cut is not null")
    added = keyed.join(either, "key").select("p", F.when(F.col("gap") == 0, F.col("cut")).otherwise(F.col("whole")).alias("first")).where("p > first")
    said = some.select(F.struct(*PLACE).alias("p"), "words").dropDuplicates(["p"])
    pairs = swapped.union(added).distinct().join(said, "p").join(said.select(F.col("p").alias("first"), F.col("words").alias("other")), "first")
    told = pairs.select("words", "other", F.xxhash64("p").alias("of"), "p.*").mapInArrow(lambda b: _near(b, words_per_edit), "of long, d long, t long, line int")
    return told.select(*PLACE), [near, some, keyed]


def _near_long(rows: DataFrame, lines: DataFrame, first: DataFrame, words_per_edit: int) -> tuple[DataFrame, list[DataFrame]]:
    """d, t, line of long lines with an earlier one within the bound, and the tables to release once they are written."""
    w = words_per_edit
    long = first.where(F.col("n") >= 2 * w).select("full", "p", "n", *PARITY)
    words_in = lines.where((F.col("n") >= 2 * w) & F.col("line").isNotNull()).agg(F.sum("n")).first()[0] or 0
    if not words_in:
        return long.select("p.*").limit(0), []
    seen = lines.where(F.col("line").isNull()).groupBy("full").agg(F.sum("n").alias("seen"))
    top = seen.orderBy(F.desc("seen"), "full").limit(MOST_FREQUENT).select("full").collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    spans = [2.0 ** (k - OCTAVES) for k in range(1, OCTAVES)]
    ids = long.agg(F.percentile_approx("p.d", spans + [k / LEVELS for k in range(1, LEVELS)], 10_000)).first()[0]
    spans, levels = ids[: len(spans)], np.array(ids[len(spans) :], np.int64)
    blocks, chunk, away = 1 + int(words_in * GRAM / w / BLOCK), CHUNK, _bounds(w)[1]
    packed = rows.select("d", "text").mapInArrow(lambda b: _blocks(b, w, blocks, frequent, levels, chunk), "block int, keys binary, fulls binary")
    shared = durable(packed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lambda b: _shared(b, w), SHARED), "line-keys")
    bound = F.floor(F.least("n1", "n2") / w)
    unlike = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in PARITY), F.lit(0))
    apart = F.abs(F.col("n1") - F.col("n2"))  # so many edits put a word in or take one out
    fits = (apart <= bound) & (unlike <= 2 * bound - apart)

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(df.select(*[F.col(c).alias(c if c == "key" else c + end) for c in df.columns]) for end in ("1", "2"))

    def later(pairs: DataFrame, name: str) -> DataFrame:
        """The later lines of those pairs (full1, full2, p1, p2) whose words are within the bound: full and p."""
        pairs = durable(pairs, f"{name}-pairs")
        places = durable(pairs.select("p1.*").union(pairs.select("p2.*")).groupBy("d", "t").agg(F.collect_set("line").alias("lines")), f"{name}-places")
        said = durable(_texts(rows, places).mapInArrow(_said, "full long, words string").dropDuplicates(["full"]), f"{name}-words")
        told = pairs.join(said.toDF("full2", "words2"), "full2").join(said.toDF("full1", "words1"), "full1")
        full, p = [F.when(F.col("p1") < F.col("p2"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")) for c in ("full", "p")]
        told = told.select("words1", "words2", full.alias("full"), p.alias("p")).select("words1", "words2", "full", "p.*")
        got = durable(told.mapInArrow(lambda b: _near(b, w), "full long, d long, t long, line int").distinct(), name)
        release(pairs, places, said)
        return got

    mine, other = sides(long)
    pairs = shared.where(F.col("other").isNotNull()).select(F.col("full").alias("full1"), F.col("other").alias("full2")).distinct()
    soon = later(pairs.join(mine, "full1").join(other, "full2").where(fits).select("full1", "full2", "p1", "p2"), "near-heads")
    settled = soon.select("full", F.lit(True).alias("settled"))
    met = durable(shared.where(F.col("key").isNotNull()).select("key", "full", "place", "lines").join(long, "full").join(settled, "full", "left"), "met")
    some, most = [met.where(c).drop("lines") for c in (F.col("lines") <= FEW, F.col("lines") > FEW)]
    keys = most.groupBy("full").agg(F.collect_set("key").alias("keys"))
    known = [F.size("keys").alias("weight"), F.filter("keys", lambda x: x < F.col("key")).alias("before")]
    most = durable(most.join(keys, "full").select(*known, *most.columns), "met-often")

    def earlier(lines: DataFrame, others: DataFrame, once: Column) -> DataFrame:
        """Pairs of those lines that are not settled with such earlier others of their keys as may be within the bound."""
        mine, other = sides(lines.where(F.col("settled").isNull()).drop("settled"))[0], sides(others.drop("settled"))[1]
        return mine.join(other, "key").where((F.col("p2") < F.col("p1")) & once & fits).select("full1", "full2", "p1", "p2")

    columns = ["weight", *[c for c in most.columns if c not in ("key", "weight", "settled")]]
    middle = F.max(F.struct(*columns)).alias("middle")
    middles = most.groupBy("key", _octave(spans).alias("octave")).agg(middle).select("key", *[F.col("middle").getField(c).alias(c) for c in columns])
    near = (F.abs(F.col("place1") - F.col("place2")) <= away) | (F.col("place1") == ANYWHERE) | (F.col("place2") == ANYWHERE)
    then = later(earlier(most, middles, near).distinct(), "near-middles")
    some, left = [df.join(then.select("full"), "full", "left_anti") for df in (some, most)]
    # a pair within the bound has one key at least where places fit, but the first that it shares need not be that one
    rest = earlier(left, most, ~F.arrays_overlap("before1", "before2")).union(earlier(some, met.where(F.col("lines") <= FEW).drop("lines"), near))
    late = later(rest.distinct(), "near-other")
    return soon.union(then).union(late).select(*PLACE), [shared, met, most, soon, then, late]


def _octave(spans: list[int]) -> Column:
    """Of a line's place p, the span of documents between these ids; without an id, one by the hash of the text."""
    by_id = sum(((F.col("p.d") >= d).cast("int") for d in spans), F.lit(0))
    by_text = F.greatest(F.floor(F.log2((F.col("p.t") + F.lit(2.0**63)) / 2.0**64)), F.lit(1 - OCTAVES)).cast("int")
    return F.when(F.col("p.d") == NO_ID, by_text - 1).otherwise(by_id)


def _texts(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """d, t, text, lines of the rows that listed (d, t, lines) names; rows alike in d and t come each."""
    if few_lists(listed, "lines"):
        return rows.join(F.broadcast(listed), ["d", "t"]).select("d", "t", "text", "lines")
    few = rows.join(broadcast_if_small(listed.select("d", "t")), ["d", "t"], "left_semi")
    return few.join(listed, ["d", "t"]).select("d", "t", "text", "lines")


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")]


def removed_lines(docs: DataFrame, least: int = 1, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """d, t, gone: for each row of docs with lines to remove, (id, hash of the text) and their numbers from 0."""
    if words_per_edit < 5:
        raise ValueError("words_per_edit is 5 at least")
    rows = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    often_at, chunk = SEEN_OFTEN, CHUNK
    every = durable(rows.mapInArrow(lambda b: _keys(b, least, words_per_edit, often_at, chunk), KEYS), "lines")
    lines = every.where(F.col("line").isNotNull())
    own = [F.min(k).alias(k) for k in ("n", *"abce", *PARITY)]
    first = durable(lines.groupBy("full").agg(F.min(F.struct(*PLACE)).alias("p"), F.count("*").alias("times"), *own), "first-lines")
    repeated = broadcast_if_small(first.where("times > 1").select("full", "p"))
    again = lines.select(*PLACE, "full").join(repeated, "full").where(F.struct(*PLACE) > F.col("p")).select(*PLACE)
    short, spent = _near_short(rows, first, words_per_edit)
    long, more = _near_long(rows, every, first, words_per_edit)
    gone = durable(again.union(short).union(long).groupBy("d", "t").agg(F.collect_set("line").alias("gone")), "removed-lines")
    release(every, first, *spent, *more)
    return gone


def _deduped(docs: DataFrame, least: int, words_per_edit: int) -> DataFrame:
    """row (a struct of the columns of docs, text without its repeats), n_lines, n_removed."""
    d, t, went = fresh_names(docs, "d", "t", "gone")
    gone = removed_lines(docs, least, words_per_edit).withColumnsRenamed({"d": d, "t": t, "gone": went})
    keyed = docs.select("*", *[c.alias(x) for c, x in zip(_key(), (d, t), strict=True)])
    got = keyed.join(F.broadcast(gone), [d, t], "left") if few_lists(gone, went) else join_few(keyed, gone, [d, t])
    # the lambda binds the lines, so that the text is split once
    kept = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(went))
    stay = F.transform(F.array(F.split("text", "\n")), lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col(went).isNull(), F.col("text")).otherwise(F.get(stay, F.lit(0)))
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col(went).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    row = F.struct(*[own.get(c, F.col(c)).alias(c) for c in docs.columns]).alias("row")
    return got.select(row, lines.alias("n_lines"), F.coalesce(F.size(went), F.lit(0)).alias("n_removed"))


def dedup_lines(docs: DataFrame, least: int = 1, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, text without repeated lines, and n_lines, n_removed.

    Lines end at \\n. A line of at least `least` words goes if an earlier line, by (doc_id, hash of the text, number), is
    equal; one of five words or more also if an earlier line of five words or more differs by no more edits of words than
    the bound: one for each words_per_edit words of the shorter line (5 at least), and one at least. It does not matter
    whether the earlier line stays. A-Z equals a-z and the width of white space does not count. Lines without words stay.

    n_chars, where there is one, follows the text of rows that lose lines. Columns of docs named n_lines or n_removed give
    way to the new ones. Null texts stay null and empty ones empty; rows without doc_id come first in order; rows alike in
    doc_id and text are one place and keep their lines together. One row per row of docs; an empty table gives none. A
    very long text is one row of its own in the tasks that read it, and its lines are dealt out like all others.
    """
    got = _deduped(docs, least, words_per_edit)
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def dedup_documents(docs: DataFrame, least: int = 1, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """The rows of docs with their own columns, as dedup_lines leaves them, but for those that lost all of their words."""
    got = _deduped(docs, least, words_per_edit).where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]"))
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
