"""Removal of byte strings that stand earlier in the corpus, by longest previous factors.

A byte goes if a string of LENGTH bytes over it also starts earlier, that is, if the longest previous factor (LPF) of
that start is LENGTH or more. A suffix array of a whole corpus does not fit any machine, and LPF need not be known beyond
LENGTH, so suffixes are ordered in bounded groups. Every start belongs to an anchor, the GRAM bytes with the smallest hash
among the WINDOW grams inside its string. Equal strings have equal anchors at equal places, so a start's previous factor
is among the starts of equal anchors, and an anchor that stands once in the corpus settles all of its starts at once.

1. Per text: the anchors, each with its run of starts and a hash of all bytes of those starts' strings (its context).
2. Anchors in the order of (anchor, context, position): a run whose context equals the one before repeats as a whole. Of
   an anchor with several contexts the first run of each stays open.
3. The bytes of open runs meet by anchor. The starts of whole groups are put in suffix order; inside a stretch of
   suffixes that share LENGTH bytes the previous and the next smaller position in that order give the earlier matches.
4. A group too large for that is taken apart: its strings are dealt by their hash, sorted by their bytes and position, and
   each has the previous smaller position right before it.
5. The covered bytes are merged per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, flat, flat_binary
from .wordhash import _BACK, _BASE, BYTES, mixed, powers

LENGTH, GRAM = 100, 48
WINDOW = LENGTH - GRAM + 1
#: Bytes that are hashed at once; a longer text is handled in blocks that share LENGTH - 1 bytes.
BLOCK = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)  # room for a place in a block beside the hash, for the smallest of both

#: Starts of which the suffixes are ordered at once, and bytes of runs of one anchor from which on it is taken apart.
STARTS, GROUP_BYTES = 100_000, 8 << 20
#: An anchor with HOT_CONTEXTS or more contexts in a sample of one in HOT_SHARE rows is hot; at most HOT are so named.
HOT, HOT_SHARE, HOT_CONTEXTS = 4096, 64, 16

# A text is two longs, o (its id) and k (a hash of it). A run is one: done (1 bit) | hot (1) | first start (32) | starts less 1 (7).
_START, _HOT, _DONE = 7, 61, 62
_MORE = (1 << _START) - 1
#: Stands for a null id, before all others.
_NULL_ID = -(2**63)


def _block_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    down = powers(_BACK, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums, down


def _grams(sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, values.max(), values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: per anchor its hash, its context's hash, first start, starts less 1.

    ``ends`` has for every byte the end of its text.
    """
    n = len(data)
    none = np.zeros(0, np.uint64)
    if n < LENGTH:
        return none, none, *[np.zeros(0, np.int64)] * 2
    sums, down = _block_sums(data)
    grams = _grams(sums, down)
    place = np.arange(n - GRAM + 1, dtype=np.uint64)
    best = (_smallest((grams & ~_PLACE) | place, WINDOW) & _PLACE).astype(np.int64)
    start = np.arange(n - LENGTH + 1)
    inside = start + LENGTH <= ends[: n - LENGTH + 1]
    start, best = start[inside], best[inside]
    if not len(start):
        return none, none, *[np.zeros(0, np.int64)] * 2
    fresh = np.ones(len(start), bool)
    fresh[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at = start[first], start[last], best[first]
    shape = ((hi - lo) << 8 | (at - lo)).astype(np.uint64)
    context = mixed((sums[hi + LENGTH] - sums[lo]) * down[lo] + mixed(shape + np.uint64(1)))
    return grams[at], context, lo, hi - lo


def _blocks(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of a chunk: bytes, every byte's end of text, every byte's row, and what to add to a start."""
    data, offsets = flat(part.column("text"))
    if len(offsets) == 2 and len(data) > BLOCK:
        step = BLOCK - LENGTH + 1
        for start in range(0, len(data) - LENGTH + 1, step):
            block = data[start : start + BLOCK]
            yield block, np.full(len(block), len(block)), np.zeros(len(block), np.int64), start
    else:
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        yield data, offsets[1:][row], row, 0


def _apart(position: tuple[np.ndarray, ...], lead: np.ndarray) -> np.ndarray:
    """Where a row's position (o, k, p) is another than its lead's."""
    o, k, p = position
    return (o != o[lead]) | (k != k[lead]) | (p != p[lead])


def _local_first(keys: tuple[np.ndarray, ...], position: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and position, and where in it a row has an earlier one with equal keys."""
    order = np.lexsort((*position[::-1], *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, _apart(tuple(x[order] for x in position), lead)


def _dealt(keys: np.ndarray, done: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of the rows' tasks: what is done already is only passed on, so it goes anywhere and makes no key heavy."""
    return np.where(done, mixed(place.view(np.uint64) ^ keys), keys)


def _positions(o: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    return _rows(o=o, k=k, p=p)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _find_anchors(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All anchors with their runs. Those of ``hot`` are dealt by their contexts too, as no task should have all of one."""
    for part in chunks(batches, "text"):
        ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in "ok")
        for data, ends, row, shift in _blocks(part):
            anchor, context, lo, more = anchors(data, ends)
            o, k = ids[row[lo]], hashes[row[lo]]
            is_hot = np.isin(anchor, hot)
            place = _relative(lo, part, shift) << _START | more | is_hot.astype(np.int64) << _HOT
            order, again = _local_first((anchor, context), (o, k, place))
            place = place[order] | (again.astype(np.int64) << _DONE)
            key = np.where(is_hot, mixed(anchor ^ mixed(context)), anchor)[order]
            yield _rows(a=_dealt(key, again, place), c=context[order], o=o[order], k=k[order], p=place)


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors that meet many contexts, from a sample of the rows. They only say which runs are dealt by more than their
    anchor: results are the same whatever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            for data, ends, _, _ in _blocks(part):
                anchor, context, _, _ = anchors(data, ends)
                yield _rows(a=anchor, c=context)

    found = rows.sample(1 / HOT_SHARE, seed=5).mapInArrow(run, "a long, c long").distinct().groupBy("a").count()
    found = found.where(F.col("count") >= HOT_CONTEXTS).orderBy(F.desc("count"), "a").limit(HOT).collect()
    return np.array(sorted(r.a for r in found), np.int64).view(np.uint64)


def _relative(lo: np.ndarray, part: pa.RecordBatch, shift: int) -> np.ndarray:
    """Starts counted from the beginning of their own text."""
    if shift:
        return lo + shift
    _, offsets = flat(part.column("text"))
    return lo - offsets[np.searchsorted(offsets, lo, "right") - 1]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of anchor, context and position: those done (one of equal context stands before), and the
    open ones, which are the first of a context of an anchor with several, or of a hot one. Keeps one row between batches,
    however large a group is."""
    held = None  # keys of the last row, its context's first position, its anchor's first open row, whether it has several
    for batch in batches:
        position = [batch.column(c).to_numpy(zero_copy_only=False) for c in "okp"]
        done = position[2] >> _DONE & 1 == 1
        if done.any():
            yield _positions(*(x[done] for x in position))
        anchor, context = (batch.column(c).to_numpy(zero_copy_only=False)[~done] for c in "ac")
        o, k, p = (x[~done] for x in position)
        n = len(o)
        if not n:
            continue
        new_anchor = np.ones(n, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_context = np.ones(n, bool)
        new_context[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        if held:
            new_anchor[0] = anchor[0] != held["keys"][0]
            new_context[0] = (anchor[0], context[0]) != held["keys"]
        lead = np.maximum.accumulate(np.where(new_context, np.arange(n), -1))
        before = held["first"] if held else (0, 0, 0)
        lead_o, lead_k, lead_p = (np.where(lead >= 0, x[lead], y) for x, y in zip((o, k, p), before))
        again = ~new_context & ((o != lead_o) | (k != lead_k) | (p != lead_p))
        if again.any():
            yield _positions(o[again], k[again], p[again] | np.int64(1 << _DONE))
        group = np.cumsum(new_anchor)  # 0: that of the held row
        contexts = np.bincount(group, weights=new_context, minlength=group[-1] + 1)
        several = contexts > 1
        several[group[p >> _HOT & 1 == 1]] = True
        carried = bool(held) and group[0] == 0
        if carried:
            several[0] = held["several"] or contexts[0] > 0
            if several[0] and not held["several"]:
                yield _positions(*(np.array([x]) for x in held["open"]))
        open_ = new_context & several[group]
        if open_.any():
            yield _positions(o[open_], k[open_], p[open_])
        last = group[-1]
        if carried and last == 0:
            first_open = held["open"]
        else:
            at = int(np.flatnonzero(group == last)[0])
            first_open = (int(o[at]), int(k[at]), int(p[at]))
        held = {
            "keys": (anchor[-1], context[-1]),
            "first": (int(lead_o[-1]), int(lead_k[-1]), int(lead_p[-1])),
            "open": first_open,
            "several": bool(several[last]),
        }


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for part in chunks(batches, "text"):
        packed = [press.compress(x.as_buffer()) for x in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("o"), part.column("k"), pa.array(packed, pa.binary())], ["o", "k", "z"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
    """Each row by its batch and place, with its text."""
    press = zstandard.ZstdDecompressor()
    for part in chunks(batches, "z", 1 << 19):
        for k, z in enumerate(part.column("z")):
            yield part, k, press.decompress(z.as_buffer())


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count, one after another."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes [start, start + size) of ``data`` as one value each."""
    joined = data[np.repeat(start, size) + _within(size)].tobytes()
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def _windows(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each start as one value that compares by bytes: all are as long, so no end is ambiguous."""
    if not len(start):
        return np.zeros(0, f"S{LENGTH}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]).view(f"S{LENGTH}").ravel()


def _string_rows(o: np.ndarray, k: np.ndarray, p: np.ndarray, data: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows of single strings, dealt by their hash. Of equal ones the first goes on; the others are done."""
    sums, down = _block_sums(data)
    hashes = mixed((sums[start + LENGTH] - sums[start]) * down[start])
    values = _windows(data, start)
    order = np.lexsort((p & ~np.int64(_MORE), k, o, hashes))
    hashes, values, o, k, p, start = (x[order] for x in (hashes, values, o, k, p, start))
    new = np.ones(len(o), bool)
    new[1:] = values[1:] != values[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    again = _apart((o, k, p), lead)
    p = p | (again.astype(np.int64) << _DONE)
    key = _dealt(hashes, again, p).view(np.int64)
    return _with_bytes(key, o, k, p, _binary(data, start, np.where(again, 0, LENGTH)))


def _with_bytes(a: np.ndarray, o: np.ndarray, k: np.ndarray, p: np.ndarray, w: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a, o, k, p)), w], ["a", "o", "k", "p", "w"])


def _find_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs with their anchor and bytes; those of hot anchors string by string."""
    held, size = [], 0  # strings of hot anchors of some texts, so that what these share is sent on once
    for part, row, text in _unpacked(batches):
        runs = part.column("runs")[row].values.to_numpy(zero_copy_only=False)
        runs = runs[runs >> _DONE & 1 == 0]
        if not len(runs):
            continue
        data = np.frombuffer(text, np.uint8)
        own = [part.column(c)[row].as_py() for c in "ok"]
        runs = runs[np.argsort(runs >> _START & 0xFFFFFFFF, kind="stable")]
        lo, more = runs >> _START & 0xFFFFFFFF, runs & _MORE
        for base in range(0, len(data), BLOCK):
            here = (lo >= base) & (lo < base + BLOCK)
            cold, hot = here & (runs >> _HOT & 1 == 0), here & (runs >> _HOT & 1 == 1)
            block = data[base : base + BLOCK + LENGTH + WINDOW]
            if cold.any():
                grams = _grams(*_block_sums(block))
                inside = (lo[cold] - base)[:, None] + np.arange(WINDOW)
                best = np.argmin(grams[inside] & ~_PLACE, axis=1)
                anchor = grams[inside[np.arange(len(best)), best]].view(np.int64)
                w = _binary(block, lo[cold] - base, more[cold] + LENGTH)
                yield _with_bytes(anchor, *(np.full(len(best), x) for x in own), runs[cold], w)
            if hot.any():
                start = np.repeat(lo[hot], more[hot] + 1) + _within(more[hot] + 1)
                held.append((*(np.full(len(start), x) for x in own), start << _START | 1 << _HOT, block, start - base))
                size += len(block) + 100 * len(start)
                if size > GROUP_BYTES:
                    yield _joined_strings(held)
                    held, size = [], 0
    if held:
        yield _joined_strings(held)


def _joined_strings(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    shifts = np.cumsum([0, *[len(x[3]) for x in held]])
    start = np.concatenate([x[4] + s for x, s in zip(held, shifts)])
    return _string_rows(*(np.concatenate([x[c] for x in held]) for c in range(4)), start)


def smaller_neighbours(position: list[int], joined: list[bool]) -> tuple[list[int], list[int]]:
    """Of suffixes in suffix order: the place of the previous and of the next smaller position inside each one's stretch,
    -1 for none. ``joined`` says of each suffix whether it shares LENGTH bytes with the one before. One pass with a stack
    of positions that rise."""
    before, after, stack = [-1] * len(position), [-1] * len(position), []
    for i, x in enumerate(position):
        if not joined[i]:
            stack = []
        while stack and position[stack[-1]] > x:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    return before, after


def repeated_starts(o: np.ndarray, k: np.ndarray, p: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions (o, k, p) of the runs of starts whose LPF among these runs is LENGTH or more.

    ``begin`` is where a run's bytes lie in ``data``. Starts are ordered by their suffixes as far as LENGTH bytes; the
    previous and next smaller positions of a stretch that shares them are its earlier matches.
    """
    count = (p & _MORE) + 1
    run = np.repeat(np.arange(len(p)), count)
    at = _within(count)
    values = _windows(data, begin[run] + at)
    order = np.argsort(values, kind="stable")  # suffix order
    joined = np.zeros(len(order) + 1, bool)
    joined[1:-1] = values[order[1:]] == values[order[:-1]]
    paired = joined[:-1] | joined[1:]  # the others have an LPF under LENGTH
    order, joined = order[paired], joined[:-1][paired]
    place = (p[run] >> _START & 0xFFFFFFFF) + at << _START
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((place, k[run], o[run]))] = np.arange(len(place))
    before, after = smaller_neighbours(rank[order].tolist(), joined.tolist())
    late = np.zeros(len(place) + 1, bool)
    late[order[(np.array(before, np.int64) >= 0) | (np.array(after, np.int64) >= 0)]] = True
    first = late[:-1] & ~(np.concatenate([[False], late[:-2]]) & (at > 0))
    first = np.flatnonzero(first)
    last = np.flatnonzero(late[:-1] & ~(late[1:] & np.append(run[1:] == run[:-1], False)))
    return np.stack([o[run[first]], k[run[first]], place[first] | (last - first) | 1 << _DONE])


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in the order of their anchors: the starts whose LPF is LENGTH or more. Whole groups are taken together up
    to STARTS starts; a group over GROUP_BYTES goes on string by string, and so do rows that are single strings already."""

    def settled(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if rows:
            o, k, p, data, size = (np.concatenate(x) for x in zip(*rows))
            yield _passed(*repeated_starts(o, k, p, data, np.cumsum(size) - size))

    whole, starts = [], 0  # runs of complete groups
    group, size, key, large = [], 0, None, False  # runs of the group that is being read
    last = None
    for batch in batches:
        a, o, k, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in "aokp")
        data, offsets = flat_binary(batch.column("w"))
        single = (p >> _DONE & 1 == 1) | (p >> _HOT & 1 == 1)
        if single.any():
            yield batch.filter(pa.array(single))
        rows = np.flatnonzero(~single)
        if not len(rows):
            continue
        same = np.zeros(len(rows), bool)  # a row that is there twice counts once
        same[1:] = ~_apart((o[rows], k[rows], p[rows]), np.arange(len(rows)) - 1)[1:]
        same[0] = last == (o[rows[0]], k[rows[0]], p[rows[0]])
        last = (o[rows[-1]], k[rows[-1]], p[rows[-1]])
        rows = rows[~same]
        edges = np.flatnonzero(np.append(True, a[rows[1:]] != a[rows[:-1]])) if len(rows) else ()
        for i, j in zip(edges, [*edges[1:], len(rows)]):
            mine = rows[i:j]
            if key is None or a[mine[0]] != key:
                whole.extend(group)
                starts += sum(int((x[2] & _MORE).sum()) + len(x[2]) for x in group)
                if starts > STARTS:
                    yield from settled(whole)
                    whole, starts = [], 0
                group, size, key, large = [], 0, a[mine[0]], False
            sizes = offsets[mine + 1] - offsets[mine]
            piece = data[np.repeat(offsets[mine], sizes) + _within(sizes)]
            group.append((o[mine], k[mine], p[mine], piece, sizes))
            size += len(piece)
            large = large or size > GROUP_BYTES
            if large:
                go, gk, gp, gdata, gsize = (np.concatenate(x) for x in zip(*group))
                count = (gp & _MORE) + 1
                run, at = np.repeat(np.arange(len(gp)), count), _within(count)
                place = (gp[run] >> _START & 0xFFFFFFFF) + at << _START
                yield _string_rows(go[run], gk[run], place, gdata, (np.cumsum(gsize) - gsize)[run] + at)
                group = []
    yield from settled(whole + group)


def _passed(o: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    none = pa.array([b""] * len(o), pa.binary())
    return _with_bytes(mixed(p.view(np.uint64) ^ k.view(np.uint64)).view(np.int64), o, k, p, none)


def _same_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings in the order of their hash, bytes and position: those done. Keeps one row between batches."""
    held = None  # the last string, and the position of the first equal to it
    for batch in batches:
        position = [batch.column(c).to_numpy(zero_copy_only=False) for c in "okp"]
        done = position[2] >> _DONE & 1 == 1
        if done.any():
            yield _positions(*(x[done] for x in position))
        o, k, p = (x[~done] for x in position)
        if not len(o):
            continue
        data, offsets = flat_binary(batch.column("w"))
        values = _windows(data, offsets[:-1][~done])
        new = np.ones(len(o), bool)
        new[1:] = values[1:] != values[:-1]
        new[0] = held is None or values[0] != held[0]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(o)), -1))
        lead_o, lead_k, lead_p = (np.where(lead >= 0, x[lead], y) for x, y in zip((o, k, p), held[1] if held else (0, 0, 0)))
        again = (o != lead_o) | (k != lead_k) | (p != lead_p)
        if again.any():
            yield _positions(o[again], k[again], p[again] | np.int64(1 << _DONE))
        held = values[-1], (int(lead_o[-1]), int(lead_k[-1]), int(lead_p[-1]))


def removed_runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of the bytes that the strings of these runs of starts cover."""
    lo = places >> _START & 0xFFFFFFFF
    hi = lo + (places & _MORE) + LENGTH
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(fresh)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, k, data in _unpacked(batches):
        found = [part.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("runs", "late") if part.column(c)[k].is_valid]
        places = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        places = places[places >> _DONE & 1 == 1]
        begin, end = removed_runs(places) if len(places) else (places, places)
        stops = [0, *[int(x) for pair in zip(begin, end) for x in pair], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(stops[::2], stops[1::2]))
        numbers = [pa.array([x], pa.int64()) for x in (len(data), (end - begin).sum(), len(begin))]
        yield pa.RecordBatch.from_arrays(
            [part.column("o").slice(k, 1), *numbers, pa.array([kept], pa.binary())], ["o", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay.

    Removed is each byte covered by LENGTH bytes that also start earlier: in a row of smaller id, or in the same text at
    a smaller place; copies may overlap, and all strings are judged on the input. Strings never cross texts. ``kept`` may
    begin or end inside a character.

    No text is collected. Groups are read as streams that Spark has sorted; of one group at most GROUP_BYTES are held, and
    what is larger is dealt again, string by string. Texts are shuffled once, compressed, to meet their runs. Runs that
    repeat as a whole are told by two 64-bit hashes (of the anchor and of all bytes), strings by their bytes.

    Null text counts as empty. Rows equal in id and text count as one and get the same result; rows that share the id
    only are ordered by, and told apart by, a 64-bit hash of the text, which goes along with every run. A null id comes
    first. Ids are whole numbers over -2^63.
    Other columns are ignored. No rows give no rows. A text of 4 GB or more is not supported.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(order.alias("o"), F.xxhash64(text).alias("k"), text.alias("text"))

    hot = hot_anchors(rows)
    found = rows.mapInArrow(lambda x: _find_anchors(x, hot), "a long, c long, o long, k long, p long")
    found = found.repartition(count, "a").sortWithinPartitions("a", "c", "o", "k", "p")
    settled = found.mapInArrow(_settle, "o long, k long, p long")
    runs = settled.groupBy("o", "k").agg(F.collect_set("p").alias("runs"))

    # Both uses of the joined rows have the same exchanges below, so texts and runs are shuffled once.
    packed = rows.mapInArrow(_pack, "o long, k long, z binary").where("o is not null and k is not null")
    rows = packed.join(runs, ["o", "k"], "left")
    open_ = rows.where(F.exists("runs", lambda p: p < F.lit(1 << _DONE)))
    late = open_.mapInArrow(_find_suffixes, "a long, o long, k long, p long, w binary")
    late = late.repartition(count, "a").sortWithinPartitions("a", "w", "o", "k", "p").mapInArrow(_factors, late.schema)
    late = late.repartition(count, "a").sortWithinPartitions("a", "w", "o", "k", "p").mapInArrow(_same_before, "o long, k long, p long")
    late = late.groupBy("o", "k").agg(F.collect_set("p").alias("late"))
    rows = rows.join(late, ["o", "k"], "left").select("o", "z", "runs", "late")
    out = rows.mapInArrow(_remove, "o long, n_bytes long, n_removed long, n_spans long, kept binary")
    id_ = F.nullif("o", F.lit(_NULL_ID)).cast(kind).alias(id_col)
    return out.select(id_, "n_bytes", "n_removed", "n_spans", "kept")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay."""
    rows = remove_repeats(docs, id_col, text_col)
    return rows.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
