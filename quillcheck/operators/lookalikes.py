"""Names that may look alike, found under equal keys by what both have in common and not by comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import many_edits
from ..functions.vendors import CONTRACTIONS, LINKS

#: Names, and askers, of a key that one task holds together; a key with more is dealt in such blocks, each with each.
BLOCK = 8_192
#: Rows that are taken together if they are less than a block's.
CHUNK = 20_000
#: Rests, or matches of rests, that are held at once.
HELD = 4 << 20
#: How many rests cost as much as comparing a pair in full: where a few short names meet, pairs are less work.
PAIR_COST = 64
#: Names of a key, in order, among which an asker looks before all others of its block.
FIRST = 64

_BASE, _SALT, _MIX = 0x9E6C63D0876A9A63, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BACK = pow(_BASE, -1, 1 << 64)


def may_look_alike(asks: DataFrame, named: DataFrame, keys: list[str], begin: int, tolerance: float, parts: int, pair_cost: int = PAIR_COST) -> DataFrame:
    """Pairs of sides (see ``name_sides``) under equal keys, of which those that look alike hold each asker's first one, by
    ``_place``: _ask, _open, _below, _first, x and y (text, whole, kind). Names' places are over ``begin``, ``_last`` is the last;
    ``_askers`` says how many ask under a key. Rows are exchanged by key, no pairs are.

    Names some edits apart are equal after as many deletions from each, so both sides' rests meet by equality, in numpy inside
    a task; where a match shows that more edits are needed it goes, the others' edits are counted, in order of places, up to
    the first that is near enough. Other reasons are equalities already (see ``_marks``).
    """
    side = lambda p: [F.col(f"{p}.{c}").alias(c) for c in ("text", "whole", "kind")]
    block = lambda place: F.floor((F.col(place) - begin - 1) / BLOCK)
    deals = F.ceil(F.col("_askers") / BLOCK)
    first = named.schema["_first"].dataType
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = asks.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), block("_last"))).alias("_block"), F.pmod(F.xxhash64("_ask"), deals).alias("_deal"), F.lit(0).alias("_named"),
        "total", "_ask", "_open", F.col("_below").cast(first).alias("_below"), none(first, "_first"), F.lit(0).cast("long").alias("_place"), *side("x"),
    )
    right = named.select(
        *keys, block("_place").alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("_deal"), F.lit(1).alias("_named"),
        F.col("_total").alias("total"), none("long", "_ask"), none("boolean", "_open"), none(first, "_below"), "_first", F.col("_place").cast("long").alias("_place"), *side("y"),
    )
    by = [*keys, "_block", "_deal"]
    rows = left.unionByName(right).repartition(parts, *by).sortWithinPartitions(*by, "_named", "_place")
    about, of_side = ["_ask", "_open", "_below"], ["text", "whole", "kind"]
    columns = [rows.schema[c] for c in about] + [rows.schema["_first"]] + [StructField(f"{p}_{c}", rows.schema[c].dataType) for p in "xy" for c in of_side]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _groups(batches, by):
            for i, j in _pairs(table, group, tolerance, pair_cost):
                for k in range(0, len(i), CHUNK):
                    mine, theirs = table.take(pa.array(i[k : k + CHUNK])), table.take(pa.array(j[k : k + CHUNK]))
                    found = [*(mine[c] for c in about), theirs["_first"], *(mine[c] for c in of_side), *(theirs[c] for c in of_side)]
                    yield from pa.table([c.combine_chunks() for c in found], [f.name for f in columns]).to_batches()

    pairs = rows.mapInArrow(meet, StructType(columns))
    return pairs.select(*about, "_first", *[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in of_side]).alias(p) for p in "xy"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows, many at a time, and each row's group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            group = _numbered(table, by)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield table.slice(0, whole).combine_chunks(), group[:whole]
            held = table.slice(whole).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _numbered(table, by)


def _numbered(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in by:
        values = table[c]
        new[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy()
    return np.cumsum(new)


def _pairs(table: pa.Table, group: np.ndarray, tolerance: float, pair_cost: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of askers and of names that are to be compared, in parts; of names some edits apart only an asker's first."""
    named = table["_named"].to_numpy() == 1
    askers, names = np.flatnonzero(~named), np.flatnonzero(named)
    askers, names = askers[np.isin(group[askers], group[names])], names[np.isin(group[names], group[askers])]
    if not len(askers):
        return
    texts = np.array(table["text"].to_pylist(), object)
    wide = np.array([len(t) for t in texts])
    kind, whole, place = table["kind"].to_numpy(), pd.factorize(table["whole"].to_pandas())[0], table["_place"].to_numpy()
    total, any_total = pc.fill_null(table["total"], 0.0).to_numpy(), pc.is_null(table["total"]).to_numpy(zero_copy_only=False)
    letters, begin = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(wide) - wide
    best = np.full(len(texts), np.iinfo(np.int64).max)  # the place of each asker's first name that is some edits apart

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        face, traded = (kind[i] == 2) | (kind[j] == 2), (kind[i] == 1) | (kind[j] == 1)
        ok = (whole[i] != whole[j]) & ~(face & traded) & (wide[i] > 0) & (wide[j] > 0) & (place[j] < best[i])
        ok &= any_total[i] | (~any_total[j] & (np.abs(total[i] - total[j]) <= tolerance))
        return i[ok], j[ok]

    def distinct(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.unique(i * len(texts) + j), len(texts))  # rows of names are in order of places

    def nearest(i: np.ndarray, j: np.ndarray) -> None:
        """Counts edits of pairs, each asker's in order of places, up to the first that is near enough."""
        i, j = distinct(i, j)
        now = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        last = np.r_[now[1:], len(i)]
        while len(now):
            apart = np.array(many_edits(texts[i[now]], texts[j[now]]))
            near = apart <= _allowed(np.maximum(wide[i[now]], wide[j[now]]))
            best[i[now[near]]], first[i[now[near]]] = place[j[now[near]]], j[now[near]]
            now, last = now[~near] + 1, last[~near]
            now, last = now[now < last], last[now < last]

    first = np.full(len(texts), -1)
    rank = np.arange(len(names)) - np.searchsorted(group[names], group[names])
    for mine in _slices(askers, wide):
        asked = names[np.isin(group[names], group[mine])]
        asked_first = rank[np.isin(group[names], group[mine])] < FIRST
        rests = None
        for theirs in _slices(asked[asked_first], wide) + _slices(asked[~asked_first], wide):
            still = mine[first[mine] < 0]
            at, n = np.searchsorted(group[theirs], group[still]), np.searchsorted(group[theirs], group[still], "right")
            n -= at
            if n.sum() * pair_cost <= _count(wide[still]).sum() + _count(wide[theirs]).sum():
                i, k = _spread(still, at, n)
                yield fit(i, theirs[k])
                continue
            rests = rests or _rests(mine, texts, wide, group)
            a, b = [c[first[rests[1]] < 0] for c in rests], _rests(theirs, texts, wide, group)
            for x, y in _equal(a[0], b[0]):
                i, j, p, q = a[1][x], b[1][y], a[2][x], b[2][y]
                # as many from both: where edits allow no more, each is of a letter put for another, or of two swapped, one of which went
                level = (p >= 0).sum(1)
                as_letter = lambda of, k: letters[np.maximum(begin[of, None] + k, 0)]
                one_edit = (p == q) | ((np.abs(p - q) == 1) & (as_letter(i, p) == as_letter(j, q)))
                ok = (level != (q >= 0).sum(1)) | (level < _allowed(wide[i])) | one_edit.all(1)
                i, j = fit(i[ok], j[ok])
                if len(i):
                    nearest(i, j)
    found = askers[first[askers] >= 0]
    yield found, first[found]
    best[found] = place[first[found]]
    of = np.sort(np.concatenate([askers, names]))
    plain, made = (tuple(np.concatenate(c) for c in zip(*marks)) for marks in _marks(of, letters, begin, wide))
    plain, made = ((_mixed(h, group[i]), i) for h, i in (plain, made))
    sides = lambda marks, which: (c[which[marks[1]]] for c in marks)
    for one, other in ((plain, made), (made, plain)):
        (a, i), (b, j) = sides(one, ~named), sides(other, named)
        for x, y in _equal(a, b):
            yield distinct(*fit(i[x], j[y]))


def _allowed(n: np.ndarray) -> np.ndarray:
    """``allowed_edits`` of numbers."""
    return np.searchsorted([6, 16, 32], n, "right")


def _most(n: int) -> int:
    """Edits that some name may be away from one of ``n`` letters."""
    return max(int(_allowed(n + k)) for k in range(4) if k <= _allowed(n + k))


@lru_cache
def _deleted(n: int) -> list[np.ndarray]:
    """By number of deletions the places that can be deleted from ``n`` letters."""
    return [np.array(list(combinations(range(n), k)), np.int16) for k in range(min(n, _most(n)) + 1)]


def _count(n: np.ndarray) -> np.ndarray:
    """How many rests names of ``n`` letters have."""
    lengths, at = np.unique(n, return_inverse=True)
    some = np.array([_rest_count(int(k)) for k in lengths], np.int64)
    return some[at] if len(n) else np.zeros(0, np.int64)


@lru_cache
def _rest_count(n: int) -> int:
    count, last = 0, 1
    for k in range(min(n, _most(n)) + 1):
        count += last
        last = last * (n - k) // (k + 1)
    return count


def _slices(rows: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """Rows in order, cut where their rests are more than are held at once."""
    if not len(rows):
        return []
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(_count(wide[rows])) // HELD)) + 1)


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _upto(values: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... values of each row."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    out[:, 1:] = np.cumsum(values * _powers(values.shape[1])[:-1], 1)
    return out


def _less(upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Hashes of rows less the places of each row of ``out``."""
    n, k = upto.shape[1] - 1, out.shape[1]
    begin, rest = np.zeros(len(out), np.int64), np.full((len(upto), len(out)), n - k, np.uint64)
    for s in range(k + 1):
        end = out[:, s].astype(np.int64) if s < k else np.full(len(out), n)
        rest += (upto[:, end] - upto[:, begin]) * _powers(k, _BACK)[s]
        begin = end + 1
    return rest


def _rests(rows: np.ndarray, texts: np.ndarray, wide: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what deletions leave, with the group; the rows; and the places deleted, from the left (-1: none)."""
    hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int16)]
    for n in np.unique(wide[rows][wide[rows] > 0]).tolist():
        mine = rows[wide[rows] == n]
        upto = _upto(np.array(texts[mine].tolist(), f"<U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64))
        for k, out in enumerate(_deleted(n)):
            hashes.append(_mixed(_less(upto, out), group[mine][:, None]).ravel())
            owners.append(np.repeat(mine, len(out)))
            padded = np.full((len(out), 3), -1, np.int16)
            padded[:, :k] = out
            places.append(np.tile(padded, (len(mine), 1)))
    return tuple(np.concatenate(c) for c in (hashes, owners, places))


def _word_hash(word: str) -> np.uint64:
    return _upto(np.array([[ord(c) for c in word]], np.uint64))[0, -1]


@lru_cache
def _contractions() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words and of what is written for them."""
    pairs = [(_word_hash(word), _word_hash(short)) for short, words in CONTRACTIONS.items() for word in words]
    return tuple(np.array(c) for c in zip(*pairs))


def _marks(rows: np.ndarray, letters: np.ndarray, begin: np.ndarray, wide: np.ndarray) -> tuple[list, list]:
    """Marks by which names that look alike other than by a typo meet, and their rows: those of a name as it stands, and those made
    of it, of which one equals a mark of the other name as it stands. Made are the name less one or two words, with initials
    for words, its initials, and each word shortened, after the word before it (the last before the first): names of which
    words are shortened have a word in common that stands before one that is shortened."""
    rows = rows[wide[rows] > 0]
    _, at = _spread(rows, begin[rows], wide[rows])
    signs, wide = letters[at].astype(np.uint64), wide[rows]
    ends = np.cumsum(wide)
    stops = np.union1d(np.flatnonzero(signs == ord(" ")), ends)
    start = np.r_[0, stops[:-1] + (stops[:-1] < len(signs)) * (~np.isin(stops[:-1], ends))] if len(stops) else stops
    upto, back = _upto(signs[None])[0], _powers(len(signs), _BACK)
    part = lambda a, b: (upto[b] - upto[a]) * back[a]  # noqa: E731  the hash of letters a to b
    word, owner = part(start, stops), np.searchsorted(ends, start, "right")
    n = np.bincount(owner, minlength=len(rows))
    head = np.cumsum(n) - n
    k = np.arange(len(word)) - head[owner]
    before = word[np.where(k > 0, np.arange(len(word)) - 1, (head + n - 1)[owner])]
    around = _mixed(before, n[owner] * 1000 + k)  # what stands around a word
    long = np.flatnonzero(stops - start > 1)
    plain = [(_mixed(word[long], np.array([1])), rows[owner[long]]), (_mixed(around ^ _mixed(word, np.array([2])), np.array([2])), rows[owner])]
    many = np.flatnonzero((stops - start > 1) & (n[owner] > 1))
    i, to = _spread(many, start[many] + 1, (stops - start)[many] - 1)
    shorts = [(i, part(start[i], to))]
    full, short = _contractions()
    known = np.flatnonzero(np.isin(word, full))
    i, which = np.nonzero(word[known][:, None] == full)
    shorts.append((known[i], short[which]))
    made = [(_mixed(around[i] ^ _mixed(w, np.array([2])), np.array([2])), rows[owner[i]]) for i, w in shorts]
    linked = np.isin(word, [_word_hash(w) for w in LINKS])
    for size in np.unique(n).tolist():
        mine = np.flatnonzero(n == size)
        of = head[mine][:, None] + np.arange(size)
        names, say = _upto(_mixed(word[of], np.array([3]))), lambda hashes: _mixed(hashes, np.array([0]))
        plain.append((say(_less(names, np.zeros((1, 0), np.int64))[:, 0]), rows[mine]))
        if size < 2:
            continue
        for out in (np.array(list(combinations(range(size), c))) for c in (1, 2) if c < size):
            made.append((say(_less(names, out)).ravel(), np.repeat(rows[mine], len(out))))
        for counts in (np.ones(of.shape, bool), ~linked[of])[: 1 + int(linked[of].any())]:
            nth = np.cumsum(counts, 1) - counts  # how many letters stand before a word's
            firsts = np.zeros((len(mine), size + 1), np.uint64)
            firsts[:, 1:] = np.cumsum(signs[start[of]] * counts * _powers(size)[nth], 1)
            for i, j in combinations(range(size), 2):
                initials = (firsts[:, j + 1] - firsts[:, i]) * _powers(size, _BACK)[nth[:, i]]
                left = size - (j - i)
                said = names[:, i] + _mixed(initials, np.array([3])) * _powers(size)[i] + (names[:, size] - names[:, j + 1]) * _powers(size, _BACK)[j - i]
                made.append((say(said + np.uint64(left)), rows[mine]))
                if left == 1:
                    made.append((_mixed(initials, np.array([1])), rows[mine]))
    return plain, made


def _mixed(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    x = x ^ (group.astype(np.uint64) * _SALT)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _spread(rows: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row ``count`` times, and as many places from ``begin``."""
    ends = np.cumsum(count)
    return np.repeat(rows, count), np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


def _equal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal hashes in a and b, in parts by places of a. Most have no equal: a table of bits tells."""
    def kept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = np.uint64(max(10, int(len(y) * 6).bit_length()))
        seen = np.zeros(1 << int(bits), bool)
        seen[y >> (np.uint64(64) - bits)] = True
        return np.flatnonzero(seen[x >> (np.uint64(64) - bits)])

    left = kept(a, b)
    right = kept(b, a[left])
    right = right[np.argsort(b[right])]
    at = np.searchsorted(b[right], a[left])
    n = np.searchsorted(b[right], a[left], "right") - at
    left, at, n = left[n > 0], at[n > 0], n[n > 0]
    for some in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(n) // HELD)) + 1):
        x, k = _spread(left[some], at[some], n[some])
        yield x, right[k]
