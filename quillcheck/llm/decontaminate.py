"""Benchmark decontamination: documents streamed through a generalised suffix automaton of the test items' words.

1. Items are cut to words, and each word to a 64-bit hash. Items are dealt into blocks of at most BLOCK words, and a task
   builds one block's automaton. How large the benchmark is only decides how many blocks there are.
2. A pass over the documents takes up to AUTOMATA of them. A document's words are walked through each: the state says
   which item strings end here, the length how many words match. Words that stand in no item, and pairs of words that do
   not follow one another in any, end a match for certain, so only the stretches between them are walked, all stretches
   of a chunk at once.
3. Where the length reaches a window's, the state's suffix of that length says which window it is, and the window whose.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import chunks, flat
from .wordhash import span_hashes, word_spans

WINDOW = 10
#: Words of items in one automaton, and automata that a task holds at once.
BLOCK, AUTOMATA = 200_000, 4
#: Words of a stretch that are walked in one go; longer stretches are cut into pieces that share a window less a word.
SEGMENT = 256
#: Bytes of one text that are looked at once.
LONG = 4 << 20
#: Rows with hits that are sent to all tasks at most; more meet the documents in a join.
FEW = 100_000

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value, -1 where it is not there."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


class Automaton:
    """A generalised suffix automaton of items, as arrays: transitions by (state, word), links, lengths, and for each size
    of window the window in which a state's suffix of that size ends."""

    def __init__(self, names: list[str | None], items: list[np.ndarray], window: int):
        self.vocabulary = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        coded = [np.searchsorted(self.vocabulary, x).tolist() for x in items]
        pairs = [np.array(x[:-1], np.int64) * len(self.vocabulary) + np.array(x[1:], np.int64) for x in coded]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
        following, link, length = [{}], [-1], [0]

        def state(size: int, moves: dict, to: int) -> int:
            following.append(moves)
            link.append(to)
            length.append(size)
            return len(link) - 1

        def split(p: int, word: int) -> int:
            """The state of the strings of p that go on with the word: of its own, if longer strings share it."""
            q = following[p][word]
            if length[q] == length[p] + 1:
                return q
            own = state(length[p] + 1, dict(following[q]), link[q])
            link[q] = own
            while p >= 0 and following[p].get(word) == q:
                following[p][word] = own
                p = link[p]
            return own

        for item in coded:
            last = 0
            for word in item:
                if word in following[last]:
                    last = split(last, word)
                    continue
                fresh, p = state(length[last] + 1, {}, 0), last
                while p >= 0 and word not in following[p]:
                    following[p][word] = fresh
                    p = link[p]
                if p >= 0:
                    link[fresh] = split(p, word)
                last = fresh

        moves = sorted((s << 32 | w, to) for s, x in enumerate(following) for w, to in x.items())
        self.keys = np.array([k for k, _ in moves], np.int64)
        self.to = np.array([t for _, t in moves], np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)

        sizes = sorted({min(len(x), window) for x in coded if x})
        self.sizes, self.windows, owners = sizes, {}, []
        for size in sizes:
            suffix = [-1] * len(link)  # the state of the suffix of this size
            for s in sorted(range(1, len(link)), key=length.__getitem__):
                up = link[s]
                suffix[s] = suffix[up] if length[up] >= size else s if length[s] >= size else -1
            number: dict[int, int] = {}
            for k, item in enumerate(coded):
                if not item or min(len(item), window) != size:
                    continue
                s = 0
                for j, word in enumerate(item):
                    s = following[s][word]
                    if j + 1 >= size:
                        at = number.setdefault(suffix[s], len(owners))
                        if at == len(owners):
                            owners.append(set())
                        owners[at].add(k)
            self.windows[size] = np.array([number.get(x, -1) for x in suffix], np.int32)
        self.bounds = np.cumsum([0, *[len(x) for x in owners]])
        self.owners = np.array([k for x in owners for k in sorted(x)], np.int64)
        self.names = names

    def walk(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words in their order, with the text of each: the words where a window ends, its size and its number."""
        none = np.zeros(0, np.int64)
        if not self.sizes or not len(hashes):
            return none, none, none
        word = _find(self.vocabulary, hashes)
        goes_on = np.zeros(len(word), bool)
        both = np.flatnonzero((word[1:] >= 0) & (word[:-1] >= 0) & (text[1:] == text[:-1]))
        goes_on[both + 1] = _find(self.pairs, word[both] * len(self.vocabulary) + word[both + 1]) >= 0
        begin = np.flatnonzero((word >= 0) & ~goes_on)
        ends = np.flatnonzero((word >= 0) & ~np.append(goes_on[1:], False)) + 1
        size = ends - begin
        begin, size = begin[size >= self.sizes[0]], size[size >= self.sizes[0]]
        shared = self.sizes[-1] - 1
        step = max(SEGMENT, 2 * shared) - shared
        pieces = np.maximum(1, -(-(size - shared) // step))
        stretch = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(stretch)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[stretch] + nth * step
        size = np.minimum(size[stretch] - nth * step, step + shared)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, matched = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found = []
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t))  # pieces of more than t words
            own, long = state[:m].copy(), matched[:m].copy()
            here = word[start[:m] + t]
            at = _find(self.keys, own << 32 | here)
            while len(lost := np.flatnonzero(at < 0)):  # shorter suffixes, until one goes on; the root's does
                own[lost] = self.link[own[lost]]
                long[lost] = self.length[own[lost]]
                at[lost] = _find(self.keys, own[lost] << 32 | here[lost])
            state[:m], matched[:m] = self.to[at], long + 1
            for n in self.sizes:
                number = self.windows[n][state[:m]]
                hit = np.flatnonzero((number >= 0) & (matched[:m] >= n))
                found.append((start[hit] + t, np.full(len(hit), n), number[hit]))
        if not found:
            return none, none, none
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _words(data: np.ndarray, offsets: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts laid end to end: word hashes, each word's text, its first byte and end, and how many of the words were
    given before. A single long text comes in blocks that share ``keep`` words."""
    if len(offsets) != 2 or len(data) <= LONG:
        start, end = word_spans(data, offsets, _APART)
        yield span_hashes(data, start, end), np.searchsorted(offsets, start, "right") - 1, start, end, 0
        return
    first, before = 0, 0
    while True:
        stop = first + LONG
        while stop < len(data) and not (gap := np.flatnonzero(_APART[data[stop : stop + LONG]])).size:
            stop += LONG
        stop = min(len(data), stop + int(gap[0])) if stop < len(data) else len(data)
        part = data[first:stop]
        start, end = word_spans(part, np.array([0, len(part)]), _APART)
        yield span_hashes(part, start, end), np.zeros(len(start), np.int64), start + first, end + first, before
        if stop == len(data):
            return
        before = min(keep, len(start))
        first = first + int(start[-before]) if before else stop


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items as lists of word hashes; a long item in pieces that share a window less a word."""
    for part in chunks(batches, "text", 1):  # an item at a time
        data, offsets = flat(part.column("text"))
        found = [x[0][x[4] :] for x in _words(data, offsets, 0)]
        words = np.concatenate(found).view(np.int64)
        step = most - window + 1
        rows = [words[k : k + most] for k in range(0, max(1, len(words) - window + 1), step)] if len(words) else []
        name = part.column("item")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"])


def automata(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One pickled automaton (column built) for each block of items; no block has more than ``block`` words."""
    most = max(2 * window, block // 8)
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = cut(rows.mapInArrow(lambda x: _pieces(x, window, most), "item string, words array<long>"))
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(1, -(-2 * total // block))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
        fullest = dealt.groupBy("block").agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] or 0
        if fullest <= block or count > 8 * total:
            break
        count *= 2

    def build(part: pa.Table) -> pa.Table:
        names = part["item"].to_pylist()
        words = [np.array(x, np.int64).view(np.uint64) for x in part["words"].to_pylist()]
        return pa.table({"built": pa.array([pickle.dumps(Automaton(names, words, window))], pa.binary())})

    return dealt.groupBy("block").applyInArrow(build, "built binary")


_FOUND = "n_words long, spans array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def _runs(hit: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of hit words inside a text."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at


def _scan(batches: Iterator[pa.RecordBatch], machines: list[Automaton], keep: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        data, offsets = flat(part.column("text"))
        n_words, spans, items = np.zeros(len(part), np.int64), defaultdict(list), defaultdict(set)
        base = 0  # words of a long text that came before this block
        counted: dict[int, tuple[int, int]] = {}  # per text a byte, and the characters up to it
        for hashes, text, start, end, again in _words(data, offsets, keep):
            base -= again
            cover = np.zeros(len(hashes) + 1, np.int64)
            for machine in machines:
                at, size, number = machine.walk(hashes, text)
                np.add.at(cover, at - size + 1, 1)
                np.add.at(cover, at + 1, -1)
                for row, k in np.unique(np.stack([text[at], number]), axis=1).T.tolist():
                    items[row].update(machine.names[x] for x in machine.owners[machine.bounds[k] : machine.bounds[k + 1]])
            first, last = _runs(np.cumsum(cover[:-1]) > 0, text)
            inside = np.searchsorted(start, offsets[:-1])
            for i, j in zip(first.tolist(), last.tolist()):
                row, b, e = int(text[i]), int(start[i]), int(end[j])
                upto, chars = counted.get(row, (int(offsets[row]), 0))
                if upto > b:
                    upto, chars = int(offsets[row]), 0
                chars += int(np.count_nonzero((data[upto:b] & 0xC0) != 0x80))
                counted[row] = b, chars
                size = int(np.count_nonzero((data[b:e] & 0xC0) != 0x80))
                shift = base - int(inside[row])
                spans[row].append((i + shift, j + shift, chars, chars + size))
            n_words += np.bincount(text, minlength=len(part))
            n_words[0] -= again  # of a single text only
            base += len(hashes) if len(part) == 1 else 0
        found = [merged(spans[k]) for k in range(len(part))]
        named = [sorted(x for x in items[k] if x is not None) for k in range(len(part))]
        shape = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")]))
        columns = [pa.array(n_words), pa.array([[dict(zip(("first", "last", "begin", "end"), s)) for s in x] for x in found], shape)]
        columns = [*[part.column(c) for c in ("id", "key")], *columns, pa.array(named, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_words", "spans", "items"])


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first and last word, first character and end) in order, those that overlap or touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(spans):
        if out and x[0] <= out[-1][1] + 1:
            last = out[-1]
            out[-1] = (last[0], max(last[1], x[1]), last[2], max(last[3], x[3]))
        else:
            out.append(x)
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """Per row: the id, key (a hash of the text), n_words, n_hit, items (their ids as strings, sorted) and spans.

    Words are runs of digits, letters a-z and characters outside ASCII, after A-Z are lower-cased. A window is ``window``
    words in a row of an item; an item of fewer words is one window, one of none has none. A word inside any occurrence of
    a window is hit; a span is a run of hit words, as words ``first`` to ``last`` and characters [begin, end). Words are
    compared by 64-bit hashes.

    With up to AUTOMATA blocks of items, texts are read once and nothing is shuffled. More blocks take more passes, of which
    only rows with hits are kept, and meet by id and key; rows equal in both have equal results. The automata of one pass
    come to the driver: AUTOMATA blocks of at most ``block`` words each.

    Null and empty texts have no words. A null id stays null, repeated rows get a row each. Items without id cause hits but
    are not named; items that share an id count as one. Without items nothing is hit; no rows give no rows. A very long text
    is read in blocks that share a window less a word. Other columns are ignored.
    """
    text = F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    built = cut(automata(items, item_col, item_text_col, window, block))
    built = built.select(F.monotonically_increasing_id().alias("at"), "built")
    places = sorted(r.at for r in built.select("at").collect())
    sc, passes = docs.sparkSession.sparkContext, []
    for k in range(0, max(1, len(places)), AUTOMATA):
        own = built.where(F.col("at").isin(places[k : k + AUTOMATA])).select("built").collect()
        sent = sc.broadcast([bytes(r.built) for r in own])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _scan(batches, [pickle.loads(x) for x in sent.value], window - 1)

        passes.append(rows.mapInArrow(run, f"id {kind}, key long, {_FOUND}"))
    out = passes[0]
    if len(passes) > 1:
        later = passes[1].where("size(spans) > 0")
        for x in passes[2:]:
            later = later.unionByName(x.where("size(spans) > 0"))
        later = later.unionByName(out.where("size(spans) > 0"))
        later = later.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_i"), F.col("id").isNull().alias("_n"), F.col("key").alias("_k"))
        later = later.agg(F.flatten(F.collect_set("spans")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_t"))
        same = (F.coalesce(F.col("id").cast("string"), F.lit("")) == F.col("_i")) & (F.col("id").isNull() == F.col("_n")) & (F.col("key") == F.col("_k"))
        out = out.join(later, same, "left").select("id", "key", "n_words", F.coalesce("_s", "spans").alias("spans"), F.coalesce("_t", "items").alias("items"))

        def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("first", "last", "begin", "end")
            for part in batches:
                found = [[dict(zip(names, s)) for s in merged([tuple(s[n] for n in names) for s in x])] for x in part.column("spans").to_pylist()]
                yield part.set_column(3, "spans", pa.array(found, part.schema.field("spans").type))

        out = out.mapInArrow(join_spans, f"id {kind}, key long, {_FOUND}")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select(F.col("id").alias(id_col), "key", "n_words", hit.alias("n_hit"), "items", "spans")


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """Per row: the id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated."""
    found = contamination(docs, items, id_col=id_col, **more)
    shown = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select(id_col, "n_words", "n_hit", n_items, shown, (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = WINDOW,
    coverage: float = 0.5,
    few: int = FEW,
    **more,
) -> DataFrame:
    """The documents with their own columns, less each span of ``length`` hit words or more; a document of whose words
    more than the share ``coverage`` is hit goes whole.

    Rows without hits, null texts among them, pass unchanged, as do all columns but the text. Rows with hits are counted:
    up to ``few`` (each with at most ten spans on average) are sent to the tasks, so that no text is shuffled; more meet
    their documents in a join. Repeated rows are cut alike.
    """
    columns = docs.columns
    inner = [f"_c{k}" for k in range(len(columns))]  # so that no column can clash with a helper
    own = dict(zip(columns, inner))
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **more).where("n_hit > 0")
    goes = F.col("n_hit") > coverage * F.col("n_words")
    spans = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= length)
    found = found.select(F.col(id_col).alias("_i"), F.col("key").alias("_k"), goes.alias("_goes"), spans.alias("_s"))
    found = cut(found.dropDuplicates(["_i", "_k"]))
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("_s")).alias("s")).first()
    if size.n <= few and (size.s or 0) <= 10 * few:
        found = F.broadcast(found)
    rows = docs.toDF(*inner)
    same = rows[own[id_col]].eqNullSafe(found["_i"]) & (F.xxhash64(rows[own[text_col]]) == found["_k"])
    rows = rows.join(found, same, "left").where(~F.coalesce("_goes", F.lit(False)))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_s", lambda s: s["end"]))
    ends = F.concat(F.transform("_s", lambda s: s["begin"]), F.array(F.length(own[text_col]).cast("long")))
    kept = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(F.col(own[text_col]), (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")))
    rows = rows.withColumn(own[text_col], F.when(F.size("_s") > 0, F.array_join(kept, "")).otherwise(F.col(own[text_col])))
    return rows.select(*inner).toDF(*columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS r FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM v),
p AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, k WHERE len(w) >= k),
h AS (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM p),
f AS (SELECT h.r, h.p, h.k, v.item FROM h JOIN v ON h.k = v.k AND h.s = v.s),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(p, p + k - 1)) AS q FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
