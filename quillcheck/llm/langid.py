"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import chunks
from .segments import Memo

#: Runs of letters (and of numerals that are no digits, which count for nothing).
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_BITS = 40  # of one language's phrase count inside a packed number


class SuffixAutomaton:
    """All substrings of a text; ``steps`` has each state's next states by character."""

    def __init__(self, text: str):
        self.steps: list[dict[str, int]] = [{}]
        links, lengths, last = [-1], [0], 0
        for c in text:
            new = len(self.steps)
            self.steps.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            at = last
            while at >= 0 and c not in self.steps[at]:
                self.steps[at][c] = new
                at = links[at]
            if at >= 0:
                q = self.steps[at][c]
                if lengths[at] + 1 == lengths[q]:
                    links[new] = q
                else:
                    clone = len(self.steps)
                    self.steps.append(dict(self.steps[q]))
                    lengths.append(lengths[at] + 1)
                    links.append(links[q])
                    while at >= 0 and self.steps[at].get(c) == q:
                        self.steps[at][c] = clone
                        at = links[at]
                    links[q] = links[new] = clone
            last = new

    def phrases(self, text: str) -> int:
        """Parts of the text when each is the longest match from where it begins (an unknown character is one)."""
        steps, n, state = self.steps, 0, {}
        first = steps[0]
        for c in text:
            found = state.get(c)
            if found is None:
                n += 1
                found = first.get(c)
            state = steps[found] if found is not None else {}
        return n


class Model:
    """Automata and usual phrase rates of the learned languages, in order."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.automata, self.rates, self.spreads = [], [], []
        for language in self.languages:
            words = [w for text in samples[language] for w in WORD.findall(text.lower())]
            cut = max(1, len(words) * 3 // 4)
            automaton = SuffixAutomaton(f" {' '.join(words[:cut])} ")
            held = words[cut:] or words[:1]
            phrases = [automaton.phrases(f" {w} ") for w in held]
            sizes = [len(w) + 2 for w in held]
            rate = sum(phrases) / sum(sizes)
            off = sum((n / rate - size) ** 2 for n, size in zip(phrases, sizes)) / len(held)
            self.automata.append(automaton)
            self.rates.append(rate)
            self.spreads.append(off**0.5 * len(held) / sum(sizes))
        self.memo = Memo(lambda words: [self._packed(w) for w in words], 20 << 20)

    def _packed(self, word: str) -> int:
        if not any(c.isalpha() for c in word):
            return 0
        padded = f" {word} "
        return sum(a.phrases(padded) << (_BITS * k) for k, a in enumerate(self.automata))

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, float]]:
        """Language, score, normalised phrase rate of each text, and the deviation of such a rate over as many words."""
        found = [WORD.findall(x.lower()) for x in texts]
        self.memo.learn(found)
        look, out = self.memo.__getitem__, []
        for words in found:
            packed = sum(map(look, words))
            if not packed:
                out.append((UNDETERMINED, 0.0, 0.0, 0.0))
                continue
            size = sum(map(len, words)) + 2 * len(words)
            counts = [(packed >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(len(self.languages))]
            rates = [n / size / r for n, r in zip(counts, self.rates)]
            best, *others = sorted(range(len(rates)), key=rates.__getitem__)
            score = 1 - rates[best] / rates[others[0]] if others else 1.0
            out.append((self.languages[best], score, rates[best], self.spreads[best] / len(words) ** 0.5))
        return out


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return Model({k: list(v) for k, v in samples})


def held_out(key: Column, modulus: int = 3, rest: int = 1) -> Column:
    """Whether the id falls in the part that nothing is learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == rest


def labelled_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = 400, chars: int = 40_000, languages: int = 200
) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """At most ``rows`` texts of each language outside the held-out part, those with the smallest hashes of id and text,
    until they have ``chars`` characters; no text gives more than a twentieth of them, from a place that its hash names.

    Languages are counted over all rows and the ``languages`` most frequent ones are learned; then about twice the rows
    needed come to the driver, already cut to size.
    """
    most = chars // 20
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    open_ = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col)))
    open_ = open_.select(F.col(lang_col).alias("lang"), hashed.alias("h"), F.col(text_col).alias("t"))
    counts = {r.lang: r.n for r in open_.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return ()
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * rows + 20) / n))])
    near = F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("lang"))
    room = F.greatest(F.length("t") - most + 1, F.lit(1))
    part = F.substring(F.col("t"), (F.pmod(F.shiftright("h", 30), room) + 1).cast("int"), F.lit(most))
    drawn = open_.where(F.col("lang").isin(*counts) & near).select("lang", "h", part.alias("t")).collect()
    out = []
    for lang in sorted(counts):
        texts, size = [], 0
        for row in sorted((r for r in drawn if r.lang == lang), key=lambda r: (r.h, r.t))[:rows]:
            if size >= chars:
                break
            texts.append(row.t)
            size += len(row.t)
        if any(WORD.search(t) for t in texts):
            out.append((lang, tuple(texts)))
    return tuple(out)


def identify(
    docs: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = 400,
    chars: int = 40_000,
) -> DataFrame:
    """The columns ``keep`` (the id) of every row with held_out, lang_pred, score, rate and deviation.

    Per language a suffix automaton of a bounded sample of labelled text (``rows`` texts and ``chars`` characters at most,
    from ids outside the held-out third) gives longest matches. Every text, lower-cased, is parsed word by word, blanks
    included, into the fewest greedy phrases; a language's phrases a character are divided by what its own held-back
    sample needs, and the smallest such rate wins. score is 1 less its ratio to the next rate, ``rate`` the winner's: 1
    for text like the sample, more for text like none. ``deviation`` is how far that rate strays by chance in the language's
    own held-back words, for as many words as the text has. As phrases do not cross words, each distinct word is parsed
    once for a task, and whole texts are counted at the cost of a lookup a word.

    Null text, or one without letters, is ``und`` with score 0, and so is all text if nothing is labelled. Ties go to
    the first language in order. Rows that repeat get results of their own. No rows give no rows.
    """
    keep = [id_col] if keep is None else keep
    samples = labelled_sample(docs, id_col, text_col, lang_col, rows, chars)
    inside = text_col in keep  # then the text goes to the workers once, as part of the row
    more = [] if inside else [F.col(text_col).alias("text")]
    source = docs.select(F.struct(*keep).alias("row"), held_out(F.col(id_col)).alias("held_out"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        if inside:
            batches = (x.append_column("text", x.column("row").field(text_col)) for x in batches)
        for part in chunks(batches, "text"):
            found = model.predict([x or "" for x in part.column("text").to_pylist()])
            lang, score, rate, off = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("held_out"), pa.array(lang), pa.array(score), pa.array(rate), pa.array(off)],
                ["row", "held_out", "lang_pred", "score", "rate", "deviation"],
            )

    kind = source.schema["row"].dataType.simpleString()
    out = source.mapInArrow(run, f"row {kind}, held_out boolean, lang_pred string, score double, rate double, deviation double")
    return out.select("row.*", "held_out", "lang_pred", "score", "rate", "deviation")


def identified_documents(docs: DataFrame, most: float = 2.1, spread: float = 4.0, **more) -> DataFrame:
    """The rows of ``docs`` that are in some learned language: not ``und``, and of a rate of at most ``most`` and ``spread``
    deviations. So short texts, whose rates stray, are let through more easily than long ones. Columns pass through,
    however named. Null and empty texts are ``und`` and go; repeated rows stay or go alike; no rows give no rows."""
    columns = docs.columns
    inner = [f"_c{k}" for k in range(len(columns))]  # so that no column can clash with a result
    names = {k: inner[columns.index(more.pop(k, v))] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang"))}
    marked = identify(docs.toDF(*inner), inner, **names, **more)
    like = F.col("rate") <= most + spread * F.col("deviation")
    return marked.where((F.col("lang_pred") != UNDETERMINED) & like).select(*inner).toDF(*columns)
