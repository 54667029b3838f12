"""Long texts cut where byte-level BPE tokens cannot cross, and batches of texts balanced by bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

#: The split pattern of the vocabularies that the cuts below are safe for (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII and U+00C0 to U+024F without the two signs: letters in every Unicode version.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: UTF-8 bytes that the library is given at once.
BATCH_BYTES = 256 << 10
#: A character outside the repertoire for which WORDS below equals PATTERN.
OTHER = re.compile(f"[^\x00-\x7f{LETTERS[6:]}«»¿¡–—‘’“”…€£§°]")
_BLANK = " \\t\\n\\r\\x0b\\x0c"
#: PATTERN with its classes written out for that repertoire, most frequent case first.
WORDS = re.compile(
    f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_BLANK}{LETTERS}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
#: A blank between a non-blank and a Latin letter: the split pattern starts a new match there whatever stands around.
SAFE = re.compile(f"(?<=\\S) (?=[{LETTERS}])")


def words(text: str) -> list[str] | None:
    """The matches of PATTERN, each of which is encoded by itself, or None if the text has characters that only the
    library should class."""
    return None if OTHER.search(text) else WORDS.findall(text)


def spans(text: str, size: int = 1 << 16) -> list[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries; a part without any stays whole."""
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def batches(texts: list[str], cut: bool, limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about ``limit`` bytes: each text's place, once for every part of it, and the parts in order."""
    places, parts, size = [], [], 0
    for place, text in enumerate(texts):
        for part in spans(text) if cut else [text]:
            places.append(place)
            parts.append(part)
            size += len(part.encode()) + 64
            if size >= limit:
                yield places, parts
                places, parts, size = [], [], 0
    if parts:
        yield places, parts


def may_be_cut(settings: str) -> bool:
    """Whether a tokenizer (its settings as JSON) gives the parts of a text, cut by ``spans``, the tokens of the whole: it
    normalizes nothing, splits by PATTERN, and no added token holds a blank or reaches over what stands beside it."""
    found = json.loads(settings)
    split = found["pre_tokenizer"] or {}
    known = split.get("type") == "ByteLevel" and split.get("use_regex", True)
    if split.get("type") == "Sequence":
        first, *rest = split["pretokenizers"]
        known = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Isolated" and not first.get("invert")
        known = known and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0].get("use_regex", True)
        split = rest[0] if known else split
    plain = all(
        not (x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in found["added_tokens"]
    )
    return bool(known and not split.get("add_prefix_space") and found["normalizer"] is None and plain)


class Memo(dict):
    """What each piece stands for. ``learn`` adds the unknown ones among the pieces of some texts by ``encode``, in
    batches balanced by bytes; it first empties a memo whose pieces passed ``limit`` bytes."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 40 << 20, batch: int = BATCH_BYTES):
        super().__init__()
        self.encode, self.limit, self.batch, self.held = encode, limit, batch, 0

    def learn(self, texts: Iterable[list[str] | None]) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0
        seen = set()
        for pieces in texts:
            seen.update(pieces or ())
        todo, size = [], 0
        for key in seen:
            if key not in self:
                todo.append(key)
                size += len(key) + 64
                if size >= self.batch:
                    self._add(todo, size)
                    todo, size = [], 0
        self._add(todo, size)

    def _add(self, keys: list[str], size: int) -> None:
        self.update(zip(keys, self.encode(keys)))
        self.held += size


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
