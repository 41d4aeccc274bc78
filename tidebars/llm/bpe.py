"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The vocabulary file (JSON of the tokenizers library, a parameter) names a normalizer (NFC, lower case), a pattern of
pre-tokens, a byte alphabet and merges. A pre-token is encoded without simulating merges: one pass of an Aho-Corasick
automaton tells the longest entry at each place; the encoder checks it against the entry before with a pair-compatibility
table, takes the next shorter entry from a table of links where they do not fit, and steps back where none does. Two entries
are compatible if no merge crosses the border between them at the time it could; a text has exactly one row of pairwise
compatible entries, its merges' result, so a place that failed once fails always and the work is linear in the length.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidebars.llm._shared import slices

#: Stands for the end-of-word suffix, as one character outside the byte alphabet.
_END = "￿"
_NEVER = 1 << 60
#: Pre-tokens (of at most so many characters) and pairs that a worker remembers; forgetting costs time only.
_WORDS, _LONGEST, _PAIRS = 690_000, 64, 500_000
#: Words that a worker may keep from one task to the next: it lives on in stages that encode nothing.
_KEPT = 50_000


#: Fixed values, in hexadecimal: letters and digits to ``regex`` that the library's tables (Unicode 16) do not have, and capitals
#: whose small letters (here: the first's) the library knows and Python's tables (15.1) do not.
_NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _points(spans: str) -> list[int]:
    ends = [[int(x, 16) for x in span.split("-")] for span in spans.split()]
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


@lru_cache(maxsize=1)
def newer_characters() -> tuple[re.Pattern, dict[int, int], dict[int, int], dict[int, int]]:
    """A pattern of the characters of _NEWER and _CAPITALS; tables of the former to private characters, which the pattern of
    pre-tokens counts as neither letters nor digits, and back; and a table of small letters."""
    there = {c: 0xF0000 + i for i, c in enumerate(_points(_NEWER))}
    small = {}
    for item in _CAPITALS.split():
        span, first = item.split(":")
        small |= {c: int(first, 16) + i for i, c in enumerate(_points(span))}
    spans = [x.split(":")[0].split("-") for x in (_NEWER + " " + _CAPITALS).split()]
    seen = re.compile("[" + "".join(f"{chr(int(x[0], 16))}-{chr(int(x[-1], 16))}" for x in spans) + "]")
    return seen, there, {v: k for k, v in there.items()}, small


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Memo(dict):
    """String -> its ids as little-endian 32-bit bytes, computed when first asked for. Holds short strings only, _WORDS at
    most, and forgets all when full."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        out = self.encode(key)
        if len(key) <= _LONGEST:
            if len(self) >= _WORDS:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.separators = re.compile("[\x1c-\x1f]")
        self.high = re.compile(f"[{chr(min(newer_characters()[1]))}-{chr(0x10FFFF)}]")
        self.marks = {t[0] for t in self.special}  # a text without any of these has no special entry
        self.bytes = byte_alphabet()
        # Merges: the rank of each pair; of each entry the rank that made it and its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.made, self.parts = [-1] * size, [(0, 0)] * size
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = r
            self.made[ab], self.parts[ab] = r, (a, b)
        self.pairs: dict[int, bool] = {}  # of the left entry's id times 2^20 plus the right one's
        sound = [True] * size
        for i in sorted(vocab.values(), key=self.made.__getitem__):
            if self.made[i] >= 0:
                a, b = self.parts[i]
                sound[i] = sound[a] and sound[b] and self._apart(a, b, self.made[i])
        # The automaton of all entries that their own merges yield; of each its size and its longest proper prefix among them.
        self.machine, self.size, self.shorter = ahocorasick.Automaton(), [0] * size, [-1] * size
        known: dict[str, int] = {}
        for token, i in vocab.items():
            if sound[i]:
                text = token.removesuffix(suffix) + _END if token.endswith(suffix) and token != suffix else token
                if len(text) > 1:
                    self.machine.add_word(text, i)
                known[text], self.size[i] = i, len(text)
        for text, i in known.items():
            self.shorter[i] = next((known[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in known), -1)
        self.machine.make_automaton()
        self.single = {text: i for text, i in known.items() if len(text) == 1}  # what there is at each place at least
        self.little = [struct.pack("<I", i) for i in range(size)]
        # Decoding: all entries in one string, each followed by the space that joins entries, and where each starts.
        entries = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            entries[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.words = Memo(self._encode_space_free)

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge crosses the border of ``a`` and ``b``, each of which the merge of rank ``until`` would take up.

        Goes back in time: whichever of the two touching parts was made last is undone (of equals the right one, as the
        left is merged first). Parts that touch merge if their rank comes before either part is taken up; of equal ranks
        the left place goes first.
        """
        rank, made, parts = self.rank, self.made, self.parts
        left_until = right_until = until
        while True:
            r = rank.get((a, b), _NEVER)
            if r < left_until and r <= right_until:
                return False
            if made[a] > made[b]:
                left_until, a = made[a], parts[a][1]
            elif made[b] >= 0:
                right_until, b = made[b], parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self._apart(a, b, _NEVER - 1)
        return known

    def rest(self) -> None:
        """After a task: forget the words if there are more than _KEPT. The pairs stay, as new numbers: the old ones lie
        among the words and would hold on to their memory."""
        if len(self.words) > _KEPT:
            self.words.clear()
            known = array("q", self.pairs), bytes(self.pairs.values())
            self.pairs.clear()
            self.pairs.update(zip(known[0], map(bool, known[1])))

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit bytes."""
        text = (word if word.isascii() and word.isalnum() else "".join(map(self.bytes.__getitem__, word.encode()))) + _END
        size, shorter, get = self.size, self.shorter, self.pairs.get
        longest = [*map(self.single.get, text)]
        n = len(longest)
        for end, i in self.machine.iter(text):  # the ends at one start only grow
            longest[end + 1 - size[i]] = i
        path: list[int] = []
        failed: set[int] = set()
        pos, before, i = 0, -1, longest[0]
        while True:
            while i is not None and i >= 0:
                end = pos + size[i]
                if end not in failed:
                    if before < 0:
                        break
                    fits = get(before << 20 | i)
                    if fits or (fits is None and self.compatible(before, i)):
                        break
                i = shorter[i]
            else:
                failed.add(pos)
                i = path.pop()
                pos -= size[i]
                before = path[-1] if path else -1
                i = shorter[i]
                continue
            path.append(i)
            if end == n:
                return b"".join(map(self.little.__getitem__, path))
            pos, before, i = end, i, longest[end]

    def _encode_space_free(self, word: str) -> bytes:
        if word.isalpha():  # letters only: one pre-token
            return self.encode_word(word)
        parts = self.pattern.findall(word)
        return self.encode_word(parts[0]) if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def _split(self, text: str) -> list[str]:
        """Pre-tokens of a text that may hold newer characters."""
        _, there, back, _ = newer_characters()
        return [x.translate(back) for x in self.pattern.findall(text.translate(there))]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. Strings of special entries give their ids."""
        parts = self.splitter.split(text) if any(c in text for c in self.marks) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                odd = self.separators.search(part) is not None
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case without context
                    seen, _, _, small = newer_characters()
                    if self.high.search(part) and seen.search(part):
                        part, odd = part.translate(small), True
                part = part.lower()
                # No pre-token holds white space, so white space may cut the text first; but split() also cuts at the
                # information separators, which the pattern counts as visible.
                if odd:
                    out.append(b"".join(map(self.encode_word, self._split(part))))
                else:
                    out.append(b"".join(map(self.words.__getitem__, part.split())))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: their entries joined by a space."""
        i = np.frombuffer(ids, "<u4")
        out = []
        for k in range(0, len(i), 1 << 18):
            part = i[k : k + (1 << 18)]
            size = self.sizes[part]
            shift = np.repeat(self.offsets[part] - (np.cumsum(size) - size), size)
            shift += np.arange(len(shift))
            out.append(self.blob[shift].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in each worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Rows are taken one by one: repeated rows and null doc_ids stay as they are,
    other columns are ignored, an empty table gives no rows. ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 4 << 20):
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        c.rest()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the rows of ``encode`` with their decoded texts; null ids decode as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 4 << 20):
            out = pa.array([c.decode(x or b"") for x in b.column("ids").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "text"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary, text string")
