"""Byte-level BPE in overlapping chunks, and exact token counts at every prefix."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import unicodedata
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from itertools import accumulate, islice

from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_texts

#: Characters of a chunk, and of the zone that it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Strings that a worker remembers; a few hundred bytes each.
REMEMBERED = 300_000

_loaded: dict = {}


# ---------------------------------------------------------------- byte-level BPE
class ChunkEncoder:
    """Encodes text by a rank file and a pre-token pattern, as the tiktoken library does without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str) -> list[int]:
        """The start of each pre-token, and the end of the last one."""
        return [*(m.start() for m in self.pattern.finditer(text, concurrent=True)), len(text)]

    def encode(self, text: str) -> list[int]:
        """Token ids of a text that starts and ends at pre-token boundaries."""
        return self.enc.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """The concatenated bytes of the tokens."""
        return self.enc.decode_bytes(ids)


def encoder(path: str, pattern: str) -> ChunkEncoder:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ChunkEncoder(path, pattern)
    return _loaded[path, pattern]


def settled(text: str, p: int) -> bool:
    """Whether a pre-token ends at p whatever precedes: one ends where white space follows something else, and between a letter,
    a number and other signs, unless an apostrophe may begin a contraction. Only characters that any version of the character
    database knows count, so that it doesn't matter which one an engine has."""
    a, b = text[p - 1], text[p]
    if a.isspace():
        return False
    if b.isspace() and not "\x1c" <= b <= "\x1f":
        return True
    old = unicodedata.ucd_3_2_0.category
    x, y = old(a), old(b)
    return a != "'" and "Cn" not in (x, y) and (x[0] if x[0] in "LN" else "") != (y[0] if y[0] in "LN" else "") and not b.isspace()


def seams(enc: ChunkEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 1) -> list[int]:
    """Places where pieces of the text meet, all of them pre-token boundaries of the whole text.

    Chunks of `chunk` characters and an overlap are pre-tokenised apart, in `threads` threads. A seam is the first place of an
    overlap where both chunks start a pre-token and which is settled; the end of the earlier chunk isn't used, for its last
    pre-token may be cut short. Where the chunks don't meet there is no seam, and the piece goes on.
    """
    starts = range(0, max(1, len(text) - overlap), chunk)

    def bounds(at: int) -> list[int]:
        return [at + p for p in enc.pieces(text[at : at + chunk + overlap])]

    if threads > 1 and len(starts) > threads:
        with ThreadPoolExecutor(threads) as pool:
            found = list(pool.map(bounds, starts))
    else:
        found = list(map(bounds, starts))
    out = []
    for a, b, at in zip(found, found[1:], starts[1:], strict=False):
        usable = set(b[:-1])
        near = (p for p in a[bisect.bisect_left(a, at) : -2] if p in usable and settled(text, p))
        out += [p for p in [next(near, None)] if p is not None]
    return out


def encode_chunked(enc: ChunkEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 1) -> list[int]:
    """Ids of a text of any length: the pieces between the seams of its overlapping chunks are encoded one by one."""
    if len(text) <= chunk + overlap:
        return enc.encode(text)
    cuts = [0, *seams(enc, text, chunk, overlap, threads), len(text)]
    return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in enc.encode(text[a:b])]


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """Token ids of every whole text and the bytes that they decode to.

    Texts are taken apart into overlapping chunks which are pre-tokenised apart, in as many threads as the task has cores,
    stitched where their boundaries resynchronise, and encoded piece by piece; decoding concatenates the tokens' bytes. No
    shuffle: documents are independent, and a worker holds one text, its ids and its chunks' boundaries.

    Result: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and with keep_ids the ids.
    Null text is the empty text: no ids, the hash of nothing. Repeated rows give equal rows; an empty table none.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def make():
        enc = encoder(path, pattern)
        threads = TaskContext.get().cpus() if TaskContext.get() else 1

        def run(texts: list) -> dict:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for text in texts:
                ids = encode_chunked(enc, text, chunk, overlap, threads) if text else []
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
            return out

        return run

    return map_texts(docs, make, schema)


# ---------------------------------------------------------------- token counts by prefix
class PrefixCounter:
    """Exact token counts of a lower-casing BPE vocabulary with word ends, at every prefix of a text.

    No token holds white space, and special tokens stand alone, so a text's count is the sum over its words and special tokens,
    and a prefix's count is the running sum up to its last whole word plus the count of the word that it cuts.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], spec["model"]["type"], spec["model"]["end_of_word_suffix"]
        if kinds != (["NFC", "Replace", "Lowercase"], "BPE", "</w>"):
            raise ValueError(f"not a lower-casing BPE with word ends: {kinds}")
        #: The library's own normaliser: other versions of the character database lower other letters.
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = [x["content"] for x in spec["added_tokens"]]
        special = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)"
        self.special = regex.compile(special)
        self.parts = regex.compile(rf"{special}|(?:(?!{special})\S)+")
        byte_of = {c: b for b, c in _printable_bytes().items()}
        end = b"\xff"  # no byte of UTF-8: stands for the word end

        def raw(token: str) -> bytes:
            whole = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in whole) + end * (whole != token)

        # A word's last byte and its end are one symbol from the start, so their merges come before all others.
        ranks = {bytes([b]) + end: b for b in range(255)}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        self.enc = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, part: str) -> int:
        """Tokens of a special token, or of a run without white space and special tokens."""
        n = self.known.get(part)
        if n is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            n = 1 if self.special.fullmatch(part) else sum(len(self.enc._encode_single_piece(x.encode() + b"\xff")) for x in self.pattern.findall(self.normal(part)))
            self.known[part] = n
        return n

    def words(self, text: str) -> list[str]:
        """The words and special tokens in order."""
        if any(x in text for x in self.specials) or not _SEPARATORS.isdisjoint(text):
            return self.parts.findall(text)
        return text.split()

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


#: White space to Python's split() and not to regular expressions.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


class PrefixTable:
    """The stored dynamic programme of one text: counts[i + 1] = counts[i] + tokens of its word i.

    total is the whole text's count, at(p) that of text[:p] for any p, and longest(budget) the longest prefix within a budget;
    they look up the running count and examine the word that is cut, never the text before it.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        words, known = counter.words(text), counter.known.get
        self.counts = [0, *accumulate([known(w) or counter.count(w) for w in words])]

    @property
    def total(self) -> int:
        return self.counts[-1]

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """Places of the words; only asked for when a prefix is."""
        return [m.span() for m in self.counter.parts.finditer(self.text)]

    @cached_property
    def ends(self) -> list[int]:
        return [b for _, b in self.spans]

    def _within(self, i: int, span: tuple[int, int], before: tuple[int, int] | None, p: int) -> int:
        """The count of text[:p], where p lies in word i at `span`, which comes after the word at `before`."""
        special, (a, b) = self.counter.special.fullmatch, span
        if p <= a:
            return self.counts[i]
        if before and before[1] == a and special(self.text, a, b) and not special(self.text, *before):
            i, a = i - 1, before[0]  # part of a special token is text like that before it
        return self.counts[i] + sum(map(self.counter.count, self.counter.words(self.text[a:p])))

    def at(self, p: int) -> int:
        i = bisect.bisect_left(self.ends, p + 1)  # words that end by p
        return self.counts[i] if i == len(self.spans) else self._within(i, self.spans[i], self.spans[i - 1] if i else None, p)

    def longest(self, budget: int) -> int:
        """The largest p with at(q) <= budget for every whole word before p, and at(p) <= budget. Reads the text up to there."""
        i = bisect.bisect_right(self.counts, budget) - 1
        if i >= len(self.counts) - 1:
            return len(self.text)
        near = [m.span() for m in islice(self.counter.parts.finditer(self.text), max(0, i - 1), i + 1)]
        a, b = near[-1]
        return max((p for p in range(a, b) if self._within(i, near[-1], near[0] if i else None, p) <= budget), default=a)


def _printable_bytes() -> dict[int, str]:
    """Fixed values of the file format, by their rule: bytes that print stand for themselves, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def counter(path: str) -> PrefixCounter:
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Exact token counts of every whole text, from the stored counts at its prefixes, and where it has to be cut for `limit`.

    No shuffle; a worker holds one text, its prefix table and a bounded memory of words. Result: doc_id, n_bytes, n_tokens,
    over_limit (more than `limit` tokens), fits_chars (characters of the longest prefix of at most `limit` tokens). Null text is
    the empty text: all are 0. Repeated rows give equal rows; an empty table none; other columns are not read.
    """

    def make():
        c = counter(path)

        def run(texts: list) -> dict:
            out: dict = {"n_bytes": [], "n_tokens": [], "over_limit": [], "fits_chars": []}
            for text in texts:
                t = c.table(text or "")
                over = t.total > limit
                for col, v in zip(out, (len(t.text.encode()), t.total, over, t.longest(limit) if over else len(t.text)), strict=True):
                    out[col].append(v)
            return out

        return run

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
