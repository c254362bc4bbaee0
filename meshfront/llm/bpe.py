"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at the strings of added tokens, then into words. A word's bytes are its first tokens; the tree's leaves are the ranks of adjacent pairs, each node the lesser of its two, so the root is the
lowest rank and of equals the leftmost. A merge changes the leaf of the pair, of its neighbour to the left and of the one that went, each in a logarithmic number of nodes. It ends when no pair is left that merges.
A word's ids depend on the word alone, so a batch merges its distinct words, thousands of short ones at a time as columns of arrays, and a task keeps short words it has met, in two generations,
so that those in use outlive the rare ones.

Words are cut by the pattern of the vocabulary. Its character classes come from the regular expression library's Unicode tables, which may be newer than those the vocabulary's own tool was built with: a character
outside ASCII is therefore looked up once a task in that tool, and where the two differ it is cut as the tool's class has it.

Defined cases: a null text is encoded as the empty one, to no ids, which decode to the empty text. Repeated rows and ids are documents each for themselves. Long texts and words are encoded whole: a word of n bytes takes
n log n steps. An empty table gives no rows. Only id and text are read, whatever the other columns' names. decode() passes over null ids and ids that the vocabulary lacks, gives the empty text for null ids arrays, and puts the replacement character
where the bytes are no UTF-8.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words up to SHORT bytes are merged TOGETHER and remembered, some CACHED a generation; bytes or ids that make a batch of results.
SHORT, TOGETHER, CACHED, BATCH_CHARS = 64, 8192, 100_000, 1 << 21
_SHIFT = 32
_PLACE, _NONE = (1 << _SHIFT) - 1, 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merge_all(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The tokens that are left when no adjacent pair merges. ranks: the shifted rank of each mergeable pair; made: the token that each rank makes.

    A leaf is a rank and its place, so that the least of two is also the one further left of equals; the tree's inner nodes are one list, a node's children at twice its number.
    """
    n, rank = len(ids), ranks.get
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 2).bit_length()
    nodes = [_NONE] * (2 * size)
    nodes[size : size + n - 1] = [rank(a << _SHIFT | b, _NONE) | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
    for k in range(size - 1, 0, -1):
        a, b = nodes[2 * k], nodes[2 * k + 1]
        nodes[k] = a if a < b else b
    while (root := nodes[1]) < _NONE:
        i = root & _PLACE
        j, h = after[i], before[i]
        k = after[i] = after[j]
        ids[i], ids[j] = made[root >> _SHIFT], -1
        changed = [(i, _NONE)]
        if k < n:  # the pair of the merged token with the next one takes the place of its own
            before[k] = i
            changed = [(j, _NONE), (i, rank(ids[i] << _SHIFT | ids[k], _NONE) | i)]
        if h >= 0:
            changed.append((h, rank(ids[h] << _SHIFT | ids[i], _NONE) | h))
        for place, least in changed:
            at = size + place
            nodes[at] = least
            while at > 1:
                other = nodes[at ^ 1]
                if other < least:
                    least = other
                at >>= 1
                if nodes[at] == least:
                    break
                nodes[at] = least
    return [t for t in ids if t >= 0]


class Forest:
    """merge_all() for many short words at once: a tree is a column of ``nodes``, and every round makes one merge in each word that has one left."""

    def __init__(self, ranks: dict[int, int], made: list[int]) -> None:
        pairs = sorted(ranks.items())
        self.pairs, self.ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.made = np.array(made, np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        pair = np.where(right < 0, -1, left << _SHIFT | right)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE) | place

    def merge(self, first: np.ndarray) -> np.ndarray:
        """first: the tokens of each word in a column, -1 below its end. The tokens that are left, with -1 between them."""
        n, width = first.shape
        size = 1 << (n - 1).bit_length()
        ids = np.vstack([first, np.full((1, width), -1)])  # the row beyond the end is nobody's
        after, before = np.tile(np.arange(1, n + 2)[:, None], width), np.tile(np.arange(-1, n)[:, None], width)
        nodes = np.full((2 * size, width), _NONE)
        nodes[size : size + n] = self._leaf(ids[:n], ids[1 : n + 1], np.arange(n)[:, None])
        level = size
        while level > 1:
            level >>= 1
            nodes[level : 2 * level] = np.minimum(nodes[2 * level : 4 * level : 2], nodes[2 * level + 1 : 4 * level : 2])
        word = np.arange(width)
        while len(word):
            root = nodes[1, word]
            open_ = root < _NONE
            word, root = word[open_], root[open_]
            i = root & _PLACE
            j, h = after[i, word], before[i, word]
            k = after[j, word]
            ids[i, word], ids[j, word] = self.made[root >> _SHIFT], -1
            after[i, word], before[k, word] = k, i
            has = h >= 0
            own, left = word[has], h[has]
            for place, at, leaf in ((j, word, _NONE), (i, word, self._leaf(ids[i, word], ids[k, word], i)), (left, own, self._leaf(ids[left, own], ids[i[has], own], left))):
                node = size + place
                nodes[node, at] = leaf
                for _ in range(size.bit_length() - 1):
                    node = node >> 1
                    nodes[node, at] = np.minimum(nodes[2 * node, at], nodes[2 * node + 1, at])
        return ids[:n]


class Codec:
    """A byte-level BPE vocabulary file. encode() gives texts' ids, decode() the text of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.ranks = {vocab[a] << _SHIFT | vocab[b]: rank << _SHIFT for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.forest = Forest(self.ranks, self.made)
        values = {c: b for b, c in enumerate(letters)}
        bytes_of = {i: bytes(values[c] for c in t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        bytes_of |= {i: t.encode() for t, i in added.items()}
        self.nothing = max(bytes_of) + 1
        self.pieces = pa.array([bytes_of.get(i, b"") for i in range(self.nothing + 1)], pa.large_binary())
        self.added = {t: np.int32(i).tobytes() for t, i in added.items()}
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = regex.compile(pattern)
        self.plain, self.plain_words = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*"), self._for_plain_texts(pattern)
        self.classes = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]")]
        self.together = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.seen: set[str] = set(map(chr, range(128)))
        self.other: dict[int, str] = {}
        self.cache: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _for_plain_texts(self, pattern: str) -> re.Pattern:
        """The pattern of words for the faster library, with its two character classes spelt out. Good for texts of Latin letters and ASCII, whose classes are the same in every Unicode table."""
        named = {f"\\p{{{k}}}": "".join(c for c in map(chr, range(0x250)) if regex.match(rf"\p{{{k}}}", c)) for k in "LN"}

        def spelt(m: re.Match) -> str:
            inside = m[0][1:-1] if m[0].startswith("[") else m[0]
            for k, letters in named.items():
                inside = inside.replace(k, letters)
            return f"[{inside}]"

        pattern = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", spelt, pattern)
        return re.compile(pattern)

    def _look_up(self, letters: set[str]) -> None:
        """Characters whose class in the vocabulary's tool is another one: each gets a stand-in of that class."""
        samples = ("a", "1", "\t", "!")
        for c in letters:
            own = next(k for k, p in enumerate(self.classes) if p.match(c))
            if len(self.together(samples[own] + c)) > 1:
                self.other[ord(c)] = next(s for s in samples if len(self.together(s + c)) == 1)
        self.seen |= letters

    def _words(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.plain_words.findall(text)
        if new := set(text) - self.seen:
            self._look_up(new)
        if self.other and (like := text.translate(self.other)) != text:
            return [text[m.start() : m.end()] for m in self.words.finditer(like)]
        return self.words.findall(text)

    def split(self, text: str) -> list[str]:
        """The words of a text; the string of an added token is one by itself."""
        out, at = [], 0
        for m in self.cuts.finditer(text) if self.cuts else ():
            out += [*self._words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._words(text[at:]) if at else self._words(text)

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, short ones of about equal length together."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out = {words[k]: np.array(merge_all(self.first[np.frombuffer(raw[k], np.uint8)].tolist(), self.ranks, self.made), "<i4").tobytes() for k in np.flatnonzero(sizes > SHORT).tolist()}
        n = 1
        while n < SHORT:
            n *= 2
            group = np.flatnonzero((sizes <= n) & ((sizes > n // 2) | (n == 2)))
            for s in range(0, len(group), TOGETHER):
                part = group[s : s + TOGETHER]
                at = part.tolist()
                first = self.first[np.frombuffer(b"".join([raw[k].ljust(n, b"\0") for k in at]), np.uint8).reshape(-1, n)]
                first[np.arange(n) >= sizes[part][:, None]] = -1
                left = self.forest.merge(np.ascontiguousarray(first.T)).T
                ends = np.cumsum((left >= 0).sum(axis=1) * 4).tolist()
                flat = left[left >= 0].astype("<i4").tobytes()
                out.update(zip([words[k] for k in at], [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of 32 bits."""
        split = [self.split(t) for t in texts]
        known, new, cache, earlier = dict(self.added), [], self.cache, self.earlier
        for w in set(chain.from_iterable(split)) - self.added.keys():
            found = cache.get(w)
            if found is None:
                found = earlier.get(w)
                if found is None:
                    new.append(w)
                    continue
                cache[w] = found
            known[w] = found
        fresh = self._merged(new)
        known.update(fresh)
        if len(cache) > CACHED:
            self.cache, self.earlier = {}, cache
        self.cache.update((w, x) for w, x in fresh.items() if len(w) <= SHORT)
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids."""
        flat = pc.fill_null(ids.flatten(), -1)
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.pieces)))
        parts = self.pieces.take(pc.if_else(known, flat, self.nothing))
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = b"" if parts.buffers()[2] is None else memoryview(parts.buffers()[2])
        ends = sizes[np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])].tolist()
        return [str(raw[x:y], "utf-8", "replace") for x, y in zip(ends, ends[1:], strict=False)]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_CHARS each, by bytes or ids."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= BATCH_CHARS:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _chunks([n or 0 for n in pc.binary_length(texts).to_pylist()]):
                own = codec.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in own)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            for a, b in _chunks([n or 0 for n in ids.value_lengths().to_pylist()]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(part.column(1)), pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every document. tokenizer: the vocabulary file and the pattern of its words. No shuffle: a document is worked on where it is read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_encoder(*tokenizer), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: tuple[str, str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, decoded)``: what encode() gave, with its text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(*tokenizer), f"doc_id {kind}, ids array<int>, decoded string")
