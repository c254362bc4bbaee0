"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognizes every substring of it. A whole text is parsed against each automaton into phrases, each the longest
match from where the last one ended. A phrase costs the bits of a place in the language's sample, ``log2(1 + its symbols)``, so that samples of unequal size compare; a letter that the sample
lacks costs what a place in the largest sample does. The language of the least cost, which is an estimate of the cross-entropy, wins.

Letters count without case, marks (vowel signs, accents) are letters, each run of all else is one gap. Alphabets are as large as the sample's letters: an automaton's
transitions are rows laid over each other in one array, which takes a few bytes a transition whatever the alphabet. Texts are parsed in parallel windows: each is parsed from its start, and then from the state in which
the window before it ends, up to where both parses break at the same place and so agree from there on. The few windows without such a place are parsed one after another. The
result is the parse of the whole text.

Training takes SAMPLES labelled documents a language at most (one of the least hash in each of SAMPLES hash buckets) and from their beginnings, in shares as equal as their lengths allow,
SYMBOLS symbols together. The driver gets that sample only. Languages have no bound: AT_ONCE are held in memory, further ones take further passes.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is everything if no language was learned. The score is 1 - least / second cost, or 1 with one language; of equal languages the
first by code point wins. Very long texts are parsed whole. Repeated rows are alike; an empty table gives no rows; null ids are predicted and neither held out nor learned from. Only id and text are read for a
prediction, whatever the other columns' names. A language whose sample has no letter isn't learned.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.llm.common import crc_of_id
from meshfront.plans.storage import materialize

WINDOW, SYMBOLS, SAMPLES, AT_ONCE = 256, 40_000, 64, 256
#: Symbols that are parsed at once.
GROUP = 1 << 21
_MODELS: dict[str, tuple] = {}


class SuffixAutomaton:
    """The online construction: states in ``next`` (a dict of transitions each), suffix links and longest lengths."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            new, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new


class Parser:
    """A language's automaton as arrays. Symbol c leads from state s to ``to[base[s] + c]`` if ``of[base[s] + c]`` is s; if not, a phrase begins in ``begin[c]``, which is the root, 0, for an unknown letter."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        states = SuffixAutomaton(symbols.tolist()).next
        self.begin, self.base = np.zeros(width, np.int32), np.zeros(len(states), np.int32)
        for c, s in states[0].items():
            self.begin[c] = s
        room = 2 * sum(map(len, states)) + width + 1
        used, places, first = bytearray(room), [], 0
        # Rows of many transitions first; those of one then take any place that is left. The root has none: from it every symbol begins a phrase.
        for s in sorted(range(1, len(states)), key=lambda s: -len(states[s])):
            row = sorted(states[s])
            if not row:
                break
            at, tries = used.find(0, max(first, row[0])), 0
            while any(used[at - row[0] + c] for c in row):
                at, tries = used.find(0, at + 1), tries + 1
                if tries == 64:  # the beginning is as good as full
                    first = at
                if at + width >= len(used):
                    used.extend(bytes(len(used)))
            self.base[s] = at - row[0]
            for c in row:
                used[at - row[0] + c] = 1
                places.append((at - row[0] + c, s, states[s][c]))
            if at + 2 * width >= len(used):
                used.extend(bytes(len(used)))
        self.of, self.to = np.full(int(self.base.max()) + width + 1, -1, np.int32), np.zeros(int(self.base.max()) + width + 1, np.int32)
        for p, s, t in places:
            self.of[p], self.to[p] = s, t
        known = np.flatnonzero(self.begin)
        self.known = np.zeros(width, bool)
        self.known[known] = True
        self.bits = float(np.log2(1 + len(symbols)))

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[state] + c
        broke = self.of[at] != state
        return np.where(broke, self.begin[c], self.to[at]), broke


class Alphabet:
    """Symbols of code points: 0 for a gap, a number for each letter of the samples, one for all other letters, and one for padding. Code points are looked up when they first occur."""

    def __init__(self, texts: list[str]) -> None:
        letters = sorted({self._folded(c) for c in set().union(*map(set, texts)) if self._in_word(c)}) if texts else []
        self.number = {c: k for k, c in enumerate(letters, 1)}
        self.other, self.padding, self.width = len(letters) + 1, len(letters) + 2, len(letters) + 3
        self.table, self.letter = np.full(0x110000, -1, np.int32), np.zeros(0x110000, bool)

    @staticmethod
    def _in_word(c: str) -> bool:
        return unicodedata.category(c)[0] in "LM"

    @staticmethod
    def _folded(c: str) -> str:
        return c.lower()[0]

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """The text's symbols, runs of gaps being one, and whether it has a letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[codes]
        if (new := out < 0).any():
            for k in np.unique(codes[new]).tolist():
                c = chr(k)
                self.table[k] = self.number.get(self._folded(c), self.other) if self._in_word(c) else 0
                self.letter[k] = unicodedata.category(c)[0] == "L"
            out = self.table[codes]
        kept = out != 0
        kept[1:] |= out[:-1] != 0
        return out[kept], bool(self.letter[codes].any())


def models(sample: dict[str, str]) -> tuple[Alphabet, list[str], list[Parser]]:
    """Alphabet, languages and their automata, built once in each process."""
    name = hashlib.sha256(repr(sorted(sample.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if name not in _MODELS:
        _MODELS.clear()
        alphabet = Alphabet(list(sample.values()))
        own = {k: alphabet.symbols(t) for k, t in sorted(sample.items())}
        _MODELS[name] = alphabet, [k for k, (_, ok) in own.items() if ok], [Parser(x, alphabet.width) for x, ok in own.values() if ok]
    return _MODELS[name]


def _redo(parser: Parser, lane: np.ndarray, broke: np.ndarray, state: int) -> tuple[int, int | None]:
    """One window from ``state``, symbol by symbol: phrases beyond those of ``broke``, and the state at its end, or none if it meets that parse."""
    base, of, to, begin = (memoryview(x) for x in (parser.base, parser.of, parser.to, parser.begin))
    more = 0
    for c, known in zip(lane.tolist(), broke.tolist(), strict=True):
        at = base[state] + c
        if of[at] == state:
            state = to[at]
            more -= known
        elif known:
            return more, None
        else:
            state = begin[c]
            more += 1
    return more, state


def phrases(texts: list[np.ndarray], parser: Parser, padding: int) -> np.ndarray:
    """Phrases of each whole text (an array of symbols)."""
    pads = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    n = int(pads.sum())
    lanes = np.full(n * WINDOW, padding, np.int32)
    for t, at in zip(texts, ((np.cumsum(pads) - pads) * WINDOW).tolist(), strict=True):
        lanes[at : at + len(t)] = t
    lanes = lanes.reshape(n, WINDOW)
    steps, owner = np.ascontiguousarray(lanes.T), np.repeat(np.arange(len(texts)), pads)
    broke, state = np.zeros((WINDOW, n), bool), np.zeros(n, np.int32)
    for k, c in enumerate(steps):
        state, broke[k] = parser.step(state, c)
    count = broke.sum(axis=0, dtype=np.int64)
    # From the state in which the window before ends.
    follows = np.r_[False, owner[1:] == owner[:-1]] if n else np.zeros(0, bool)
    active = np.flatnonzero(follows)
    now, more = state[active - 1], np.zeros(n, np.int64)
    for k in range(WINDOW):
        if not len(active):
            break
        now, here = parser.step(now, steps[k][active])
        there = broke[k][active]
        more[active] += here.astype(np.int64) - there
        apart = ~(here & there)
        if not apart.all():
            active, now = active[apart], now[apart]
    # Windows that never met: the ones after them begin in another state than the one tried.
    left = dict(zip(active.tolist(), now.tolist(), strict=True))
    for lane in sorted(left):
        end = left.pop(lane, None)
        at = lane + 1
        while end is not None and at < n and follows[at] and end != state[at - 1]:
            more[at], end = _redo(parser, lanes[at], broke[:, at], end)
            left.pop(at, None)
            at += 1
    whole = np.bincount(owner, count + more, len(texts)).astype(np.int64)
    return whole - (pads * WINDOW - np.array([len(t) for t in texts], np.int64))  # each padding symbol is a phrase


def costs(texts: list[np.ndarray], alphabet: Alphabet, parsers: list[Parser], unknown: float) -> np.ndarray:
    """Bits of each text under each automaton. ``unknown``: those of a letter that a sample lacks."""
    out = np.zeros((len(texts), len(parsers)))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    every = np.concatenate([*texts, np.zeros(0, np.int32)])
    for k, p in enumerate(parsers):
        lacking = np.bincount(owner, ~p.known[every] if len(every) else None, len(texts))
        out[:, k] = (phrases(texts, p, alphabet.padding) - lacking) * p.bits + lacking * unknown
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def _shared(texts: list[str], symbols: int) -> str:
    """Beginnings of all texts, ``symbols`` characters together, the shorter texts whole."""
    out, left = [], symbols
    for k, t in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        out.append(t[: left // (len(texts) - k)])
        left -= len(out[-1]) + 1
    return " ".join(out)


def fit(docs: DataFrame, samples: int = SAMPLES, symbols: int = SYMBOLS) -> dict[str, str]:
    """Text of each language to build its automaton from."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    known = docs.select(F.col("doc_id").alias("id"), "lang", "text").where(usable)
    rows = known.select("id", "lang", F.xxhash64("id", F.lit("language")).alias("h"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(samples)).alias("bucket")).agg(F.min(F.struct("h", "id")).alias("pick"))
    least = materialize(least.select("lang", "pick.h", "pick.id"), "picked")
    number = least.groupBy("lang").agg(F.count("*").alias("n"))
    picked = least.join(number, "lang")
    if least.count() <= samples * AT_ONCE:  # a proven size; more are joined as they come
        picked = F.broadcast(picked)
    # A text may fill what shorter ones leave, within four times its share; a repeated id counts once.
    part = F.expr(f"substring(text, 1, cast(ceil({4 * symbols} / n) AS int))")
    rows = known.join(picked, ["id", "lang"]).groupBy("lang", "h", "id").agg(F.min(part).alias("text")).select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.text)
    return {k: _shared(t, symbols) for k, t in texts.items()}


def _update(sample: dict[str, str], unknown: float, kind: str, last: bool):
    """A pass over rows ``(doc_id, text, lang_pred, least, second)`` that brings in the languages of the sample; the last one leaves the text out."""
    kept = ["doc_id", "lang_pred", "least", "second"] if last else ["doc_id", "text", "lang_pred", "least", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, names, parsers = models(sample)

        def judged(part: pa.RecordBatch, texts: list[tuple[np.ndarray, bool]]) -> pa.RecordBatch:
            found = costs([t for t, _ in texts], alphabet, parsers, unknown)
            langs, firsts, seconds = (part.column(c).to_pylist() for c in (2, 3, 4))
            for k, (_, ok) in enumerate(texts):
                if not ok:
                    continue
                for name, cost in zip(names, found[k].tolist(), strict=True):  # in order of names, so ties stay with the first
                    if firsts[k] is None or cost < firsts[k]:
                        langs[k], firsts[k], seconds[k] = name, cost, firsts[k]
                    elif seconds[k] is None or cost < seconds[k]:
                        seconds[k] = cost
            columns = [pa.array(langs, pa.string()), pa.array(firsts, pa.float64()), pa.array(seconds, pa.float64())]
            return pa.RecordBatch.from_arrays([*part.columns[: len(kept) - 3], *columns], kept)

        for batch in batches:
            begin, texts, size = 0, [], 0
            for k, t in enumerate(batch.column(1)):
                texts.append(alphabet.symbols(t.as_py() or ""))
                size += len(texts[-1][0])
                if size >= GROUP:
                    yield judged(batch.slice(begin, k + 1 - begin), texts)
                    begin, texts, size = k + 1, [], 0
            if texts:
                yield judged(batch.slice(begin), texts)

    kinds = {"doc_id": kind, "text": "string", "lang_pred": "string", "least": "double", "second": "double"}
    return run, ", ".join(f"{n} {kinds[n]}" for n in kept)


def predict(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row."""
    names, kind = sorted(sample), docs.schema["doc_id"].dataType.simpleString()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("lang_pred", "string"), ("least", "double"), ("second", "double"))]
    rows, unknown = docs.select("doc_id", "text", *none), float(np.log2(1 + max(map(len, sample.values()), default=1)))
    for k in range(0, len(names), AT_ONCE):
        rows = materialize(rows, "judged") if k else rows
        run, schema = _update({n: sample[n] for n in names[k : k + AT_ONCE]}, unknown, kind, k + AT_ONCE >= len(names))
        rows = rows.mapInArrow(run, schema)
    score = F.when(F.col("least").isNull(), 0.0).when(F.col("second").isNull(), 1.0).otherwise(1 - F.col("least") / F.col("second"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))
