"""Language identification by cross-parsing entropy.

Fit: for every language, a bounded sample of labelled texts becomes a suffix
automaton. Predict: a text is cut greedily into the longest phrases that occur in a
language's sample (the cross-parsing of Ziv and Merhav); the language that needs the
fewest phrases per symbol wins.

Symbols: letters are lower-cased; every run of other characters is one blank. Every
letter of the samples has a symbol of its own, whatever the script; those that no
sample holds share one, and cost a phrase each.

The transitions of all automata lie in one hash table, and all texts of a batch advance
together in all languages, one symbol a step: the inner loop is a table look-up in
numpy. Long texts are cut into blocks (``BLOCK`` symbols) that are first parsed side by
side, each as if a phrase began with it. Then each block is parsed again from where the
last phrase of the block before it really ends, as far as the first place where a phrase
begins in both parsings; from there on they are the same. So phrases cross the borders
of blocks, and the counts are those of one pass over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .names import column, numbered, others

BLOCK = 512
#: Bounds of the fit: texts and symbols per language (a longer text only where there is
#: no other), and languages; more labels than that are an error.
FIT_TEXTS, FIT_SYMBOLS, MOST_LANGUAGES = 60, 40_000, 1000
UNKNOWN = "und"
#: Texts are handled in groups of about so many characters, times languages.
GROUP_CHARS = 8_000_000
ADDED = ("lang_pred", "score", "phrase_rate")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, by state; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(s) == q:
                    nxt[p][s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


_HASH = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(2**64 - 2)


@dataclass
class Model:
    """A fitted model: its size is bounded by the FIT bounds; the same for all tasks."""

    languages: list[str]
    letters: str
    width: int  # symbols: the blank, the letters, any other letter
    roots: np.ndarray  # start state of each language
    first: np.ndarray  # language x symbol: state after a phrase's first symbol; the start where the sample lacks it
    keys: np.ndarray  # transitions: state * width + symbol
    goals: np.ndarray  # and the next state
    #: open addressing of the transitions: key (or -1) and goal, in turn; made where it is used
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": np.zeros(0, np.int64)}

    @classmethod
    def build(cls, samples: dict[str, list[int]], letters: str) -> Model:
        """From the symbols of each language's sample, below ``len(letters) + 1``."""
        width, base = len(letters) + 2, 0
        names, roots, keys, goals = sorted(samples), [], [], []
        first = np.zeros((len(names), width), np.int32)
        for i, name in enumerate(names):
            states = automaton(samples[name])
            roots.append(base)
            first[i] = base
            for s, t in states[0].items():
                first[i, s] = base + t
            for p, out in enumerate(states):
                for s, t in out.items():
                    keys.append((base + p) * width + s)
                    goals.append(base + t)
            base += len(states)
        return cls(names, letters, width, np.array(roots, np.int32), first, np.array(keys, np.int64), np.array(goals, np.int32))

    def ready(self) -> None:
        """Make the hash table, if it is not there."""
        if len(self.table):
            return
        keys, goals = self.keys, self.goals
        size = 1 << max(4, int(3 * len(keys)).bit_length())
        self.table = np.full(2 * size, -1, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.table[at] == -1
            slot, which = np.unique(at[free], return_index=True)
            which = np.flatnonzero(free)[which]
            self.table[slot], self.table[slot + 1] = keys[which], goals[which]
            left = np.ones(len(keys), bool)
            left[which] = False
            keys, goals, at = keys[left], goals[left], (at[left] + 2) & (2 * size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where to look first: even places."""
        shift = np.uint64(65 - len(self.table).bit_length())
        return (((keys.view(np.uint64) * _HASH) >> shift) & _EVEN).view(np.int64)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no transition."""
        want = state.astype(np.int64) * self.width + symbol
        shape, want = want.shape, want.ravel()
        at = self._slot(want)
        held = self.table.take(at)
        out = self.table.take(at + 1)
        wrong = held != want
        out[wrong] = -1
        open_ = np.flatnonzero(wrong & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 2) & (len(self.table) - 1)
            held = self.table[at[open_]]
            found = held == want[open_]
            out[open_[found]] = self.table[at[open_[found]] + 1]
            open_ = open_[~found & (held != -1)]
        return out.astype(np.int32).reshape(shape)

    def follower(self) -> Callable[[int, int], int]:
        """:meth:`follow` for one state."""
        table, width, mask = memoryview(self.table), self.width, len(self.table) - 1
        factor, whole, shift = int(_HASH), 2**64 - 1, 65 - len(self.table).bit_length()

        def follow(state: int, symbol: int) -> int:
            want = state * width + symbol
            at = ((want * factor & whole) >> shift) & ~1
            while (held := table[at]) != want:
                if held == -1:
                    return -1
                at = (at + 2) & mask
            return table[at + 1]

        return follow

    def step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the symbols, and whether a phrase begins with them."""
        goal = self.follow(state, symbol)
        stop = goal < 0
        return np.where(stop, self.first[lang, symbol], goal), stop | (state == self.roots[lang])

    def lookup(self) -> np.ndarray:
        """Code point -> symbol: 0 for the blank, the last for a letter of no sample."""
        table = np.zeros(0x110000, np.int32)
        for a, b in _letter_ranges():
            table[a:b] = self.width - 1
        for i, c in enumerate(self.letters):
            table[ord(c)] = i + 1
        return table


_ranges: list[tuple[int, int]] = []
_tables: dict[str, np.ndarray] = {}


def _letter_ranges() -> list[tuple[int, int]]:
    if not _ranges:
        start = None
        for i in range(0x110000):
            alpha = chr(i).isalpha()
            if alpha and start is None:
                start = i
            elif not alpha and start is not None:
                _ranges.append((start, i))
                start = None
    return _ranges


def code_points(text: str) -> np.ndarray:
    """Lower-case code points; lone surrogates are kept."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _squeeze(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop blanks that follow a blank or begin a text; the new starts."""
    blank = symbols == 0
    before = np.empty_like(blank)
    before[1:] = blank[:-1]
    before[starts[:-1][starts[:-1] < len(symbols)]] = True
    keep = ~(blank & before)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return symbols[keep], kept[starts]


def to_symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, and where each text starts (n + 1)."""
    points = [code_points(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    flat = np.concatenate(points) if points else np.empty(0, np.uint32)
    return _squeeze(table[flat], starts)


def count_phrases(symbols: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of every text (rows) by every language (columns)."""
    model.ready()
    n_lang, sizes = len(model.languages), np.diff(starts)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    counts = np.zeros((len(sizes), n_lang), np.int64)
    if not len(owner) or not n_lang:
        return counts
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[:-1][owner] + nth * BLOCK
    stop = starts[1:][owner]  # of the text
    end = np.minimum(begin + BLOCK, stop)
    n, lang = len(owner), np.arange(n_lang)

    # every block as if a phrase began with it; marks: where phrases begin
    order = np.argsort(begin - end, kind="stable")
    size = (end - begin)[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    state = np.repeat(model.roots[None, :], n, axis=0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    marks = np.zeros((int(size[0]), n, n_lang), bool)  # blocks by rank
    for t, lanes in enumerate(alive.tolist()):
        symbol = symbols[begin[order[:lanes]] + t][:, None]
        state[:lanes], marks[t, :lanes] = model.step(state[:lanes], symbol, lang[None, :])
    states = state[rank]
    behind = np.cumsum(marks[::-1], axis=0, dtype=np.int16)[::-1]  # phrases from a place on
    per_block = behind[0, rank].astype(np.int64)

    # again from where the phrase before a block really ends, until both parsings agree: a
    # few symbols at each border, so one by one
    follow, at_of = model.follower(), memoryview(np.ascontiguousarray(symbols, np.int32))

    def leave(state: int, at: int, stop: int, root: int) -> int:
        """Where the next phrase begins."""
        while at < stop:
            goal = follow(state, at_of[at])
            if goal < 0 or state == root:
                return at
            state = goal
            at += 1
        return stop

    where = np.cumsum(blocks) - blocks
    for text in np.flatnonzero(blocks > 1).tolist():
        head, last = int(where[text]), int(starts[text + 1])
        for k in range(n_lang):
            root = int(model.roots[k])
            entry = leave(int(states[head, k]), int(end[head]), last, root)
            for b in range(head + 1, head + int(blocks[text])):
                b_begin, b_end = int(begin[b]), int(end[b])
                if entry >= b_end:  # one phrase covers the whole block
                    per_block[b, k] = 0
                    continue
                at, state_of, made = entry, root, 0
                while at < b_end:
                    goal = follow(state_of, at_of[at])
                    if goal < 0 or state_of == root:
                        if marks[at - b_begin, rank[b], k]:
                            per_block[b, k] = made + int(behind[at - b_begin, rank[b], k])
                            state_of = int(states[b, k])
                            break
                        made += 1
                        if goal < 0:
                            goal = int(model.first[k, at_of[at]])
                    state_of = goal
                    at += 1
                else:
                    per_block[b, k] = made
                entry = leave(state_of, b_end, last, root)
    np.add.at(counts, owner, per_block)
    return counts


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    texts: int = FIT_TEXTS,
    symbols: int = FIT_SYMBOLS,
) -> Model:
    """Learn from a bounded sample of distinct labelled texts, each whole.

    Per language the texts of least hash are taken in that order, ``texts`` of them at
    most, as long as they have ``symbols`` characters in all; one that would exceed this
    is passed over, and where every text alone does, the shortest is taken. Copies of a
    text don't change the model. Rows without text or language are left out. Only the
    sample reaches the driver, and the hashes and lengths of about four times as many
    texts.
    """
    known = labelled.select(column(lang).cast("string").alias("lang"), column(text).alias("text"))
    known = known.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    known = known.withColumn("place", F.pmod("h", F.lit(1 << 31)) / float(1 << 31)).withColumn("n", F.char_length("text"))
    # copies count once; the count is near enough, as it only sets how many candidates come
    distinct = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows"))
    sizes = {r["lang"]: max(r["rows"], 1) for r in distinct.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chosen: dict[str, list[int]] = {}
    shares = {k: 4.0 * texts / n for k, n in sizes.items()}
    while shares:
        share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        near = known.filter(F.col("place") < F.element_at(share, F.col("lang")))
        found: dict[str, list[tuple[int, int]]] = {}
        for row in sorted(near.groupBy("lang", "place", "h").agg(F.min("n").alias("n")).collect(), key=lambda r: (r["lang"], r["place"], r["h"])):
            found.setdefault(row["lang"], []).append((row["h"], row["n"]))
        again = {}
        for k, x in shares.items():
            taken, held = [], 0
            for h, n in found.get(k, ()):
                if len(taken) < texts and held + n <= symbols:
                    taken.append(h)
                    held += n
            if x < 1 and len(taken) < texts and held < symbols / 2:
                again[k] = 8 * x  # came short: look at more, at last at all
            elif taken:
                chosen[k] = taken
            elif k in found:
                chosen[k] = [min(found[k], key=lambda c: (c[1], c[0]))[0]]
        shares = again
    sample: dict[str, dict[int, str]] = {}
    if chosen:
        wanted = F.create_map(*[x for k, hs in chosen.items() for x in (F.lit(k), F.array(*map(F.lit, hs)))])
        rows = known.filter(F.array_contains(F.element_at(wanted, F.col("lang")), F.col("h")))
        for row in rows.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
            sample.setdefault(row["lang"], {})[row["h"]] = row["text"]
    letters = "".join(sorted({c for found in sample.values() for t in found.values() for c in t.lower() if c.isalpha()}))
    table = Model.build({}, letters).lookup()
    parts: dict[str, list[int]] = {}
    for name, found in sample.items():
        parts[name] = [s for h in chosen[name] if h in found for s in [*to_symbols([found[h]], table)[0].tolist(), 0]]
    return Model.build(parts, letters)


def classify(texts: list[str | None], model: Model, table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and best phrases per symbol of each text."""
    names, scores, rates = [], np.zeros(len(texts)), np.ones(len(texts))
    symbols, starts = to_symbols([t or "" for t in texts], table)
    sizes = np.diff(starts)
    letters = np.concatenate([[0], np.cumsum(symbols > 0)])
    lettered = letters[starts[1:]] > letters[starts[:-1]]
    counts = count_phrases(symbols, starts, model)
    for i in range(len(texts)):
        if not lettered[i] or not model.languages:
            names.append(UNKNOWN)
            continue
        row = counts[i]
        best = int(row.argmin())  # ties: the first by name
        rest = np.delete(row, best)
        names.append(model.languages[best])
        scores[i] = 1.0 - row[best] / rest.min() if len(rest) else 1.0
        rates[i] = row[best] / sizes[i]
    return names, scores, rates


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and phrase_rate added; no other column is read.

    score: 1 - phrases of the best / phrases of the second-best language, from 0 to
    1. phrase_rate: phrases per symbol of the best language, 1 at most. Text that is
    null or has no letter: 'und', score 0, rate 1. Columns of the added names are
    replaced; all others, whatever their names, pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the FIT bounds
    names = others(docs.columns, ADDED)
    read = names if text in names else [*names, text]
    rows = numbered(docs, read)
    plain = rows.columns[: len(names)]
    place, most = read.index(text), max(1, GROUP_CHARS // max(4, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = _tables.get(m.letters)
        if table is None:
            _tables.clear()
            table = _tables.setdefault(m.letters, m.lookup())
        for batch in batches:
            texts = batch.column(place).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < most:
                    size += len(texts[end] or "")
                    end += 1
                langs, scores, rates = classify(texts[start:end], m, table)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores), pa.array(rates)],
                    names=[*plain, *ADDED],
                )
                start = end

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(lean(run), f"{schema}lang_pred string, score double, phrase_rate double").toDF(*names, *ADDED)


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
