"""Language ID by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton, which knows every piece of that
text. A document is parsed greedily into the longest phrases the automaton knows; the language that needs the
fewest phrases, weighed by the size of its sample, wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_CHARS = 20_000
SAMPLE_DOCS = 40
LANE = 1024
UNKNOWN = "und"

_built: dict[int, "Parser"] = {}


def sample(docs: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(language, text) of at most ``chars`` characters per language, from at most ``rows`` documents.

    The documents with the least id hashes are taken, in hashed slices first, so that no language is one task.
    This is the bounded sample the model is fitted on; rows without text, language or letters are left out.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(
        "lang", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, chars).alias("text")
    )
    sliced = known.withColumn("slice", F.pmod("h", F.lit(256)))
    first = Window.partitionBy("lang", "slice").orderBy("h", "text")
    some = sliced.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows)
    every = Window.partitionBy("lang").orderBy("h", "text")
    chosen = some.withColumn("k", F.row_number().over(every)).where(F.col("k") <= rows).select("lang", "k", "text")
    texts: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"])):
        texts[row["lang"]] = (texts.get(row["lang"], "") + " " + row["text"])[:chars]
    return [(lang, text) for lang, text in sorted(texts.items()) if any(c.isalpha() for c in text)]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (state, symbol) of the suffix automaton of a sequence; 0 where there is none, 1 is the start.

    Symbols run from 1; column 0 stands for characters no sample has.
    """
    room = 2 * len(symbols) + 2
    to = np.zeros((room, width), np.int32)
    link, length = [0] * room, [0] * room
    last, used = 1, 2
    for c in symbols:
        new, used = used, used + 1
        length[new] = length[last] + 1
        at = last
        while at and not to[at, c]:
            to[at, c] = new
            at = link[at]
        if not at:
            link[new] = 1
        else:
            old = int(to[at, c])
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy, used = used, used + 1
                length[copy] = length[at] + 1
                to[copy] = to[old]
                link[copy] = link[old]
                while at and to[at, c] == old:
                    to[at, c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return to[:used].copy()


class Parser:
    """The automata of all languages over one alphabet; memory is bounded by the sample."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.langs = [lang for lang, _ in texts]
        folded = [self._points(text) for _, text in texts]
        alphabet = np.unique(np.concatenate(folded)) if folded else np.zeros(0, np.int64)
        self.code = np.zeros(0x110000, np.int32)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.tables = [automaton(self.code[p].tolist(), self.width).reshape(-1) for p in folded]
        self.weight = [np.log2(len(p) + 1) for p in folded]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        """Code points in small letters, runs of anything but letters as one blank."""
        small = text.lower()
        points = np.frombuffer(small.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _LETTER[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        return np.where(letter, points, 32)[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and characters by text.

        A text is parsed in lanes of ``LANE`` characters that are stepped together, each lane starting a phrase.
        """
        codes = [self.code[self._points(t)] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // LANE) for c in codes])
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        chars = np.array([len(c) for c in codes], np.int64)
        if not len(owner):
            return counts, chars
        lanes = np.full((len(owner), LANE), -1, np.int32)
        at = 0
        for c in codes:
            n = -(-len(c) // LANE)
            if n:
                lanes[at : at + n].reshape(-1)[: len(c)] = c
                at += n
        size = (lanes >= 0).sum(1)
        rank = np.argsort(-size, kind="stable")
        steps = np.ascontiguousarray(lanes[rank].T)
        active = np.searchsorted(-size[rank], -np.arange(LANE), "left")
        for k, table in enumerate(self.tables):
            state = np.ones(len(owner), np.int64)
            made = np.ones(len(owner), np.int64)
            for i in range(int(size.max())):
                n = int(active[i])
                sym = steps[i, :n]
                new = table[state[:n] * self.width + sym]
                miss = np.flatnonzero(new == 0)
                if i:
                    made[miss] += 1
                if len(miss):
                    # A new phrase begins with this character; one that no sample has leads to state 0, from
                    # which nothing goes on, and so is a phrase of its own.
                    new[miss] = table[self.width + sym[miss]]
                state[:n] = new
            counts[:, k] = np.bincount(owner[rank], made, len(texts)).astype(np.int64)
        return counts, chars


_LETTER = np.zeros(0x110000, bool)
for _c in range(0x110000):
    if chr(_c).isalpha():
        _LETTER[_c] = True


def _parser(texts: list[tuple[str, str]]) -> Parser:
    name = hash(tuple(texts))
    if name not in _built:
        _built.clear()
        _built[name] = Parser(texts)
    return _built[name]


def identify(docs: DataFrame, texts: list[tuple[str, str]], carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``lang_pred`` and ``score``; only ``text`` decides.

    Costs are phrases times the bits of a place in the sample, per character. The least cost wins, ties by name;
    ``score`` is one minus its ratio to the second least (1 with one language). NULL texts, and such without a
    letter, are ``und`` with score 0, as is everything when no language was learned. Every row gets one result;
    nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                counts, chars = parser.phrases([t or "" for t in some.column(0).to_pylist()])
                names, scores = [UNKNOWN] * len(chars), np.zeros(len(chars))
                if parser.langs:
                    cost = counts * np.array(parser.weight) / np.maximum(chars, 1)[:, None]
                    best = np.argmin(cost, 1)
                    ordered = np.sort(cost, 1)
                    known = chars > 0
                    for i in np.flatnonzero(known):
                        names[i] = parser.langs[best[i]]
                    scores[known] = 1.0 if len(parser.langs) == 1 else (1 - ordered[:, 0] / ordered[:, 1])[known]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*some.schema.names[1:], "lang_pred", "score"],
                )

    named = docs.select("text", *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return named.mapInArrow(parse, f"{kinds}, lang_pred string, score double")
