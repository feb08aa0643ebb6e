"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of labelled text accepts
all its substrings. A text is parsed greedily into longest matches; the language that
needs the fewest phrases per character explains it best.

Texts are parsed as running text: letters (and marks on them) in lower case, anything
between two words as one space. Each language's automaton is built in a task of its own
and laid out there as a table of rows that are put into each other's gaps, so its size
goes with the sample and not with the alphabet. A batch's texts are parsed at once, a
character of each and all languages a step. For that, texts are laid out in stretches of
`STRETCH` characters; a stretch that the one before it enters in the middle of a phrase is
parsed again from there, until both ways of parsing it meet. So phrases are those of the
whole text.

Texts that are null or hold no letter get `und` and score 0. If nothing was labelled,
all texts get `und`. Ties go to the first language by name. Repeated rows each get their
row, very long texts are parsed whole, an empty table gives no rows, and extra columns
of any name are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

UNDETERMINED = "und"
SAMPLE_DOCS = 120
SAMPLE_CHARS = 60_000
TOTAL_CHARS = 2_000_000
STRETCH = 2048
ROUNDS = 3
BATCH_CHARS = 2_000_000
_SPACE, _LETTER, _MARK = 0, 1, 2


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, a mark or neither, and its lower case if that is one character."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = _LETTER
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif unicodedata.category(c)[0] == "M":
            kind[i] = _MARK
    return kind, lower


def running(text: str) -> np.ndarray:
    """A text's letters and marks as code points in lower case, with one space before, between and behind words; empty without a letter."""
    kind, lower = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = kind[points]
    if not (kinds == _LETTER).any():
        return np.zeros(0, np.uint32)
    out = np.full(len(points) + 2, 32, np.uint32)
    out[1:-1] = np.where(kinds == _SPACE, 32, lower[points])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def _suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Ways of each state on by code; state 0 is the start."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(ways)
        ways.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(ways)
                ways.append(dict(ways[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return ways


def _laid_out(ways: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An automaton as (first, base, cells): a state's way on by code c is at base[state] + c.

    `cells` has the state there (upper half) and where the way leads (lower half), `first`
    where the start's ways lead. States with most ways are placed first, each in the first
    gap found. Codes are below `size`.
    """
    used, cells, base = bytearray(size), [-1] * size, np.zeros(len(ways), np.int32)
    low = high = size
    for state in sorted(range(len(ways)), key=lambda s: -len(ways[s])):
        own = ways[state]
        if not own:
            continue
        codes = list(own)
        at = low - codes[0]
        for _ in range(64):
            if all(at + c >= len(used) or not used[at + c] for c in codes):
                break
            at += 1
        else:
            at = high
        while len(used) < at + size + 1:
            used += bytes(size)
            cells += [-1] * size
        base[state] = at
        for c, to in own.items():
            used[at + c] = 1
            cells[at + c] = state << 32 | to
        high = max(high, at + max(codes))
        while low < len(used) and used[low]:
            low += 1
    first = np.zeros(size, np.int32)
    for c, to in ways[0].items():
        first[c] = to
    return first, base, np.array(cells + [-1] * size, np.int64)


def _table(text: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _laid_out(_suffix_automaton((np.searchsorted(alphabet, text) + 1).tolist()), len(alphabet) + 1)


class Model:
    """Suffix automata of all languages in one table.

    State 0 is no language's: it has no ways on, and every text begins there. Other states
    are numbered through, language by language.
    """

    def __init__(self, samples: dict[str, str]):
        texts = {k: running(samples[k]) for k in sorted(samples)}
        alphabet = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.uint32)
        self._put_together(alphabet, {k: _table(t, alphabet) for k, t in texts.items()})

    @classmethod
    def of(cls, alphabet: np.ndarray, tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        model = cls.__new__(cls)
        model._put_together(alphabet, tables)
        return model

    def _put_together(self, alphabet: np.ndarray, tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.languages, self.alphabet = sorted(tables), alphabet
        size = len(alphabet) + 1
        first, base, cells = [], [np.zeros(1, np.int32)], [np.full(size, -1, np.int64)]
        states, places = 1, size
        for k in self.languages:
            f, b, c = tables[k]
            first.append(np.where(f > 0, f + states, 0).astype(np.int32))  # no way leads back to the start
            base.append((b + places).astype(np.int32))
            cells.append(np.where(c >= 0, c + (states << 32) + states, -1))
            states, places = states + len(b), places + len(c)
        self.first = np.stack(first) if first else np.zeros((0, size), np.int32)
        self.base, self.cells = np.concatenate(base), np.concatenate(cells)

    def _step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the next characters, and where a new phrase began with them."""
        cell = self.cells[self.base[state] + code]
        on = (cell >> 32) == state
        return np.where(on, cell.astype(np.int32), self.first[:, code]), ~on

    def _codes(self, flat: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == flat, place + 1, 0).astype(np.int32)

    def _whole(self, text: np.ndarray) -> np.ndarray:
        """Phrases of one text, by language, a character a step."""
        state = np.zeros((len(self.languages), 1), np.int32)
        cuts = np.zeros(len(self.languages), np.int64)
        for c in self._codes(text):
            state, new = self._step(state, np.array([c]))
            cuts += new[:, 0]
        return cuts

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that running texts are parsed into, a row per language."""
        count = np.zeros((len(self.languages), len(texts)), np.int64)
        lanes = [(i, a, t[a : a + STRETCH]) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        lanes.sort(key=lambda x: -len(x[2]))
        if not lanes or not self.languages:
            return count
        sizes = np.array([len(x[2]) for x in lanes])
        flat = self._codes(np.concatenate([x[2] for x in lanes]))
        coded = np.zeros((int(sizes[0]), len(lanes)), np.int32)
        lane, starts = np.repeat(np.arange(len(lanes)), sizes), np.cumsum(sizes) - sizes
        coded[np.arange(len(flat)) - starts[lane], lane] = flat
        end = np.zeros((len(self.languages), len(lanes)), np.int32)
        cuts = np.zeros(end.shape, np.int64)
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
        for c, n in zip(coded, live.tolist(), strict=True):
            end[:, :n], new = self._step(end[:, :n], c[:n])
            cuts[:, :n] += new
        owner = np.array([x[0] for x in lanes])
        unmet = self._carry(lanes, sizes, coded, end, cuts)
        for k in range(len(count)):
            count[k] = np.bincount(owner, cuts[k], len(texts)).astype(np.int64)
        for i in np.unique(owner[unmet]).tolist():  # such as one word without end, which never meets
            count[:, i] = self._whole(texts[i])
        return count

    def _carry(self, lanes: list, sizes: np.ndarray, coded: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Mends `end` and `cuts` of stretches, parsed from the start, for the state in which the one before ends; returns those still open after ROUNDS."""
        at = {(x[0], x[1]): j for j, x in enumerate(lanes)}
        later = np.array([j for j, x in enumerate(lanes) if x[1]], np.int64)
        before = np.array([at[lanes[j][0], lanes[j][1] - STRETCH] for j in later.tolist()], np.int64)
        begin = np.zeros(end.shape, np.int32)
        for _ in range(ROUNDS):
            apart = (end[:, before] != begin[:, later]).any(axis=0)
            own = later[apart]
            old, new = begin[:, own], end[:, before[apart]]
            begin[:, own] = new
            ends = set(sizes[own].tolist())
            for i, c in enumerate(coded):
                if i % 8 == 0 or i in ends:  # those that have met may go on until then, as both sides count alike
                    done = sizes[own] == i
                    end[:, own[done]] = new[:, done]
                    keep = ~done & (old != new).any(axis=0)
                    own, old, new = own[keep], old[:, keep], new[:, keep]
                    if not len(own):
                        break
                old, less = self._step(old, c[own])
                new, more = self._step(new, c[own])
                cuts[:, own] += more.astype(np.int64) - less
            end[:, own] = new
        return later[(end[:, before] != begin[:, later]).any(axis=0)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [running(t) if t else np.zeros(0, np.uint32) for t in texts]
        chars = np.array([len(t) for t in plain])
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cost = self.phrases(plain) / np.maximum(chars, 1)
        best, low = cost.argmin(axis=0), cost.min(axis=0)
        share = 1 / np.exp(-20 * (cost - low)).sum(axis=0)
        return [self.languages[b] if n else UNDETERMINED for b, n in zip(best, chars, strict=True)], [float(x) if n else 0.0 for x, n in zip(share, chars, strict=True)]


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on excerpts of about `sample_docs` texts per language from (key, text, lang), at most `sample_chars` characters each language.

    All languages are learned; with many, each has less text, so that all have TOTAL_CHARS
    together and the model, some 40 bytes a character, a bounded size. Texts are chosen by a
    hash of key and text, and so is the place in a long text where its excerpt begins.
    Repeated excerpts count once. An automaton is built in its language's task; the driver
    only puts the finished tables behind one another.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("key", "text").alias("mark"))
    sizes = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    languages = max(1, sizes.count())
    most = max(200, min(sample_chars, TOTAL_CHARS // languages))
    share = F.least(F.lit(1.0), F.lit(sample_docs) / F.col("n"))
    each = F.greatest(F.lit(200), F.floor(F.lit(2 * most) / F.least("n", F.lit(sample_docs)))).cast("int")
    places = F.greatest(F.length("text") - each + 1, F.lit(1))
    picked = known.join(sizes, "lang").where(F.pmod(F.xxhash64("mark", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    excerpts = picked.select("lang", F.substring("text", F.pmod(F.xxhash64("mark", F.lit(5)), places).cast("int") + 1, each).alias("text"))
    excerpts = written(excerpts.dropDuplicates(), "language-excerpts")

    def characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"point": np.unique(np.concatenate([running(t) for t in pdf["text"]])).astype(np.int64)})

    alphabet = np.array([r["point"] for r in excerpts.mapInPandas(characters, "point long").distinct().orderBy("point").collect()], np.uint32)  # no more than there are characters

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        text = running(" ".join(sorted(pdf["text"]))[:most])
        first, base, cells = _table(text, alphabet) if len(text) else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "first": [first.tobytes()], "base": [base.tobytes()], "cells": [cells.tobytes()]})

    built = excerpts.repartition(min(languages, 2000), "lang").groupBy("lang").applyInPandas(build, "lang string, first binary, base binary, cells binary").collect()  # bounded by TOTAL_CHARS
    return Model.of(alphabet, {r["lang"]: (np.frombuffer(r["first"], np.int32), np.frombuffer(r["base"], np.int32), np.frombuffer(r["cells"], np.int64)) for r in built if len(r["base"])})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row (doc_id, text): doc_id, lang_pred and score (0 to 1, the share of the best language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = np.cumsum(pdf["text"].map(lambda t: len(t) if t else 0).to_numpy())
            first = 0
            while first < len(pdf):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BATCH_CHARS, "right")))
                own = pdf.iloc[first:last]
                langs, scores = shared.value.predict(own["text"].tolist())
                yield pd.DataFrame({"doc_id": own["doc_id"], "lang_pred": langs, "score": scores})
                first = last

    return map_texts(docs, run, "lang_pred string, score double")
