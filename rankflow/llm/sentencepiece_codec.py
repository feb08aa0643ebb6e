"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A merge-type vocabulary has one encoding per text: the one that greedy merging by
score gives. It is found here without merging the text: a text's encoding is the
only token sequence in which every pair of neighbours stays apart when the two are
merged again from their characters. So the encoder walks the text with the longest
tokens (an Aho-Corasick scan over the reversed text lists the tokens that start at each
place), checks each new neighbour pair, falls back to shorter tokens, steps back
when none fits, and marks places from which no encoding exists in a bitfield, so
that none is tried twice.

Pieces never hold a space mark behind another character (checked on load), so texts
are cut there. Arrow finds the distinct words of a batch; each is encoded once and its
result kept in a bounded memo per worker. Runs of space marks, whose pieces all have one
score (checked on load), are merged from the left, as the library does, in linear time;
texts with such runs, or with a mark before a space, are cut by themselves.

Null texts count as empty. An empty text has the end id alone. Very long texts, and very
long parts without a space, are handled as any other. Repeated rows give repeated
results, an empty table none. Extra columns of any name are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .words import Cut, Kept, map_arrow

MARK = "▁"
MEMO = 200_000
PAIR_MEMO = 200_000
LONGEST_KEPT = 40


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.eos = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, s in enumerate(special) if s}
        self.rank = {p: -sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if sp.normalize(" Aé ﬁ ") != f"{MARK}{MARK}Aé{MARK}ﬁ{MARK}":
            raise ValueError("the model normalises texts in another way")
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.id):
            raise ValueError("a piece holds a space mark behind other characters")
        self.known = {p for p in self.id if len(p) == 1}
        if any(not set(p) <= self.known for p in self.id):
            raise ValueError("a piece holds a character that is no piece")
        self.scan = ahocorasick.Automaton()
        usable = [p for p in self.id if (p.strip(MARK) or len(p) == 1) and (len(p) == 1 or self._merged(p) == [p])]
        for p in usable:
            self.scan.add_word(p[::-1], p)
        self.scan.make_automaton()
        have = set(usable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in have), None) for p in usable}
        self.runs = {len(p) for p in self.id if not p.strip(MARK)}
        if len({self.rank[MARK * n] for n in self.runs if n > 1}) > 1:
            raise ValueError("runs of space marks have several scores")
        self.memo: Kept = Kept(MEMO)
        self.feeds = "\n" not in self.known  # a line feed is no part of a piece, so texts can be cut before it
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Punctuation that no piece joins to a letter, digit or other character: texts can be cut at its runs too.
        plain = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "}
        while mixed := {c for p in self.id for x, y in zip(p, p[1:], strict=False) for c in (x, y) if c in plain and ({x, y} - plain - {MARK})}:
            plain -= mixed
        inner = "".join(map(re.escape, sorted(plain)))
        self.parts = re.compile(f"{MARK}*[^{MARK}{inner}]+|{MARK}*[{inner}]+|{MARK}+")

    def _merged(self, text: str) -> list[str]:
        """Greedy merging of a text: best score first, then the leftmost."""
        parts, rank, none = list(text), self.rank.get, float("inf")
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) != none:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merged_marks(self, n: int) -> list[str]:
        """Greedy merging of `n` space marks, always the leftmost pair that makes a piece."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return [MARK * k for k in done]

    def _apart(self, key: tuple[str, str]) -> bool:
        """Whether two pieces stay two tokens when their characters are merged again."""
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        known = self.pairs[key] = self._merged(key[0] + key[1]) == [*key]
        return known

    def _backtrack(self, text: str) -> list[str]:
        """The encoding of a text of known characters with at most one space mark, in front."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.scan.iter(text[::-1]):  # the longest of an end comes first
            if longest[~end] is None:
                longest[~end] = piece
        failed = bytearray((n >> 3) + 1)
        tokens: list[str] = []
        at, piece, shorter, pairs = 0, longest[0], self.shorter, self.pairs
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not tokens or (pairs[key] if (key := (tokens[-1], piece)) in pairs else self._apart(key))):
                    break
                piece = shorter[piece]
            if piece is not None:
                tokens.append(piece)
                at = end
                piece = longest[at] if at < n else None
            elif tokens:
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter[last := tokens.pop()]
                at -= len(last)
            else:
                raise ValueError("no encoding found")
        return tokens

    def _part(self, part: str) -> list[int]:
        """Ids of one part: a run of space marks, then characters without one."""
        ids = self.id
        if part[1:2] != MARK and self.known.issuperset(part):
            return [ids[p] for p in self._backtrack(part)]
        run = len(part) - len(part.lstrip(MARK))
        body: list[list[str] | bytes] = []
        i = max(0, run - 1)
        while i < len(part):
            j = i
            if part[i] in self.known:
                while j < len(part) and part[j] in self.known:
                    j += 1
                body.append(self._backtrack(part[i:j]))
            else:
                while j < len(part) and part[j] not in self.known:
                    j += 1
                body.append(part[i:j].encode())
            i = j
        marks: list[int] = []
        if run:
            if body and body[0][0] != MARK:
                run -= 1  # the last mark belongs to the characters behind it
            else:
                body[0] = body[0][1:]
            marks = [ids[p] for p in self._merged_marks(run)]
        return marks + [i for b in body for i in ([self.bytes[x] for x in b] if isinstance(b, bytes) else [ids[p] for p in b])]

    def _plain(self, ids: list[int]) -> str:
        """The characters of the ids; marks become spaces, byte ids characters, control ids nothing."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of the ids without the one space that encoding puts in front."""
        return self._plain(ids).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        """All ids of a whole text, the end id last."""
        return [i for p in self._cut(text) for i in self._part(p)] + [self.eos]

    def _cut(self, text: str) -> list[str]:
        return self.parts.findall(f"{MARK}{text}".replace(" ", MARK)) if text else []

    def _known(self, part: str) -> tuple[str, int, str]:
        """Ids as text, their number and decoded text of one part."""
        known = self.memo.find(part)
        if known is None:
            own = self._part(part)
            known = (" ".join(map(str, own)), len(own), self._plain(own))
            if len(part) <= LONGEST_KEPT:
                self.memo.keep(part, known)
        return known

    def _word(self, word: str) -> tuple[str, int, str]:
        """As `_known`, for a word with a space, or nothing but its line feed, before it."""
        parts = self.parts.findall(word if word[0] == "\n" and self.feeds else (MARK + word).replace(" ", MARK))
        if len(parts) == 1:
            return self._known(parts[0])
        found = [self._known(p) for p in parts]
        return " ".join([f[0] for f in found]), sum([f[1] for f in found]), "".join([f[2] for f in found])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        rows = [self._known(p) for p in self._cut(text)]
        ids = " ".join([*[r[0] for r in rows], str(self.eos)])
        plain = "".join([r[2] for r in rows]).removeprefix(" ")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()

    def digests(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of `digest` for many texts, each distinct word encoded once."""
        cut, known, make = Cut(texts, self.feeds), self.memo.young, self._word
        feed = "\n" if self.feeds else ""  # a word that begins with its line feed has no mark before it, and so another part
        found = [known[k] if (k := w if w[:1] == feed else MARK + w) in known else make(w) if w else ("", 0, "") for w in cut.words]
        counts = cut.sums(np.array([f[1] for f in found], np.int64)) + 1
        end = f" {self.eos}"
        ids = [hashlib.sha256((x + end).encode()).hexdigest() for x in cut.joined([f[0] for f in found], " ")]
        plain = [hashlib.sha256(x.removeprefix(" ").encode()).hexdigest() for x in cut.joined([f[2] for f in found], "")]
        for i in np.flatnonzero(cut.any_of(np.array([not w or w[-1] == MARK for w in cut.words], bool))):
            counts[i], ids[i], plain[i] = self.digest(texts[int(i)].as_py() or "")
        return [pa.array(counts), pa.array(ids, pa.string()), pa.array(plain, pa.string())]


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a model file, built once in each Python process."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of its whole text.

    A narrow stage: rows stay in the partitions they were read in.
    """

    return map_arrow(docs, lambda texts: codec(model_file).digests(texts), "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and `ids`, all ids of its whole text with the end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [own.encode(t or "") for t in pdf["text"]]})

    return map_texts(docs, run, "ids array<int>", id_col, text_col)


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and `text`, the decoded ids (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [own.decode([int(i) for i in x]) if x is not None else "" for x in pdf["text"]]})

    return map_texts(rows, run, "text string", id_col, ids_col)
