"""Token-id files: fixed-width bit packing with block offsets.

A data file holds whole documents in ascending id order. Layout, all integers
little-endian:

    magic "RFT1", bits u32, block u32, documents u64, tokens u64
    ids packed with `bits` bits each (the least that the vocabulary needs), in
        blocks of `block` ids; every block begins on a byte
    block offsets u64 (bytes from the start of the packed ids, one per block)
    doc ids i64, first token u64 and token count u64 per document

A reader seeks straight to any block, and unpacks a block with numpy at once.

Texts are encoded where they are read; ids, not texts, are shuffled into ranges of
doc_id, so that each task writes one file. A null text counts as empty and has the end
id alone. A very long text is encoded whole; its ids may run over many blocks. An
empty table writes no file. Extra columns of any name are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import open_fs, shared_dir, spread, written
from .words import Cut, Kept, slices

MAGIC = b"RFT1"
HEAD = struct.Struct("<4sIIQQ")
BLOCK = 8192
STRETCH = 12_000_000
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, most significant bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8)).tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits).reshape(count, bits)
    width = max(8, 1 << (bits - 1).bit_length())
    wide = np.zeros((count, width), np.uint8)
    wide[:, width - bits :] = flat
    return np.packbits(wide, axis=1).view(f">u{width // 8}").ravel().astype(np.uint32)


class Writer:
    """Writes one file; ids go out block by block, so memory holds one block and the index."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = stream, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.tokens = self.size = 0
        self.out.write(HEAD.pack(MAGIC, bits, block, 0, 0))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.add_many([doc_id], [len(ids)], ids)

    def add_many(self, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> None:
        """Documents with so many ids each; `ids` has those of all of them."""
        for doc_id, count in zip(doc_ids, counts, strict=True):
            self.docs.append((doc_id, self.tokens, count))
            self.tokens += count
        self.rest = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(self.rest) - len(self.rest) % self.block
        for a in range(0, whole, self.block):
            self._block(self.rest[a : a + self.block])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.size)
        self.out.write(raw)
        self.size += len(raw)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        index = np.array(self.docs, "<i8").reshape(-1, 3)
        self.out.write(np.ascontiguousarray(index.T).tobytes())
        self.out.write(struct.pack("<QQQ", len(self.docs), self.tokens, self.size))


class Reader:
    """Random access to the documents of one file; `source` is seekable."""

    def __init__(self, source, length: int):
        self.source = source
        source.seek(0)
        magic, self.bits, self.block, _, _ = HEAD.unpack(source.read(HEAD.size))
        source.seek(length - 24)
        n, self.tokens, size = struct.unpack("<QQQ", source.read(24))
        blocks = -(-self.tokens // self.block)
        source.seek(HEAD.size + size)
        raw = source.read(8 * blocks + 24 * n)
        if magic != MAGIC or length != HEAD.size + size + len(raw) + 24:
            raise ValueError("not a whole token file")
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(size)).astype(np.int64)
        self.doc_ids, self.first, self.count = np.frombuffer(raw, "<i8", 3 * n, 8 * blocks).reshape(3, n)
        self.cached = (-1, np.zeros(0, np.uint32))

    def _ids(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            self.source.seek(HEAD.size + int(self.offsets[k]))
            raw = self.source.read(int(self.offsets[k + 1] - self.offsets[k]))
            self.cached = (k, unpack(raw, self.bits, min(self.block, self.tokens - k * self.block)))
        return self.cached[1]

    def ids(self, i: int) -> np.ndarray:
        """All ids of the i-th document; reads its blocks only."""
        a, n = int(self.first[i]), int(self.count[i])
        if not n:
            return np.zeros(0, np.uint32)
        k, last = a // self.block, (a + n - 1) // self.block
        parts = [self._ids(b) for b in range(k, last + 1)]
        own = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return own[a - k * self.block : a - k * self.block + n]


def id_type(vocabulary: int) -> str:
    """Type of ids on their way between tasks."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Ranges:
    """Ranges of (doc_id, row), told by the least of each but the first."""

    def __init__(self, least: list[tuple[int, int]]):
        self.doc_ids, self.rows = (np.array([x[k] for x in least], np.int64) for k in (0, 1))

    def of(self, doc_ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The range of each row; a range may begin within rows of one doc_id."""
        low, high = np.searchsorted(self.doc_ids, doc_ids), np.searchsorted(self.doc_ids, doc_ids, "right")
        for i in np.flatnonzero(low < high).tolist():
            low[i] += np.searchsorted(self.rows[low[i] : high[i]], rows[i], "right")
        return low.astype(np.int32)


def _bounds(keys: DataFrame) -> Ranges:
    """As many ranges as the table is read in, from ids alone."""
    n = keys.select(F.spark_partition_id().alias("part")).agg(F.count_distinct("part").alias("n")).first()["n"]
    ranges = keys.repartitionByRange(max(1, n), "doc_id", "row").select(F.spark_partition_id().alias("part"), F.struct("doc_id", "row").alias("key")).groupBy("part").agg(F.min("key").alias("least"))
    return Ranges(sorted((NO_ID if r["least"][0] is None else r["least"][0], r["least"][1]) for r in ranges.collect())[1:])


def _encoded(rows: DataFrame, bounds, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], vocabulary: int, end_id: int) -> DataFrame:
    """Per row (doc_id, row, text): doc_id, row, its range `part` and `ids`, the ids of the whole text and the end id, as bytes. `bounds` is a broadcast of `Ranges`."""
    kind, width = id_type(vocabulary), np.dtype(id_type(vocabulary)).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column(2), STRETCH):
                doc_ids, places, texts = (c.slice(first, n) for c in batch.columns)
                counts, ids = encode(texts)
                out = np.full(len(ids) + n, end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
                ends = np.zeros(n + 1, np.int32)
                np.cumsum((counts + 1) * width, out=ends[1:])
                parts = bounds.value.of(doc_ids.fill_null(NO_ID).to_numpy(), places.to_numpy())
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([doc_ids, places, pa.array(parts), binary], ["doc_id", "row", "part", "ids"])

    return rows.mapInArrow(run, "doc_id long, row long, part int, ids binary")


def write_files(docs: DataFrame, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], vocabulary: int, end_id: int) -> DataFrame:
    """Writes the documents (doc_id, text) to token files and returns the manifest: part, path, bytes, docs, tokens, base.

    Ranges of doc_id come from the ids alone, as many as the table is read in; texts are
    read and encoded once. Spark brings the ids of a range together and sorts them; each
    task writes its range to one file under a name of its own attempt. Only files of finished
    attempts get into the manifest, so a lost executor or a repeated task does no harm.
    `base` is the number of ids in the files before. A null doc_id comes first and is
    stored as the least 64-bit integer. Repeated doc_ids stay separate documents next to
    each other, in the order in which they were read; ranges may cut such a group.
    """
    spark = docs.sparkSession
    folder, bits, kind = shared_dir(spark, "tokens"), bits_for(vocabulary), id_type(vocabulary)
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        out = writer = None
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.rft"
        for batch in batches:
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
                writer = Writer(out, bits)
            rows = batch.column(1).cast(pa.binary())
            ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
            ids = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
            writer.add_many([NO_ID if i is None else i for i in batch.column(0).to_pylist()], (np.diff(ends) // width).tolist(), ids.astype(np.uint32))
        if writer is not None:
            writer.close()
            out.close()
            values = [[part], [path], [fs.get_file_info(path).size], [len(writer.docs)], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["part", "path", "bytes", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    bounds = _bounds(rows.select("doc_id", "row"))
    found = _encoded(rows, spark.sparkContext.broadcast(bounds), encode, vocabulary, end_id)
    ordered = found.repartitionById(len(bounds.doc_ids) + 1, "part").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    manifest = written(ordered.mapInArrow(run, "part int, path string, bytes long, docs long, tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("root", F.lit(folder))


def read_files(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens, ids_crc32 per document, from the packed ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                fs, _ = open_fs(row.root)
                with fs.open_input_file(row.path) as source:
                    reader = Reader(source, row.bytes)
                    for a in range(0, len(reader.doc_ids), 2000):
                        span = range(a, min(a + 2000, len(reader.doc_ids)))
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array([None if i == NO_ID else int(i) for i in reader.doc_ids[span.start : span.stop]], dtype="Int64"),
                                "start": reader.first[span.start : span.stop] + row.base,
                                "n_tokens": reader.count[span.start : span.stop],
                                "ids_crc32": [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in span],
                            }
                        )

    return spread(manifest).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class WordMemo:
    """Whole texts to ids with the tokenizers library, each distinct word of a batch encoded once.

    A byte-level tokenizer cuts texts into words before it merges, and a single space
    or line feed between two characters that are no white space always begins a new
    word. Texts are cut there, and the parts' ids kept in a bounded memo. Parts not seen
    before are encoded many at a time, with line feeds between them. Texts with other
    white space next to a space or feed are cut by themselves. Tokenizers of another make
    encode their texts whole.
    """

    SIZE = 300_000
    LONGEST = 48
    PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        made = json.loads(self.own.to_str())
        feed = self._whole(["\n"])[0]
        self.parts = made["pre_tokenizer"] == self.PLAIN and made["normalizer"] is None and made["post_processor"] is None and len(feed) == 1
        self.parts &= not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in made["added_tokens"])
        self.feed = feed[0]
        self.bare = Kept(self.SIZE)  # parts with no space before them
        self.later = Kept(self.SIZE)  # parts behind a space, kept without it

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, kept: Kept, parts: set[str], lead: str) -> dict[str, bytes]:
        """Ids of parts with `lead` before each; those not kept are encoded, and kept if short."""
        found, new = {}, []
        for p in parts:
            if (known := kept.find(p)) is None:
                new.append(p)
            else:
                found[p] = known
        simple = [p for p in new if p.isalpha() or not _SPACE.search(p)]
        for a in range(0, len(simple), 500):
            group = simple[a : a + 500]
            ids = np.array(self._whole(["\n".join([lead + p for p in group])])[0], "<u4")
            cuts = (4 * np.flatnonzero(ids == self.feed)).tolist()
            if len(cuts) == len(group) - 1:
                raw, start = ids.tobytes(), 0
                for p, end in zip(group, [*cuts, len(raw)], strict=True):
                    found[p] = raw[start:end]
                    start = end + 4
        rest = [p for p in new if p not in found]
        for p, ids in zip(rest, self._whole([lead + p for p in rest]) if rest else [], strict=True):
            found[p] = np.array(ids, "<u4").tobytes()
        for p in new:
            if len(p) <= self.LONGEST:
                kept.keep(p, found[p])
        return found

    def _ids(self, words: list[str], heads: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of words behind a space (or behind the line feed in front of them) and of texts' first parts.

        Marks behind a letter are words of their own, so `word.` needs `word` and `.` alone.
        """
        out: list = list(map(self.later.young.get, words))
        bare, later, made = set(heads), set(), []
        for i, known in enumerate(out):
            if known is not None:
                continue
            word = words[i]
            fed = word[0] == "\n"
            inner = word[1:] if fed else word
            core = inner.rstrip(MARKS)
            if core != inner and core and core[-1].isalpha():
                tail = inner[len(core) :]
                bare.add(tail)
            else:
                core, tail = inner, ""
            (bare if fed else later).add(core)
            made.append((i, fed, core, tail))
        b, f = self._learned(self.bare, bare, ""), np.array([self.feed], "<u4").tobytes()
        b[""] = b""
        own = self._learned(self.later, later, " ")
        for i, fed, core, tail in made:
            out[i] = (f + b[core] if fed else own[core]) + b[tail]
        return out, [b[h] for h in heads]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all."""
        if not self.parts:
            found = self._whole([t or "" for t in texts.to_pylist()])
            return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32)
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        cut = Cut(texts)
        odd = np.array([_odd_part(w) for w in cut.words], bool)
        codes, firsts = cut.codes.astype(np.int64), cut.offsets[:-1]
        heads = [cut.words[k] for k in codes[firsts].tolist()]
        odd_texts = cut.any_of(odd)
        odd_texts |= np.array([not h or h[0].isspace() for h in heads], bool)
        raws, first = self._ids([w if not o else "a" for w, o in zip(cut.words, odd.tolist(), strict=True)], [h if not o else "" for h, o in zip(heads, odd_texts.tolist(), strict=True)])
        codes[firsts] = len(raws) + np.arange(len(heads))
        raws += first
        sizes = np.array([len(r) >> 2 for r in raws], np.int64)
        flat = np.frombuffer(b"".join(raws), "<u4")
        starts = np.cumsum(sizes) - sizes
        own = sizes[codes]
        before = np.cumsum(own) - own
        ids = flat[np.repeat(starts[codes] - before, own) + np.arange(int(own.sum()))]
        counts = np.add.reduceat(own, firsts)
        if odd_texts.any():
            cuts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd_texts).tolist():
                cuts[i] = self._odd(texts[i].as_py() or "")
            counts, ids = np.array([len(c) for c in cuts], np.int64), np.concatenate(cuts)
        return counts, ids

    def _odd(self, text: str) -> np.ndarray:
        """A text with white space next to a space: cut at the single spaces alone."""
        head, *body = _CUT.split(text)
        tail = [" " + body.pop()] if body and body[-1][-1].isspace() else []
        found = self._learned(self.later, set(body), " ")
        ends = [np.array(ids, "<u4").tobytes() for ids in self._whole([head, *tail])]
        return np.frombuffer(ends[0] + b"".join([found[p] for p in body]) + b"".join(ends[1:]), "<u4")


def _odd_part(part: str) -> bool:
    """Whether a part is empty, or has white space at an end besides one line feed in front."""
    return not part or part[-1].isspace() or (part[0].isspace() and (part[0] != "\n" or part[1].isspace()))


def tokenizer_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encoder of the tokenizer file `path`, loaded once in each Python process."""

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return word_memo(path).encode(texts)

    return encode


def word_memo(path: str) -> WordMemo:
    """The memo of a tokenizer file; kept by the worker from task to task."""
    if path not in _loaded:
        _loaded[path] = WordMemo(path)
    return _loaded[path]


_loaded: dict[str, WordMemo] = {}
MARKS = ".,;:!?#$%&*)"
_SPACE = re.compile(r"\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
