"""Texts cut into words with Arrow, so that an encoder meets each distinct word of a batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 8_000_000


def slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches of about `most` bytes; a longer text is a stretch of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last - first
        pa.default_memory_pool().release_unused()  # workers live on, and Arrow would keep what a stretch needed
        first = last


class Cut:
    """The parts of some texts between single spaces: `words` (distinct), `codes` (one for each part), `offsets` (of each text's first part).

    A line feed begins a part of its own, which then has the feed in front and no
    space before it. A text with spaces in a row, at an end or next to a line feed has an
    empty part.
    """

    def __init__(self, texts: pa.Array, feeds: bool = True):
        plain = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n") if feeds else plain, " ")
        coded = pc.dictionary_encode(parts.flatten())
        self.offsets = parts.offsets.to_numpy().astype(np.int64)
        self.offsets -= self.offsets[0]
        self.codes = coded.indices.to_numpy()
        self.words: list[str] = coded.dictionary.to_pylist()

    def any_of(self, flags: np.ndarray) -> np.ndarray:
        """Whether a text has a part whose word is flagged."""
        return np.logical_or.reduceat(flags[self.codes], self.offsets[:-1]) if len(self.offsets) > 1 else np.zeros(0, bool)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of its words' values."""
        return np.add.reduceat(values[self.codes], self.offsets[:-1]) if len(self.offsets) > 1 else np.zeros(0, np.int64)

    def joined(self, values: list[str], mark: str) -> list[str]:
        """Per text its words' values, with `mark` between them."""
        taken = pa.array(values, pa.string()).take(pa.array(self.codes))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), taken), mark).to_pylist()


class Kept:
    """A memo of at most 2 * `size` entries: where `young` is full, it replaces `old`; what is found in `old` gets young again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, key):
        known = self.young.get(key)
        if known is None and (known := self.old.get(key)) is not None:
            self.keep(key, known)
        return known

    def keep(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()  # callers may hold this dictionary
        self.young[key] = value


def map_arrow(docs: DataFrame, run: Callable[[pa.Array], list], fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id and `fields`, the columns that `run` finds for stretches of texts. Ids pass as text; rows stay in their partitions."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *(f.strip().split(" ")[0] for f in fields.split(","))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, count in slices(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(first, count), *run(texts.slice(first, count))], names)

    return rows.mapInArrow(found, f"doc_id string, {fields}").withColumn("doc_id", F.col("doc_id").cast(kind))
