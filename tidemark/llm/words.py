"""Word counts of a corpus, and its most frequent words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, small_batches, written

#: Different words that a task counts before it hands them on.
HELD = 300_000


def count_words(texts: DataFrame, split: Callable[[str], list[bytes]]) -> DataFrame:
    """Rows (word, n) of all words of the only column of texts, written to the shared folder; null texts have none.

    Each task adds up its own words before the shuffle. word: binary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(split(t))
            if len(seen) > HELD:
                yield flush()
        yield flush()

    rows = small_batches(texts).mapInArrow(count, "word binary, n bigint")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def most_frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, ties by the word: at most most rows reach the driver.

    Counts are first sorted into a thousand or so classes of about equal counts, so that only words near the front or
    above it are ranked.
    """
    kind = F.floor(F.log2("n") * 16)
    sizes = words.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect()  # 16 * log2 of the largest count
    total, least = 0, 0
    for r in sizes:
        total, least = total + r["count"], r["kind"]
        if total >= most:
            break
    top = words.where(kind >= least).orderBy(F.desc("n"), "word").limit(most)
    return [(bytes(r["word"]), r["n"]) for r in top.collect()]
