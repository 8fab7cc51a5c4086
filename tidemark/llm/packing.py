"""Best-fit packing whose partitions are certified by lower bounds.

Documents become token ids with an end id; those longer than a sequence are cut. The pieces are dealt to groups of
about GROUP pieces, and each group is packed best-fit decreasing. Dual-feasible functions bound each group's number of
bins from below: a group that meets its bound is certified and done. Groups with a gap release the pieces of their
unfilled bins, which are dealt anew to fewer groups, mixed with those of other groups, and packed again, as long as that
saves bins.

Null texts count as empty: one piece with the end id. Repeated rows are packed one by one. An empty table gives none.
Extra columns of the input are left out of pieces(), and kept by pack() but for its own result columns.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text, written

#: Pieces in a group that is packed at once.
GROUP = 8192
CAPACITY = 2048
END = 0
#: Encoded words that a Python worker remembers.
REMEMBERED = 300_000
_SPACES = re.compile(r"\s\x20|\x20\s")
#: Columns of pack() while it runs.
_OWN = "_pk_group bigint, _pk_bin bigint, _pk_at bigint, _pk_used bigint, _pk_gap bigint"


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    Where every space stands alone between two words, pretokens never reach over it, so words are encoded one by one
    and remembered. Any other text, and one that spells a special token, goes to the tokenizer whole.
    """

    def __init__(self, tokenizer: str):
        import json

        from tokenizers import Tokenizer

        with open(tokenizer) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.whole = Tokenizer.from_file(tokenizer)
        self.known: dict[str, bytes] = {}
        self.by_word = self._by_word(spec)

    @staticmethod
    def _by_word(spec: dict) -> Callable[[str], list[int]] | None:
        """An encoder of single words with the same vocabulary, if it can be had: ranks are the ids."""
        import tiktoken

        from public_tokenizers import PATTERN

        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        extra = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in extra}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _SPACES.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known, get = self.known, self.known.get
        words = text.split(" ")
        out = []
        for i, w in enumerate(words):
            if i:
                w = " " + w
            ids = get(w)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self.by_word(w)
                ids = struct.pack(f"<{len(got)}I", *got)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(tokenizer: str) -> ByteBpe:
    return ByteBpe(tokenizer)


def _pieces(tokenizer: str, capacity: int, end: int, whole: bool, texts: list[str | None]) -> list[tuple]:
    import zlib

    encode, last, out = _encoder(tokenizer).encode, struct.pack("<I", end), []
    for t in texts:
        ids = encode(t or "") + last
        n = len(ids) // 4
        first = n % capacity or capacity
        cuts = [0, *range(min(first, n), n + 1, capacity)]
        out.append(([(i, a, b - a, ids[4 * a : 4 * b] if whole else None, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))],))
    return out


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, ids_crc32) of each document: pieces of capacity tokens, the first maybe shorter.

    tokenizer: path of a byte-level BPE file, the same on all machines. ids: without them that column is null.
    """
    ddl = "_pieces array<struct<piece:int,start:bigint,length:bigint,ids:binary,ids_crc32:bigint>>"
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return per_text(src, ddl, partial(_pieces, tokenizer, capacity, end, ids), keep=["doc_id"]).select("doc_id", F.inline("_pieces"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several bounds on the number of bins, each by a function that keeps every full bin's sum at most 1.

    One family counts items over capacity - e whole, those under e not at all and the rest in proportion, for every e up
    to half of the capacity; the other rounds (k + 1) times the share down to k-ths, unless it is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = np.concatenate([[0], np.cumsum(count * size)])
    number = np.concatenate([[0], np.cumsum(count)])
    e = np.arange(capacity // 2 + 1)
    large = number[capacity + 1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        share = (k + 1) * size
        value = np.where(share % capacity == 0, size * k, share // capacity * capacity)  # in parts of k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each item, and each bin's load: longest first, each into the fullest bin that has room."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    loads: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i], places[i] = b, loads[b]
        loads[b] += size
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, places, np.array(loads, np.int64)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items with sequence_id and offset: sequences of at most capacity, each filled from 0 without gaps.

    Every length must be from 1 to capacity. Groups are dealt by a hash of the row and its place, so equal rows part.
    """
    names = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    items = written(items.select(*[F.col(f"`{c}`") for c in names]), "pack-items")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows[length].to_numpy(np.int64)
        bins, places, loads = best_fit_decreasing(sizes, capacity)
        return rows.assign(_pk_bin=bins, _pk_at=places, _pk_used=loads[bins], _pk_gap=len(loads) - lower_bound(sizes, capacity))

    def packed(df: DataFrame, salt: int) -> DataFrame:
        n = max(1, math.ceil(df.count() / group))
        place = F.xxhash64(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id(), F.lit(salt))
        dealt = df.withColumn("_pk_group", F.pmod(place, F.lit(n)))
        return written(dealt.groupBy("_pk_group").applyInPandas(pack_group, f"{ddl}, {_OWN}"), f"pack-{salt}")

    def sequences(df: DataFrame) -> int:
        return df.where("_pk_at = 0").count()

    done, last, salt = [], packed(items, 0), 0
    while True:
        loose = (F.col("_pk_gap") > 0) & (F.col("_pk_used") < capacity)
        open_rows = last.where(loose)
        before = sequences(open_rows)
        if before < 2:
            break
        again = packed(open_rows.select(*names), salt + 1)
        if sequences(again) >= before:
            break
        done.append(_numbered(last.where(~loose), salt, names))
        last, salt = again, salt + 1
    done.append(_numbered(last, salt, names))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _numbered(df: DataFrame, salt: int, names: list[str]) -> DataFrame:
    """Sequence numbers from round (8 bits), group (35 bits) and bin (20 bits)."""
    number = F.shiftleft(F.lit(salt).cast("bigint"), 55) + F.shiftleft(F.col("_pk_group"), 20) + F.col("_pk_bin")
    return df.select(*[F.col(f"`{c}`") for c in names], number.alias("sequence_id"), F.col("_pk_at").alias("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False).drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
