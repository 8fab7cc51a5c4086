"""SentencePiece BPE encoding by a prefix table, and decoding.

BPE by merges has one encoding for every prefix of a text, so a table of each prefix's last token is enough: of the
tokens that an automaton finds to end at a place, exactly one may follow the last token of the prefix before it, as the
two side by side encode to themselves. The ids are read off the table backwards.

No token reaches from a non-space into a space, or over a newline, so a text is taken word by word, and words are
remembered. Characters the vocabulary lacks become byte ids. Null texts count as empty: only the end id. Whole texts are
encoded, however long; repeated rows are encoded one by one. Columns of the input that carry the name of a result column
give way to it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, partial

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text

SPACE = "▁"
#: Words, and pairs of tokens, that a Python worker remembers.
REMEMBERED = 400_000
_WORD = re.compile(r" *[^ \n]+| +|\n")


class PieceBpe:
    """A vocabulary of a SentencePiece BPE model with byte fallback, no normalisation and a space put in front of a text."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.end = sp.eos_id()
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.surface = {i: sp.id_to_piece(i) for i in normal}
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        # better scores merge first
        self.rank = {self.surface[i]: r for r, i in enumerate(sorted(normal, key=lambda i: -sp.get_score(i)))}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("tokens of this model reach over words")
        self.automaton = ahocorasick.Automaton()
        for i, p in self.surface.items():
            if self.merged(p) == [p]:  # others can't come out of merges
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.unknown: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best pair, the leftmost of equals, until none is left. For short texts."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        x, y = self.surface[a], self.surface[b]
        return self.merged(x + y) == [x, y]

    def table(self, text: str) -> list[tuple[int, int]]:
        """For each prefix's length the id of its last token and that token's length; new ids stand for unknown characters."""
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        fits = self.fits
        if len(fits) > 4 * REMEMBERED:
            fits.clear()
        for end, (i, k) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            if end == k:
                last[end] = (i, k)
                continue
            before = last[end - k]
            if before is None:
                before = last[end - k] = self._unknown(text[end - k - 1])
            pair = before[0] << 32 | i
            ok = fits.get(pair)
            if ok is None:
                ok = fits[pair] = self._fit(before[0], i)
            if ok:
                last[end] = (i, k)
        for e in range(1, n + 1):
            if last[e] is None:
                last[e] = self._unknown(text[e - 1])
        return last

    def _unknown(self, c: str) -> tuple[int, int]:
        i = self.unknown.get(c)
        if i is None:
            i = self.unknown[c] = 1 << 20 | ord(c)
            self.surface[i] = c
        return i, 1

    def ids_of(self, word: str) -> list[int]:
        last, out, at = self.table(word), [], len(word)
        while at:
            i, k = last[at]
            if i >> 20:
                out += [self.byte_ids[b] for b in reversed(self.surface[i].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            at -= k
        out.reverse()
        return out

    def bytes_from(self, ids: list[int]) -> bytes:
        return b"".join(bytes([self.bytes_of[i]]) if i in self.bytes_of else self.surface[i].replace(SPACE, " ").encode() for i in ids)

    def word(self, w: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and the bytes that they decode to."""
        got = self.words.get(w)
        if got is None:
            ids = self.ids_of(w.replace(" ", SPACE))
            got = len(ids), " ".join(map(str, ids)), self.bytes_from(ids)
            if len(w) < 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[w] = got
        return got

    def split(self, text: str) -> list[str]:
        return _WORD.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [i for w in self.split(text) for i in map(int, self.word(w)[1].split())] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space in front of it and control ids are left out."""
        raw = self.bytes_from([i for i in ids if i in self.bytes_of or i in self.surface])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(model: str) -> PieceBpe:
    return PieceBpe(model)


def _ids(model: str, texts: list[str | None]) -> list[tuple]:
    encoder = bpe(model)
    return [(encoder.encode(t or ""),) for t in texts]


def _texts(model: str, ids: list[list[int] | None]) -> list[tuple]:
    decoder = bpe(model)
    return [(decoder.decode(i or []),) for i in ids]


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text, the end id last. model: path of a SentencePiece file, the same on all machines."""
    return per_text(docs, f"`{out}` array<int>", partial(_ids, model), text)


def _digests(model: str, texts: list[str | None]) -> list[tuple]:
    coder, out = bpe(model), []
    end = str(coder.end)
    for t in texts:
        words = [coder.word(w) for w in coder.split(t or "")]
        ids = " ".join([w[1] for w in words] + [end])
        raw = b"".join([w[2] for w in words]).removeprefix(b" ")
        text = raw.decode("utf-8", "replace").encode()
        out.append((sum(w[0] for w in words) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return out


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the digests of the ids and of the text decoded from them, without moving the ids."""
    return per_text(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", partial(_digests, model), text)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
