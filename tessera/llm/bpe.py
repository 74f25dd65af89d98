"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A vocabulary file of ranks (base64 of the token's bytes, rank) is a path given by the caller; every
executor opens it where it runs. The byte-to-character table of byte-level BPE turns each byte into a
printable character, so the library works on strings: its vocabulary is that of the ranks, and its merges
are all the splits of each token into two tokens, by rank. That is the merge rule of rank-based encoders,
which always join the neighbours whose concatenation has the least rank, except where two splits of one
token compete for the same middle part; those parts are found beforehand (a token with x + y = y + z, all
three tokens) and pieces in which such a string occurs are encoded by the rule itself.

A text is cut into pieces by the vocabulary's pattern and each different piece is encoded once per worker
(memory bounded by CACHE). Texts with characters on whose class libraries of different Unicode versions
differ are cut by the tokenizers library's own pre-tokenizer instead of the regex module.

Decoding reverses the byte table. A character may be split over tokens: bytes are joined before they are
read as UTF-8, and an incomplete sequence at the end of an id list becomes U+FFFD in text (the bytes stay
whole). Ids outside the vocabulary raise an error.

Null texts are empty ones; an empty text has no ids. Nothing is truncated, whatever a text's length, and
rows stay as they are, other columns included.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, small_batches, text_or_empty

#: Different pieces that a worker keeps.
CACHE = 300_000
#: The same where other stages' workers wait beside this one.
SMALL_CACHE = 80_000

#: Characters of texts that are encoded together.
RUN = 500_000

#: Characters on which the two cutters agree (tests compare them); texts with others take the library's.
_PLAIN = regex.compile(r"[^\x00-ԯḀ-⁯₠-₰←-⇿　-鿼가-힣＀-￯]")


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Codec:
    """An encoder and decoder for one vocabulary of ranks and one piece pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.characters = byte_characters()
        self.characters_of = dict(enumerate(self.characters))
        self.bytes_of = {c: b for b, c in enumerate(self.characters)}
        self.pattern = regex.compile(pattern)
        spelled = {self.spell(token): rank for token, rank in self.ranks.items()}
        splits = sorted((rank, self.ranks[t[:i]], self.ranks[t[i:]], i, t) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        model = models.BPE(vocab=spelled, merges=[(self.spell(t[:i]), self.spell(t[i:])) for *_, i, t in splits], ignore_merges=True, cache_capacity=1000)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cutter = pre_tokenizers.Split(Regex(pattern), "isolated")
        #: bytes of each id, by reversing the byte table over the library's vocabulary
        self.tokens: dict[int, bytes] = {rank: bytes(self.bytes_of[c] for c in token) for token, rank in self.library.get_vocab().items()}
        self.sizes = np.array([len(self.tokens.get(i, b"")) for i in range(max(self.tokens, default=-1) + 1)], np.int64)
        self.contested = self._contested()
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.most = CACHE

    def spell(self, raw: bytes) -> str:
        return "".join(self.characters[b] for b in raw)

    def _contested(self) -> list[bytes]:
        """Strings x + y + z in which x + y = y + z is a token whose two splits compete for y."""
        out = set()
        for t in self.ranks:
            for i in range(1, len(t)):
                y = t[:i]
                if t.endswith(y) and y in self.ranks and t[i:] in self.ranks and t[:-i] in self.ranks:
                    out.add(t[:-i] + y + t[i:])
        return sorted(out)

    @property
    def _contested_pattern(self):
        if not hasattr(self, "_found"):
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for s in self.contested:
                self._found.add_word(self.spell(s), 1)
            if self.contested:
                self._found.make_automaton()
        return self._found

    def by_rule(self, raw: bytes) -> list[int]:
        """Ids of one piece by the rule: join the leftmost neighbours of least rank until none can be joined."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        queue = [(self.ranks[pair], i, pair) for i in range(len(raw) - 1) if (pair := raw[i : i + 2]) in self.ranks]
        heapify(queue)
        while queue:
            _, i, pair = heappop(queue)
            j = after[i] if parts[i] is not None else len(raw)
            if j == len(raw) or parts[i] + parts[j] != pair:
                continue  # one of the two has been joined to something else
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[i] < len(raw):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(raw) and (pair := parts[left] + parts[right]) in self.ranks:
                    heappush(queue, (self.ranks[pair], left, pair))
        return [self.ranks[p] for p in parts if p is not None]

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern in turn."""
        if _PLAIN.search(text) is None:
            return self.pattern.findall(text)
        return [piece for piece, _ in self.cutter.pre_tokenize_str(text)]

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet in one call of the library."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(pieces)
        if not new:
            return
        coded = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids = coded.ids
        at = np.searchsorted(np.array(coded.word_ids), np.arange(len(new) + 1)).tolist()
        said, raw = list(map(str, ids)), list(map(self.tokens.__getitem__, ids))
        for piece, a, b in zip(new, at, at[1:]):
            self.known[piece] = (",".join(said[a:b]), b - a, b"".join(raw[a:b]))
        if self.contested:
            own = [p.encode() for p in new]
            ends = np.cumsum([len(o) for o in own])
            spelled = b"".join(own).decode("latin-1").translate(self.characters_of)
            # a find across the bounds of two pieces does no harm: the rule is right for every piece
            for i in {int(np.searchsorted(ends, end, "right")) for end, _ in self._contested_pattern.iter(spelled)}:
                ids = self.by_rule(own[i])
                self.known[new[i]] = (",".join(map(str, ids)), len(ids), self.decode_bytes(ids))

    def held(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text what its pieces are encoded to; texts are taken together up to about RUN characters."""
        run: list[list[str]] = []
        size = 0
        for last, text in enumerate(texts, 1 - len(texts)):
            run.append(self.pieces(text))
            size += len(text)
            if size >= RUN or not last:
                self.learn(set().union(*run))
                for pieces in run:
                    yield list(map(self.known.__getitem__, pieces))
                run, size = [], 0

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, and the SHA-256 of the ids joined by commas and of the bytes decoded from them."""
        for held in self.held(texts):
            said, n, raw = zip(*held) if held else ((), (), ())
            yield sum(n), hashlib.sha256(",".join(said).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        for held in self.held(texts):
            yield np.fromstring(",".join([h[0] for h in held]), np.int32, sep=",") if held else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point that each id's bytes touch; ids that share a split character overlap."""
        lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return (lead[ends - size] - 1).astype(np.int32), lead[ends - 1].astype(np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def encode(df: DataFrame, *, path: str, pattern: str, text_col: str = "text", out_col: str = "tokens", offsets: bool = True) -> DataFrame:
    """``df`` with a struct column (ids array<int>, starts array<int>, ends array<int>) of the text's encoding."""

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def run(column: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        texts = column.to_pylist()
        ids = list(c.encode_all(texts))
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        none = np.zeros(len(ids) + 1, np.int32)
        lists = [pa.ListArray.from_arrays(ends, np.concatenate([none[:0], *ids]))]
        if offsets:
            at = [c.offsets(t, i) for t, i in zip(texts, ids)]
            lists += [pa.ListArray.from_arrays(ends, np.concatenate([none[:0], *[a[k] for a in at]])) for k in (0, 1)]
        else:
            lists += [pa.ListArray.from_arrays(none, none[:0])] * 2
        return pa.StructArray.from_arrays(lists, ["ids", "starts", "ends"])

    return small_batches(df).withColumn(out_col, run(text_or_empty(text_col)))


def decode(df: DataFrame, *, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids spell; null ids give null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.decode(ids.as_py()) if ids.is_valid else None for ids in column], pa.string())

    return small_batches(df).withColumn(out_col, run(F.col(ids_col)))


def encode_checked(df: DataFrame, *, path: str, pattern: str, text_col: str = "text", out_col: str = "bpe") -> DataFrame:
    """``df`` with a struct column (ids array<int>, decodes boolean): the encoding, and whether it decodes to the text.

    One worker does both, so that a task needs one codec and not two.
    """

    @F.arrow_udf("struct<ids:array<int>,decodes:boolean>")
    def run(column: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        c.most = SMALL_CACHE
        texts = column.to_pylist()
        ids, fine = [], []
        for text, found in zip(texts, c.encode_all(texts)):
            ids.append(found)
            fine.append(c.decode(found.tolist()) == text)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        out = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids])), pa.array(fine, pa.bool_())], ["ids", "decodes"])
        del texts, ids, fine
        release()
        return out

    return small_batches(df).withColumn(out_col, run(text_or_empty(text_col)))


def round_trip_digests(df: DataFrame, *, path: str, pattern: str, text_col: str = "text", out_col: str = "bpe") -> DataFrame:
    """``df`` with a struct column (n_tokens, ids_sha256, decoded_sha256): encoding, then decoding of the ids."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(column: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        n, ids, raw = zip(*c.digests(column.to_pylist())) if len(column) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(df).withColumn(out_col, run(text_or_empty(text_col)))
