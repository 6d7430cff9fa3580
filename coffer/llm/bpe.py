"""Byte-level BPE that is exact in linear time, after a rank file.

Bytes stand as Latin-1 characters in an Aho-Corasick automaton of all tokens, whose trie gives the
longest token at a place. From there the encoder walks on with the longest token that is compatible with the one before it, or else a shorter one, or else steps back and never comes to
that place again. Two tokens are compatible if merging their joint bytes by rank gives just the
two; a sequence in which all neighbours are compatible is the one that the merges give.

A worker keeps the ids of a piece of text, and the bytes that they decode to, for when it comes again.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import release
from .workspace import ship

#: Entries of the two halves of a worker's cache, which ends with a task: a full half becomes the
#: older one, and what is still in use moves to the new one. The memo of pairs starts anew when it is
#: full, or has more than PAIRS_KEPT when a task ends.
CACHE = 300_000
PAIRS, PAIRS_KEPT = 1_000_000, 200_000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer pieces of text aren't kept in the cache.
CACHED_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    """Texts are Latin-1 within: a character stands for a byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {t.decode("latin-1"): i for t, i in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.names = list(map(str, range(size)))
        self.most = max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        # Whether a blank and letters are one match and a mark behind them another, as in the
        # patterns of the GPT-2 family.
        self.by_kind = r" ?\p{L}+" in pattern and r" ?[^\s\p{L}\p{N}]+" in pattern
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.ranks:
            self.automaton.add_word(token)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._shorter: dict[str, int] = {}
        self._whole: list[bool | None] = [None] * size
        self._pieces: dict[str, tuple[str, bytes]] = {}
        self._older: dict[str, tuple[str, bytes]] = {}
        self._marks: dict[str, tuple[str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """The merges by rank, one at a time: the pair of lowest rank first, the leftmost of equal
        ones. For single tokens and pairs, which are short."""
        parts, rank, none = list(text), self.ranks.get, 1 << 60
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def _compatible(self, pair: int, a: str, b: str) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        known = self._pairs[pair] = self.merged(a + b) == [a, b]
        return known

    def _reached(self, i: int, token: str) -> bool:
        known = self._whole[i] = len(token) == 1 or self.merged(token) == [token]
        return known

    def _less(self, token: str) -> int:
        """The length of the longest proper prefix that is a token; 0 for none."""
        known = self._shorter.get(token)
        if known is None:
            known = next((k for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), 0)
            self._shorter[token] = known
        return known

    def split(self, text: str) -> list[int]:
        """The ids of one match of the pattern."""
        rank, prefix, most = self.ranks.get, self.automaton.longest_prefix, self.most
        i = rank(text)
        if i is not None:
            return [i]
        pairs, whole, n = self._pairs.get, self._whole, len(text)
        out: list[int] = []
        dead = None  # places that are come to in vain; mostly there are none
        at, last, length = 0, -1, 0
        while True:
            if not length:
                # What the trie has of the text at a place begins with the longest token there.
                length = prefix(text[at : at + most]) or 1
                i = rank(text[at : at + length])
                while i is None and length > 1:
                    length -= 1
                    i = rank(text[at : at + length])
                if i is None:
                    raise ValueError("the ranks lack a single byte of the text")
            end = at + length
            if dead is None or not dead[end]:
                reached = whole[i]
                if reached is None:
                    reached = self._reached(i, text[at:end])
                if reached:
                    fits = True if last < 0 else pairs(last << 32 | i)
                    if fits is None:
                        fits = self._compatible(last << 32 | i, text[at - len(self.tokens[last]) : at], text[at:end])
                    if fits:
                        out.append(i)
                        if end == n:
                            return out
                        at, last, length = end, i, 0
                        continue
            length = self._less(text[at:end])
            while not length:
                if not out:
                    raise ValueError("no sequence of tokens gives the text")
                if dead is None:
                    dead = bytearray(n + 1)
                dead[at] = 1
                end = at
                at -= len(self.tokens[out.pop()])
                last = out[-1] if out else -1
                length = self._less(text[at:end])
            i = rank(text[at : at + length])

    def _told(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join([self.names[i] for i in ids]), self.decode(ids)

    def _piece(self, text: str) -> tuple[str, bytes]:
        found = []
        for match in self.find(text):
            found += self.split(match.encode().decode("latin-1"))
        return self._told(found)

    def _keep(self, part: str, known: tuple[str, bytes]) -> tuple[str, bytes]:
        if len(part) <= CACHED_LENGTH:
            if len(self._pieces) >= CACHE:
                self._older, self._pieces = self._pieces, {}
            self._pieces[part] = known
        return known

    def _word(self, part: str) -> tuple[str, bytes]:
        """A blank and a part of letters alone: one match of a pattern of such parts."""
        known = self._older.get(part)
        if known is None:
            known = self._told(self.split(" " + part.encode().decode("latin-1")))
        return self._keep(part, known)

    def _part(self, part: str) -> tuple[str, bytes]:
        """A blank and a part without white space at its ends, which isn't in the newer cache."""
        if self.by_kind:
            if part.isalpha():
                return self._word(part)
            if part[-1] in MARKS and part[:-1].isalpha():
                word, mark = self._pieces.get(part[:-1]) or self._word(part[:-1]), self._marks.get(part[-1])
                if mark is None:
                    mark = self._marks[part[-1]] = self._piece(part[-1])
                return self._keep(part, (f"{word[0]},{mark[0]}", word[1] + mark[1]))
        return self._keep(part, self._older.get(part) or self._piece(" " + part))

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """The ids of parts of text, joined by commas, and the bytes that they decode to. Parts end before a single blank
        between two other characters, which no match of a pattern crosses whose matches have white
        space only at their start or throughout."""
        parts = text.split(" ")
        first = parts[0]
        if len(parts) > 1 and (not first or first[-1].isspace()):
            return self._glued(parts)
        out = list(map(self._pieces.get, parts))
        i = 0
        out[0] = self._piece(first) if first else ("", b"")
        try:
            while True:
                i = out.index(None, i)
                part = parts[i]
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._glued(parts)
                out[i] = self._part(part)
        except ValueError:
            return out if first else out[1:]

    def _glued(self, parts: list[str]) -> list[tuple[str, bytes]]:
        out, part = [], [parts[0]]
        last = parts[0][-1:]
        for p in parts[1:]:
            if last and p and not last.isspace() and not p[0].isspace():
                out.append("".join(part))
                part = [" ", p]
            else:
                part += [" ", p]
            last = p[-1] if p else " "
        out.append("".join(part))
        got = []
        for text in out:
            if text[:1] == " " and text[1:] and not text[1].isspace() and not text[-1].isspace():
                got.append(self._pieces.get(text[1:]) or self._part(text[1:]))
            elif text:
                got.append(self._piece(text))
        return got

    def forget(self) -> None:
        """Drop the cached pieces, which take the most memory, for whoever shares the executor."""
        self._pieces, self._older = {}, {}
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs = {}
        release()

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """Kept by a worker for its next tasks."""
    key = path, pattern
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(path), pattern)
    return _encoders[key]


def _digest(path: str, pattern: str):
    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                counts, ids, decoded = [], [], []
                for text in b.column(1).to_pylist():
                    own_ids, raw = zip(*own.pieces(text)) if text else ((), ())
                    joined = ",".join(own_ids)
                    counts.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return run


def _encode(path: str, pattern: str):
    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                ids = [own.encode(t) if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
        own.forget()

    return run


def _decode(path: str, pattern: str):
    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            raw = [own.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], names=["id", "raw"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens; null and empty texts have none.
    path must be readable on every executor; no shuffle takes place."""
    ship(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_encode(path, pattern), "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, raw): the bytes of encode()'s rows."""
    ship(encoded.sparkSession)
    out = encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(_decode(path, pattern), "id long, raw binary")
    return out.withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the bytes that the ids decode to).

    Null texts count as empty: no tokens, digests of nothing. Rows that repeat come out alike, an
    empty table gives an empty one, null ids stay null and other columns are ignored.
    """
    ship(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_digest(path, pattern), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
