"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has exactly one last token: the token with which the encoding of that prefix
ends. It is found from left to right. An automaton over the vocabulary reports the tokens that end at a
position; the last token is the one that may follow the last token of the prefix in front of it. Whether two
tokens may stand next to each other is decided by undoing their merges from the latest to the earliest: the
pair is impossible when a merge across the border would have come first. Back-pointers from the end give the ids.
The merge list is never replayed over the text.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How the byte-level vocabulary cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces and pairs a worker remembers, and the longest piece worth remembering.
MEMORY, LONGEST = 250_000, 48
# Texts encoded at a time.
SLICE = 256


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Remembered(dict):
    """The ids of short pieces met before; emptied when it is full."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.find(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file; built once per worker process."""

    def __init__(self, source: str):
        spec = json.loads(source)
        names, vocab = byte_names(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max(chain(vocab.values(), special.values())) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(names[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.special = special
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(PIECES)
        # The merge of two tokens: when it happens and what it gives; and the merge that a token came from.
        self.when: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.when[a, b] = rank
            self.parts.setdefault(made, (rank, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in special:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = Remembered(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoder can leave the tokens ``a`` and ``b`` side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self._undo(a, b)
        return found

    def _undo(self, a: int, b: int) -> bool:
        never, start = len(self.when), (-1, -1, -1)
        limit, strict = never, False
        while True:
            rank = self.when.get((a, b), never)
            if rank < limit or strict and rank == limit < never:
                return False
            made_a, made_b = self.parts.get(a, start), self.parts.get(b, start)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            # The later of the two merges is undone; of equal ones the right token was made later.
            if made_b[0] >= made_a[0]:
                limit, strict, b = made_b[0], True, made_b[1]
            else:
                limit, strict, a = made_a[0], False, made_a[2]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        raw = text.encode().decode("latin-1")
        last = [-1] * len(raw)
        size = [0] * len(raw)
        pairs, undo = self.pairs, self.compatible
        for end, (token, n) in self.automaton.iter(raw):
            if last[end] < 0:
                if end >= n:
                    pair = (last[end - n], token)
                    fits = pairs[pair] if pair in pairs else undo(*pair)
                    if not fits:
                        continue
                last[end], size[end] = token, n
        out, at = [], len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return tuple(out)

    def _plain(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.known.__getitem__, self.cut.findall(text)))

    def encode(self, text: str) -> list[int]:
        if not (self.at_special and any(s in text for s in self.special)):
            return list(self._plain(text))
        out: list[int] = []
        at = 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        out += self._plain(text[at:])
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(source: str, key: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source)
    return _codecs[key]


def _shipped(docs: DataFrame, path: str):
    """The vocabulary file, read where the job starts and sent to each executor once (its size is fixed, some MB)."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


@contextmanager
def no_collector() -> Iterator[None]:
    """Nothing here makes reference cycles, and the collector would walk the remembered pieces again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``into``, the token ids of the whole text, as the tokenizer of the file gives them.

    A null or empty text gives no ids. With ``decoded`` the text that these ids decode to is added as well. Other
    columns pass through; columns with the names of the results are replaced.
    """
    file = _shipped(docs, path)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("back", pa.string())])

    @F.arrow_udf("struct<ids:array<int>,back:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(file.value, path)
        with no_collector():
            for texts in batches:
                for at in range(0, len(texts), SLICE):  # few lists of ids at a time
                    ids = [coder.encode(t) if t else [] for t in texts.slice(at, SLICE).to_pylist()]
                    back = [coder.decode(x) for x in ids] if decoded else [None] * len(ids)
                    yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], fields=list(kind))

    both = F.col(into)
    results = {decoded: both["back"], into: both["ids"]} if decoded else {into: both["ids"]}
    return docs.withColumn(into, run(F.col(text))).withColumns(results)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids give the empty text."""
    file = _shipped(docs, path)

    @F.arrow_udf("string")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(file.value, path)
        for lists in batches:
            for at in range(0, len(lists), SLICE):
                yield pa.array([coder.decode(x) if x else "" for x in lists.slice(at, SLICE).to_pylist()], pa.string())

    return docs.withColumn(into, back(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``documents``: doc_id, number of ids, and digests of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
