r"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its paths are exactly the token sequences that the
merges can give. It is compiled by one gadget for each merge (u, v) -> w, in
rank order: the state after u loses its arc for v, every state that could read
u and then v gets an arc for w, and w leads where v led. Tokens that lead to
the same state share a row and tokens with the same arcs a column, both copied
when a gadget changes one of them, so the arcs are a bit matrix of a few
thousand classes instead of 50,000 squared.

Encoding is table-driven: for each start in a word, a trie's transitions give
the tokens that begin there, and the automaton's bit for (last token, token)
tells whether the arc exists; exactly one path reaches each position. Decoding
emits the label (the bytes) of each arc. A whole vocabulary of 50,257 entries
compiles in seconds to tables of bounded size; each worker process compiles them
once from the file, which it must be able to read, and keeps them packed, so that
nothing large passes the driver. Each task unpacks them and builds its trie.

Words are split by the vocabulary's pattern. Characters that were assigned
after the vocabulary's library are classified by that library instead; texts
with any character outside SAFE take that way. The special token's string is
one token wherever it stands in a text.

Edge cases: null counts as empty text, which has no tokens; each row gives a
row, repeated ids too; a text of any length is encoded whole, word by word; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pattern that splits texts, and characters whose class never changed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = r"[\x00-՗ -₎　-鿿가-힣]*+"
CACHE_WORDS = 300_000
WORD32 = "I"  # unsigned, 32 bits


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Arcs:
    """The automaton's arcs: allows(a, b) tells whether b can follow a; None is the start."""

    def __init__(self, n_tokens: int, base: list[int], merges: list[tuple[int, int, int]]):
        self.row = np.zeros(n_tokens, np.int32)
        self.col = np.full(n_tokens, -1, np.int32)
        self.col[base] = 0
        room = 1024
        bits = np.zeros((room, room // 8), np.uint8)  # a line for each column class, a bit for each row class
        rows = cols = 1
        bits[0, 0] = 1
        row_users, col_users = [len(base) + 1], [len(base)]  # the start uses row 0
        row, col = self.row.tolist(), self.col.tolist()
        for u, v, w in merges:
            ru, cv, rv = row[u], col[v], row[v]
            if cv < 0 or not bits[cv, ru >> 3] >> (ru & 7) & 1:
                raise ValueError(f"merge {u} {v} can never apply")
            if rows + 1 >= bits.shape[1] * 8:
                bits = np.concatenate([bits, np.zeros_like(bits)], axis=1)
            if cols + 1 >= len(bits):
                bits = np.concatenate([bits, np.zeros_like(bits)])
            if row_users[ru] > 1 or u == v:
                at, to = bits[:cols, ru >> 3] >> (ru & 7) & 1, rows
                bits[:cols, to >> 3] |= at << (to & 7)
                row_users[ru] -= 1
                row_users.append(1)
                row[u] = ru = to
                rows += 1
            if col_users[cv] > 1:
                bits[cols] = bits[cv]
                col_users[cv] -= 1
                col_users.append(1)
                col[v] = cv = cols
                cols += 1
            bits[cv, ru >> 3] &= np.uint8(255 ^ (1 << (ru & 7)))
            row[w], col[w] = rv, col[u]
            row_users[rv] += 1
            col_users[col[u]] += 1
        self.row, self.col = np.array(row, np.int32), np.array(col, np.int32)
        self.bits = np.ascontiguousarray(bits[:cols, : (rows + 7) // 8])


def compile_file(path: str) -> dict:
    """Tables of a vocabulary file: arcs, labels, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    n = max([*vocab.values(), *special.values()]) + 1
    label = [b""] * n
    for text, i in vocab.items():
        label[i] = bytes(letters[c] for c in text)
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    arcs = Arcs(n, [i for i, x in enumerate(label) if len(x) == 1], merges)
    plain = list(label)
    for text, i in special.items():
        label[i] = text.encode()
    return {
        "row": arcs.row.tolist(), "col": arcs.col.tolist(), "bits": arcs.bits.tobytes(), "width": arcs.bits.shape[1],
        "plain": plain, "label": label, "special": special, "path": path,
    }


class Coder(dict):
    """Encodes words (kept: word -> packed ids) and texts, decodes ids."""

    def __init__(self, tables: dict):
        self.row, self.col, self.bits, self.width = (tables[k] for k in ("row", "col", "bits", "width"))
        self.special = tables["special"]
        self.parts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split, self.safe = regex.compile(PATTERN).findall, regex.compile(SAFE).fullmatch
        self.path, self.library = tables["path"], None
        # a node of the trie: byte -> node; under -1 its token, where its arcs' bits start, and its length
        self.root: dict = {}
        for i, x in enumerate(tables["plain"]):
            at = self.root
            for b in x:
                at = at.setdefault(b, {})
            if x:
                at[-1] = (i, self.col[i] * self.width, len(x))
        self.lengths = np.array([len(x) for x in tables["label"]], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.labels = np.frombuffer(b"".join(tables["label"]), np.uint8)

    def encode_word(self, word: bytes) -> list[int]:
        n, row, bits, root = len(word), self.row, self.bits, self.root
        last: list = [None] * (n + 1)  # the arc by which the path reaches each position
        for i in range(n):
            if i:
                arc = last[i]
                if arc is None:
                    continue
                r = row[arc[0]]
            else:
                r = 0
            byte, bit, node, k = r >> 3, 1 << (r & 7), root, i
            for b in word[i:] if i else word:
                node = node.get(b)
                if node is None:
                    break
                k += 1
                arc = node.get(-1)
                if arc is not None and last[k] is None and bits[arc[1] + byte] & bit:
                    last[k] = arc
        out = []
        while n:
            arc = last[n]
            out.append(arc[0])
            n -= arc[2]
        out.reverse()
        return out

    def __missing__(self, word: str) -> bytes:
        ids = array(WORD32, self.encode_word(word.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        if self.safe(text):
            return self.split(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian 32-bit integers."""
        packed, at = [], 0
        for m in self.parts.finditer(text) if self.parts else ():
            packed += [*map(self.__getitem__, self.words(text[at : m.start()])), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        packed += map(self.__getitem__, self.words(text[at:] if at else text))
        return np.frombuffer(b"".join(packed), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.labels[at].tobytes().decode("utf-8", "replace")


_packed: dict[str, bytes] = {}


def tables_of(path: str) -> dict:
    """Tables of a vocabulary file; a worker process compiles it once and keeps it packed."""
    if path not in _packed:
        _packed[path] = zlib.compress(pickle.dumps(compile_file(path)), 1)
    return pickle.loads(zlib.decompress(_packed[path]))


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = True, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, then the digests of ids and decoded text, then the ids if asked for."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens"] + ["ids_sha256", "decoded_sha256"] * digests + ["ids"] * ids
    types = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tables_of(path or default_path()))  # of the task, so that an idle worker holds no words
        for batch in batches:
            n, one, two, all_ids = [], [], [], []
            for text in batch.column(1):
                got = coder.encode(text.as_py() or "")
                n.append(len(got))
                if digests:
                    one.append(hashlib.sha256(got).hexdigest())
                    two.append(hashlib.sha256(coder.decode(got).encode()).hexdigest())
                if ids:
                    all_ids.append(got)
            cols = [batch.column(0), pa.array(n, pa.int64())]
            if digests:
                cols += [pa.array(one, pa.string()), pa.array(two, pa.string())]
            if ids:
                offs = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])]).astype(np.int32)
                flat = np.concatenate([*all_ids, np.zeros(0, np.uint32)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
