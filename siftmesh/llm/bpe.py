"""Encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.sources.tables import read

#: Folder of the public vocabulary files; none of them is copied here.
TOKENIZERS = os.environ.get("SIFTMESH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of text that a task remembers before it starts anew.
REMEMBERED = 400_000
_NONE = np.iinfo(np.int64).max
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r" \s|\s |^ | $")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: printable ones for themselves, others from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Bpe:
    """The merges of a vocabulary file as sorted pair keys, and what a task has encoded so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.pieces = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, in one flat array with offsets.

        In each round every word merges its pair of lowest rank, wherever it stands in the word, left to
        right. The pairs of all words are looked up at once, by binary search over the sorted keys.
        """
        size = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym) > 1:
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.rank[at], _NONE), _NONE)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(sym))))
            live = best < _NONE
            if not live.any():
                break
            chosen = live & (rank == best)
            # In a run of the same symbol the pairs overlap: every second one counts.
            index = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), index, 0))
            chosen &= (index - run) % 2 == 0
            gone = np.append(False, chosen[:-1])
            sym = sym.copy()
            sym[chosen] = self.merged[at[np.flatnonzero(chosen)]]
            if not live.all():
                ready.append((word[~live], sym[~live]))
            keep = live & ~gone
            sym, word = sym[keep], word[keep]
        ready.append((word, sym))
        word, sym = np.concatenate([w for w, _ in ready]), np.concatenate([s for _, s in ready])
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(words))
        return sym[order].astype(np.int32), np.append(0, np.cumsum(count))

    def learn(self, chunks: list[str]) -> None:
        """Append the ids of new chunks, each cut into pieces; a piece is merged once."""
        codes: dict[str, int] = {}
        cut = [[codes.setdefault(p, len(codes)) for p in self.pieces(c)] for c in chunks]
        flat, start = self.merge([p.encode() for p in codes])
        of = np.array([p for ps in cut for p in ps], np.int64)
        ids, length = _gather(flat, start, of)
        ends = np.cumsum(length)
        bounds = np.cumsum([len(ps) for ps in cut])
        done = np.where(bounds > 0, ends[np.maximum(bounds - 1, 0)] if len(ends) else 0, 0)
        self.start = np.concatenate([self.start, self.start[-1] + done])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts; null and empty texts have none.

        A single space between two characters that aren't white space always begins a piece, so a text is
        cut there first, and each chunk, which recurs in very many texts, is encoded once.
        """
        if len(self.first) + len(self.later) > REMEMBERED:
            self.forget()
        new: list[str] = []
        known = len(self.start) - 1
        codes: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            chunks = text.split(" ") if not _ODD_SPACE.search(text) else _INNER_SPACE.split(text)
            sizes[i] = len(chunks)
            head = self.first.get(chunks[0])
            if head is None:
                head = self.first[chunks[0]] = known + len(new)
                new.append(chunks[0])
            own = list(map(self.later.get, chunks[1:]))
            if None in own:
                for k, code in enumerate(own):
                    if code is None:
                        chunk = chunks[k + 1]
                        code = self.later.get(chunk)
                        if code is None:
                            code = self.later[chunk] = known + len(new)
                            new.append(" " + chunk)
                        own[k] = code
            codes.append(head)
            codes += own
        if new:
            self.learn(new)
        ids, length = _gather(self.flat, self.start, np.array(codes, np.int64))
        ends = np.append(0, np.cumsum(length))
        return ids, ends[np.append(0, np.cumsum(sizes))]


def _gather(flat: np.ndarray, start: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start[c]:start[c + 1]] of all codes one after another, and their lengths."""
    begin = start[codes]
    length = start[codes + 1] - begin
    before = np.cumsum(length) - length
    return flat[np.repeat(begin - before, length) + np.arange(length.sum())], length


def encode(documents: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``documents`` with the column ``out``: the token ids of ``text``, without special tokens.

    Whole texts are encoded, of any length; an empty or null text has an empty list, a blank one the ids of its
    blanks. Strings of special tokens in a text are ordinary text. No shuffle; other columns are kept,
    but for one named ``out``, which is replaced.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    kept = [c for c in documents.columns if c != out]
    rows = documents.select(*kept)
    schema = rows.select("*", F.array().cast("array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or Bpe(path)
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                ids, ends = bpe.encode(part.column(kept.index(text)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids."""
    return encode(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """source, n_docs, n_tokens, longest (tokens of the longest document)."""
    ids = encode(read(spark, folder, "documents").select("source", "text"))
    n = F.size("ids").cast("long")
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))
