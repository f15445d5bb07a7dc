"""Sum-of-squares online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

WINDOW = 1024
END_ID = 0
MOST_OPEN = 4096       # partly filled windows that a task holds before it closes them all
CACHED = 300_000       # distinct units whose ids a worker keeps
PIECE_CHARS = 1 << 20  # of texts that are tokenised together
SEQUENCES = 1 << 40    # sequence ids of one task
NO_ROOM = np.iinfo(np.int64).max
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# ------------------------------------------------------------------ tokens
class Encoder:
    """Ids of the byte-level BPE vocabulary, equal to those of `tokenizers` with byte_bpe_50k.json and no added tokens.

    A space between two other characters that are no white space always begins a new word of the tokenizer, so the ids of a
    text are those of its space-separated units in a row.  Units seen before are looked up; all new units of
    a batch are encoded in one call and cut apart by the byte lengths of their tokens.  Texts with other runs of
    spaces are encoded whole.
    """

    ODD = re.compile(r" (?=\s)|(?<=[^\S ]) |^ |\s$")
    SPECIAL = "<|endoftext|>"

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.SPECIAL: len(ranks)})
        self.width = np.zeros(len(ranks) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.width[len(ranks)] = len(self.SPECIAL)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(units)
        ids = self.whole(" " + " ".join(new))
        ends = np.cumsum([len(u) + 1 if u.isascii() else len(u.encode()) + 1 for u in new])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        raw = ids.tobytes()
        at = 0
        for u, cut in zip(new, cuts.tolist()):
            self.known[u] = raw[4 * at:4 * cut]
            at = cut

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if self.ODD.search(t) else t.split(" ") for t in texts]
        units = set()
        for parts in split:
            if parts:
                units.update(parts[1:])
        self.learn(units)
        out = []
        for text, parts in zip(texts, split):
            if parts is None:
                out.append(self.whole(text))
            else:
                raw = b"".join(map(self.known.__getitem__, parts[1:]))
                out.append(np.concatenate([self.whole(parts[0]), np.frombuffer(raw, "<u4")]))
        return out


_ENCODERS: dict[str, Encoder] = {}  # one per Python worker


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------ packing
class Packer:
    """Online packing: a piece goes on top of the fill level that leaves the least sum of squared level counts.

    levels[h] is the number of windows filled to h (0 < h < window).  Moving one from h to h + s changes the sum of squares
    by 2 (levels[h + s] - levels[h]) + 2, opening one at s by 2 levels[s] + 1, closing one by 1 - 2 levels[h]; ties go
    to the fullest level.  Longer documents are cut into whole windows and a rest.  `close` ends the run: it puts open windows on
    others by the same rule as long as two fit, and cuts pieces of the emptiest left to fill the fullest, so at most one window
    stays partly filled; `cut` counts the windows that this takes part in.
    """

    def __init__(self, window: int, first: int, most_open: int):
        self.window, self.next, self.most_open = window, first, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.count = self.cut = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.emit([(doc, at, total, ids[at:at + self.window])])
            at += self.window
        if at < total:
            self.place((doc, at, total, ids[at:].copy()))

    def place(self, piece: tuple) -> None:
        self.put([piece], len(piece[3]), True)
        if self.count > self.most_open:
            self.close()

    def put(self, pieces: list[tuple], size: int, may_open: bool) -> None:
        """Pieces of `size` ids on top of the best level; unless `may_open`, a new window is opened only where no level has room."""
        n = self.window
        below = self.levels[1:n - size + 1]
        cost = 2 * (self.levels[size + 1:n + 1] - below) + 2
        cost[-1:] -= 1  # a full window is no level: its count stays zero
        cost = np.where(below > 0, cost, NO_ROOM)
        fresh = 2 * self.levels[size] + 1 if may_open else NO_ROOM - 1
        level = 0
        if len(cost):
            best = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[best] <= fresh:
                level = best + 1
        if level:
            held = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        else:
            held = []
        held.extend(pieces)
        if level + size == n:
            self.emit(held)
            return
        self.open[level + size].append(held)
        self.levels[level + size] += 1
        self.count += 1

    def drain(self) -> list[tuple[int, list[tuple]]]:
        """All open windows, fullest first; none is open after."""
        windows = [(level, held) for level in sorted(self.open, reverse=True) for held in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        self.count = 0
        return windows

    def close(self) -> None:
        for level, held in self.drain():
            self.put(held, level, False)
        windows = self.drain()
        self.cut += len(windows)
        low = len(windows) - 1
        for i in range(len(windows)):
            if i > low:
                break
            level, held = windows[i]
            while level < self.window and low > i:
                below, pieces = windows[low]
                doc, start, total, ids = pieces.pop()
                take = min(len(ids), self.window - level)
                held.append((doc, start, total, ids[:take]))
                level += take
                if take < len(ids):
                    pieces.append((doc, start + take, total, ids[take:]))
                if not pieces:
                    low -= 1
            self.emit(held)

    def emit(self, held: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in held:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype=object)


def pack_documents(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is the ids of its whole text and END_ID; a null text is empty (one id).  Every id is in exactly one piece.
    Repeated rows are packed each; a null doc_id stays null; other columns are ignored.  A task packs its rows
    without a shuffle and holds at most `most_open` windows; sequence ids are the task's number times 2^40 and on.
    A text with the vocabulary's special token has its id there, as `tokenizers` gives it.
    """
    ship(docs.sparkSession)
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        packer = Packer(window, TaskContext.get().partitionId() * SEQUENCES, most_open)
        for batch in batches:
            ids, texts = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(), batch["text"].fillna("").tolist()
            at = 0
            while at < len(texts):  # about a million characters at once
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE_CHARS):
                    size += len(texts[to])
                    to += 1
                for doc, tokens in zip(ids[at:to], encoder(path).batch(texts[at:to])):
                    packer.add(None if doc is None else int(doc), np.append(tokens, np.uint32(END_ID)))
                at = to
            if packer.rows:
                yield packer.take()
        packer.close()
        yield packer.take()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pack, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
