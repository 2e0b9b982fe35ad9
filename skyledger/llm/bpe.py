"""Byte-level BPE encoding and decoding by tree concatenation.

A text of over ``leaf`` characters is cut into halves until they are leaves; the leaves of all texts at hand are encoded
together, by several threads where a text is very long, and neighbours are joined level by level. Halves are cut before a
space between two words, where the tokenizer's pattern splits whatever stands around; a stretch without such a place is
cut where the pattern splits it, and what the pattern leaves whole (a pre-token of over ``leaf`` characters) anywhere.

At each join a window of tokens on both sides is encoded again, and it grows until its first token is the left side's
own token there and its last token is the right side's. Then every adjacent pair of tokens in the joined sequence is a
pair of some valid encoding, which is what makes a sequence *the* BPE encoding of its text; so both sides agree exactly.
A tokenizer whose pattern or normalizer is another than the byte-level one's encodes texts whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, spread, whole_text

LEAF = 4096
WINDOW = 8
#: Threads that encode the leaves of a text of over TURN characters, and characters that a thread takes at a time.
THREADS, TURN = 4, 1 << 18
#: Before the space, the pattern " ?letters| ?digits| ?others|spaces" splits whatever stands around: nothing that it matches goes on over a space.
_SURE = re.compile(r"\w (?=\w)")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    return table | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class TreeCodec:
    """encode() and decode() as the tokenizers library has them for a byte-level BPE file; ids are lists of int."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads are this class's own affair
        from tokenizers import Tokenizer

        self.library, self.leaf, self.window = Tokenizer.from_file(path), leaf, window
        self.threads, self.pool = threads, None
        alphabet, size = byte_alphabet(), self.library.get_vocab_size(with_added_tokens=True)
        self.bytes_of = [b""] * size
        for token, k in self.library.get_vocab(with_added_tokens=True).items():
            whole = all(c in alphabet for c in token)
            self.bytes_of[k] = bytes(alphabet[c] for c in token) if whole else token.encode()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        made = json.loads(self.library.to_str())
        cut = made["pre_tokenizer"] or {}
        self.known = made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32."""
        if not self.known:
            return self._leaves(texts)
        # each text is a row of groups that only have to be put end to end; the leaves of a group are joined
        cut = [[[t]] if len(t) <= self.leaf else self._groups(t) for t in texts]
        groups = [g for gs in cut for g in gs]
        # a text that is longer than a turn would hold up its task; others wait for no one, as each core has its own task
        leaves = iter(self._leaves([leaf for g in groups for leaf in g], wide=max(map(len, texts), default=0) > TURN))
        done = iter(self._joined([[next(leaves) for _ in g] for g in groups]))
        return [np.concatenate([next(done) for _ in gs]) if len(gs) != 1 else next(done) for gs in cut]

    def _leaves(self, texts: list[str], wide: bool = True) -> list[np.ndarray]:
        turns, size = [[]], 0
        for t in texts:
            if turns[-1] and size + len(t) > TURN:
                turns.append([])
                size = 0
            turns[-1].append(t)
            size += len(t)
        if len(turns) < 2 or self.threads < 2 or not wide:
            found = map(self._turn, turns)
        else:
            self.pool = self.pool or ThreadPoolExecutor(self.threads)
            found = self.pool.map(self._turn, turns)
        return [ids for some in found for ids in some]

    def _turn(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _groups(self, text: str) -> list[list[str]]:
        """Leaves of a text, special tokens being groups of their own."""
        at, groups = 0, []
        while True:
            found = [(k, -len(s), s) for s in self.special if (k := text.find(s, at)) >= 0]
            k, _, special = min(found, default=(len(text), 0, ""))
            if k > at:
                groups += self._halves(text[at:k])
            if not special:
                return groups
            groups.append([special])
            at = k + len(special)

    def _halves(self, text: str) -> list[list[str]]:
        """Groups of leaves of ordinary text."""
        if len(text) <= self.leaf:
            return [[text]]
        if not (at := self._sure(text)):
            return self._unsplit(text)
        left, right = self._halves(text[:at]), self._halves(text[at:])
        return [*left[:-1], left[-1] + right[0], *right[1:]]

    def _sure(self, text: str) -> int:
        """Where to halve a text: a place near its middle at which the pattern splits for sure; 0 if there is none."""
        middle, n = len(text) // 2, self.leaf
        if (m := _SURE.search(text, middle, middle + n)) or (m := _last(text, max(0, middle - n), middle + 1)):
            return m.start() + 1
        m = _SURE.search(text, middle) or _last(text, 0, middle)
        return m.start() + 1 if m else 0

    def _unsplit(self, text: str) -> list[list[str]]:
        """Groups of a stretch without a sure place: what the pattern leaves whole is halved anywhere."""
        groups, start = [], 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            if b - a > self.leaf:
                groups += [[text[start:a]]] if a > start else []
                parts = [text[a:b]]
                while len(parts[0]) > self.leaf:
                    parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
                groups.append(parts)
                start = b
        return groups + ([[text[start:]]] if start < len(text) else [])

    def _joined(self, groups: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Each group's leaves as one sequence: neighbours are joined level by level, in all groups together."""
        while any(len(g) > 1 for g in groups):
            pairs = iter(self._join([(g[k], g[k + 1]) for g in groups for k in range(0, len(g) - 1, 2)]))
            groups = [[next(pairs) for _ in range(0, len(g) - 1, 2)] + (g[-1:] if len(g) % 2 else []) for g in groups]
        return [g[0] for g in groups]

    def _join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        out: list = [None] * len(pairs)
        open_ = [(k, self.window, self.window) for k in range(len(pairs))]
        while open_:
            places, texts = [], []
            for k, a, b in open_:
                left, right = pairs[k]
                a, b = self._whole_character(left, len(left) - a, -1), self._whole_character(right, b, 1)
                places.append((k, a, b))
                texts.append(self.decode_bytes([*left[a:].tolist(), *right[:b].tolist()]).decode())
            open_ = []
            for (k, a, b), middle in zip(places, self._leaves(texts), strict=True):
                left, right = pairs[k]
                left_done = a == 0 or middle[0] == left[a]
                right_done = b == len(right) or middle[-1] == right[b - 1]
                if left_done and right_done:
                    out[k] = np.concatenate([left[:a], middle, right[b:]])
                else:
                    open_.append((k, (len(left) - a) * (1 if left_done else 2), b * (1 if right_done else 2)))
        return out

    def _whole_character(self, ids: np.ndarray, at: int, step: int) -> int:
        """The next index at or beyond ``at`` where a token starts with a whole character."""
        at = max(0, min(at, len(ids)))
        while 0 < at < len(ids) and self.bytes_of[ids[at]][0] & 0xC0 == 0x80:
            at += step
        return at


def _last(text: str, start: int, stop: int) -> re.Match | None:
    """The last sure place that begins in a part of the text."""
    found = None
    for found in _SURE.finditer(text, start, stop + 2):
        pass
    return found


def codec(path: str, leaf: int = LEAF, window: int = WINDOW) -> TreeCodec:
    return kept(("bpe", path, leaf, window), lambda: TreeCodec(path, leaf, window))


def slices(batch: pa.RecordBatch, column: str = "body", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of about ``limit`` bytes of the column, so that a batch of very long texts doesn't stay in memory as a whole."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: batch.num_rows + 1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def encode(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, ids array<int>. A null or empty text has no ids; ids may repeat or be null, rows keep apart; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, leaf, window)
        for part in (p for b in batches for p in slices(b, limit=1 << 20)):
            ids = c.arrays(part.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = spread(df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")))
    return rows.mapInArrow(run, rows.select("doc_id", F.array(F.lit(0)).alias("ids")).schema)


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of encode()'s result: doc_id, text. No ids (or null) give an empty text; bytes that aren't UTF-8 give U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            texts = [c.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, df.select("doc_id", F.lit("").alias("text")).schema)


def round_trip_digests(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Each text encoded and its ids decoded in one pass: doc_id, n_tokens, ids_sha256 (over little-endian unsigned 32-bit ids), decoded_sha256 (over UTF-8).

    A null text counts as empty. Nothing but the digests leaves a task, so there is no shuffle and the work splits by rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, leaf, window)
        for part in (p for b in batches for p in slices(b, limit=1 << 20)):
            n, hashes, texts = [], [], []
            for ids in c.arrays(part.column("body").to_pylist()):
                n.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                texts.append(hashlib.sha256(c.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = spread(df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")))
    out = rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    return rows.mapInArrow(run, out.schema)
