"""Token-ID output: one compressed file per shard that answers access, counting and occurrence lookup.

A shard holds the ids of consecutive documents as a wavelet matrix (Claude, Navarro and Ordonez, "The wavelet matrix",
2015): one bit-plane per id bit, highest first; after each plane the sequence is parted stably into those with a 0 and
those with a 1. Rank is a lookup of the ones before a chunk, of those before a block of 512 bits in it, and a count within
the block; select is a binary search over ranks. Planes are compressed by chunks of 2**18 bits, each a Zstandard frame of
its own whose place and preceding ones the head names, so a lookup reads the head and one chunk for each plane. Layout,
all little-endian:

    magic "SKWM0002" | u64 bytes of the head | head, a Zstandard frame: u32 planes, u32 documents, u64 ids,
    i64 doc_ids[documents], u8 has_id[documents], u32 lengths[documents], for each plane: u64 zeros,
    and for each of its chunks: u64 ones before, u64 offset behind the head, u32 bytes | chunks: Zstandard frames
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import atomic_file, file_system, kept, one_task_each, shared_path, whole_text, written
from .bpe import byte_alphabet, slices

MAGIC = b"SKWM0002"
#: Bits of a block and of a chunk; chunks that a reader keeps.
BLOCK, CHUNK, CACHED = 512, 1 << 18, 256
#: The id that ends each document (a fixed value of the query contract).
END = 2
#: A shard is closed when it has this many ids.
SHARD_IDS = 4 << 20
#: Characters of the words whose ids a worker remembers.
KEPT = 12_000_000
#: How the tokenizer that the encoder below knows prepares texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: That pattern for texts of U+0000 to U+00FF in lower case: letters, its contractions, single digits, and runs of the rest without white space.
_LETTER, _DIGIT, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


class WaveletMatrix:
    """ids, planes highest bit first. bits[l]: uint64 words of the plane; ones[l]: ones before each block; zeros[l]."""

    def __init__(self, n: int, bits: list[np.ndarray], ones: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self.ones, self.zeros = n, bits, ones, zeros

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        current = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        bits, ones, zeros = [], [], []
        for shift in range(planes - 1, -1, -1):
            mask = current & np.array(1 << shift, current.dtype) != 0
            packed = np.packbits(mask, bitorder="little")
            words = np.zeros(-(-len(current) // BLOCK) * BLOCK // 8, dtype=np.uint8)
            words[: len(packed)] = packed
            words = words.view("<u8")
            count = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            bits.append(words)
            ones.append((np.cumsum(count) - count).astype("<u4"))
            zeros.append(len(current) - int(count.sum()))
            current = np.concatenate([current.take(np.flatnonzero(~mask)), current.take(np.flatnonzero(mask))])
        return cls(len(ids), bits, ones, zeros)

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of the plane."""
        block, words = at // BLOCK, self.bits[plane]
        total = np.append(self.ones[plane], 0)[block].astype(np.int64)
        total[block == len(self.ones[plane])] = self.n - self.zeros[plane]
        for k in range(BLOCK // 64):
            word = block * (BLOCK // 64) + k
            inside = np.clip(at - word * 64, 0, 64)
            value = words[np.minimum(word, len(words) - 1)] if len(words) else np.zeros(len(at), np.uint64)
            mask = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
            total += np.where(inside > 0, np.bitwise_count(value & mask), 0)
        return total

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions, in any order."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for plane, zeros in enumerate(self.zeros):
            before = self._rank1(plane, at)
            bit = self._rank1(plane, at + 1) - before
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out

    def rank(self, token: int, start: int, stop: int) -> int:
        """How often the id occurs in [start, stop)."""
        a, b = self._places(token, np.array([start, stop])).tolist()
        return b - a

    def counts(self, token: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """rank() of many ranges."""
        return self._places(token, stops) - self._places(token, starts)

    def _places(self, token: int, at: np.ndarray) -> np.ndarray:
        """Where positions go as if each held the id: below the last plane, its occurrences stand together."""
        for plane, zeros in enumerate(self.zeros):
            before = self._rank1(plane, at)
            at = zeros + before if token >> (len(self.zeros) - 1 - plane) & 1 else at - before
        return at

    def select(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the first-th to last-th (exclusive) occurrence of the id, in order."""
        a, b = self._places(token, np.array([0, self.n])).tolist()
        at = np.arange(a + first, b if last is None else min(b, a + last))
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - plane) & 1
            wanted = at - self.zeros[plane] if one else at  # the how manieth 1 (or 0) of the plane
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
            while (high > low).any():
                middle = (low + high) // 2
                ranks = self._rank1(plane, middle + 1)
                ranks = ranks if one else middle + 1 - ranks
                right = (ranks <= wanted) & (low < high)
                low, high = np.where(right, middle + 1, low), np.where(right | (low >= high), high, middle)
            at = low
        return at

    def sequence(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says where the parted halves came from."""
        current = np.zeros(self.n, dtype=np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for plane in range(len(self.zeros) - 1, -1, -1):
            mask = np.unpackbits(self.bits[plane].view(np.uint8), bitorder="little")[: self.n].view(bool)
            whole = np.empty_like(current)
            whole[np.flatnonzero(~mask)] = current[: self.zeros[plane]]
            whole[np.flatnonzero(mask)] = current[self.zeros[plane] :] | np.array(1 << (len(self.zeros) - 1 - plane), current.dtype)
            current = whole
        return current


class StoredMatrix(WaveletMatrix):
    """A matrix whose chunks are read from its file when they are asked for; the last CACHED of them are kept."""

    def __init__(self, n: int, zeros: list[int], places: list[np.ndarray], read):
        self.n, self.zeros, self.places, self.read = n, zeros, places, read
        self.chunks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _chunk(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's words and the ones before each of its blocks."""
        found = self.chunks.pop((plane, k), None)
        if found is None:
            _, offset, size = self.places[plane][k].tolist()
            words = np.frombuffer(self.read(offset, size), "<u8")
            count = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            found = words, np.cumsum(count) - count
        self.chunks[plane, k] = found
        if len(self.chunks) > CACHED:
            del self.chunks[next(iter(self.chunks))]
        return found

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        total = np.full(len(at), self.n - self.zeros[plane])  # of positions behind the last bit
        where = at // CHUNK
        for k in np.unique(where[at < self.n]).tolist():
            here = np.flatnonzero((where == k) & (at < self.n))
            words, ones = self._chunk(plane, k)
            part = WaveletMatrix(CHUNK, [words], [ones], [0])
            total[here] = int(self.places[plane][k]["before"]) + part._rank1(0, at[here] - k * CHUNK)
        return total

    def loaded(self) -> WaveletMatrix:
        """The whole matrix in memory."""
        bits, ones = [], []
        for plane in range(len(self.zeros)):
            chunks = [self._chunk(plane, k) for k in range(len(self.places[plane]))]
            bits.append(np.concatenate([c[0] for c in chunks]) if chunks else np.zeros(0, "<u8"))
            ones.append(np.concatenate([c[1] + int(p["before"]) for c, p in zip(chunks, self.places[plane], strict=True)]) if chunks else np.zeros(0, np.int64))
        return WaveletMatrix(self.n, bits, ones, self.zeros)


_PLACE = np.dtype([("before", "<u8"), ("offset", "<u8"), ("size", "<u4")])


class Shard:
    """A shard's file: doc_ids (None where null), lengths, and the wavelet matrix over all its ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    @classmethod
    def open(cls, path: str) -> Shard:
        """Reads the head; the matrix reads its chunks when they are asked for."""
        import zstandard

        files, at = file_system(path)
        f = files.open_input_file(at)
        start = f.read(16)
        if start[:8] != MAGIC:
            raise ValueError(f"{path} isn't a shard")
        behind = 16 + (size := struct.unpack("<Q", start[8:])[0])
        data = zstandard.ZstdDecompressor().decompress(f.read(size))
        planes, docs, n = struct.unpack_from("<IIQ", data)
        at = 16

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        def read(offset: int, size: int) -> bytes:
            f.seek(behind + offset)
            return zstandard.ZstdDecompressor().decompress(f.read(size))

        ids, has, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        zeros, places = [], []
        for _ in range(planes):
            zeros.append(int(take("<u8", 1)[0]))
            places.append(take(_PLACE, -(-n // CHUNK)))
        return cls([i if h else None for i, h in zip(ids.tolist(), has.tolist(), strict=True)], lengths, StoredMatrix(n, zeros, places, read))

    def write(self, path: str, level: int = 1) -> None:
        import zstandard

        m, pack = self.matrix, zstandard.ZstdCompressor(level=level)
        head = [struct.pack("<IIQ", len(m.zeros), len(self.doc_ids), m.n), np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(), np.array([i is not None for i in self.doc_ids], "u1").tobytes(), np.asarray(self.lengths, "<u4").tobytes()]
        frames, offset = [], 0
        for zeros, ones, bits in zip(m.zeros, m.ones, m.bits, strict=True):
            places = np.zeros(-(-m.n // CHUNK), _PLACE)
            for k in range(len(places)):
                frames.append(pack.compress(bits[k * (CHUNK // 64) : (k + 1) * (CHUNK // 64)].tobytes()))
                places[k] = int(ones[k * (CHUNK // BLOCK)]), offset, len(frames[-1])
                offset += len(frames[-1])
            head += [struct.pack("<Q", zeros), places.tobytes()]
        packed = pack.compress(b"".join(head))
        with atomic_file(path) as out:
            out.write(MAGIC + struct.pack("<Q", len(packed)) + packed)
            for frame in frames:
                out.write(frame)


class WordEncoder:
    """ids of whole texts, by a tokenizer file of the library.

    For a tokenizer that lowers case, drops white space and merges within the pieces of _PATTERN, texts of U+0000 to U+00FF
    are cut into the pattern's pieces here (lower case and NFC are plain there) and each piece that a worker hasn't met goes
    through the library's model. All other texts, those that may hold a special token, and all texts of a tokenizer that
    prepares them in another way, go through the library as they are.
    """

    def __init__(self, path: str, end: int = END, most: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.model, self.end = self.library.model, end
        made = json.loads(self.library.to_str())
        cut = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"]["type"] == "Sequence" and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": _PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.planes = max(1, (max(end, self.library.get_vocab_size(with_added_tokens=True) - 1)).bit_length())
        self.kind = np.uint16 if self.planes <= 16 else np.uint32
        self.code = "H" if self.planes <= 16 else "I"
        self.starts = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.seen = _Pieces(self)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        if self.seen.held > self.most:
            self.seen = _Pieces(self)
        plain = [self.known and _latin(t) and not any(s in t for s in self.starts) for t in texts]
        whole = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        of, end = self.seen.__getitem__, np.array([self.end], self.kind).tobytes()
        return [np.frombuffer((b"".join(map(of, _PIECE.findall(t.lower()))) if p else np.array(next(whole).ids, self.kind).tobytes()) + end, self.kind) for t, p in zip(texts, plain, strict=True)]


class _Pieces(dict):
    """piece -> its ids as bytes, found when first asked for."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.tokenize, self.code, self.alphabet, self.held = encoder.model.tokenize, encoder.code, encoder.alphabet, 0

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join([self.alphabet[b] for b in piece.encode()])
        found = self[piece] = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()
        self.held += len(piece)
        return found


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str, end: int = END) -> WordEncoder:
    return kept(("words", path, end), lambda: WordEncoder(path, end))


def write_shards(df: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, partitions: int | None = None, end: int = END) -> DataFrame:
    """Writes the ids of all rows in ascending order of doc_id (null first) and returns the manifest, a table in the shared folder: part, seq, path, docs, ids, start.

    Rows are dealt by ranges of the id and sorted there, so the shards in order of (part, seq) hold the rows in order; start
    is the number of ids in all shards before. A null text counts as empty and is the end id alone. Repeated doc_ids stand
    together, in any order, and may go over several tasks. No rows: no shards.
    """
    spark = df.sparkSession
    folder = folder or shared_path(spark, "token-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, end)
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = seq = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wm"
            Shard(ids, np.array([len(p) for p in parts]), WaveletMatrix.build(np.concatenate(parts), e.planes)).write(path)
            return pa.RecordBatch.from_arrays([pa.array([part_no], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64())], ["part", "seq", "path", "docs", "ids"])

        part_no = 0
        for part in (p for b in batches for p in slices(b)):
            part_no = part.column("part")[0].as_py()
            for i, tokens in zip(part.column("doc_id").to_pylist(), e.encode(part.column("body").to_pylist()), strict=True):
                ids.append(i)
                parts.append(tokens)
                held += len(tokens)
                if held >= shard_ids:
                    yield close()
                    ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "row"]  # row parts the rows of an id that repeats very often
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("row")
    found = written(rows.mapInArrow(run, "part int, seq int, path string, docs long, ids long"), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return found.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, *, end: int = END) -> DataFrame:
    """One row per document, read from the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), last_id (by access) and end_ids (how often the end id occurs, by rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard.open(path)
                matrix = shard.matrix.loaded()
                ids = matrix.sequence().astype("<u4")
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(matrix.access(ends - 1)), pa.array(matrix.counts(end, starts, ends))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "end_ids"])

    shards = one_task_each(manifest.select("path", "start"))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long, end_ids long")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """doc_id, start (of the document), position: where an id occurs, position counting all ids before. Found by select in each shard, which reads a few chunks of it and no sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard.open(path)
                at = shard.matrix.select(token)
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array((ends - shard.lengths)[doc] + start), pa.array(at + start)], ["doc_id", "start", "position"])

    return one_task_each(manifest.select("path", "start")).mapInArrow(run, "doc_id long, start long, position long")
