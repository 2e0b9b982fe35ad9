"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits: 8 positional bytes. Two fingerprints that differ in at most 4 bits differ in at most 4 bytes,
so they share at least 4 positional bytes: that is the guaranteed minimum of matches. The index lists fingerprints by
``width`` positional bytes, and by no more sets of positions than it takes for any 4 shared positions to hold one of them:
5 single bytes, 7 pairs, 20 triples (Turan systems) or all 70 quadruples. So every pair that reaches the minimum meets in
a list, and a pair that meets needn't reach it: the shared positional bytes of each pair of a list are tallied, pairs
under the minimum go, and what stays is verified by counting differing bits.

Lists of single bytes hold a 256th of all fingerprints each, and their pairs grow with the square of the input; lists of
triples (WIDTH) have 2**24 values for each set. All widths find the same links.

Of the links in a list only what connectivity needs leaves it: in a list of up to SMALL fingerprints each verified link,
in the one list where it is counted (that of the first set that the two share); in longer ones the forest of a
breadth-first search, which visits each fingerprint once and compares it with those not yet reached. A list of more than
``most`` fingerprints is cut into chunks, and each pair of chunks is a list of its own, so that no task gets a long list
as a whole and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, packed, spread, unpacked, whole_text, written
from .bpe import slices
from .components import components

BITS, SEED = 4, 42
SMALL = 24
#: Positional bytes that key a list, and fingerprints of a list that one task compares.
WIDTH, MOST = 3, 4096


def position_sets(width: int = WIDTH) -> list[tuple[int, ...]]:
    """Sets of ``width`` of the 8 positions, as few as can be such that any 4 positions hold one of them."""
    if width == 1:
        return [(k,) for k in range(5)]
    if width == 4:
        return list(combinations(range(8), 4))
    a, b, c = groups = range(3), range(3, 6), range(6, 8)
    inside = [s for g in groups for s in combinations(g, width)]
    if width == 2:
        return inside
    return inside + [tuple(sorted((*two, one))) for x, y in ((a, b), (b, c), (c, a)) for two in combinations(x, 2) for one in y]


def fingerprint(texts: list[str], words: int = 4, seed: int = SEED) -> np.ndarray:
    """The SimHash of each text, as uint64.

    A-Z in lower case; words are runs of other characters than ASCII white space; shingles of ``words`` words joined by a
    space, repeats included (fewer words: all of them; none: fingerprint 0). A bit is 1 if it is set in over half of the
    shingles' XXH64 values.
    """
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        tokens = _words(text)
        if not tokens:
            continue
        body = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        n = max(1, len(tokens) - words + 1)
        firsts, lasts = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
        hashes = np.fromiter((xxh64_intdigest(body[a:b], seed) for a, b in zip(firsts, lasts, strict=True)), dtype=np.uint64, count=n)
        out[k] = _majority(hashes)
    return out


def _words(text: str) -> list[bytes]:
    # bytes.split() splits at exactly the six ASCII white-space bytes, and bytes.lower() touches A-Z alone
    return text.encode().lower().split()


def _majority(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for part in (p for b in batches for p in slices(b)):
            fp = fingerprint(part.column("body").to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = spread(df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _postings(distinct: DataFrame, width: int) -> DataFrame:
    """key, fp: a fingerprint under each of its lists; a key is the set's number and the bytes at its positions."""
    byte = [F.shiftright(F.col("fp"), 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = []
    for n, positions in enumerate(position_sets(width)):
        key = F.lit(n).cast("long")
        for k in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[k])
        keys.append(key)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def _cells(postings: DataFrame, most: int) -> DataFrame:
    """key, cell, fp: lists as tasks take them. A list of up to ``most`` is one cell; of a longer one, each pair of its chunks is."""
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    long = written(sizes.select(F.col("key").alias("_key"), F.ceil(F.col("n") / most).cast("int").alias("chunks")), "simhash-long")
    rows = postings.join(long, F.col("key") == F.col("_key"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("key", "fp", "chunk", "chunks", other.alias("other"))
    # a list of two chunks or more has no cell of a chunk with itself: two others hold the pairs within it
    rows = rows.filter((F.col("chunks") == 1) | (F.col("chunk") != F.col("other")))
    cell = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    return rows.select("key", cell.cast("int").alias("cell"), "fp")


def _tally(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of fingerprints: which positional bytes they share, and how many bits differ."""
    diff = (x ^ y).view(np.uint8).reshape(-1, 8)
    return diff == 0, np.bitwise_count(diff).sum(axis=1)


def _first_set(shared: np.ndarray, width: int) -> np.ndarray:
    """The number of the first set of positions that each pair shares."""
    numbers = np.full(256, -1, dtype=np.int64)
    for k, positions in reversed(list(enumerate(position_sets(width)))):
        mask = sum(1 << p for p in positions)
        numbers[[m for m in range(256) if m & mask == mask]] = k
    return numbers[(shared * (1 << np.arange(8))).sum(axis=1)]


def _links(width: int):
    """From postings sorted by key and cell: the links that leave each list. A list may go over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "cell", "fp")])
            last = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # from here on the batch's last list, which may go on
            if waiting and (cut or (waiting[-1][:2, -1] != rows[:2, 0]).any()):
                yield from _lists(np.concatenate([*waiting, rows[:, :cut]], axis=1), width)
                waiting = []
            elif cut:
                yield from _lists(rows[:, :cut], width)
            waiting.append(rows[:, cut:])
        if waiting:
            yield from _lists(np.concatenate(waiting, axis=1), width)

    return run


def _lists(rows: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    key, cell, fp = rows
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    xs, ys = [], []
    for gap in range(1, int(min(SMALL, sizes.max()))):  # pairs of short lists, by how far apart they stand
        long_enough = (sizes > gap) & (sizes <= SMALL)
        n = sizes[long_enough] - gap
        if not len(n):
            continue
        a = np.repeat(starts[long_enough], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = fp[a], fp[a + gap]
        shared, bits = _tally(x, y)
        enough = np.flatnonzero(shared.sum(axis=1) >= 8 - BITS)  # the count filter
        enough = enough[bits[enough] <= BITS]
        a, x, y, shared = a[enough], x[enough], y[enough], shared[enough]
        here = _first_set(shared, width) == key[a] >> 8 * width
        xs.append(x[here])
        ys.append(y[here])
    for k in np.flatnonzero(sizes > SMALL):
        for x, y in _forest(fp[starts[k] : starts[k] + sizes[k]]):
            xs.append(x)
            ys.append(y)
    if xs:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["a", "b"])


def _forest(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rest = fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= BITS
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                queue.extend(found)
                rest = rest[~near]


def links(distinct: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """a, b: links (as many as connectivity needs) between different fingerprints (column fp, each once) at most BITS bits apart."""
    cells = _cells(_postings(distinct.select("fp"), width), most)
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_links(width), "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, its own included).

    Texts without words (null, empty, white space) have fingerprint 0 and link like any other. Equal fingerprints are one
    component; a null id gets the component's smallest id, null if it has none. Extra columns are ignored.
    """
    rows = written(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "simhash")
    # both sides are tables as written, so adaptive execution may split the rows of a very common fingerprint
    return rows.join(_component_ids(rows), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_ids(rows: DataFrame) -> DataFrame:
    """_fp, root, component_id of every fingerprint of rows (doc_id, fp): root is its component's smallest fingerprint."""
    own = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = written(components(links(own)), "simhash-components")
    least = found.join(own, found["node"] == own["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    classes = found.join(least, "root").select(F.col("node").alias("_fp"), "root", "least")
    ids = own.join(classes, own["fp"] == F.col("_fp"), "left")
    return written(ids.select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")), "simhash-ids")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """The rows of df that stay, with all their columns, one of each component: that with the smallest id.

    A null id is larger than any other. Where several rows of a component have its smallest id (or none has one), the text
    with the smallest digest decides, and of rows that agree in id and text any one stays. Columns of df may have any names.
    """
    text = F.sha2(whole_text(text_col), 256)
    keyed = df.select(F.struct(F.col(id_col).alias("id"), text.alias("digest")).alias("key"), F.col(text_col).alias("body"))
    prints = fingerprints(keyed, id_col="key", text_col="body", words=words)
    rows = written(prints.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.digest").alias("digest"), "fp"), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    chosen = rows.join(_component_ids(rows.select("doc_id", "fp")), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min(order).alias("best"))
    chosen = chosen.select(F.col("best.id").alias("_id"), F.col("best.digest").alias("_digest"))
    counts = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    chosen = written(chosen.join(counts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))).select("_id", "_digest", "copies"), "simhash-chosen")
    given = df.select(packed(df).alias("row"), F.col(id_col).alias("id"), text.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    repeated = chosen.filter("copies > 1")
    if repeated.isEmpty():
        return unpacked(given.join(chosen, same, "left_semi"), df)
    once = given.join(chosen.filter("copies = 1"), same, "left_semi")
    again = given.join(repeated, same, "left_semi").dropDuplicates(["id", "digest"])
    return unpacked(once.unionByName(again), df)
