"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Texts are cut into pre-tokens that no piece of the model can span. The pre-tokens that a worker hasn't met are held as
one ragged numpy array of symbols. In each round every pre-token finds the lowest rank among its adjacent pairs, and all
of them apply their pair at once; those with no pair left are done. What survives is counted: a symbol that is a piece
counts once, any other as its UTF-8 bytes. Counts by pre-token are kept up to a bound.

A pre-token takes as many rounds as it has merges in a row, so one of over LONG characters is cut into parts of PART,
which are merged like pre-tokens of their own, all in the same rounds. Neighbouring parts are then joined, level by
level: the tokens around each join are merged again as one sequence, and this window grows until its first and its last
token are those that the two sides have there. A pair of neighbours that some encoding holds is one that merging the two
alone leaves apart (what is merged first within them doesn't depend on what is around them), and a sequence of which
every pair of neighbours is such is the encoding of its text. So the work is in proportion to the length, and exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, spread, whole_text
from .bpe import slices

SPACE = "▁"
#: Characters of the pre-tokens that a worker remembers.
KEPT = 12_000_000
#: Symbols that are merged together (about 100 bytes each while rounds run).
BLOCK = 400_000
#: Characters of a pre-token that is merged in parts, at least, and of a part; tokens on either side of a join that are merged again at first.
LONG, PART, WINDOW = 192, 64, 6


class PieceCounter:
    def __init__(self, path: str, most: int = KEPT):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave the text as it is can be counted by array merging")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't provided for")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte_fallback = model.trainer_spec.byte_fallback
        ranks = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {p: ranks[s] for p, s in pieces.items()}
        inside = {c for p in rank if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in rank):
            self.split = None
        else:
            alone = "".join(re.escape(c) for c in "\n" if c not in inside)
            self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        # symbols: one for each character of a longer piece, one for each longer piece; 0 is any other character
        self.symbol = {s: k for k, s in enumerate(sorted(inside) + [p for p in rank if len(p) > 1], 1)}
        pairs = []
        for p in (p for p in rank if len(p) > 1):
            pairs += [(self.symbol[p[:k]], self.symbol[p[k:]], rank[p], self.symbol[p]) for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        a, b, r, made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        order = np.argsort(key := a << 32 | b)
        self.keys, self.ranks, self.made = key[order], r[order].astype(np.int32), made[order].astype(np.int32)
        # A merge may be applied at several places of a pre-token at once if whatever its result can merge into comes later.
        later = np.full(len(self.symbol) + 1, np.iinfo(np.int32).max)
        np.minimum.at(later, a, r)
        np.minimum.at(later, b, r)
        tied = np.bincount(r, minlength=len(ranks))
        several = np.array([len({int(m) for m in group}) for group in np.split(made[np.argsort(r, kind="stable")], np.cumsum(tied)[:-1])]) > 1
        safe = np.ones(len(ranks), dtype=bool)
        np.logical_and.at(safe, r, later[made] > r)
        self.safe = safe & ~several
        # tokens of a surviving symbol
        utf8 = lambda c: len(c.encode()) if self.byte_fallback else 1
        self.weight = np.ones(len(self.symbol) + 1, dtype=np.int64)
        for c in inside:
            if c not in rank:
                self.weight[self.symbol[c]] = utf8(c)
        self.single, self.utf8 = {p for p in rank if len(p) == 1}, utf8
        self.seen: dict[str, int] = {}
        self.most, self.held = most, 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. An empty text has none."""
        cut = [self._cut(t) for t in texts]
        if self.held > self.most:
            self.seen, self.held = {}, 0
        new = list({w for ws in cut for w in ws} - self.seen.keys())
        self.held += sum(map(len, new))
        for some in _blocks([w for w in new if len(w) < LONG]):
            self.seen.update(zip(some, self._merged(some).tolist(), strict=True))
        long = [w for w in new if len(w) >= LONG]
        for some in _blocks(long):
            self.seen.update(zip(some, self._joined(some).tolist(), strict=True))
        of = self.seen.__getitem__
        counts = [sum(map(of, ws)) for ws in cut]
        for w in long:  # counted once, not kept: they hardly come again
            self.held -= len(w)
            del self.seen[w]
        return counts

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        return self.split.findall(text) if self.split else [text]

    def _merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        sym, single = self._symbols(words)
        at, worth = self._survivors(sym, single, lengths)
        return np.bincount(np.repeat(np.arange(len(words)), lengths)[at], weights=worth, minlength=len(words)).astype(np.int64)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character of the words, and its tokens if it stays alone."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in distinct]
        sym = np.array([self.symbol.get(c, 0) for c in chars], dtype=np.int32)[inverse]
        return sym, np.array([1 if c in self.single else self.utf8(c) for c in chars], dtype=np.int32)[inverse]

    def _survivors(self, sym: np.ndarray, worth: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What merging leaves of sequences of symbols that stand end to end: where each token begins, and how many tokens it counts; in no order."""
        n = len(lengths)
        seq, at = np.repeat(np.arange(n), lengths), np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray]] = [(at[:0], worth[:0])]
        while len(sym):
            rank, made = self._pairs(sym, seq)
            best = np.full(n, np.iinfo(np.int32).max, dtype=np.int32)
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best[seq[start]] = np.minimum.reduceat(rank, start)
            open_ = best[seq] != np.iinfo(np.int32).max
            if not open_.all():  # these have no pair left: what survives is counted
                done.append((at[~open_], worth[~open_]))
                sym, seq, at, worth, rank, made = sym[open_], seq[open_], at[open_], worth[open_], rank[open_], made[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best[seq])
            hit = hit[self._apart(hit, seq[hit], best)]
            sym, worth = sym.copy(), worth.copy()
            sym[hit] = made[hit]
            worth[hit] = self.weight[made[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, seq, at, worth = sym[keep], seq[keep], at[keep], worth[keep]
        return tuple(map(np.concatenate, zip(*done, strict=True)))

    def _joined(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, in parts that are joined."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        sym, single = self._symbols(words)
        worth = np.zeros(len(sym) + 1, dtype=np.int32)  # of the token that begins here; 0: none does
        worth[-1] = 1
        parts = [np.arange(a, z, PART) for a, z in zip(ends - lengths, ends, strict=True)]
        edges = np.concatenate(parts)
        self._again(sym, single, worth, edges, np.r_[edges[1:], len(sym)])
        place, word = np.concatenate([np.arange(len(p)) for p in parts]), np.repeat(np.arange(len(words)), [len(p) for p in parts])
        step = 1
        while step <= place.max():
            joins = np.flatnonzero(place % (2 * step) == step)
            low = edges[joins] - step * PART
            self._join(sym, single, worth, low, edges[joins], np.minimum(edges[joins] + step * PART, ends[word[joins]]))
            step *= 2
        return np.add.reduceat(worth[:-1], ends - lengths, dtype=np.int64)

    def _join(self, sym: np.ndarray, single: np.ndarray, worth: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> None:
        """Joins what stands in [low, middle) with what stands in [middle, high), for many places at once."""
        left = right = np.full(len(middle), WINDOW)
        while len(middle):
            starts = np.flatnonzero(worth)
            a, b = np.searchsorted(starts, middle) - left, np.searchsorted(starts, middle) + right
            a, b = np.maximum(a, np.searchsorted(starts, low)), np.minimum(b, np.searchsorted(starts, high))
            first, last = starts[a], starts[b]
            again = np.zeros_like(worth)
            found = self._again(sym, single, again, first, last)
            # the first token is as before if the next one begins where it did, and the last if it begins where it did
            second = found[np.minimum(np.searchsorted(found, first) + 1, len(found) - 1)]
            left_done = (first == low) | (second == starts[a + 1])
            right_done = (last == high) | (found[np.searchsorted(found, last) - 1] == starts[b - 1])
            done = left_done & right_done
            for x, y in zip(first[done].tolist(), last[done].tolist(), strict=True):
                worth[x:y] = again[x:y]
            left, right = np.where(left_done, left, left * 2)[~done], np.where(right_done, right, right * 2)[~done]
            low, middle, high = low[~done], middle[~done], high[~done]

    def _again(self, sym: np.ndarray, single: np.ndarray, worth: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Merges each [first, last) on its own, notes the tokens in worth and returns where they begin, in order."""
        out = []
        sizes = last - first
        for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1):
            n = sizes[some]
            index = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at, found = self._survivors(sym[index], single[index], n)
            worth[index[at]] = found
            out.append(np.sort(index[at]))
        return np.concatenate(out)

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(sym), np.iinfo(np.int32).max, dtype=np.int32)
        made = np.zeros(len(sym), dtype=np.int32)
        key = sym[:-1].astype(np.int64) << 32 | sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = np.flatnonzero((self.keys[at] == key) & (seq[:-1] == seq[1:]))
        rank[ok], made[ok] = self.ranks[at[ok]], self.made[at[ok]]
        return rank, made

    def _apart(self, hit: np.ndarray, seq: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which of the places are merged now: from the left, none overlapping; only the leftmost of a pre-token whose merge isn't safe."""
        first = np.r_[True, seq[1:] != seq[:-1]]
        run = first | np.r_[True, hit[1:] != hit[:-1] + 1]  # of places that overlap each other, every second one
        starts = np.flatnonzero(run)
        place = np.arange(len(hit)) - np.repeat(starts, np.diff(np.r_[starts, len(hit)]))
        return np.where(self.safe[best[seq]], place % 2 == 0, first)


def _blocks(words: list[str]) -> Iterator[list[str]]:
    """The words in blocks of about BLOCK characters."""
    start = size = 0
    for k, w in enumerate(words):
        size += len(w)
        if size >= BLOCK or k + 1 == len(words):
            yield words[start : k + 1]
            start, size = k + 1, 0


def counter(path: str, most: int = KEPT) -> PieceCounter:
    return kept(("pieces", path, most), lambda: PieceCounter(path, most))


def token_counts(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, most: int = KEPT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Ids may repeat or be null; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model, most)
        for part in (p for b in batches for p in slices(b)):
            n = c.count(part.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    body = whole_text(text_col)
    rows = spread(df).select(F.col(id_col).alias("doc_id"), body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"))
    out = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit"))
    return rows.mapInArrow(run, out.schema)
