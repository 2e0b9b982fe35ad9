"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two lexicons, one given (INSULTS) and one learned from labelled rows (words and word
beginnings by their log-odds), how near insults stand to a second person, capitals, punctuation and obfuscation rates.
All features come from a table of word properties that a worker fills as it meets words, so a text costs one lookup a word.

Trees and calibration are fitted on a sample of labelled rows of bounded size; features of the sample use a lexicon
learned from the sample's other half, and calibration uses margins from trees that haven't seen the row. Scoring is one
pass over all rows without a shuffle.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, spread, whole_text, written
from .boosting import Boosted, Isotonic
from .bpe import slices

#: Labelled rows to learn from, at most, by label.
MOST_TOXIC, MOST_CLEAN = 8_000, 16_000
#: Terms of the learned lexicon, at most.
TERMS = 4_000
THRESHOLD = 0.7
#: Common English insults, and words for the second person in the corpus's languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool fools loser losers trash garbage scum filth filthy vermin worthless useless pathetic disgusting "
    "clown clowns jerk jerks creep creeps freak freaks pig pigs rat rats ugly lame retard retarded imbecile cretin bastard bastards bitch bitches whore "
    "slut asshole assholes shit shitty bullshit crap fuck fucking fucker fucked damn hell hate kill die sucks suck liar liars coward cowards parasite "
    "parasites braindead brainless ignorant nasty vile repulsive revolting sick psycho maniac savage savages animal animals".split()
)
SECOND = frozenset("you your yours yourself ur u du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d*@$#!|+.\-_]+[^\W\d_]")
_STRETCH = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[\W\d_]")
_PUNCTUATION, _MARKS, _SYMBOLS = ".,;:!?\"'()-", frozenset(".,;:'\"()-"), frozenset("$%&#*@^~")
_WIDTH = 17
#: Bytes of text whose words are looked at together.
SLICE = 1 << 20
#: Words whose properties a worker remembers (about 200 bytes each).
KEPT = 120_000


def beginnings(word: str) -> list[str]:
    """The terms that a word brings to the learned lexicon: itself and, marked, how it starts."""
    return [word] + [word[:k] + "-" for k in range(4, 9) if len(word) > k]


def core(word: str) -> str:
    return _EDGE.sub("", word.lower())


class Features:
    """Feature rows of texts. lexicon: term -> log-odds of being in a toxic text."""

    names = (
        ["log_words", "log_chars"]
        + [f"{n}_rate" for n in ("upper", "all_caps", "exclaim", "question", "punctuation", "digit", "obfuscated", "insult", "hidden_insult", "second", "odds_up", "odds_down", "weak", "strong", "symbol", "stretch")]
        + ["insults", "hidden_insults", "strong_hits", "weak_hits", "odds_sum", "odds_top", "near_second_rate", "near_second", "distinct_share"]
    )

    def __init__(self, lexicon: dict[str, float], most: int = KEPT):
        self.lexicon, self.most = lexicon, most
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, _WIDTH), np.float32)

    def _odds(self, c: str) -> float:
        get, best = self.lexicon.get, self.lexicon.get(c, 0.0)
        for k in range(4, min(9, len(c))):
            if (x := get(c[:k] + "-", 0.0)) and abs(x) > abs(best):
                best = x
        return best

    def _word(self, w: str, row: np.ndarray) -> None:
        """Fills the word's row: letters, capitals, all capitals, !, ?, other punctuation, digits, obfuscated, insult, hidden insult, second person, odds up and down, weak and strong hit, symbols, stretch."""
        inner = w.strip(_PUNCTUATION)
        rest = w if len(inner) < len(w) else ""
        if inner.isalpha():
            c = inner.lower()
            row[0] = len(inner)
            if c != inner:
                row[1] = upper = sum(map(str.isupper, inner))
                row[2] = upper == len(inner) > 1
            row[8] = c in INSULTS
        else:
            c, rest = core(w), w
            row[0], row[1], row[6] = sum(map(str.isalpha, w)), sum(map(str.isupper, w)), sum(map(str.isdigit, w))
            row[2] = row[1] == row[0] > 1
            row[7] = bool(_INNER.search(c))
            row[8] = c in INSULTS
            row[9] = not row[8] and (c.translate(_LEET) in INSULTS or _LETTERS.sub("", c) in INSULTS)
        if rest:
            row[3], row[4] = rest.count("!"), rest.count("?")
            row[5], row[15] = sum(map(_MARKS.__contains__, rest)), sum(map(_SYMBOLS.__contains__, rest))
        row[10] = c in SECOND
        if odds := self._odds(c):
            row[11], row[12], row[13], row[14] = max(odds, 0.0), max(-odds, 0.0), odds > 1.0, odds > 2.0
        row[16] = bool(_STRETCH.search(c))

    def __call__(self, texts: list[str]) -> np.ndarray:
        cut = [t.split() for t in texts]
        if len(self.place) > self.most:
            self.place = {}
        for w in {w for ws in cut for w in ws} - self.place.keys():
            k = self.place[w] = len(self.place)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = 0
            self._word(w, self.table[k])
        n = np.array([len(ws) for ws in cut])
        out = np.zeros((len(texts), len(self.names)))
        some = np.flatnonzero(n)
        if not len(some):
            return out
        at = np.fromiter((k for ws in cut for k in map(self.place.__getitem__, ws)), np.int64, n.sum())
        words = self.table[at]
        starts = (np.cumsum(n) - n)[some]
        sums = np.add.reduceat(words, starts, axis=0, dtype=np.float64)
        count, chars = n[some], np.maximum(sums[:, 0], 1)
        out[some, 0], out[some, 1] = np.log1p(count), np.log1p([len(texts[k]) for k in some])
        out[some, 2] = sums[:, 1] / chars
        for j in range(2, _WIDTH):
            out[some, j + 1] = sums[:, j] / count
        k = _WIDTH + 1
        out[some, k : k + 5] = np.stack([sums[:, 8], sums[:, 9], sums[:, 14], sums[:, 13], sums[:, 11] - sums[:, 12]], axis=1)
        out[some, k + 5] = np.maximum.reduceat(words[:, 11], starts)
        doc = np.repeat(np.arange(len(some)), count)
        near = self._near(np.flatnonzero(words[:, 8] + words[:, 9] + words[:, 14]), np.flatnonzero(words[:, 10]), doc)
        hits = np.bincount(doc[near], minlength=len(some))
        out[some, k + 6], out[some, k + 7] = hits / count, hits
        pairs = np.unique(doc.astype(np.int64) << 32 | at)
        out[some, k + 8] = np.bincount(pairs >> 32, minlength=len(some)) / count
        return out

    @staticmethod
    def _near(hits: np.ndarray, second: np.ndarray, doc: np.ndarray, reach: int = 5) -> np.ndarray:
        """The hits with a second person at most ``reach`` words away in the same text."""
        if not len(second) or not len(hits):
            return hits[:0]
        right = np.searchsorted(second, hits)
        found = np.zeros(len(hits), bool)
        for s in (second[np.minimum(right, len(second) - 1)], second[np.maximum(right - 1, 0)]):
            found |= (np.abs(s - hits) <= reach) & (doc[s] == doc[hits])
        return hits[found]


class Model:
    """Everything a score needs: the lexicon, the trees and the calibration; without two labels to learn from, one score for all."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share
        self.stamp = uuid.uuid4().hex

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        return self.calibration(self.trees.margin(features))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _half(ids: list[int]) -> np.ndarray:
    return np.array([zlib.crc32(f"half {i}".encode()) & 1 for i in ids])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, half, toxic, texts: in how many of a task's texts each term stands."""
    counts: Counter = Counter()

    def batch() -> pa.RecordBatch:
        terms, halves, toxic = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(halves, pa.int32()), pa.array(toxic, pa.int32()), pa.array(counts.values(), pa.int64())], ["term", "half", "toxic", "texts"])

    for part in (p for b in batches for p in slices(b, limit=SLICE // 2)):
        ids = part.column("doc_id").to_pylist()
        for half, text, y in zip(_half(ids).tolist(), part.column("body").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            counts.update((t, half, y) for t in {t for w in set(text.split()) for t in beginnings(core(w))})
        if len(counts) > 100_000:
            yield batch()
            counts.clear()
    if counts:
        yield batch()


def _lexicons(sample: DataFrame, totals: dict[tuple[int, int], int], terms: int) -> list[dict[str, float]]:
    """Three lexicons: from half 0, from half 1, from both."""
    counted = sample.mapInArrow(_terms, "term string, half int, toxic int, texts long")
    by = {(h, y): F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("texts")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)}
    counted = written(counted.groupBy("term").agg(*by.values()).filter(F.length("term") > 1).filter("n01 + n11 >= 3 OR n00 + n10 >= 60"), "toxicity-terms")
    found = []
    for halves in ((0,), (1,), (0, 1)):
        a = sum(F.col(f"n{h}1") for h in halves)
        b = sum(F.col(f"n{h}0") for h in halves)
        ta, tb = sum(totals.get((h, 1), 0) for h in halves), sum(totals.get((h, 0), 0) for h in halves)
        odds = F.log((a + 0.5) / (ta + 1.0)) - F.log((b + 0.5) / (tb + 1.0))
        best = counted.select("term", odds.alias("odds"), (F.abs(odds) / F.sqrt(1.0 / (a + 0.5) + 1.0 / (b + 0.5))).alias("z"))
        best = best.filter("z > 3 AND abs(odds) > 0.7").orderBy(F.col("z").desc(), "term").limit(terms)  # bounded, so it may come to the driver
        found.append({r.term: r.odds for r in best.collect()})
    return found


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, terms: int = TERMS) -> Model:
    """A model from labelled rows outside the held-out fold: per label the first ``most_*`` by a hash of the id. Null labels and ids are left out; of several labels of a row the highest counts."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.filter(F.col("toxic").isin(0, 1)).filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = written(known, "toxicity-labels")
    have = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = known.filter("toxic = 1").orderBy(*draw).limit(most_toxic).unionByName(known.filter("toxic = 0").orderBy(*draw).limit(most_clean))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"))
    # at most most_toxic + most_clean rows of two numbers: a bounded broadcast
    sample = written(rows.join(F.broadcast(picked), "doc_id").repartition(F.xxhash64("doc_id")), "toxicity-sample")
    totals = Counter()
    for r in sample.select("doc_id", "toxic").collect():  # bounded likewise
        totals[int(_half([r.doc_id])[0]), r.toxic] += 1
    if not all(sum(totals[h, y] for h in (0, 1)) for y in (0, 1)):
        return Model({}, None, None, 1.0 if totals and have.get(1) and not have.get(0) else 0.0)
    lexicons = _lexicons(sample, totals, terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        by_half = [Features(lexicons[1]), Features(lexicons[0])]  # each row by the lexicon of the other half
        for part in (p for b in batches for p in slices(b, limit=SLICE)):
            half, texts = _half(part.column("doc_id").to_pylist()), part.column("body").to_pylist()
            x = np.zeros((len(texts), len(Features.names)))
            for h in (0, 1):
                if len(at := np.flatnonzero(half == h)):
                    x[at] = by_half[h]([texts[k] for k in at])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), flat], ["doc_id", "toxic", "x"])

    got = sample.mapInArrow(features, sample.select("doc_id", "toxic", F.array(F.lit(0.0)).alias("x")).schema).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x, y = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(dtype=float)
    weight = np.where(y == 1, have[1] / max(1, (y == 1).sum()), have[0] / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    fold = np.array([zlib.crc32(f"fold {i}".encode()) & 1 for i in got["doc_id"]])
    margin = np.zeros(len(y))
    for f in (0, 1):
        if not (fold == f).any():
            continue
        other = fold != f if len(set(y[fold != f])) == 2 else np.ones(len(y), bool)
        margin[fold == f] = Boosted().fit(x[other], y[other], weight[other]).margin(x[fold == f])
    return Model(lexicons[2], Boosted().fit(x, y, weight), Isotonic().fit(margin, y, weight), float(np.average(y, weights=weight)))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold). A null text counts as empty; empty texts have a score like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept(("toxicity", model.stamp), lambda: Features(model.lexicon))
        for part in (p for b in batches for p in slices(b, limit=SLICE)):
            s = model.scores(features(part.column("body").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = spread(df).select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(run, rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def clean_rows(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df with a score below threshold, with all their columns."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept(("toxicity", model.stamp), lambda: Features(model.lexicon))
        for part in (p for b in batches for p in slices(b, text_col, SLICE)):
            s = model.scores(features([t or "" for t in part.column(text_col).to_pylist()]))
            yield part.filter(pa.array(s < threshold)).select(names)

    return spread(df).mapInArrow(run, df.schema)
