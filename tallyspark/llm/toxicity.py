"""Toxicity scores from class-conditional Kneser-Ney models of letters.

Every letter of a lower-cased run of letters, and the run's end, is an expression
together with the ``order - 1`` before it (marks where the run begins), so whole
words, the later parts of compounds and runs in scripts without spaces are read to
their last letter.  The toxic and the ordinary class each have discounted counts of
expressions from labelled texts; what the discount takes off goes to a backoff model
that both share: the same expression's discounted count in both classes, and below
it the expression one letter shorter, which counts in how many different left
neighbours' company it is found, and so on down to single letters.  An expression in
neither class is read as the longest shorter one that is known.  Rare expressions so
get nearly the same probability in both, and frequent ones of one class stand out.

A word counts once a text, so a text that repeats itself teaches no more than others.
All expressions count, those of every length from all that are longer; only then those of
fewer than ``least`` words are taken out of the table, and are read as the longest shorter
one that is in it.

A run's log-likelihood ratio is summed by pieces of ``piece`` letters (a word is
mostly one piece).  A text's median piece is its own level (it reflects the language
and the topic, not toxicity, unless it is high) and is taken off.  Its evidence is the
largest mean, both signs kept, over all windows of ``window`` pieces in a row, normalised
for the text's length: the largest of m windows grows with log m whatever the text
says, so ``growth`` times the logarithm of the number of different windows, beyond that of a
short ordinary text (the ``usual``, a quarter have fewer), is taken off.
``growth`` is twice the slope of ordinary texts (one language's or topic's evidence grows
faster than the mean of all).  The
text is read as a ring for this, so windows cover each piece equally often and
repeating a text changes nothing.  A logistic curve maps this to a score; its place
and slope are fitted on texts that the counting has not seen: the sample is split in
two, and each half is scored by the other's model.

Labels are learnt from a bounded sample: the ``sample_rows`` labelled rows with
the smallest hashes of their id.  All its expressions of full length are counted by Spark, and
the counts, some hundred an added text, come to the driver.

Defined results: null and empty texts, and texts without a letter, get the score
of no evidence; so does everything if a class has no labelled text.  Labels
other than 0 and 1, null ids and null labels teach nothing; of several labels
for an id the largest holds.  Repeated rows are scored one by one; columns other
than id and text are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .letters import Letters, blocks, code_points
from .shingles import hashed, mixed
from .shared import tidy

#: Letters only, as ``Letters`` has them.
WORD = r"[^\W\d_]+"
MARK = " "


class Model(NamedTuple):
    table: tuple[np.ndarray, np.ndarray]
    order: int
    piece: int
    window: int
    growth: float
    usual: float
    place: float
    slope: float


def runs(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


def grams(run: str, order: int) -> list[str]:
    """Each letter of a run and its end, with the order - 1 before."""
    padded = MARK * (order - 1) + run + MARK
    return [padded[i : i + order] for i in range(len(run) + 1)]


FACTORS = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def keys(codes: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hashes of the expressions that end at ``at``, of one letter, of two, and so on; each time, send which of them go on."""
    letters = mixed(codes.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(at), np.uint64)
    for n in range(order):
        with np.errstate(over="ignore"):
            total = total + letters[at - n] * FACTORS[n]
            going_on = yield mixed(total + np.uint64(n))
        at, total = at[going_on], total[going_on]


def key(gram: str) -> int:
    """The hash of one expression."""
    step = keys(code_points(gram), np.array([len(gram) - 1]), len(gram))
    found = next(step)
    for _ in gram[1:]:
        found = step.send(np.array([True]))
    return int(found[0])


class Runs(NamedTuple):
    """The runs of letters of a block of texts: where they stand, those that differ, and each run's kind."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray  # of each text, and the end
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str], letters: Letters) -> Runs:
        texts = [t.lower() for t in texts]
        codes = code_points("\n".join(texts) + "\n")
        edge = np.flatnonzero(np.diff(letters(codes), prepend=False))
        start, size = edge[::2], edge[1::2] - edge[::2]
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return cls(codes, start, size, first, hashed(codes.tobytes(), 4 * start, 4 * size))


def spelled(codes: np.ndarray, start: np.ndarray, size: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs with ``order - 1`` marks before and one after, and the places of their letters and ends."""
    width = size + order
    lead = np.cumsum(width) - width + order - 1
    padded = np.full(int(width.sum()), ord(MARK), np.uint32)
    padded[np.repeat(lead - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = gathered(codes, start, size)
    return padded, np.repeat(lead - (np.cumsum(size + 1) - (size + 1)), size + 1) + np.arange(int((size + 1).sum()))


class Reader:
    """Evidence of texts, a block of about ``block_chars`` at once; a block's equal runs are looked up once."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray], order: int, piece: int, window: int, growth: float = 0.0, usual: float = 0.0, most: float = 1.0, block_chars: int = 500_000):
        self.order, self.piece, self.window, self.most, self.block_chars = order, piece, window, most, block_chars
        self.growth, self.usual = growth, usual
        self.letters = Letters()
        # the sorted hashes, each at the place of its first bits or the next free one, in a table at most half full
        keys_, values = table
        bits = max(8, (2 * len(keys_)).bit_length())
        self.shift = np.uint64(64 - bits)
        at = np.arange(len(keys_))
        at += np.maximum.accumulate((keys_ >> self.shift).astype(np.int64) - at) if len(at) else at
        self.slots = np.zeros(max(1 << bits, int(at[-1]) + 1 if len(at) else 0) + 1, np.uint64)
        self.slots[at] = keys_
        self.values = np.zeros(len(self.slots))
        self.values[at] = values
        self.empty = not len(keys_)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot, or -1."""
        out = np.full(len(hashes), -1)
        at, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(at):
            there = self.slots[slot]
            hit = there == hashes[at]
            out[at[hit]] = slot[hit]
            on = ~hit & (there != 0)
            at, slot = at[on], slot[on] + 1
        return out

    def evidence(self, text: str | None) -> float:
        return next(self.all([text]))

    def all(self, column: Iterable) -> Iterator[float]:
        """The evidence of each text: its largest window less what its length alone lets it have."""
        for largest, length in self.largest(column):
            yield largest - self.growth * max(0.0, length - self.usual)

    def largest(self, column: Iterable) -> Iterator[tuple[float, float]]:
        """For each text the largest mean log-likelihood ratio of a window of pieces, above the text's own level, which is ``most`` at most (a median beyond it is evidence itself), and the logarithm of the number of different windows."""
        for texts in blocks(column, self.block_chars):
            yield from self._block(texts)

    def _block(self, texts: list[str]) -> Iterator[tuple[float, float]]:
        runs_ = Runs.of(texts, self.letters)
        if not len(runs_.start) or self.empty:
            yield from [(0.0, 0.0)] * len(texts)
            return
        _, kind, of = np.unique(runs_.hashes, return_index=True, return_inverse=True)
        sums, n_pieces = self._pieces(runs_.codes, runs_.start[kind], runs_.size[kind])
        begins = np.cumsum(n_pieces) - n_pieces
        values = gathered(sums, begins[of], n_pieces[of])
        ends = np.concatenate([[0], np.cumsum(n_pieces[of])])[runs_.first]
        for a, b in zip(ends, ends[1:], strict=False):
            yield self._largest(values[a:b]) if b > a else (0.0, 0.0)

    def _largest(self, values: np.ndarray) -> tuple[float, float]:
        values = values - min(float(np.median(values)), self.most)
        total, ring = np.zeros(len(values)), np.resize(values, len(values) + self.window - 1)
        for k in range(self.window):  # window by window, so equal ones have equal sums
            total += ring[k : k + len(values)]
        return float(total.max() / self.window), math.log(len(np.unique(total)))

    def _pieces(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the ratios of each run's pieces, and the number of pieces of each run."""
        padded, at = spelled(codes, start, size, self.order)
        ratio, alive = np.zeros(len(at)), np.arange(len(at))
        step = keys(padded, at, self.order)
        found = None
        for n in range(self.order):
            hashes = next(step) if n == 0 else step.send(found)
            place = self.found(hashes)
            found = place >= 0
            place = place[found]
            # what is unknown is unknown in longer company too
            alive = alive[found]
            ratio[alive] = self.values[place]
            if not len(alive):
                break
        n_pieces = -(-size // self.piece)
        begin = np.repeat(np.cumsum(size + 1) - (size + 1) - self.piece * (np.cumsum(n_pieces) - n_pieces), n_pieces) + self.piece * np.arange(int(n_pieces.sum()))
        return np.add.reduceat(ratio, begin), n_pieces


def kneser_ney(spelled_: str, counts: np.ndarray, order: int, discount: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of runs of 1 to ``order`` letters and their log ratios, from the counts of those of ``order``
    letters (spelled one after another; one row each: in ordinary, in toxic texts).

    Runs of any length that are found fewer than ``least`` times are left out, once all lengths are counted.
    """
    there = counts.sum(1) > 0
    if not counts[there].any(0).all():
        return np.zeros(0, np.uint64), np.zeros(0)
    codes = code_points(spelled_).reshape(-1, order)[there]
    own = counts[there].astype(np.float64)
    times = own.sum(1)
    levels = []  # (hash of the run, of the run without its last letter, without its first; counts), longest runs first
    for size in range(order, 0, -1):
        letters = mixed(codes.astype(np.uint64) + np.uint64(1))
        total, begun = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
        shorter = total
        with np.errstate(over="ignore"):
            for n in range(size):
                shorter = mixed(total + np.uint64(n - 1)) if n else total
                total = total + letters[:, size - 1 - n] * FACTORS[n]
                begun = begun + (letters[:, size - 2 - n] * FACTORS[n] if n < size - 1 else np.uint64(0))
            name = mixed(total + np.uint64(size - 1))
        often = times >= least
        levels.append((name[often], begun[often], shorter[often], own[often]))
        # below, a run counts in how many different left neighbours' company it is found
        names, first, of = np.unique(shorter, return_index=True, return_inverse=True)
        own = np.stack([np.bincount(of, c > 0, len(names)) for c in own.T], 1)
        times = np.bincount(of, times, len(names))
        codes = codes[first][:, 1:]
    found, ratios, below = [], [], None
    for name, begun, shorter, own in reversed(levels):
        contexts, of = np.unique(begun, return_inverse=True)
        here, p = None, []
        for n in (own.sum(1), *own.T):
            total = np.bincount(of, n, len(contexts))[of]
            taken = np.minimum(n, discount)
            spare = np.where(total > 0, np.bincount(of, taken, len(contexts))[of] / np.maximum(total, 1), 1.0)
            lower = here
            if here is None:  # what both classes share backs off to shorter runs, the classes back off to it
                lower = 1 / (len(name) + 1) if below is None else below[1][np.searchsorted(below[0], shorter)]
            value = (n - taken) / np.maximum(total, 1) + spare * lower
            here = value if here is None else here
            p.append(value)
        found.append(name)
        ratios.append(np.log(p[2] / p[1]))
        order_ = np.argsort(name)
        below = name[order_], here[order_]
    found, ratios = np.concatenate(found), np.concatenate(ratios)
    order_ = np.argsort(found)
    return found[order_], ratios[order_]


def train(
    docs: DataFrame,
    labels: DataFrame,
    order: int = 8,
    piece: int = 12,
    window: int = 2,
    discount: float = 0.75,
    least: int = 4,
    sample_rows: int = 4_000,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model whose score reaches ``threshold`` where it parts the sample best (largest F1)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label"))
    known = known.groupBy(id_col).agg(F.max("_label").alias("_label"))
    known = known.join(docs.where(F.col(id_col).isNotNull()).select(id_col).distinct(), id_col, "left_semi")
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    # at most sample_rows short rows, so a broadcast; the half is another hash of the id
    picked = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(sample), id_col)
    picked = picked.select("_text", "_label", F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)).cast("int").alias("_half"))

    def count(batches):
        letters = Letters()
        for batch in batches:
            kinds, at = 2 * batch.column(2).to_numpy().astype(np.int64) + batch.column(1).to_numpy(), 0
            for texts in blocks(batch.column(0), 300_000):
                kind = kinds[at : at + len(texts)]
                at += len(texts)
                runs_ = Runs.of(texts, letters)
                text = np.repeat(np.arange(len(texts)), np.diff(runs_.first))
                with np.errstate(over="ignore"):
                    # a run once a text, then its texts by kind
                    _, once = np.unique(mixed(runs_.hashes + text.astype(np.uint64)), return_index=True)
                    of_kind = kind[text[once]]
                    _, some, n = np.unique(mixed(runs_.hashes[once] + of_kind.astype(np.uint64)), return_index=True, return_counts=True)
                    chosen = once[some]
                    padded, places = spelled(runs_.codes, runs_.start[chosen], runs_.size[chosen], order)
                    weight, of_kind = (np.repeat(x, runs_.size[chosen] + 1) for x in (n, of_kind[some]))
                    whole = np.zeros(len(places), np.uint64)
                    for k in range(order):
                        whole += mixed(padded[places - k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
                    _, some, of = np.unique(mixed(whole + of_kind.astype(np.uint64)), return_index=True, return_inverse=True)
                weight = np.bincount(of, weight, len(some)).astype(np.int64)
                for lo in range(0, len(some), 100_000):
                    part = some[lo : lo + 100_000]
                    text_ = padded[(places[part] - order + 1)[:, None] + np.arange(order)].tobytes().decode("utf-32-le")
                    yield rows([text_[i : i + order] for i in range(0, len(text_), order)], of_kind[part], weight[lo : lo + 100_000])

    def rows(names, kind, n):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kind, pa.int64()), pa.array(n, pa.int64())], ["gram", "kind", "n"])

    counted = picked.mapInArrow(tidy(count), "gram string, kind bigint, n bigint")
    summed = counted.groupBy("gram").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)))
    found = summed.toArrow()
    counts = np.stack([found.column(f"n{k}").to_numpy().astype(np.int32) for k in range(4)], 1) if found.num_rows else np.zeros((0, 4), np.int32)
    names = "".join(found.column("gram").to_pylist())
    del found

    def fitted(kinds):
        """A model of these halves' ordinary and toxic counts."""
        return kneser_ney(names, np.stack([counts[:, k].sum(1) for k in np.array(kinds).T], 1), order, discount, least)

    whole, halves = fitted([[0, 1], [2, 3]]), [fitted([[0, 1]]), fitted([[2, 3]])]
    del names, counts
    if not len(whole[0]) or not all(len(h[0]) for h in halves):
        return Model(whole, order, piece, window, 0.0, 0.0, 1.0, 4.0)
    other = docs.sparkSession.sparkContext.broadcast(halves[::-1])  # bounded as the sample is

    def unseen(batches):
        readers = [Reader(r, order, piece, window) for r in other.value]
        for batch in batches:
            half = batch.column(2).to_numpy()
            x = np.zeros((batch.num_rows, 2))
            for h, reader in enumerate(readers):
                at = np.flatnonzero(half == h)
                x[at] = np.array(list(reader.largest(batch.column(0).take(pa.array(at))))).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["x", "length", "label"])

    # in steps of 1/1000, and by id at most: an id's repeated text is one row
    steps = picked.mapInArrow(tidy(unseen), "x double, length double, label int").groupBy(F.round(F.least("x", F.lit(100.0)), 3).alias("x"), F.round("length", 3).alias("length")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).toPandas()
    x, length, hits, n = (steps[c].to_numpy(float) for c in ("x", "length", "hits", "n"))
    growth, usual = growth_of(x, length, n - hits)
    place = best_place(x - growth * np.maximum(0, length - usual), hits, n)
    return Model(whole, order, piece, window, growth, usual, place, 4.0 / max(place, 1e-6))


def growth_of(x: np.ndarray, length: np.ndarray, n: np.ndarray, least: int = 30) -> tuple[float, float]:
    """Of ``n`` ordinary texts each: twice the slope of the largest windows over the logarithm of their number, and that logarithm's lower quartile; no growth if fewer than ``least`` texts tell."""
    some = (n > 0) & (length >= math.log(8))
    if n[some].sum() < least or np.ptp(length[some]) == 0:
        return 0.0, 0.0
    slope = np.polyfit(length[some], x[some], 1, w=np.sqrt(n[some]))[0]
    return 2 * max(0.0, float(slope)), float(np.percentile(np.repeat(length[n > 0], n[n > 0].astype(int)), 25))


def best_place(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The cut with the largest F1, halfway to the next value below; ``hits`` of the ``n`` texts with evidence x are toxic."""
    order = np.argsort(-x)
    x, hits, n = x[order], np.cumsum(hits[order]), np.cumsum(n[order])
    k = int((2 * hits / (n + max(hits[-1], 1))).argmax())
    below = x[k + 1] if k + 1 < len(x) else 0.0
    return float(max((x[k] + below) / 2, 1e-6))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score, predicted) of every text. ``keep``: more columns to carry."""
    carried = [id_col, *(c for c in keep or [] if c not in (id_col, text_col))]
    with_text = [text_col] if text_col in (keep or []) else []
    shipped = docs.sparkSession.sparkContext.broadcast(model._asdict())
    shift = math.log(threshold / (1 - threshold))

    def run(batches):
        m = shipped.value
        reader = Reader(m["table"], m["order"], m["piece"], m["window"], m["growth"], m["usual"])
        for batch in batches:
            x = list(reader.all(batch.column(0)))
            scores = [1 / (1 + math.exp(-max(-700.0, min(700.0, m["slope"] * (v - m["place"]) + shift)))) for v in x]
            yield pa.RecordBatch.from_arrays([*batch.columns[1 - len(with_text) :], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*with_text, *carried, "score", "predicted"])

    source = docs.select(text_col, *carried)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*with_text, *carried])
    return source.mapInArrow(tidy(run), f"{schema}, score double, predicted int")
