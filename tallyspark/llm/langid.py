"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is bound from
its letters' vectors, each rotated by its distance from the end, by
elementwise product; a text's profile is the bundle (sum) of its n-grams.  A
language's prototype is the bundle of the unit profiles of its labelled texts,
and a text gets the language whose prototype has the largest cosine with it.

Texts are lower-cased; a run of characters that are no letters is one gap, which
counts as a letter of its own.  Profiles of a block of texts are one matrix
product: counts of n-grams by text, times the n-gram vectors.

Training sums whole-number profiles by language and dimension in Spark; what
comes to the driver is one vector for each language, whatever the input's size.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything when there is no labelled text.  Equal scores go to the smaller
language name.  Repeated rows are judged one by one; columns other than id, text
and (in training) language are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import Letters, blocks, code_points
from .shared import tidy

GAP = 32
SCALE = 1 << 20


class Profiler:
    """Profiles of texts; ``block_chars`` bounds the text that is counted at once, ``cells`` the table of its counts."""

    def __init__(self, dims: int, n: int, seed: int, block_chars: int = 300_000, cells: int = 2_000_000):
        self.dims, self.n, self.seed, self.block_chars, self.cells = dims, n, seed, block_chars, cells
        self.letter = Letters()
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dims)
            self.vectors[code] = (2 * bits - 1).astype(np.int8)
        return self.vectors[code]

    def codes(self, text: str) -> np.ndarray:
        """Code points of the letters, gaps between them and at both ends; empty if there is no letter."""
        raw = code_points(text.lower())
        known = self.letter(raw)
        if not known.any():
            return raw[:0]
        raw = np.concatenate([[GAP], np.where(known, raw, GAP), [GAP]])
        return raw[np.concatenate([[True], (raw[1:] != GAP) | (raw[:-1] != GAP)])]

    def blocks(self, column: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which texts have a letter, their unit profiles), block by block."""
        for texts in blocks(column, self.block_chars):
            yield self._block([self.codes(t) for t in texts])

    def _block(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, known = self.n, np.array([len(r) > 0 for r in rows])
        rows = [np.concatenate([r, np.full(max(0, n - len(r)), GAP, r.dtype)]) for r in rows if len(r)]
        if not rows:
            return known, np.zeros((0, self.dims), np.float32)
        joined = np.concatenate(rows)
        alphabet, code = np.unique(joined, return_inverse=True) if len(joined) < 4096 else self._small(joined)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        gram = np.zeros(len(joined) - n + 1, np.int64)
        for k in range(n):
            gram = gram * len(alphabet) + code[k : len(gram) + k]
        inside = of[: len(gram)] == of[n - 1 :]
        gram, of = gram[inside], of[: len(inside)][inside]
        if len(alphabet) ** n <= 4_000_000:
            seen = np.flatnonzero(np.bincount(gram, minlength=1))
            place = np.zeros(seen[-1] + 1, np.int64)
            place[seen] = np.arange(len(seen))
            gram = place[gram]
        else:
            seen, gram = np.unique(gram, return_inverse=True)
        letters = np.stack([self.vector(int(c)) for c in alphabet])
        profiles = np.zeros((len(rows), self.dims), np.float32)
        # rows of texts and columns of n-grams, as many at once as the table holds
        step = max(1, self.cells // len(rows))
        order = np.argsort(gram, kind="stable") if step < len(seen) else None
        for lo in range(0, len(seen), step):
            part = seen[lo : lo + step]
            some = slice(None) if order is None else order[np.searchsorted(gram, lo, sorter=order) : np.searchsorted(gram, lo + step, sorter=order)]
            counts = np.bincount(of[some] * len(part) + gram[some] - lo, minlength=len(rows) * len(part)).reshape(len(rows), len(part)).astype(np.float32)
            for at in range(0, len(part), 4096):
                these, bound = part[at : at + 4096], None
                for k in range(n):  # the last letter is not rotated
                    turned = np.roll(letters, k, axis=1)[these % len(alphabet)]
                    bound = turned if bound is None else bound * turned
                    these = these // len(alphabet)
                profiles += counts[:, at : at + 4096] @ bound.astype(np.float32)
        norm = np.linalg.norm(profiles, axis=1, keepdims=True)
        return known, profiles / np.where(norm > 0, norm, 1)

    @staticmethod
    def _small(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = np.zeros(int(joined.max()) + 1, bool)
        there[joined] = True
        alphabet = np.flatnonzero(there)
        place = np.zeros(len(there), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, place[joined]


def train(labelled: DataFrame, dims: int = 1024, n: int = 3, seed: int = 17, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype for each language from all labelled texts."""

    def run(batches):
        profiler, sums = Profiler(dims, n, seed), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            at = 0
            for known, profiles in profiler.blocks(batch.column(0)):
                own = langs[at : at + len(known)][known]
                at += len(known)
                for lang in set(own):
                    total = np.rint(profiles[own == lang] * SCALE).astype(np.int64).sum(0)
                    sums[lang] = sums.get(lang, 0) + total
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "total"])

    sums = labelled.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(tidy(run), "lang string, total array<bigint>")
    rows = sums.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("total")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("total")).collect()
    vectors = {r["lang"]: np.array([x["total"] for x in r["total"]], float) for r in rows}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(vectors.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score): the language of the nearest prototype and its cosine, at least 0. ``keep``: more columns to carry."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else np.zeros((0, 1), np.float32)
    carried = [id_col, *(c for c in keep or [] if c not in (id_col, text_col))]
    with_text = [text_col] if text_col in (keep or []) else []

    def run(batches):
        profiler = Profiler(matrix.shape[1], n, seed)
        for batch in batches:
            langs, scores = [], []
            for known, profiles in profiler.blocks(batch.column(0) if names else [None] * batch.num_rows):
                cosine = profiles @ matrix.T if names else np.zeros((0, 1))
                best = iter(zip(cosine.argmax(1), cosine.max(1), strict=True))
                for is_known in known:
                    k, score = next(best) if is_known else (-1, 0.0)
                    langs.append(names[k] if k >= 0 else "und")
                    scores.append(min(1.0, max(0.0, float(score))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1 - len(with_text) :], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*with_text, *carried, "lang_pred", "score"])

    source = docs.select(text_col, *carried)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*with_text, *carried])
    return source.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def least_cosine(scored: DataFrame, share: float = 0.001, least_chars: int = 200, lang_col: str = "lang", text_col: str = "text") -> float:
    """The cosine that all but ``share`` of the labelled texts of some length reach, in steps of 1/1000; 0 without such texts.

    ``scored``: what ``identify`` returns with the columns of language and text kept.  Texts of other languages than
    the learned ones stay below it.
    """
    known = scored.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) >= least_chars))
    steps = known.groupBy(F.floor(F.col("score") * 1000).alias("step")).agg(F.count("*").alias("n")).collect()  # 1,001 rows at most
    below, allowed = 0, share * sum(r["n"] for r in steps)
    for r in sorted(steps):
        below += r["n"]
        if below > allowed:
            return r["step"] / 1000
    return 0.0


def recognised(scored: DataFrame, least: float, least_chars: int = 200, text_col: str = "text") -> DataFrame:
    """The rows whose text has letters and, unless it is too short to tell, a language at cosine ``least`` or more."""
    return scored.where((F.col("lang_pred") != "und") & ((F.col("score") >= least) | (F.char_length(text_col) < least_chars)))
