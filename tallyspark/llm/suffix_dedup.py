"""Removal of long strings that stand in an earlier document, by prefix-free parsing.

Every place of a text has a hash of the ``gram`` bytes from it.  A place
is a trigger if its hash is the least in some window of ``length`` bytes; so
every string of that length contains a trigger, and wherever the string stands
it has the same one.  The phrase of a trigger is the text around it that such
strings can reach: ``length - gram`` bytes before it and ``length`` from it on.

* Parse: documents are dealt into chunks (a table clustered by chunk, which later
  steps read without another shuffle).  A chunk sends, for each distinct phrase,
  152 bits of hashes (96 of two unlike ones of the phrase, 28 each of its inner parts
  to the left and to the right) and its smallest document.
* Dictionary: phrases are grouped by trigger.  A phrase that an earlier document
  has too is wholly covered.  Two phrases that share a string of ``length`` bytes
  through the trigger share the inner part on one side at least: the ``a`` bytes before
  the trigger with its gram, or the ``length + 1 - a`` from it on.  Only where different
  phrases do, the first document of each sends the phrase itself.
* Suffix arrays: distinct phrases are sorted by what follows the trigger and by
  what precedes it, read backwards.  Runs of the two arrays with common prefixes
  of n and ``length - n`` bytes name the strings through the trigger; a string
  whose smallest document is smaller than the phrase's is covered there.
* Corpus order: the answers go back to the chunks, where every place of a phrase
  in a document gets its covered ranges.

Highly repetitive text costs little: repeated phrases are sent once a chunk and
sorted once.  Chunks and groups are sized by the input's bytes.  What a chunk and a
group exchange is one array of records, so their number times each other costs
no work in Python but a slice.

Defined results: null texts are empty; rows with a null id are kept whole and
cover nothing; rows with equal ids do not cover each other; repeated rows each
get the same answer; texts shorter than ``length`` bytes are kept whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, release_shuffles, tidy, tidy_group
from .shingles import mixed

#: Bytes that are parsed at a time: their hashes stay in a core's cache.
SEGMENT = 1 << 15


def packed(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def spread(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def words_of(lo: int, hi: int) -> list[int]:
    """Places of 8-byte words that together are the bytes from ``lo`` to ``hi``, 8 at least."""
    return [*range(lo, hi - 7, 8), *([hi - 8] if (hi - lo) % 8 else [])]


class Parser:
    """Triggers and phrases of texts."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.lead = length, gram, length - gram
        if gram < 8 or not 0 <= self.lead < 64:
            raise ValueError("gram must have 8 bytes at least, and length up to 63 more")
        # places from the trigger on: its gram; the inner parts to its right and left, if there is room; the rest
        if self.lead < 16:
            self.words = [words_of(0, gram), [], [], words_of(-self.lead, length)]
        else:
            left, right = self.lead // 2, length + 1 - self.lead // 2
            self.words = [words_of(0, gram), words_of(gram, right), words_of(-left, 0), [*words_of(min(right, length - 8), length), *words_of(-self.lead, -left)]]
        rng = np.random.Generator(np.random.PCG64(11))
        self.odd = rng.integers(1, 1 << 63, (7, 8), np.uint64) * np.uint64(2) + np.uint64(1)

    def triggers(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(places in the joined texts, trigger hashes, two phrase hashes, both hashes of inner parts in one)."""
        pad = 2 * self.length
        size = np.array([len(t) for t in texts], np.int64)
        end = pad + np.cumsum(size)
        data = b"".join([bytes(pad), *texts, bytes(pad)])
        #: windows that no text has whole
        dead = np.zeros(len(data), bool)
        for back in range(1, self.length):
            dead[end - back] = True
        dead[:pad] = True
        stop, found = len(data) - pad, []
        for lo in range(pad, stop, SEGMENT):
            found.append(self._segment(data, dead, lo, min(lo + SEGMENT, stop)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), *np.zeros((3, 0), np.uint64)
        del dead
        place, key = (np.concatenate(c) for c in zip(*found, strict=True))
        row = np.searchsorted(end, place, "right")
        before, after = np.minimum(place - (end - size)[row], self.lead), np.minimum(end[row] - place, self.length)
        clipped = np.flatnonzero((before < self.lead) | (after < self.length))
        phrase, phrase2, inner = (np.empty(len(place), np.uint64) for _ in range(3))
        for lo in range(0, len(place), 4096):
            phrase[lo : lo + 4096], phrase2[lo : lo + 4096], inner[lo : lo + 4096] = self._phrases(data, place[lo : lo + 4096])
        for lo in range(0, len(clipped), 4096):
            at = clipped[lo : lo + 4096]
            # equal bytes around another place in them are another phrase
            shape = (before[at] * (self.length + 1) + after[at]).astype(np.uint64)
            rows = around(data, place[at], before[at], after[at], self.lead, self.length)
            phrase[at], phrase2[at], inner[at] = self._phrases(rows.tobytes() + bytes(8), np.arange(len(at)) * rows.shape[1] + self.lead, mixed(shape + np.uint64(1)))
        return place - pad, key, phrase, phrase2, inner

    def _segment(self, data: bytes, dead: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of triggers in data from ``lo`` to ``hi``, and their hashes."""
        first, width = lo - self.lead, self.lead + 1
        words, n = self.words[0], hi - lo + 2 * self.lead
        eight = np.ndarray(n + words[-1], "<u8", data, first, (1,)).copy()
        hashes = np.zeros(n, np.uint64)
        for i, w in enumerate(words):
            hashes ^= hashes >> np.uint64(32)
            hashes ^= eight[w : w + n]
            hashes *= self.odd[0, i % 8]
        key = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        least = spread(key, width, np.minimum)
        least[dead[first:hi]] = 0
        place = np.flatnonzero(spread(least, width, np.maximum) == key[self.lead : self.lead + hi - lo])
        return place + lo, key[place + self.lead]

    def _phrases(self, data: bytes, place: np.ndarray, shape: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of phrases and those of their inner parts: chains of steps that can be undone, so one word that differs is enough."""
        eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        gram, right, left, outer = ([eight[place + w] for w in part] for part in self.words)
        if shape is not None:
            outer.append(shape)

        def chain(x: np.ndarray, words: list[np.ndarray], n: int) -> np.ndarray:
            for i, w in enumerate(words):
                x = (x ^ w) * self.odd[n, i % 8]
                x ^= x >> np.uint64(28 + n)
            return x

        middle = chain(np.zeros(len(place), np.uint64), gram, 1)
        on_left, on_right = chain(middle, left, 2), chain(middle, right, 3)
        phrase = mixed(chain(chain(on_right, left, 4), outer, 5))
        phrase2 = mixed(chain(np.full(len(place), self.odd[0, 7]), [*right, *outer, *left, *gram], 6))
        inner = (mixed(on_left) >> np.uint64(36)) | (mixed(on_right) >> np.uint64(36)) << np.uint64(28)
        return phrase, phrase2, inner


def around(data: bytes, place: np.ndarray, before: np.ndarray, after: np.ndarray, lead: int, length: int) -> np.ndarray:
    """The bytes from ``lead`` before each place to ``length`` from it on; those beyond ``before`` and ``after`` are 0."""
    column = np.arange(-lead, length)
    rows = np.frombuffer(data, np.uint8)[place[:, None] + column]
    cut = np.flatnonzero((before < lead) | (after < length))
    rows[cut] *= (column >= -before[cut, None]) & (column < after[cut, None])
    return rows


def changed(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def grouped(first: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in an order in which equal ones follow one another, and where those of the next kind begin."""
    order = np.argsort(first)
    new = changed(first[order])
    for x in others:
        if (x[order][1:] != x[order][:-1])[~new[1:]].any():  # only the first are sorted, and some of equal first ones differ
            order = np.lexsort((*others, first))
            return order, np.flatnonzero(changed(first[order], *(o[order] for o in others)))
    return order, np.flatnonzero(new)


class Chunk:
    """A chunk's documents in a fixed order, and the distinct phrases that it sends."""

    def __init__(self, blobs: list[bytes], parser: Parser, buckets: int):
        table = pa.concat_tables([unpacked(b) for b in blobs])
        ids, texts = table["id"].to_pylist(), [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.table = table.take(pa.array(order, pa.int64()))
        self.texts = [texts[i] for i in order]
        #: of the rows with an id, which come first
        self.ids = np.array([ids[i] for i in order if ids[i] is not None], np.int64)
        named = self.texts[: len(self.ids)]
        #: where texts begin in the joined ones, and the end
        self.starts = np.cumsum([0, *(len(t) for t in named)])
        self.at, key, phrase, phrase2, inner = parser.triggers(named)
        del table, texts
        self.row = (np.searchsorted(self.starts[1:], self.at, "right")).astype(np.int32)
        self.place = self.at - self.starts[self.row]
        # rows are in order of ids, so the first place of a phrase is in its smallest document
        order, starts = grouped(phrase, phrase2)
        first = np.minimum.reduceat(order, starts) if len(order) else order
        bucket = key[first] % np.uint32(buckets)
        by_place = np.argsort(first)
        by_bucket = by_place[np.argsort(bucket[by_place].astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")]
        self.first = first[by_bucket]
        self.bucket = bucket[by_bucket].astype(np.int64)
        back = np.empty(len(first), np.int64)
        back[by_bucket] = np.arange(len(first))
        #: the phrase of every place, in the order of sending
        self.phrase_of = np.empty(len(key), np.int64)
        self.phrase_of[order] = np.repeat(back, np.diff(starts, append=len(order)))
        self.phrase, self.phrase2, self.inner = phrase[self.first], phrase2[self.first], inner[self.first]
        self.found_in = self.ids[self.row[self.first]]

    def joined(self) -> bytes:
        return b"".join(self.texts[: len(self.ids)])


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 16, chunk_bytes: int = 4_000_000, group_phrases: int = 500_000, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(id, ``keep`` columns, n_bytes, spans array<struct<start, end>> that were removed, kept binary that is left) of every row.

    ``as_text``: kept is a string, without what is left of letters that were cut in two.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    carried = [c for c in keep or [] if c not in (id_col, text_col)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(carried)))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.min("id"), F.lit(0)).alias("least"), F.coalesce(F.max("id"), F.lit(0)).alias("most")).first()
    least = spark.sparkContext.defaultParallelism
    chunks = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), size["bytes"] // chunk_bytes)
    groups = max(least, size["bytes"] // (length - gram) * 2 // group_phrases)
    chunked = _clustered(source.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")), chunks, work)
    lead, least_id = length - gram, size["least"]
    sending = np.dtype([("phrase", "<u8"), ("phrase2", "<u4"), ("inner", "u1", 7), ("doc", "<u4" if size["most"] - least_id < 1 << 32 else "<u8")])
    asking = np.dtype([("number", "<u4"), ("doc", "<i8"), ("before", "u1"), ("after", "<u2"), ("text", "u1", lead + length)])
    telling = np.dtype([("number", "<u4"), ("mask", "<u8")])

    def parse(table: pa.Table) -> pa.Table:
        chunk, me = Chunk(table["blob"].to_pylist(), Parser(length, gram), groups), table["chunk"][0].as_py()
        out = np.empty(len(chunk.first), sending)
        out["phrase"], out["phrase2"] = chunk.phrase, chunk.phrase2 >> np.uint64(32)
        out["inner"] = chunk.inner.view("u1").reshape(-1, 8)[:, :7]
        out["doc"] = (chunk.found_in - least_id).view(np.uint64)
        starts = np.flatnonzero(changed(chunk.bucket))
        # byte by byte of all records: those of ids, which ascend, are nearly alike
        return _rows(chunk.bucket[starts], me, [out[a:b].view("u1").reshape(-1, sending.itemsize).T.tobytes() for a, b in pairwise([*starts.tolist(), len(out)])])

    sent = chunked.groupBy("chunk").applyInArrow(tidy_group(parse), "bucket int, chunk int, blob binary")

    def group(table: pa.Table) -> pa.Table:
        got, ends = _records([np.frombuffer(b, "u1").reshape(sending.itemsize, -1).T.tobytes() for b in table["blob"].to_pylist()], sending)
        phrase, phrase2, doc, inner = got["phrase"].copy(), got["phrase2"].copy(), got["doc"].copy(), np.zeros((len(got), 8), "u1")
        inner[:, :7] = got["inner"]
        inner = inner.view("<u8").ravel()
        del got
        order, starts = grouped(phrase, phrase2, inner)
        earliest = np.minimum.reduceat(doc[order], starts)
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        inner = inner[order[starts]]
        asked = np.zeros(len(starts), bool)
        for part in (inner & np.uint64((1 << 28) - 1), inner >> np.uint64(28)):
            by, begin = grouped(part.astype(np.uint32))
            several = np.minimum.reduceat(earliest[by], begin) < np.maximum.reduceat(earliest[by], begin)
            asked[by] |= np.repeat(several, np.diff(begin, append=len(by)))
        status = np.empty(len(order), np.uint8)
        status[order] = np.where(doc[order] > earliest[of], 1, np.where(asked[of], 2, 0))
        return _rows(table["bucket"].to_numpy(), table["chunk"].to_numpy(), _slices(status, ends[:-1]))

    status = work.saved(sent.groupBy("bucket").applyInArrow(tidy_group(group), "bucket int, chunk int, blob binary"))
    release_shuffles(spark)

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([], 0, [])
        chunk, me = Chunk(left["blob"].to_pylist(), Parser(length, gram), groups), key[0].as_py()
        # phrases are numbered bucket by bucket
        wanted = np.flatnonzero(_statuses(right) == 2)
        first = chunk.first[wanted]
        out = np.empty(len(wanted), asking)
        out["number"], out["doc"] = wanted, chunk.found_in[wanted]
        out["before"] = before = np.minimum(chunk.place[first], lead)
        out["after"] = after = np.minimum(chunk.starts[1:][chunk.row[first]] - chunk.at[first], length)
        data = b"".join([bytes(length), chunk.joined(), bytes(length)])
        for lo in range(0, len(first), 4096):
            at = slice(lo, lo + 4096)
            out["text"][at] = around(data, chunk.at[first[at]] + length, before[at], after[at], lead, length)
        starts = np.flatnonzero(changed(chunk.bucket[wanted]))
        return _rows(chunk.bucket[wanted][starts], me, _slices(out, starts[1:]))

    asked = chunked.groupBy("chunk").cogroup(status.groupBy("chunk")).applyInArrow(tidy_group(ask), "bucket int, chunk int, blob binary")

    def compare(table: pa.Table) -> pa.Table:
        got, ends = _records(table["blob"].to_pylist(), asking)
        mask = strings_before(got["text"], got["before"], got["after"], got["doc"].copy(), length, gram)
        hit = np.flatnonzero(mask)
        out = np.empty(len(hit), telling)
        out["number"], out["mask"] = got["number"][hit], mask[hit]
        return _rows(np.full(len(ends), -1), table["chunk"].to_numpy(), _slices(out, np.searchsorted(hit, ends[:-1])))

    masks = asked.groupBy("bucket").applyInArrow(tidy_group(compare), "bucket int, chunk int, blob binary")
    answers = status.union(masks)
    fields = source.schema.fields[2:]

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        chunk = Chunk(left["blob"].to_pylist(), Parser(length, gram), groups)
        is_mask = pa.array(right["bucket"].to_numpy() == -1)
        known = _statuses(right.filter(pc.invert(is_mask)))
        told, _ = _records(right.filter(is_mask)["blob"].to_pylist(), telling)
        masks_ = np.zeros(len(chunk.first), np.uint64)
        masks_[told["number"]] = told["mask"]
        starts, of = chunk.starts, chunk.phrase_of
        over = (known[of] == 1) | (chunk.found_in[of] < chunk.ids[chunk.row])
        step = np.zeros(starts[-1] + 1, np.int32)
        at, row = chunk.at[over], chunk.row[over]
        np.add.at(step, np.maximum(at - lead, starts[row]), 1)
        np.add.at(step, np.minimum(at + length, starts[row + 1]), -1)
        some = np.flatnonzero(~over & (masks_[of] > 0))
        at, mask = chunk.at[some], masks_[of[some]]
        for j in range(lead + 1):
            begin = at[(mask >> np.uint64(j)) & np.uint64(1) > 0] - j
            np.add.at(step, begin, 1)
            np.add.at(step, begin + length, -1)
        covered = np.cumsum(step[:-1], dtype=np.int32) > 0
        del step
        # a span ends where its text does
        opens, closes = covered.copy(), covered.copy()
        opens[1:] &= ~covered[:-1]
        closes[:-1] &= ~covered[1:]
        edge = starts[:-1][np.diff(starts) > 0]
        opens[edge] = covered[edge]
        closes[edge[1:] - 1] = covered[edge[1:] - 1]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        base = starts[np.searchsorted(starts, begin, "right") - 1]
        whole = len(chunk.texts) - len(chunk.ids)
        spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([np.searchsorted(begin, starts), np.full(whole, len(begin))]), pa.int32()), spans)
        gone = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])[starts]
        left_over = np.frombuffer(chunk.joined(), np.uint8)[~covered].tobytes()
        ends = (starts - gone).tolist()
        kept = [*(left_over[a:b] for a, b in pairwise(ends)), *chunk.texts[len(chunk.ids) :]]
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        columns = [chunk.table["id"], *(chunk.table[f.name] for f in fields), pa.array([len(t) for t in chunk.texts], pa.int64()), spans, pa.array(kept, pa.string() if as_text else pa.binary())]
        return pa.table(columns, names=["id", *(f.name for f in fields), "n_bytes", "spans", "kept"])

    schema = "id bigint, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields) + "n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept " + ("string" if as_text else "binary")
    result = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy_group(cut), schema)
    return result.select(F.col("id").alias(id_col), *(F.col(f"c{n}").alias(c) for n, c in enumerate(carried)), "n_bytes", "spans", "kept")


def strings_before(texts: np.ndarray, size_before: np.ndarray, size_after: np.ndarray, doc: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each phrase, bit j: the string from j bytes before the trigger stands in a phrase of a smaller document."""
    n, lead = len(doc), length - gram
    orders = []
    for part in (texts[:, lead:], texts[:, :lead][:, ::-1]):
        letters = np.zeros((n, -(-part.shape[1] // 8) * 8), np.uint8)
        letters[:, : part.shape[1]] = part
        words = letters.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        letters = letters[order]
        differs = letters[1:] != letters[:-1]
        common = np.where(differs.any(1), differs.argmax(1), letters.shape[1])
        orders.append((order, np.concatenate([[0], common])))
    (by_after, common_after), (by_before, common_before) = orders
    mask = np.zeros(n, np.uint64)
    for j in range(lead + 1):
        live = (size_before >= j) & (size_after >= length - j)
        at = np.flatnonzero(live)
        if len(at) < 2:
            continue
        follows, precedes = np.empty(n, np.int64), np.empty(n, np.int64)
        follows[by_after] = np.cumsum(common_after < length - j)
        precedes[by_before] = np.cumsum(common_before < j)
        order, starts = grouped(follows[at] * (n + 1) + precedes[at])
        of_doc = doc[at[order]]
        earliest = np.repeat(np.minimum.reduceat(of_doc, starts), np.diff(starts, append=len(order)))
        mask[at[order[of_doc > earliest]]] |= np.uint64(1 << j)
    return mask


def _records(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of all blobs in one array, and the ends of the blobs in it."""
    return np.frombuffer(b"".join(blobs), kind), np.cumsum([len(b) for b in blobs], dtype=np.int64) // kind.itemsize


def _slices(records: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """The bytes of records up to the first border, between borders, and from the last on."""
    raw, width = records.tobytes(), records.itemsize
    return [raw[a * width : b * width] for a, b in pairwise([0, *borders.tolist(), len(records)])]


def _rows(buckets, chunks, blobs: list[bytes]) -> pa.Table:
    """Of blobs that hold something."""
    has = np.flatnonzero([len(b) for b in blobs[: len(buckets)]])
    chunks = np.broadcast_to(chunks, len(buckets))
    columns = [pa.array(np.asarray(x)[has].astype(np.int32), pa.int32()) for x in (buckets, chunks)]
    return pa.table([*columns, pa.array([blobs[i] for i in has.tolist()], pa.binary())], ["bucket", "chunk", "blob"])


def _statuses(table: pa.Table) -> np.ndarray:
    """The answers on a chunk's phrases, in the order in which it sent them."""
    blobs = table["blob"].to_pylist()
    return _records([blobs[i] for i in np.argsort(table["bucket"].to_numpy()).tolist()], np.dtype("u1"))[0]


def _clustered(rows: DataFrame, chunks: int, work: Workspace) -> DataFrame:
    """A table (chunk, blob) of the rows, bucketed by chunk in the shared folder."""
    others = [c for c in rows.columns if c != "chunk"]

    def pack(batches: Iterator[pa.RecordBatch], most: int = 32_000_000) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            table = pa.Table.from_batches(held)
            chunk = table["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            rows_ = table.select(others).take(pa.array(order)).combine_chunks()
            starts = np.flatnonzero(changed(chunk[order]))
            blobs = [packed(rows_.slice(a, b - a)) for a, b in pairwise([*starts.tolist(), len(order)])]
            return pa.RecordBatch.from_arrays([pa.array(chunk[order[starts]], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "blob"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                held.append(batch.slice(lo, 1000))
                size += held[-1].get_total_buffer_size() if batch.num_rows <= 1000 else held[-1].nbytes
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    name = f"tallyspark_{uuid.uuid4().hex}"
    table = rows.mapInArrow(tidy(pack), "chunk int, blob binary").repartition(chunks, "chunk")
    table.write.bucketBy(chunks, "chunk").option("path", f"{work.root}/{name}").option("compression", "none").saveAsTable(name)
    release_shuffles(rows.sparkSession)
    clustered = rows.sparkSession.table(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the name only: files stay, and the frame knows them and their buckets
    return clustered
