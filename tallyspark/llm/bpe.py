"""Byte-level BPE by forced-boundary splitting, as Spark map stages.

Two neighbouring bytes that stand side by side in no vocabulary entry can never
be merged, so every such place is a certain cut.  Texts are cut there (one
vectorised table lookup over their bytes), distinct fragments are encoded by
themselves, and the ids are concatenated in the fragments' order.  Fragments repeat
a lot, so a worker remembers the ids of short ones, by their bytes, in a table of
bounded memory; only new fragments reach the merging encoder.

The cuts must also not change what the pre-tokeniser sees.  Its pattern looks
ahead only after white space and starts a contraction only at an apostrophe, so
a cut is taken only after a character that is surely no white space, before a
character (never inside one) that is no apostrophe.

Defined results: null and empty texts give an empty id list; rows are kept one
for one, so ties and repeated rows stay; columns other than the id and the text
are dropped; empty tables give empty tables.  Special strings of the vocabulary
found in a text become their single id, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .shared import by_bytes, release, tidy
from .shingles import hashed, same

#: Bytes and ids of a remembered fragment for which there is room on average, and about how much memory it takes with them.
LETTERS, IDS, ENTRY_BYTES = 16, 6, 78
#: Masks of the first bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that end no white-space character are those outside this set.
#: ASCII white space and separators, and the last bytes of U+0085, U+00A0, U+1680,
#: U+2000-U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
MAY_END_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(moved)}


class Vocabulary:
    """What a byte-level BPE file says, ready for cutting and decoding."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        to_byte = {letter: byte for byte, letter in byte_letters().items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        token = {n: bytes(map(to_byte.__getitem__, letters)) for letters, n in spec["model"]["vocab"].items()}
        joined = np.zeros((256, 256), bool)
        for text in token.values():
            row = np.frombuffer(text, np.uint8)
            joined[row[:-1], row[1:]] = True
        cut = ~joined
        cut[MAY_END_SPACE, :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, ord("'")] = False
        self.cut = cut.ravel()
        token |= {n: text for text, n in self.special.items()}
        table = [token.get(n, b"") for n in range(max(token) + 1)]
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(table), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        return gathered(self.letters, self.starts[ids], self.sizes[ids]).tobytes()


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[starts[0] : starts[0] + sizes[0]], and so on, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Remembered:
    """Ids of up to ``most`` short fragments, in arrays of fixed size: found by hash, then compared by their bytes."""

    def __init__(self, most: int, short: int):
        self.most, self.n, self.n_letters, self.n_ids = most, 0, 0, 0
        bits = max(8, (2 * most - 1).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full((1 << bits) + most, -1, np.int32)
        self.hashes, self.start, self.id_start = np.empty(most, np.uint64), np.empty(most, np.uint32), np.empty(most, np.uint32)
        self.size, self.id_size = np.empty(most, np.uint8), np.empty(most, np.uint8)
        # a place that is not written takes no memory; eight bytes are read from any place
        self.letters, self.ids = np.empty(LETTERS * most + short + 8, np.uint8), np.empty(IDS * most + short, "<u4")
        self.eight = np.ndarray(len(self.letters) - 7, "<u8", self.letters, strides=(1,))

    def found(self, hashes: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each fragment's entry; -1 if there is none of its hash, -2 if that is another fragment's."""
        out, at, slot = np.full(len(hashes), -1), np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(at):
            entry = self.slots[slot]
            used = entry >= 0
            at, slot, entry = at[used], slot[used], entry[used]
            hit = self.hashes[entry] == hashes[at]
            out[at[hit]] = entry[hit]
            at, slot = at[~hit], slot[~hit] + 1
        at = np.flatnonzero(out >= 0)
        entry = out[at]
        unlike = self.size[entry] != size[at]
        a, b, left, which = self.start[entry].astype(np.int64)[~unlike], start[at][~unlike], size[at][~unlike], np.flatnonzero(~unlike)
        while len(a):
            unlike[which[((self.eight[a] ^ eight[b]) & FIRST[np.minimum(left, 8)]) != 0]] = True
            on = left > 8
            a, b, left, which = a[on] + 8, b[on] + 8, left[on] - 8, which[on]
        out[at[unlike]] = -2
        return out

    def of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these entries one after another, and their numbers."""
        sizes = self.id_size[entry].astype(np.int64)
        return gathered(self.ids, self.id_start[entry].astype(np.int64), sizes), sizes

    def room(self, size: np.ndarray, id_size: np.ndarray) -> int:
        """How many of these fragments, from the first, can be added."""
        fit = (self.n_letters + np.cumsum(size) <= LETTERS * self.most) & (self.n_ids + np.cumsum(id_size) <= IDS * self.most)
        return int(fit[: self.most - self.n].sum())

    def add(self, hashes: np.ndarray, letters: np.ndarray, size: np.ndarray, ids: np.ndarray, id_size: np.ndarray) -> None:
        """Fragments whose hashes are not there yet, for which there is room."""
        entry = np.arange(self.n, self.n + len(hashes))
        self.hashes[entry], self.size[entry], self.id_size[entry] = hashes, size, id_size
        self.start[entry] = self.n_letters + np.cumsum(size) - size
        self.id_start[entry] = self.n_ids + np.cumsum(id_size) - id_size
        self.letters[self.n_letters : self.n_letters + len(letters)] = letters
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_letters, self.n_ids = self.n + len(hashes), self.n_letters + len(letters), self.n_ids + len(ids)
        slot = (hashes >> self.shift).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            on = self.slots[slot] != entry
            entry, slot = entry[on], slot[on] + 1


class FragmentEncoder:
    """Encodes blocks of texts; remembers the ids of short fragments, ``keep_bytes`` of memory at most.

    A block's equal fragments are found by hash and then compared by their bytes, and so are the remembered ones,
    all of a block at once."""

    def __init__(self, tokenizer_json: str, keep_bytes: int = 64 << 20, short: int = 48, block_bytes: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this core to the task
        from tokenizers import Tokenizer

        self.vocabulary, self.short, self.block_bytes = Vocabulary(tokenizer_json), short, block_bytes
        self.merger = Tokenizer.from_str(tokenizer_json)
        self.merger.no_padding()
        self.merger.no_truncation()
        self.most = max(1, keep_bytes // 2 // ENTRY_BYTES)
        self.known, self.older = Remembered(self.most, short), Remembered(1, short)

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for block in by_bytes(texts, self.block_bytes):
            yield from self._block(block)

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = b"".join(texts)
        row = np.frombuffer(data, np.uint8)
        pairs = row[:-1].astype(np.int32)
        pairs <<= 8
        pairs |= row[1:]
        is_cut = np.ones(len(data) + 1, bool)
        is_cut[1:-1] = self.vocabulary.cut.take(pairs)
        bounds = np.cumsum([0, *map(len, texts)])
        is_cut[bounds] = True
        for special in self.vocabulary.special:
            at = data.find(special)
            while at >= 0:
                end = at + len(special)
                # not across two texts
                if np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, end, "left"):
                    is_cut[at:end] = False
                    is_cut[[at, end]] = True
                at = data.find(special, end)
        cuts = np.flatnonzero(is_cut)
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        first = 0
        while first < len(cuts) - 1:
            # a part ends at a cut, and is longer than a block and a quarter only if it is one fragment
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + self.block_bytes * 5 // 4, "right")) - 1)
            part = self._part(data, cuts[first:last], np.diff(cuts[first : last + 1]))
            ids.append(part[0])
            sizes.append(part[1])
            first = last
        ids, ends = np.concatenate(ids), np.cumsum(np.concatenate([[0], *sizes]))
        of_text = ends[np.searchsorted(cuts, bounds)]
        for a, b in zip(of_text, of_text[1:], strict=False):
            yield ids[a:b]

    def _part(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each fragment."""
        hashes, kind, place = np.unique(hashed(data, start, size), return_index=True, return_inverse=True)
        if not same(data, start, start[kind][place], size, size[kind][place]):  # equal hashes of unlike fragments
            return self._merged(data, start, size)
        ids, starts, sizes = self._looked_up(data, hashes, start[kind], size[kind])
        return gathered(ids, starts[place], sizes[place]), sizes[place]

    def _looked_up(self, data: bytes, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different fragments, where each fragment's begin, and their number."""
        eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
        entry = self.known.found(hashes, eight, start, size)
        held, unheld = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        earlier = self.older.found(hashes[unheld], eight, start[unheld], size[unheld])
        again, unseen = unheld[earlier >= 0], unheld[earlier < 0]
        parts = [self.known.of(entry[held]), self.older.of(earlier[earlier >= 0]), self._merged(data, start[unseen], size[unseen])]
        order = np.concatenate([held, again, unseen])
        ids, found = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], sizes[order] = np.cumsum(found) - found, found
        kept = np.concatenate([again, unseen])
        self._keep(data, hashes, start, size, ids, starts, sizes, kept[(entry[kept] == -1) & (size[kept] <= self.short)])
        return ids, starts, sizes

    def _merged(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments by the merging encoder, and their numbers."""
        fragments = [data[a : a + n].decode() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        ids, sizes = array("I"), []
        for found in self.merger.encode_batch_fast(fragments, add_special_tokens=False):
            own = found.ids
            ids.extend(own)
            sizes.append(len(own))
        return np.array(ids, "<u4"), np.array(sizes, np.int64)

    def _keep(self, data: bytes, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> None:
        if self.known.room(size[kept], sizes[kept]) < len(kept):  # the younger half stays
            self.older, self.known = self.known, Remembered(self.most, self.short)
            kept = kept[: self.known.room(size[kept], sizes[kept])]
        letters = gathered(np.frombuffer(data, np.uint8), start[kept], size[kept])
        self.known.add(hashes[kept], letters, size[kept], gathered(ids, starts[kept], sizes[kept]), sizes[kept])


def encoder_of(file: Broadcast) -> FragmentEncoder:
    """A worker's encoder, kept with the broadcast file from task to task."""
    if not hasattr(file, "encoder"):
        file.encoder = FragmentEncoder(file.value)
        release()  # what reading the vocabulary took
    return file.encoder


_shipped: dict[tuple[str, str], Broadcast] = {}


def shipped(df: DataFrame, tokenizer_path: str) -> Broadcast:
    """The vocabulary file for the workers, a fixed file of a few MB, whatever the input's size.

    All queries of an application share it, and so a worker's encoder."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    context = df.sparkSession.sparkContext
    key = context.applicationId, hashlib.sha256(spec.encode()).hexdigest()
    if key not in _shipped:
        _shipped[key] = context.broadcast(spec)
    return _shipped[key]


def texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


def id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype("i4"), pa.array(np.concatenate(rows).view("i4")))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, most_ids: int = 500_000) -> DataFrame:
    """(id, token_ids array<int>) of every whole text, and with ``decoded`` the text that the ids decode to, by the same worker.

    About ``most_ids`` ids are held at once, or one text's."""
    file = shipped(docs, tokenizer_path)
    names = [id_col, "token_ids", "decoded"][: 2 + decoded]

    def run(batches):
        encoder = encoder_of(file)

        def out(part, rows):
            back = [pa.array([encoder.vocabulary.text(ids).decode("utf-8", "replace") for ids in rows], pa.string())] * decoded
            return pa.RecordBatch.from_arrays([part.column(0), id_lists(rows), *back], names)

        for batch in batches:
            at, rows, size = 0, [], 0
            for ids in encoder.encode(texts(batch)):
                rows.append(ids)
                size += len(ids)
                if size >= most_ids:
                    yield out(batch.slice(at, len(rows)), rows)
                    at, rows, size = at + len(rows), [], 0
            if rows:
                yield out(batch.slice(at, len(rows)), rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, token_ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", keep_ids: bool = True, rows_at_once: int = 200) -> DataFrame:
    """Adds ``decoded``: the text of each id list; bytes that are no UTF-8 become U+FFFD. Null lists give ''."""
    file = shipped(tokens, tokenizer_path)
    names = [id_col, *["token_ids"] * keep_ids, "decoded"]

    def run(batches):
        vocabulary = encoder_of(file).vocabulary
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(lo, rows_at_once)
                out = [vocabulary.text(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns[: 1 + keep_ids], pa.array(out, pa.string())], names)

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "token_ids").mapInArrow(tidy(run), f"`{id_col}` {kind}, " + "token_ids array<int>, " * keep_ids + "decoded string")
