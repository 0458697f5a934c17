"""Benchmark decontamination by q-gram lemma filtering.

An item of n characters that occurs in a text with at most k edits leaves at least
n + 1 - Q - k * Q of its q-grams in place, on diagonals (text position minus item
position) that differ by at most k. So shared q-grams are counted in overlapping
diagonal bands, bands that reach the bound are kept, and a banded alignment verifies
them. Where so many edits may leave no q-gram of a short item in place, the item is cut
into one piece more than edits: some piece is left as it was, and each place where one
stands is verified. Item q-grams that are common within the benchmark may be left out of the
count; the bound then counts only the others, so nothing is lost.

Texts and items are compared in normal form: letters A-Z lower-cased and runs of
ASCII characters other than letters and digits as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back

Q = 8
#: Edits allowed for each character of an item.
EDIT_SHARE = 0.1
#: Bytes of benchmark text per broadcast; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that are searched at a time.
BATCH_BYTES = 256 << 10
_BITMAP_BITS = 22
_SEPARATOR = 30
#: One edit in a cell of an alignment; beginnings are less.
_EDIT = 1 << 32
#: A q-gram that occurs more often in the benchmark is left out of the count if the rest suffice.
_COMMON = (2, 8, 32)
#: The count that is asked for before common q-grams may be left out.
_ENOUGH = 8

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_WORDY = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
#: Normal form of each byte.
_NORMAL = np.where(_UPPER, _BYTES + 32, np.where(_WORDY, _BYTES, 32)).astype(np.uint8)
#: Five bits for each byte of the normal form; 0 stands apart texts and has a symbol of its own.
_SYMBOL = np.where(_BYTES == 32, 27, np.where(_BYTES >= 128, 29, np.where(_BYTES >= 97, _BYTES % 32, 28))).astype(np.uint64)
_SYMBOL[0] = _SEPARATOR


def normal_form(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of bytes (0 passes through, as the mark between texts), and where each byte came from."""
    out = _NORMAL[data]
    out[data == 0] = 0
    space = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return out[at], at


def _grams(normal: np.ndarray) -> np.ndarray:
    """Exact 40-bit codes of all runs of Q = 8 symbols."""
    if len(normal) < Q:
        return np.empty(0, np.uint64)
    s = _SYMBOL[normal]
    two = (s[:-1] << np.uint64(5)) | s[1:]
    four = (two[:-2] << np.uint64(10)) | two[2:]
    return (four[:-4] << np.uint64(20)) | four[4:]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITMAP_BITS)


def banded_distance(item: np.ndarray, text: np.ndarray, start: int, width: int) -> tuple[int, int, int]:
    """Least edits of ``item`` against a part of ``text``, and where that part begins and ends.

    Alignments begin anywhere in text[start : start + width] and stay on those diagonals.
    What lies outside ``text`` equals nothing and is no part of it.
    """
    # a cell is its edits times _EDIT plus the offset its alignment began at
    offsets = np.arange(width)
    steps = offsets * _EDIT
    padded = np.full(len(item) + width, 255, np.int16)
    lo, hi = max(start, 0), min(start + len(padded), len(text))
    if hi > lo:
        padded[lo - start : hi - start] = text[lo:hi]
    row = offsets
    for j, symbol in enumerate(item.tolist()):
        cost = row + (padded[j : j + width] != symbol) * _EDIT
        np.minimum(cost[:-1], row[1:] + _EDIT, out=cost[:-1])
        row = np.minimum.accumulate(cost - steps) + steps
    best = int((row // _EDIT).argmin())
    edits, began = divmod(int(row[best]), _EDIT)
    return edits, max(start + began, 0), min(start + best + len(item), len(text))


class PassageFinder:
    """Finds benchmark items in texts within their edit budgets."""

    def __init__(self, items: list[tuple[object, str]], edit_share: float = EDIT_SHARE):
        by_form: dict[bytes, list] = {}
        for key, text in items:
            form = normal_form(np.frombuffer((text or "").replace("\0", " ").encode(), np.uint8))[0].tobytes().strip(b" ")
            if form:
                by_form.setdefault(form, []).append(key)
        self.short = [(f, k) for f, k in by_form.items() if len(f) < Q]
        long = [(f, k) for f, k in by_form.items() if len(f) >= Q]
        self.keys = [k for _, k in long]
        self.forms = [np.frombuffer(f, np.uint8) for f, _ in long]
        sizes = np.array([len(f) for f in self.forms], np.int64)
        self.budget = (edit_share * sizes).astype(np.int64)
        # short items that the q-grams can't vouch for: their pieces, with their places
        self.brief = {int(i): self._pieces(self.forms[i].tobytes(), int(self.budget[i])) for i in np.flatnonzero(self.budget > (sizes - Q) // Q)}
        codes = [_grams(f) for f in self.forms]
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) if codes else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        _, back, times = np.unique(every, return_inverse=True, return_counts=True)
        times = times[back] if len(every) else times
        bound = sizes - Q + 1 - self.budget * Q
        open_ = np.ones(len(codes), bool)
        open_[list(self.brief)] = False
        counted = open_[item]
        for most in _COMMON:
            rare = np.bincount(item[times <= most], minlength=len(codes)) - self.budget * Q
            chosen = open_ & (rare >= _ENOUGH)
            counted[chosen[item] & (times > most)] = False
            bound[chosen] = rare[chosen]
            open_ &= ~chosen
        self.bound = bound
        order = np.argsort(every[counted], kind="stable")
        self.codes, first = np.unique(every[counted][order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.place = item[counted][order], place[counted][order]
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[_slot(self.codes)] = True

    @staticmethod
    def _pieces(form: bytes, edits: int) -> list[tuple[int, bytes]]:
        cuts = [len(form) * j // (edits + 1) for j in range(edits + 2)]
        return [(a, form[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _brief_candidates(self, normal: np.ndarray) -> tuple[list[int], list[int]]:
        """Short items and the diagonals on which one of their pieces stands."""
        flat, items, diagonals = normal.tobytes() if self.brief else b"", [], []
        for i, pieces in self.brief.items():
            near: set[int] = set()
            for place, piece in pieces:
                at = flat.find(piece)
                while at >= 0:
                    near.add(at - place)
                    at = flat.find(piece, at + 1)
            items += [i] * len(near)
            diagonals += sorted(near)
        return items, diagonals

    def _candidates(self, normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the first diagonals of the bands that reach their bounds, from windows in one of which any passage lies."""
        reach = max((len(f) for f in self.forms), default=0) + int(self.budget.max(initial=0))
        items, diagonals = [], []
        for at in range(0, max(1, len(normal)), BATCH_BYTES):
            i, d = self._in_window(normal[at : at + BATCH_BYTES + reach])
            items.append(i)
            diagonals.append(d + at)
        i, d = self._brief_candidates(normal)
        items.append(np.array(i, np.int64))
        diagonals.append(np.array(d, np.int64))
        return np.concatenate(items), np.concatenate(diagonals)

    def _in_window(self, normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = _grams(normal)
        at = np.flatnonzero(self.bitmap[_slot(codes)])
        if not len(at) or not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        gram = np.searchsorted(self.codes, codes[at])
        gram[gram == len(self.codes)] = 0
        real = self.codes[gram] == codes[at]
        at, gram = at[real], gram[real]
        times = self.first[gram + 1] - self.first[gram]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[gram], times) + nth
        item = self.item[entry]
        # half a band is k + 1 diagonals wide, so that k diagonals in a row always lie within two halves
        longest = max((len(f) for f in self.forms), default=0)
        half = (np.repeat(at, times) - self.place[entry] + longest) // (self.budget[item] + 1)
        keys, hits = np.unique(item << np.int64(40) | half, return_counts=True)
        after = np.zeros(len(keys), np.int64)
        after[:-1] = np.where(keys[1:] == keys[:-1] + 1, hits[1:], 0)
        before = np.zeros(len(keys), np.int64)
        before[1:] = np.where(keys[1:] == keys[:-1] + 1, hits[:-1], 0)
        own = keys >> np.int64(40)
        good = (hits + after >= self.bound[own]) | ((before == 0) & (hits >= self.bound[own]))
        return own[good], (keys[good] & ((1 << 40) - 1)) * (self.budget[own[good]] + 1) - longest

    @staticmethod
    def _verified(form: np.ndarray, text: np.ndarray, start: int, width: int) -> tuple[int, int, int]:
        whole = text[max(start, 0) : start + width + len(form) - 1].tobytes().find(form.tobytes())
        return (0, max(start, 0) + whole, max(start, 0) + whole + len(form)) if whole >= 0 else banded_distance(form, text, start, width)

    def find(self, data: np.ndarray) -> list[tuple[object, int, int, int]]:
        """(item key, start, stop, edits) in bytes that may hold several texts with 0 between them; no passage leaves its text."""
        normal, origin = normal_form(data)
        marks = np.flatnonzero(normal == 0)
        begins, ends = np.append(0, marks + 1).tolist(), np.append(marks, len(normal)).tolist()
        items, diagonals = self._candidates(normal)
        nearest = np.searchsorted(ends, diagonals - self.budget[items], side="right")
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i, diagonal, t in zip(*(x.tolist() for x in (items, diagonals, nearest)), strict=True):
            form, k = self.forms[i], int(self.budget[i])
            first, width = diagonal - k, 4 * k + 3
            last = first + width + len(form) - 1
            while t < len(ends) and begins[t] < last:
                begin, end = begins[t], ends[t]
                t += 1
                if min(end, last) - max(begin, first) < len(form) - k:
                    continue
                edits, start, stop = self._verified(form, normal[begin:end], first - begin, width)
                if edits <= k:
                    here = (edits, begin + start)
                    found[i, begin + stop] = min(found.get((i, begin + stop), here), here)
        out = []
        for (i, end), (edits, start) in found.items():
            out += [(key, int(origin[start]), int(origin[end - 1]) + 1, edits) for key in self.keys[i]]
        if self.short:
            flat = b" " + normal.tobytes().replace(b"\0", b" \0 ") + b" "
            marks = np.frombuffer(flat, np.uint8)
            # positions in flat, back to positions in normal: each mark has added two spaces
            shift = 1 + 2 * np.cumsum(marks == 0) - (marks == 0)
            for form, keys in self.short:
                at = flat.find(b" " + form + b" ")
                while at >= 0:
                    start = at + 1 - int(shift[at])
                    out += [(key, int(origin[start]), int(origin[start + len(form) - 1]) + 1, 0) for key in keys]
                    at = flat.find(b" " + form + b" ", at + 1)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block: list[tuple[object, str]] = []
    size = 0
    for key, text in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((key, text))
        size += len(text.encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searched_texts(finder: PassageFinder, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, int]]:
    """(number of the text, item key, start, stop, edits) of each text's best passage of each item; as many texts at a time as BATCH_BYTES hold."""
    forms = ((t or "").replace("\0", " ").encode() for t in texts)
    at = 0
    for held in _by_bytes(forms):
        starts = np.cumsum([0, *(len(t) + 1 for t in held)])
        best: dict[tuple[int, object], tuple[int, int, int]] = {}
        for key, start, stop, edits in finder.find(np.frombuffer(b"\0".join(held), np.uint8)):
            d = int(np.searchsorted(starts, stop - 1, side="right")) - 1
            here = (edits, start - int(starts[d]), stop - int(starts[d]))
            best[d, key] = min(best.get((d, key), here), here)
        yield from ((at + d, key, start, stop, edits) for (d, key), (edits, start, stop) in best.items())
        at += len(held)


def _by_bytes(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """Rows id, item_id, start, stop, edits: one per item and document, its best passage.

    An item of n characters in normal form may have int(edit_share * n) edits, whatever its length.
    start and stop are byte offsets in the text. Null and empty texts hold nothing, and
    null or empty items are nowhere. Items of fewer than Q characters in normal form
    match as whole words only. Of passages with equally few edits the first counts. Rows
    with equal ids are told apart by nothing else, so their passages are the same rows.
    The benchmark is broadcast in blocks of at most BLOCK_BYTES and one item; each block
    takes a pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([rows.schema["id"], T.StructField("item_id", item_type), *(T.StructField(x, T.LongType()) for x in ("start", "stop", "edits"))])
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or PassageFinder(shared.value, edit_share)
                found = list(_searched_texts(finder, batch.column(1).to_pylist()))
                if found:
                    owner, keys, *numbers = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys), *(pa.array(x, pa.int64()) for x in numbers)], schema.names)

        out = out.unionByName(rows.mapInArrow(giving_back(search), schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item within its edit budget, with all their columns.

    Each row is decided where it lies, so nothing is shuffled. Null and empty texts stay.
    """
    rows = docs.select(F.struct("*").alias("row"))
    schema, text = T.StructType(list(rows.schema)), docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or PassageFinder(shared.value, edit_share)
                stays = np.ones(batch.num_rows, bool)
                stays[[d for d, *_ in _searched_texts(finder, pc.struct_field(batch.column(0), [text]).to_pylist())]] = False
                yield batch.filter(pa.array(stays))

        rows = rows.mapInArrow(giving_back(clean), schema)
    return rows.select("row.*")
