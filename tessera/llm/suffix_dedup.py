"""Removal of passages that an earlier document has, by suffix arrays of what is left after a filter.

A byte goes if a run of ``LENGTH`` bytes that covers it also starts in a document
with a smaller id. A window is such a run; it never crosses a document's end.

1. A window's key is the least hash of its ``GRAM``-byte grams, so that equal windows
   have equal keys wherever they stand, and some 16 neighbouring windows share one. Per
   task, each key goes on once, with one document that has it; where these meet, a key
   of one document alone is refuted. Keys that several documents of a task share need no
   meeting to be known. The others are told to their documents.
2. A document's stretches of windows that share a key that is left (*segments*) move, with their
   bytes, to where their key is gathered. Equal segments are one there. The distinct
   ones lie end to end, and their suffixes are sorted in two stages: those smaller than
   their successors directly, eight bytes at a time, the rest by scans over the buckets
   of first bytes, from the least on, which put a suffix where its successor stands. Adjacent suffixes
   with LENGTH bytes in common are equal windows, and of each class the least id
   stays.
3. A key with more than ``SALT_ROWS`` documents is gathered in several parts, and so is
   one that does not fit the bytes that are sorted at a time. Of each class of windows in
   such a part, one goes on to a second meeting, by its bytes, with a combine before
   the shuffle. No group is ever held as a whole.

Documents of equal texts are one in all this: the copies with larger ids lose
everything. At any corpus size a task holds some MB.

Defined results: a null text is empty; texts of under LENGTH bytes lose nothing; a
null id counts as larger than all others; rows of equal ids remove nothing from each
other, and each is judged by its own text; repeated rows are a row each in the result; very long texts
are scanned in pieces; other columns are ignored; an empty table gives no rows. An id
stands for a text together with the text's 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, scratch, small_batches

LENGTH, GRAM = 50, 20
#: Bytes of text that are hashed at a time, and of segments that are sorted at a time.
SCAN_BYTES, SORT_BYTES = 1 << 18, 2_000_000
#: Documents of a key that are gathered together, about; keys that are known to have more, at most.
SALT_ROWS, HEAVY = 4_096, 65_536
#: Keys that a task hands on at a time, and that a task compares, about.
HANDED, COMPARED = 1_000_000, 1_000_000
#: Bytes of segments that a task gathers, about.
GATHERED = 16_000_000
_ODD = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# --- keys of windows


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _TABLES:
        found = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            found.append(np.multiply.accumulate(row))
        _TABLES[size] = (found[0], found[1])
    up, down = _TABLES[size]
    return up[:n], down[:n]


_BYTE_WORDS = np.random.default_rng(20250211).integers(1, 1 << 63, 256, dtype=np.uint64)


def window_keys(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of the bytes the least hash of its grams."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_WORDS[data] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, wanted = 1, length - gram + 1
    while 2 * width <= wanted:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (wanted - width)], h[wanted - width :]) if width < wanted else h


def segments(column: pa.Array, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For some texts at a time: key, text (its number in the column), first window and number of windows of each stretch of windows of one key; some bytes; and what to add to a first window for its place in its text.

    First windows are places in those bytes. A long text comes in pieces that overlap by length - 1.
    """
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCAN_BYTES, "right")) - 1)
        begin, end = offsets[at], offsets[stop]
        for low in range(begin, max(end - length + 1, begin + 1), SCAN_BYTES) if stop == at + 1 else (begin,):
            piece = data[low : min(end, low + SCAN_BYTES + length - 1) if stop == at + 1 else end]
            keys = window_keys(piece, length, gram)
            if not len(keys):
                continue
            starts = np.arange(at, stop)
            if stop == at + 1:
                owner = np.full(len(piece), at, np.int64)
            else:
                owner = np.repeat(starts, np.diff(offsets[at : stop + 1]))
            own = owner[: len(keys)]
            inside = own == owner[length - 1 :]
            fresh = np.empty(len(keys), bool)
            fresh[0] = True
            np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
            fresh[1:] |= (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
            first = np.flatnonzero(fresh)
            many = np.diff(np.append(first, len(keys)))
            good = inside[first]
            first, many = first[good], many[good]
            yield keys[first], own[first], first, many, piece, np.where(stop == at + 1, low - begin, begin - offsets[own[first]])
        at = stop


# --- suffix arrays


def words_at(data: np.ndarray, extra: int) -> np.ndarray:
    """At each byte, and so many places beyond the end, the eight bytes from there on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + extra + 8, np.uint64)
    padded[: len(data)] = data
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[: len(data) + extra]


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first depth bytes at least; each step orders by eight more bytes those that are not told apart."""
    out = places[np.argsort(words[places], kind="stable")]
    open_ = np.arange(len(out))
    group = np.zeros(len(out), np.int64)
    for at in range(0, depth, 8):
        key = words[out[open_] + at]
        if at:
            order = np.lexsort((key, group))
            out[open_] = out[open_][order]
            key = key[order]
        new = np.empty(len(open_), bool)
        if len(new):
            new[0] = True
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        last = np.append(new[1:], True)[: len(new)]
        group = np.cumsum(new)
        tied = ~(new & last)
        open_, group = open_[tied], group[tied]
        if not len(open_):
            break
    return out


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in the order of their first depth bytes (ties in any order), and words_at them.

    A suffix smaller than its successor is sorted directly. Any other begins with a
    byte that is not below the next one: in the scan over the buckets of first bytes
    it follows from where its successor stands, which is in an earlier bucket, or in
    the same one if the byte is repeated. Suffixes shorter than depth may stand among
    those that go on with zeros in their place.
    """
    n = len(data)
    words = words_at(data, depth + 8)
    if not n:
        return np.zeros(0, np.int64), words
    text = data.astype(np.int16)
    border = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # ends of runs of one byte
    run_end = np.repeat(border, np.diff(np.append(-1, border)))
    after = np.append(text, -1)[run_end + 1]
    small = text < after
    direct = sorted_directly(np.flatnonzero(small), words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix is larger than the empty one, which stands before all
    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [wave]
        for _ in range(depth):  # repeated bytes: suffixes with one more of them come after all with fewer
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            if not len(wave):
                break
            bucket.append(wave)
        else:  # more than depth equal bytes: such suffixes are ties
            rest = wave[wave > 0] - 1
            rest = rest[text[rest] == c]
            if len(rest):
                bucket.append(np.flatnonzero(~small & (text == c) & (run_end - np.arange(n) > depth)))
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        full = np.concatenate(bucket)
        out.append(full)
        before = full[full > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cut):
            if len(part):
                induced[int(text[part[0]])].append(part)
    return np.concatenate(out), words


def common_prefixes(words: np.ndarray, places: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """How many bytes, up to depth, the suffix at each place has in common with that at the place before (0 for the first)."""
    found = np.zeros(len(places), np.int64)
    open_ = np.arange(1, len(places))
    for at in range(0, depth, 8):
        differ = words[places[open_] + at] ^ words[places[open_ - 1] + at]
        same = differ == 0
        found[open_[same]] = at + 8
        other, bits = open_[~same], differ[~same]
        equal = np.zeros(len(other), np.int64)
        for k in range(7):
            equal += bits < np.uint64(1 << (56 - 8 * k))
        found[other] = at + equal
        open_ = open_[same]
    return np.minimum(found, depth)


def least_owners(contents: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of distinct contents, in order: the content of each, its place there, and the least owner of an equal window."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begins = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    whose = np.repeat(np.arange(len(contents)), many)
    inside = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
    window = np.full(len(data), -1, np.int64)
    window[begins[whose] + inside] = np.arange(len(whose))
    places, words = suffix_array(data, length)
    places = places[window[places] >= 0]
    first = np.flatnonzero(common_prefixes(words, places, length) < length)
    own = owners[whose]
    least = np.empty(len(whose), np.int64)
    ordered = window[places]
    least[ordered] = np.repeat(np.minimum.reduceat(own[ordered], first), np.diff(np.append(first, len(ordered)))) if len(ordered) else 0
    return whose, inside, least


# --- the steps over all documents


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handed_keys(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, ids, keys, documents: per task each key once, with one document and how many of the task's have it; and, with no ``documents``, an id with the keys that another document of the task has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["bucket", "ids", "keys", "documents"]

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            ids = np.concatenate([i for _, i in held])
            held.clear()
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
            keys, ids = keys[fresh], ids[fresh]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(first, len(keys)))
            several = np.repeat(count > 1, count)
            known_keys, known_ids = keys[several], ids[several]
            by_id = np.argsort(known_ids, kind="stable")
            known_keys, known_ids = known_keys[by_id], known_ids[by_id]
            cut = np.flatnonzero(np.append(True, known_ids[1:] != known_ids[:-1])) if len(known_ids) else np.zeros(0, np.int64)
            # in each bucket by id, which makes long runs
            one_keys, one_ids = keys[first], ids[first]
            part = (one_keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((one_ids, part))
            part, one_keys, one_ids, count = part[order], one_keys[order], one_ids[order], count[order]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends, cut_ends = np.append(begin, len(part)), np.append(cut, len(known_ids))

            def lists(values: np.ndarray, more: np.ndarray, kind: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([ends[:-1], ends[-1] + cut_ends]), pa.int32()), pa.array(np.concatenate([values, more]), kind))

            nothing = np.zeros(len(known_ids), np.int32)
            where = np.concatenate([part[begin], known_ids[cut] % buckets])
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), lists(one_ids, known_ids, pa.int64()), lists(one_keys.view(np.int64), known_keys.view(np.int64), pa.int64()), lists(count.astype(np.int32), nothing, pa.int32())], names=names)

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for keys, owner, *_ in segments(batch.column(1), length, gram):
                held.append((keys, ids[owner]))
                size += len(keys)
            if size > HANDED:
                yield flush()
                size = 0
        if size:
            yield flush()

    return texts.select("id", "text").mapInArrow(run, "bucket long, ids array<long>, keys array<long>, documents array<int>")


def shared_keys(handed: DataFrame) -> DataFrame:
    """id and key: a key of a document that another one has too; and, without id, a key and how many ``documents`` have it, where that is more than SALT_ROWS.

    A row may come several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "documents"]
        held = []
        for batch in batches:
            lists = [batch.column(k) for k in (1, 2, 3)]
            held.append(tuple(x.flatten().to_numpy(zero_copy_only=False) for x in lists))
        if not held:
            return
        ids, keys, count = (np.concatenate([h[k] for h in held]) for k in range(3))
        held.clear()
        known = count == 0
        order = np.argsort(keys[~known], kind="stable")
        k, i, c = keys[~known][order], ids[~known][order], count[~known][order].astype(np.int64)
        if len(k):
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(first, len(k)))
            total = np.add.reduceat(c, first)
            several = (np.minimum.reduceat(i, first) < np.maximum.reduceat(i, first)) | (np.maximum.reduceat(c, first) > 1)
            told = np.repeat(several, size) & (c == 1)
            ids, keys = np.concatenate([ids[known], i[told]]), np.concatenate([keys[known], k[told]])
            heavy = total > SALT_ROWS
            if heavy.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(heavy.sum()), pa.int64()), pa.array(k[first][heavy]), pa.array(total[heavy])], names=names)
        order = np.argsort(ids, kind="stable")  # equal ids one after the other take less space
        for at in range(0, len(ids), 100_000):
            part = order[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(keys[part]), pa.nulls(len(part), pa.int64())], names=names)

    return handed.mapInArrow(run, "id long, key long, documents long")


def gathered_segments(texts: DataFrame, heavy: dict[int, int], length: int, gram: int) -> DataFrame:
    """texts(id, hash, text, keys) to key, salt (-1: the key has one group), id, hash, at (first byte) and segment (bytes)."""
    heavy_keys = np.array(sorted(heavy), np.int64)
    heavy_salts = np.array([heavy[k] // SALT_ROWS + 1 for k in sorted(heavy)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            which = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((flat, which))
            flat, which = flat[order], which[order]
            for keys, owner, first, many, data, shift in segments(batch.column(2), length, gram):
                keys = keys.view(np.int64)
                # whether (owner, key) is among (which, flat): both are looked up text by text
                good = np.zeros(len(keys), bool)
                edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for a, b in zip(edge, np.append(edge[1:], len(owner))):
                    low, high = np.searchsorted(which, [owner[a], owner[a] + 1])
                    own = flat[low:high]
                    if len(own):
                        spot = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                        good[a:b] = own[spot] == keys[a:b]
                if not good.any():
                    continue
                keys, owner, first, many = keys[good], owner[good], first[good], many[good]
                place = first + shift[good]
                sizes = many + length - 1
                ends = np.cumsum(sizes)
                take = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
                salt = np.full(len(keys), -1, np.int32)
                if len(heavy_keys):
                    spot = np.minimum(np.searchsorted(heavy_keys, keys), len(heavy_keys) - 1)
                    hot = heavy_keys[spot] == keys
                    salt[hot] = (hashes[owner[hot]] & 0x7FFFFFFF) % heavy_salts[spot[hot]]
                contents = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salt), pa.array(ids[owner]), pa.array(hashes[owner]), pa.array(place.astype(np.int64)), contents], names=["key", "salt", "id", "hash", "at", "segment"])

    return texts.mapInArrow(run, "key long, salt int, id long, hash long, at long, segment binary")


def _stretches(low: np.ndarray, whose: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that begin at low, in order for each of whose, as stretches of bytes: whose, begin, end."""
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1] + 1) | (whose[1:] != whose[:-1])))
    last = np.append(first[1:], len(low)) - 1
    return whose[first], low[first], low[last] + length


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Of gathered segments, sorted by key and salt within partitions: id, hash, begin, end of what goes; and, for keys in several parts, ``window`` with one id, hash and begin for each class of equal windows."""

    def judged(table: pa.Table, partial: np.ndarray) -> Iterator[pa.RecordBatch]:
        contents = table.column("segment").combine_chunks().dictionary_encode()
        codes = contents.indices.to_numpy(zero_copy_only=False)
        ids, hashes, ats = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "hash", "at"))
        values = contents.dictionary.to_pylist()
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        owners = np.full(len(values), _NO_ID, np.int64)
        np.minimum.at(owners, codes, ids)
        whose, inside, least = least_owners(values, owners, length)
        names = ["id", "hash", "begin", "end", "window"]
        later = ids > owners[codes]
        if later.any():  # an equal segment stands in an earlier document: all of it goes
            n = int(later.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(hashes[later]), pa.array(ats[later]), pa.array(ats[later] + sizes[codes[later]]), pa.nulls(n, pa.binary())], names=names)
        # a content's own windows go by content; its rows of the least id are few
        begin = np.searchsorted(whose, np.arange(len(values) + 1))
        firsts = np.flatnonzero(~later)
        lost = np.flatnonzero(least < owners[whose])
        if len(lost):
            content, low, high = _stretches(inside[lost], whose[lost], length)
            edge = np.searchsorted(content, np.arange(len(values) + 1))
            many = (edge[1:] - edge[:-1])[codes[firsts]]
            row = np.repeat(firsts, many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + edge[codes[row]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hashes[row]), pa.array(ats[row] + low[at]), pa.array(ats[row] + high[at]), pa.nulls(len(row), pa.binary())], names=names)
        # equal windows of one part have met: those of the least id go on
        for row in firsts[partial[firsts]]:
            c = codes[row]
            own = np.arange(begin[c], begin[c + 1])
            own = own[least[own] == ids[row]]
            if len(own):
                text = values[c]
                places = inside[own]
                windows = pa.array([text[p : p + length] for p in places.tolist()], pa.binary())
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[row])), pa.array(np.full(n, hashes[row])), pa.array(ats[row] + places), pa.nulls(n, pa.int64()), windows], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        cut = None  # a key whose first rows were judged already
        for batch in batches:
            held.append(batch)
            size += batch.column(5).nbytes
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            border = int(np.searchsorted(keys == keys[-1], True))  # where the last key begins
            last = keys[-1]
            if border == 0:  # one key fills it all
                border = len(keys)
            partial = _in_parts(table, border, cut)
            if border == len(keys):
                partial |= keys == last
                cut = last
            yield from judged(table.slice(0, border), partial[:border])
            held = table.slice(border).to_batches()
            size = sum(b.column(5).nbytes for b in held) if border < len(keys) else 0
            if size >= SORT_BYTES:
                size = SORT_BYTES - 1
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from judged(table, _in_parts(table, table.num_rows, cut))

    def _in_parts(table: pa.Table, n: int, cut: int | None) -> np.ndarray:
        partial = table.column("salt").combine_chunks().to_numpy(zero_copy_only=False) >= 0
        if cut is not None:
            partial = partial | (table.column("key").combine_chunks().to_numpy(zero_copy_only=False) == cut)
        return partial

    return rows.mapInArrow(run, "id long, hash long, begin long, end long, window binary")


def removed_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row for each row of df with ``id``, ``hash`` and what is known of the text, and the spans (id, hash, spans: array of begin, end) of texts that lose some of their bytes.

    Rows with ``whole`` lose everything, by an equal text with a smaller id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = _written(texts.select("own_id", "id", "hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")), "suffix-rows")
    long_rows = rows.where(F.col("n_bytes") >= length)
    firsts = long_rows.groupBy("sha256").agg(F.min("id").alias("first"))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    joined = rows.join(firsts, "sha256", "left").withColumn("whole", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    rows = _written(joined.drop("first"), "suffix-judged")

    buckets = blocks_for(total[0] // 16, COMPARED)
    named = texts.where(F.octet_length("text") >= length).select("id", "hash", "text")
    with small_batches(df.sparkSession):
        known = _written(shared_keys(handed_keys(named, buckets, length, gram).repartition(buckets, "bucket")), "suffix-keys")
        heavy = {r["key"]: r["documents"] for r in known.where("id IS NULL").groupBy("key").agg(F.sum("documents").alias("documents")).orderBy(F.desc("documents"), "key").limit(HEAVY).collect()}
        lists = known.where("id IS NOT NULL").groupBy("id").agg(F.collect_list("key").alias("keys"))
        reps = rows.where(~F.col("whole") & (F.col("n_bytes") >= length)).select("id", "hash").distinct()
        found = gathered_segments(named.join(reps.join(lists, "id"), ["id", "hash"]).select("id", "hash", "text", "keys"), heavy, length, gram)
        parts = blocks_for(total[0] // 2, GATHERED)
        pieces = _written(compared(found.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt"), length), "suffix-spans")
    spans = pieces.where("window IS NULL").select("id", "hash", "begin", "end")
    open_ = pieces.where("window IS NOT NULL")
    least = open_.groupBy("window").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "least")
    more = open_.join(least, "window").where("id > least").select("id", "hash", "begin", (F.col("begin") + length).alias("end"))
    return rows, spans.unionByName(more).groupBy("id", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """texts(id, hash, text, spans) to id, hash, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(2).cast(pa.binary() if pa.types.is_string(batch.column(2).type) else pa.large_binary())
            removed, many, digests, kept = [], [], [], []
            spans = batch.column(3)
            low, high = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            each = np.append(0, np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False)))
            for i, content in enumerate(contents):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, low[each[i] : each[i + 1]], 1)
                np.subtract.at(edges, high[each[i] : each[i + 1]], 1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                many.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                left = data[~gone].tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "hash", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return texts.mapInArrow(run, "id long, hash long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row: the id column, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept_bytes (what stays; null where nothing goes, or all)."""
    rows, spans = removed_bytes(df, id_col, text_col, length)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where(F.octet_length("text") >= length)
    with small_batches(df.sparkSession):
        cut = _written(_cut(texts.join(spans, ["id", "hash"]).select("id", "hash", "text", "spans"), with_text), "suffix-cut").dropDuplicates(["id", "hash"])
    none = F.sha2(F.lit("").cast("binary"), 256)
    whole = F.col("whole")
    found = rows.join(cut, ["id", "hash"], "left").select(
        F.col("own_id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        "kept_bytes",
    )
    return found if with_text else found.drop("kept_bytes")
