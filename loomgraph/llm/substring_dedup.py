"""Exact removal of repeated word windows, with a count-min prefilter.

A window is `window` consecutive words (runs of bytes other than space and 0x09-0x0D) of one document, known by two
64-bit hashes of its words' 64-bit hashes: sequences of equal words always agree, and others differ but for a chance of
about 2^-64 for each pair of words. Each word that a repeated window covers is removed, in every copy.

1. Documents are dealt into buckets by a hash of the row: its id, its text and its place in the table, so that repeated
   rows (a third of all, say, of a null id) are spread too. The table should be a stored one, which gives the same places
   whenever a lost task is done again. A bucket makes a partial count-min sketch of its windows: `depth` rows of cells
   dealt over shards by the window's hash, sent sparsely (cells met, and which of them were met twice or more).
2. A shard adds the buckets' partial sketches up and answers each bucket: one bit for each cell sent, set where the
   merged count reaches two. Counts are only ever overestimated, so no repeated window is lost.
3. The bucket keeps windows whose least count reaches two and sends their 128-bit hashes, each once, to be grouped
   exactly; one bit for each comes back, set where the window was met twice or more.
4. The bucket removes the words covered by such windows.

What moves: the texts once (the exchange is used again by every step), about two bytes for each window and row of the
sketch, 16 bytes for each window estimated to be repeated, and bits. Nothing is collected or broadcast; a hot window
reaches its shard once from each bucket. The number of buckets and of shards follows the size of the input.

Cases: null and empty texts and those of fewer than `window` words lose nothing. Repeated rows are separate documents,
so their windows repeat. Null ids are kept as they are. Other columns do not pass, but for those named in `passed`.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 96
SHARD_WORDS = 6_000_000
LEAST_SHARDS = 48
ROW_BITS = 24  # cells of one row of the sketch in one shard
U = np.uint64


def _packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cells as gaps in two planes of bytes, and a bit for each; compressed."""
    gaps = np.diff(cells, prepend=np.int64(0)).astype("<u4")
    planes = gaps.view(np.uint8).reshape(-1, 4)
    body = np.concatenate([planes[:, i] for i in range(4)] + [np.packbits(twice)])
    return len(cells).to_bytes(4, "little") + len(body).to_bytes(4, "little") + pa.compress(body.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    body = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(body[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps.astype(np.int64)), np.unpackbits(body[4 * n :], count=n).astype(bool)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _flags(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=4), count=int.from_bytes(blob[:4], "little")).astype(bool)


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of the hash; the rows of the sketch take other mixtures of all its bits."""
    return ((h1 >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class _Windows:
    """The 128-bit hashes of all windows of a table of texts, in order, with the spans to remove words by."""

    def __init__(self, texts: pa.Table, column: str, k: int):
        h1, h2 = [np.empty(0, U)], [np.empty(0, U)]
        for part in w.slices(texts, column):
            data, offs = w.flat(part[column])
            starts, ends, first = w.spans(w.is_space_free(data), offs)
            at, _ = w.window_texts(first, k)
            if len(at):
                words = w.hashes(data, starts, ends)
                h1.append(w.mix(w.windows(words, k)[at]))
                h2.append(w.mix(w.windows(w.mix(words, 7), k, base=0xAF251AF3B0F025B5)[at], 3))
        self.h1, self.h2 = np.concatenate(h1), np.concatenate(h2)

    def cells(self, shards: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the sketch, each window's cell; shards follow one another."""
        shard = _shard_of(self.h1, shards)
        for row in range(depth):
            yield row, (shard << ROW_BITS) | (w.mix(self.h1 ^ self.h2, 11 + row) >> U(64 - ROW_BITS)).astype(np.int64)


def _unique_twice(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each was there twice or more."""
    values = np.sort(values)
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))) > 1


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _pairs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 128-bit hashes, and whether each was there twice or more."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.empty(0, bool)
    at = np.flatnonzero(new)
    out = np.empty(len(at), _PAIR)
    out["a"], out["b"] = h1[at], h2[at]
    return out, np.diff(np.append(at, len(h1))) > 1


def _one_bucket(key: tuple) -> int:
    return key[0].as_py()


def _reply(table: pa.Table, kind: int) -> dict[tuple[int, int], np.ndarray]:
    """The flags that came back to a bucket, by shard and row."""
    return {(s, r): _flags(f) for s, r, k, f in zip(*(table[c].to_pylist() for c in ("shard", "row", "kind", "flags")), strict=True) if k == kind}


def _estimated(win: _Windows, replies: pa.Table, shards: int, depth: int) -> np.ndarray:
    """Whether the least count of each window's cells reaches two."""
    found, flags = np.ones(len(win.h1), bool), _reply(replies, 0)
    for row, cells in win.cells(shards, depth):
        sent, _ = _unique_twice(cells)
        counts = np.concatenate([np.empty(0, bool)] + [flags[s, row] for s in sorted(set((sent >> ROW_BITS).tolist()))])
        found &= counts[np.searchsorted(sent, cells)]
    return found


def _exact(win: _Windows, chosen: np.ndarray, replies: pa.Table, shards: int) -> np.ndarray:
    """Whether each window is repeated, among those chosen by the sketch."""
    flags, at = _reply(replies, 1), np.flatnonzero(chosen)
    pairs, _ = _pairs(win.h1[at], win.h2[at])
    known = np.concatenate([np.empty(0, bool)] + [flags[s, 0] for s in sorted(set(_shard_of(pairs["a"], shards).tolist()))])
    repeated = pairs[known]
    place = np.searchsorted(repeated["a"], win.h1[at])
    hit = np.zeros(len(at), bool)
    todo = np.flatnonzero(place < len(repeated))
    while len(todo):  # hashes that agree in 64 bits alone stand next to one another
        p = place[todo]
        same = repeated["a"][p] == win.h1[at][todo]
        equal = same & (repeated["b"][p] == win.h2[at][todo])
        hit[todo[equal]] = True
        todo = todo[same & ~equal]
        place[todo] += 1
        todo = todo[place[todo] < len(repeated)]
    out = np.zeros(len(win.h1), bool)
    out[at] = hit
    return out


def remove_repeats(docs: DataFrame, window: int = 35, depth: int = 2, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """id_col, passed columns, n_words, n_removed and kept_text (kept words joined by one space) of every row."""
    kept = [id_col, *passed]
    size = docs.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")), F.lit(0)).alias("b")).first()
    buckets = max(min(LEAST_BUCKETS, size["n"]), size["b"] // BUCKET_BYTES, 1)
    shards = max(LEAST_SHARDS, size["b"] // 6 // SHARD_WORDS)
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = docs.select(*kept, F.col(text_col).cast("string").alias("_text"), key.alias("_bucket")).groupBy("_bucket")

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        win, out = _Windows(table, "_text", window), []
        for row, cells in win.cells(shards, depth):
            sent, twice = _unique_twice(cells)
            cut = np.searchsorted(sent, np.arange(shards + 1) << ROW_BITS)
            out += [(s, _one_bucket(key), row, _packed(sent[a:b] - (s << ROW_BITS), twice[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return _rows(out)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        rows = np.array(table["row"].to_pylist())
        for row in range(depth):
            parts = table.take(pa.array(np.flatnonzero(rows == row)))
            count = np.zeros(1 << ROW_BITS, np.uint8)
            for blob in parts["payload"]:
                cells, twice = _unpacked(blob.as_py())
                count[cells] = np.minimum(count[cells] + 1 + twice, 2)
            for bucket, blob in zip(parts["_bucket"].to_pylist(), parts["payload"], strict=True):
                out.append((bucket, key[0].as_py(), row, 0, _bits(count[_unpacked(blob.as_py())[0]] > 1)))
        return _answers(out)

    def candidates(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        win = _Windows(table, "_text", window)
        chosen = _estimated(win, replies, shards, depth)
        pairs, twice = _pairs(win.h1[chosen], win.h2[chosen])
        shard = _shard_of(pairs["a"], shards)
        cut, number = np.searchsorted(shard, np.arange(shards + 1)), key[0].as_py()
        return _rows([(s, number, 0, (b - a).item().to_bytes(4, "little") + pairs[a:b].tobytes() + np.packbits(twice[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b])

    def group(key: tuple, table: pa.Table) -> pa.Table:
        sent, twice = [np.empty(0, _PAIR)], [np.empty(0, bool)]
        for blob in table["payload"].to_pylist():
            n = int.from_bytes(blob[:4], "little")
            sent.append(np.frombuffer(blob, _PAIR, count=n, offset=4))
            twice.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + 16 * n), count=n).astype(bool))
        every, size = np.concatenate(sent), np.array([len(x) for x in sent[1:]])
        order = np.lexsort((every["b"], every["a"]))
        a, b = every["a"][order], every["b"][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
        label = np.cumsum(new) - 1
        count = np.bincount(label, weights=1 + np.concatenate(twice)[order], minlength=1)
        flags = np.empty(len(every), bool)
        flags[order] = count[label] > 1
        cut = np.concatenate(([0], np.cumsum(size)))
        return _answers([(bucket, key[0].as_py(), 0, 1, _bits(flags[i:j])) for bucket, i, j in zip(table["_bucket"].to_pylist(), cut[:-1], cut[1:], strict=True)])

    def removed(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        win = _Windows(table, "_text", window)
        repeated = _exact(win, _estimated(win, replies, shards, depth), replies, shards)
        out, at = [], 0
        for part in w.slices(table, "_text"):
            data, offs = w.flat(part["_text"])
            starts, ends, first = w.spans(w.is_space_free(data), offs)
            place, n = w.window_texts(first, window)
            hit = place[repeated[at : at + len(place)]]
            at += len(place)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            texts = _kept_texts(data, starts, ends, first, ~gone)
            lost = np.concatenate(([0], np.cumsum(gone)))
            columns = [part[c] for c in kept] + [pa.array(np.diff(first), pa.int64()), pa.array(lost[first[1:]] - lost[first[:-1]], pa.int64()), texts]
            out.append(pa.Table.from_arrays(columns, names=[*kept, "n_words", "n_removed", "kept_text"]))
        return pa.concat_tables(out) if out else _empty(table, kept)

    sent = dealt.applyInArrow(sketch, "shard int, _bucket int, row int, payload binary")
    counted = sent.groupBy("shard").applyInArrow(merge, "_bucket int, shard int, row int, kind int, flags binary")
    rare = dealt.cogroup(counted.groupBy("_bucket")).applyInArrow(candidates, "shard int, _bucket int, row int, payload binary")
    grouped = rare.groupBy("shard").applyInArrow(group, "_bucket int, shard int, row int, kind int, flags binary")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.cogroup(counted.unionAll(grouped).groupBy("_bucket")).applyInArrow(removed, f"{schema}, n_words long, n_removed long, kept_text string")


def _rows(rows: list[tuple]) -> pa.Table:
    shard, bucket, row, payload = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"shard": pa.array(shard, pa.int32()), "_bucket": pa.array(bucket, pa.int32()), "row": pa.array(row, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _answers(rows: list[tuple]) -> pa.Table:
    bucket, shard, row, kind, flags = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table({"_bucket": pa.array(bucket, pa.int32()), "shard": pa.array(shard, pa.int32()), "row": pa.array(row, pa.int32()), "kind": pa.array(kind, pa.int32()), "flags": pa.array(flags, pa.binary())})


def _empty(table: pa.Table, kept: list[str]) -> pa.Table:
    none = table.select(kept).slice(0, 0)
    for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())):
        none = none.append_column(name, pa.array([], kind))
    return none


def _kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    s, e = starts[kept], ends[kept]
    count = np.concatenate(([0], np.cumsum(kept)))[first]  # kept words before each text
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, s, 1)
    np.add.at(step, e, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    final = np.zeros(len(s), bool)
    final[(count[1:] - 1)[np.diff(count) > 0]] = True
    gap = e[~final]  # a white-space byte follows every word but a text's last
    data = data.copy()
    data[gap] = 32
    inside[gap] = True
    size = e - s + ~final
    offs = np.concatenate(([0], np.cumsum(size)))[count]
    return pa.LargeStringArray.from_buffers(len(count) - 1, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())).cast(pa.string())


def op6_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
