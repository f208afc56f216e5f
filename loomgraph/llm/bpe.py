"""BPE encoding and decoding with contiguous rank arrays.

A word's parts stand in a row of part ids (boundaries) with the ranks of adjacent parts beside them. The minimum rank
is found by a scan, its right boundary is deleted and the ranks of its neighbours are looked up anew, until no pair
has a rank. New words of a batch are worked on together: words of one length share a matrix, one row each. Longer words keep the same two arrays on their own. The distinct words met by a task are cached, at most CACHE.
Texts are encoded in slices of some PART bytes and matrices have at most ROWS rows, which bounds a task's memory.

Cases: null and empty texts give no ids and an empty text. Repeated rows, null ids and other columns change nothing:
each row is encoded alone; extra columns do not pass. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

NO_RANK = np.iinfo(np.int32).max
WIDTHS = (4, 8, 12, 16, 24, 48)  # of the shared matrices
ROWS = 1 << 13
PART = 1 << 19
CACHE = 100_000
# Letters and digits of Unicode 16, which the tokenizer knows and unicodedata (15.1) does not yet.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to str.split alone


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in kept)
    spare = {b: chr(256 + i) for i, b in enumerate(other)}
    return [spare.get(b, chr(b)) for b in range(256)]


def later_letters() -> str:
    """Letters and digits of the installed regex that the tokenizer's Unicode version does not have."""
    new = {c for r in f"{NEW_LETTERS} {NEW_DIGITS}".split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)}
    out = []
    for low in range(0, sys.maxunicode + 1, 1 << 12):  # in blocks, for all characters at once take some 60 MB
        every = "".join(chr(c) for c in range(low, low + (1 << 12)) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and c not in new)
        out += regex.findall(r"[\p{L}\p{N}]", every)
    return "".join(out)


class PairTable:
    """Ranks and merged ids of pairs of ids: an open-addressed table that answers whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32), np.zeros(size, np.int32)
        for key, rank, new in zip(pairs.tolist(), ranks.tolist(), merged.tolist(), strict=True):
            at = self._slot(key)
            while self.keys[at] not in (-1, key):
                at = (at + 1) % size
            if self.keys[at] == -1:
                self.keys[at], self.rank[at], self.merged[at] = key, rank, new

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; slot -1 stands for a pair without a rank."""
        key = (left.astype(np.int64) << 32) | right
        with np.errstate(over="ignore"):
            at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        seen = self.keys.take(at)
        out = np.where((seen == key) & (key >= 0), at, -1)
        todo = np.flatnonzero((seen != key) & (seen != -1) & (key >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys.take(at[todo])
            hit = seen == key[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (seen != -1)]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NO_RANK)


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.pairs = PairTable((left << 32) | right, np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.find_known = regex.compile(pattern).findall
        later = later_letters()
        self.later = frozenset(later)
        known = {kind: f"(?:(?![{later}])\\p{{{kind}}})" for kind in "LN"}
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{later}]|[^\s\p{{L}}\p{{N}}])").replace(r"[\p{L}]", known["L"]).replace(r"[\p{N}]", known["N"])
        self.find_exact = regex.compile(exact).findall if later else self.find_known
        self.find_chunks = regex.compile(r"\S+").findall
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cache: dict[str, bytes] = {}

    def find_words(self, text: str) -> list[str]:
        return self.find_exact(text) if not text.isascii() and not self.later.isdisjoint(text) else self.find_known(text)

    def merge_matrix(self, parts: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Rows of size part ids, filled up with -1, merged; ids as little-endian unsigned 32-bit integers."""
        n, width = parts.shape
        out: list[bytes] = [b""] * n
        rows, column = np.arange(n), np.arange(width)
        ranks = np.full((n, width), NO_RANK, np.int32)
        ranks[:, :-1] = self.pairs.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            best = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), best] != NO_RANK
            if not live.all():
                for r, p, k in zip(rows[~live].tolist(), parts[~live].astype("<u4"), size[~live].tolist(), strict=True):
                    out[r] = p[:k].tobytes()
                rows, parts, ranks, size, best = rows[live], parts[live], ranks[live], size[live], best[live]
            if not len(rows):
                return out
            i = np.arange(len(rows))
            slot = self.pairs.find(parts[i, best], parts[i, best + 1])
            gone = column[:-1] > best[:, None]  # from the deleted boundary on, everything moves left by one
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=gone)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=gone)
            parts[i, best] = self.pairs.merged[slot]
            size = size - 1
            parts[i, size], ranks[i, size - 1] = -1, NO_RANK
            ranks[i, best] = self.pairs.ranks(parts[i, best], parts[i, best + 1])
            before = np.maximum(best - 1, 0)
            ranks[i, before] = np.where(best > 0, self.pairs.ranks(parts[i, before], parts[i, best]), ranks[i, before])

    def merge_long(self, parts: np.ndarray) -> bytes:
        """One word of many parts: the same arrays, with a heap in place of the scan so that the time stays near linear."""
        import heapq

        ids, after = parts.tolist(), list(range(1, len(parts))) + [-1]
        before, alive = list(range(-1, len(parts) - 1)), [True] * len(parts)
        slots = self.pairs.find(parts[:-1], parts[1:])
        heap = [(int(self.pairs.rank[s]), i, ids[i], ids[i + 1]) for i, s in enumerate(slots.tolist()) if s >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if i < 0 or j < 0:
                return
            if (pair := (ids[i], ids[j])) not in known:
                known[pair] = int(self.pairs.find(np.array([ids[i]]), np.array([ids[j]]))[0])
            if known[pair] >= 0:
                heapq.heappush(heap, (int(self.pairs.rank[known[pair]]), i, *pair))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.pairs.merged[self.pairs.find(np.array([a]), np.array([b]))[0]])
            alive[j], after[i] = False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, y in zip(ids, alive, strict=True) if y], "<u4").tobytes()

    def merged(self, found: list[str]) -> dict[str, bytes]:
        """The ids of distinct words; words of like length share a matrix."""
        data = [w.encode() for w in found]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out: dict[str, bytes] = {}
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((size > low) & (size <= width))
            for at in range(0, len(chosen), ROWS):
                rows = chosen[at : at + ROWS]
                n = size[rows]
                flat = np.frombuffer(b"".join([data[r] for r in rows]), np.uint8)
                parts = np.full((len(rows), width + 1), -1, np.int32)
                parts[np.arange(width + 1) < n[:, None]] = self.first[flat]
                parts[np.arange(len(rows)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
                out.update(zip([found[r] for r in rows], self.merge_matrix(parts, n), strict=True))
            low = width
        for r in np.flatnonzero(size > low):
            parts = np.frombuffer(data[r], np.uint8)
            out[found[r]] = self.merge_long(np.append(self.first[parts[:-1]], self.last[parts[-1:]]))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes stretches without white space that are new."""
        split = {c: self.find_words(c) for c in chunks}
        ids = self.merged(list(set().union(*split.values())))
        self.cache.update((c, ids[w[0]] if len(w) == 1 else b"".join(map(ids.__getitem__, w))) for c, w in split.items())

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Stretches between white space. No word crosses white space, so each stretch is encoded alone."""
        text = self.normalised(text)
        return self.find_chunks(text) if SEPARATORS.search(text) else text.split()

    def pieces(self, text: str) -> list[tuple[bytes, list[str]]]:
        """Stretches, after the id of the special token before them, which is found in the raw text."""
        parts = self.find_special.split(text)
        return [(self.special[parts[i - 1]].to_bytes(4, "little") if i else b"", self.chunks(parts[i])) for i in range(0, len(parts), 2)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(self.pieces(t) if "<|" in t else [(b"", self.chunks(t))]) if t else [] for t in texts]
        met = {c for pieces in split for _, chunks in pieces for c in chunks}
        if len(self.cache) + len(met) > CACHE:
            self.cache.clear()
        self.learn({c for c in met if c not in self.cache})
        get = self.cache.__getitem__
        return [b"".join([x for special, chunks in pieces for x in (special, *map(get, chunks))]) for pieces in split]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """id_col, passed columns, n_tokens, ids (packed little-endian unsigned 32-bit integers) and decoded of every row.

    tokenizer: a tokenizers JSON file of a byte-level BPE with word ends, at the same place on each machine."""
    path = tokenizer or default_tokenizer()
    kept = [id_col, *passed]
    chosen = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            for part in slices(batch, "_text", PART):
                ids = bpe.encode(part["_text"].to_pylist())
                columns = [part[c] for c in kept] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.large_binary()), pa.array([bpe.decode(x) for x in ids], pa.large_string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(run, f"{schema}, n_tokens long, ids binary, decoded string")


def op4_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    out = encode_decode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
