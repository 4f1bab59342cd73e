"""Token counts by rank-synchronous merging of ragged symbol arrays.

Texts are cut into pre-tokens as the vocabulary file prescribes (special strings first, then NFC,
white space, lower case, the split pattern). Pre-tokens not met before by the worker are held as one
ragged numpy batch: a flat symbol array with row offsets. In each round every row finds its
lowest-rank adjacent pair and merges all of its non-overlapping occurrences, left to right, all rows at
once; rounds go on until no row has a mergeable pair. What survives is counted. Nothing here calls a tokenizer
library; results equal that library's, which the tests check.

Scale. No shuffle: one pass over the texts by mapInArrow, texts whole. Vocabulary tables are built
once a worker; the memo of pre-token counts holds MEMO_CHARS characters at most, none of it of long runs, and starts anew when full.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and any other columns are no matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.common import documents, slices

MEMO_CHARS, MEMO_LONGEST = 16 << 20, 64
BATCH_SYMBOLS = 1 << 20


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """(left, right) -> (rank, merged symbol) by open addressing over int64 keys, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        n = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, step, at = np.arange(len(keys)), 0, self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = todo[free]
            _, one = np.unique(at[first], return_index=True)
            put = first[one]
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[put], put, merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (n - 1)
            step += 1
        self.most = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a large number: none) and merged symbol of every pair."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        rank, merged = np.full(len(keys), 1 << 30, np.int32), np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[todo[hit]]], self.merged[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return rank, merged


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Symbols left in each row after merging; rows run through rounds together, finished ones leave."""
    none = np.int32(1 << 30)
    left = lengths.astype(np.int64).copy()
    rows, sym, lens = np.flatnonzero(left > 1), symbols.astype(np.int32), left[left > 1]
    sym = sym[np.repeat(left > 1, left)]
    if not len(rows):
        return left
    rank, merged = (np.append(x, np.int32(y)) for x, y in zip(pairs.find(sym[:-1], sym[1:]), (none, 0), strict=True))
    rank[np.cumsum(lens) - 1] = none  # a pair never crosses rows
    while True:
        low = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
        busy = low < none
        if not busy.all():
            left[rows] = lens
            on = np.repeat(busy, lens)
            sym, rank, merged = sym[on], rank[on], merged[on]
            rows, lens, low = rows[busy], lens[busy], low[busy]
        if not len(rows):
            return left
        of = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
        at = np.flatnonzero(rank == low[of])
        close = np.diff(at) == 1  # in runs such as "aaa" every other hit holds, from the left
        if close.any():
            fresh = np.concatenate([[True], ~close])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        rank[at] = rank[at + 1]  # none where the row now ends here
        lens = lens - np.bincount(of[at], minlength=len(rows))
        here = at - np.arange(len(at))  # places after the gaps are closed
        sym, rank, merged = sym[keep], rank[keep], merged[keep]
        first = np.zeros(len(sym), bool)
        first[np.cumsum(lens) - lens] = True
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lens) - 1] = True
        touched = np.zeros(len(sym), bool)
        touched[here[~last[here]]] = True
        touched[here[~first[here]] - 1] = True
        new = np.flatnonzero(touched)
        rank[new], merged[new] = pairs.find(sym[new], sym[new + 1])


class Counter:
    """Counts tokens for one vocabulary file of the `tokenizers` library with BPE and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = spec.get("normalizer") or {}
        kinds = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        if model["type"] != "BPE" or any(k not in ("NFC", "Replace", "Lowercase") for k in kinds):
            raise ValueError("this vocabulary file is not of a supported kind")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # str.split() takes four control characters for white space that the vocabulary's patterns do not.
        self.odd, self.space = re.compile("[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple({s[0] for s in special})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(*(np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])))
        byte = byte_symbols()
        self.inner = np.array([vocab[byte[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[byte[b] + self.suffix] for b in range(256)], np.int32)
        self.memo: dict[str, int] = {}
        self.held = 0  # characters in the memo

    def lowered(self, s: str) -> str:
        return s.lower() if s.isascii() or "Σ" not in s else "".join(c.lower() for c in s)  # letter by letter

    def words(self, chunks: list[str]) -> dict[str, int]:
        """Counts of these white-space-free chunks; those that are not long go to the memo."""
        pre, owner = [], []
        for k, c in enumerate(chunks):
            n = unicodedata.normalize("NFC", c) if self.nfc and not c.isascii() else c
            found = self.pattern.findall(self.lowered(n) if self.lower else n)
            pre += found
            owner += [k] * len(found)
        counts = np.zeros(len(chunks), np.int64)
        if pre:
            raw = [p.encode() for p in pre]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            order = np.argsort(lens, kind="stable")
            out, i = np.zeros(len(raw), np.int64), 0
            area = np.cumsum(lens[order])
            while i < len(raw):
                base = area[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(area, base + BATCH_SYMBOLS)))
                part = order[i:j]
                flat = np.frombuffer(b"".join([raw[p] for p in part]), np.uint8)
                sym = self.inner[flat]
                ends = np.cumsum(lens[part]) - 1
                sym[ends] = self.last[flat[ends]]
                out[part] = merge_ragged(sym, lens[part], self.pairs)
                i = j
            counts = np.bincount(np.array(owner), weights=out, minlength=len(chunks)).astype(np.int64)
        got = dict(zip(chunks, counts.tolist(), strict=True))
        short = {w: n for w, n in got.items() if len(w) <= MEMO_LONGEST}
        self.held += sum(map(len, short))
        if self.held > MEMO_CHARS:
            self.memo, self.held = {}, sum(map(len, short))
        self.memo.update(short)
        return got

    def count(self, texts: list[str]) -> list[int]:
        base, plain = [0] * len(texts), []
        for i, t in enumerate(texts):
            if self.special and any(m in t for m in self.marks) and (hits := self.special.findall(t)):
                base[i] = len(hits)
                t = self.special.sub(" ", t)
            plain.append(t.split() if not self.odd.search(t) else self.space.split(t))
        memo = self.memo
        new = {w for ws in plain for w in ws if w not in memo}
        got = self.words(list(new)) if new else {}
        return [b + sum([memo[w] if w in memo else got[w] for w in ws]) for b, ws in zip(base, plain, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path None: the installed word_bpe_49k.json."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = counter(path or public_tokenizers.path("word_bpe_49k.json"))
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = np.array(c.count(texts), np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_rank_merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
