"""Token ids of whole texts by a byte-level BPE vocabulary, through a transducer lexicon.

The words of the corpus (the pieces of the tokenizer's pattern) are counted over all texts. The
most frequent ones are compiled into a minimal acyclic transducer: sorted words are added one by
one, equal suffix states are shared, and ids are pushed as far to the front as their common
prefixes allow. It is written as flat arrays to the shared folder and memory-mapped by every
worker. The distinct words of a batch walk it together, a byte of all of them at a time; words that
aren't in it are merged exactly, pair by pair in rank order. The lexicon decides only speed: every
word gets the same ids with or without it, so its size is a plain parameter.

Edge cases: null and empty texts give an empty list; a special token's string is ordinary text;
very long texts and words are handled whole (merging takes n log n steps); repeated rows each get
their row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import mmap
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import shared_dir

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed values: the vocabulary's word pattern
LEXICON_WORDS = 50_000
LONGEST = 64  # characters of a word that is counted for the lexicon
MAGIC = b"TMLX0001"


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 and rank lines."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair of least rank, the leftmost of equal ones, is merged until none is known."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has been merged since
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of words and id lists, as flat arrays."""
    # A state is [arcs: {label: [target, out]}, final output or None]; frozen states are shared by signature.
    frozen: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(s: list) -> int:
        sig = (tuple((b, t, o) for b, (t, o) in sorted(s[0].items())), s[1])
        at = frozen.get(sig)
        if at is None:
            at = frozen[sig] = len(states)
            states.append(sig)
        return at

    path: list[list] = [[{}, None]]
    last = b""
    for word in sorted(entries):
        out = tuple(entries[word])
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        for i in range(len(last), k, -1):
            path[i - 1][0][last[i - 1]][0] = freeze(path[i])
        del path[k + 1 :]
        for i in range(1, k + 1):  # push outputs: keep the common start, hand the rest on
            arc = path[i - 1][0][word[i - 1]]
            c = 0
            while c < min(len(arc[1]), len(out)) and arc[1][c] == out[c]:
                c += 1
            rest, arc[1], out = arc[1][c:], arc[1][:c], out[c:]
            if rest:
                for a in path[i][0].values():
                    a[1] = rest + a[1]
                if path[i][1] is not None:
                    path[i][1] = rest + path[i][1]
        for i in range(k, len(word)):
            path[i][0][word[i]] = [-1, out if i == k else ()]
            path.append([{}, None])
        path[-1][1] = out if k == len(word) else ()
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][0][last[i - 1]][0] = freeze(path[i])
    root = freeze(path[0])
    pool: dict[tuple, int] = {(): 0}
    flat, starts = [], [0, 0]

    def place(o: tuple) -> int:
        at = pool.get(o)
        if at is None:
            at = pool[o] = len(starts) - 1
            flat.extend(o)
            starts.append(len(flat))
        return at

    first, label, target, arc_out, final = [0], [], [], [], []
    for arcs, end in states:
        for b, t, o in arcs:
            label.append(b)
            target.append(t)
            arc_out.append(place(o))
        first.append(len(label))
        final.append(-1 if end is None else place(end))
    arrays = [np.array(x, dtype="<i4") for x in (first, target, arc_out, final, starts, flat)] + [np.array(label, dtype="<u1")]
    head = MAGIC + struct.pack("<8q", root, *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Reads a compiled lexicon from bytes or a memory map."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        self.root, *sizes = struct.unpack("<8q", view[8:72])
        at, parts = 72, []
        for n in sizes[:-1]:
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.arc_out, self.final, self.starts, self.flat = parts
        self.label = view[at : at + sizes[-1]]

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def tables(self) -> tuple[np.ndarray, ...]:
        """The arrays over the map itself: arc keys (state, label) in order, targets, outputs of arcs, of states, and their ids."""
        first, target, arc_out, final, starts, flat = (np.frombuffer(x, "<i4") for x in (self.first, self.target, self.arc_out, self.final, self.starts, self.flat))
        key = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 8 | np.frombuffer(self.label, np.uint8)
        return key, target, arc_out, final, starts, flat

    def walk(self, words: list[bytes], tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are held, how many ids each of them has (0 if not), and their ids in a row."""
        key, target, arc_out, final, starts, flat = tables
        size = np.array([len(w) for w in words])
        longest = int(size.max(initial=0))
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        state, alive = np.full(len(words), self.root, np.int64), np.full(len(words), len(key) > 0)
        out = np.zeros((len(words), longest + 1), np.int64)  # output 0 is empty
        for i in range(longest):
            at = np.flatnonzero(alive & (size > i))
            if not len(at):
                break
            want = state[at] << 8 | text[at, i]
            arc = np.searchsorted(key, want)
            arc[arc == len(key)] = 0
            ok = key[arc] == want
            alive[at[~ok]] = False
            at, arc = at[ok], arc[ok]
            state[at] = target[arc]
            out[at, i] = arc_out[arc]
        end = np.where(alive, final[state], -1)
        held = end >= 0
        out[~held] = 0
        out[:, longest] = np.where(held, end, 0)
        n = starts[out + 1] - starts[out]
        return held, n.sum(1), _spans(starts[out].ravel(), n.ravel(), flat)

    def get(self, word: bytes) -> list[int] | None:
        state, out = self.root, []
        for b in word:
            lo, hi = self.first[state], self.first[state + 1]
            while lo < hi:
                mid = (lo + hi) // 2
                if self.label[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == self.first[state + 1] or self.label[lo] != b:
                return None
            o = self.arc_out[lo]
            out += self.flat[self.starts[o] : self.starts[o + 1]].tolist()
            state = self.target[lo]
        end = self.final[state]
        return None if end < 0 else out + self.flat[self.starts[end] : self.starts[end + 1]].tolist()


def _spans(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all spans, one after the other."""
    some = size > 0
    start, size = start[some].astype(np.int64), size[some].astype(np.int64)
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))] if len(size) else flat[:0]


def frequent_words(texts: DataFrame, k: int) -> list[str]:
    """The k most frequent words that occur twice or more, counted over all texts. texts: one column, text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen = regex.compile(PATTERN).findall, Counter()

        def rows() -> pd.DataFrame:
            some = [w for w in seen if len(w) <= LONGEST]
            return pd.DataFrame({"word": some, "n": [seen[w] for w in some]})

        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    seen.update(find(t))
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    counts = texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(k).select("word").collect()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """id_col and ids (list of integers) of every row. folder holds `<vocabulary>.tiktoken` on the driver."""
    spark = docs.sparkSession
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = ranks_of(raw)
    words = frequent_words(docs.select(F.col(text_col).alias("text")).filter("text is not null"), lexicon_words)
    data = compile_lexicon({w: merge(w, ranks) for w in (x.encode() for x in words)})
    shared = shared_dir(spark)
    path = None
    if shared.startswith("file:") or shared.startswith("/"):
        # Named by its content, so that encoding again writes nothing new.
        path = os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin")
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                f.write(data)
            os.replace(f.name, path)
    # The lexicon is bounded by lexicon_words: where a worker can't map the file (an object store, say), it uses the bytes.
    sent = spark.sparkContext.broadcast((raw, data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, own = sent.value
        known = None
        lex = Lexicon.mapped(path) if path and os.path.exists(path) else Lexicon(own)
        tables = lex.tables()
        find = regex.compile(PATTERN).findall
        for batch in batches:
            number: dict[str, int] = {}
            tokens, per_text = [], []
            for t in batch.column(1).to_pylist():
                found = find(t) if t else ()
                tokens += [number.setdefault(w, len(number)) for w in found]
                per_text.append(len(found))
            words = [w.encode() for w in number]
            short = np.array([len(w) <= 4 * LONGEST for w in words], bool)  # longer ones aren't in it: at most four bytes a character
            held, size, ids = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.empty(0, np.int32)
            if short.any():
                held[short], size[short], ids = lex.walk([w for w, s in zip(words, short, strict=True) if s], tables)
            start = np.cumsum(size) - size
            rest, at = [], len(ids)
            if not held.all() and known is None:
                known = ranks_of(vocab)
            for i in np.flatnonzero(~held):
                one = merge(words[i], known)
                start[i], size[i] = at, len(one)
                at += len(one)
                rest += one
            flat = np.concatenate([ids, np.array(rest, np.int32)]).astype(np.int32)
            order = np.array(tokens, np.int64)
            values = _spans(start[order], size[order], flat) if len(order) else flat[:0]
            ends = np.r_[0, np.cumsum(size[order])] if len(order) else np.zeros(1, np.int64)
            offsets = ends[np.r_[0, np.cumsum(np.array(per_text, np.int64))]]
            if offsets[-1] > 2**31 - 1:
                raise ValueError("a batch has more ids than a list array holds: set spark.sql.execution.arrow.maxRecordsPerBatch lower")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return base.mapInArrow(run, f"{id_col} long, ids array<int>")
