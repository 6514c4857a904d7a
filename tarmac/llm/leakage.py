"""Evaluation passages leaking into a corpus, by latent semantic retrieval.

Passages and corpus windows are vectors of character n-grams weighted by inverse document frequency
over the whole corpus. A randomised SVD of the passages' TF-IDF matrix gives a latent basis: every
step is a pass over partitions of TF-IDF rows (range finder, products with the transposed matrix,
sums per gram); only rank x rank matrices meet on the driver. Windows and passages are compared by
their inner product in the latent space; candidates are checked against the text: the longest common
run, the longest common subsequence and the passage's answer codes.

The search loses no case at any rank. A shared run of min_run characters holds a whole stretch of g
characters of a grid over the passage, and some corpus window of 2g holds that stretch whole, so all
of its grams: the window's inner product with the passage is at least the stretch's squared norm.
What the basis leaves out of either vector is added back by its norm (Cauchy-Schwarz), so a small
rank costs candidates, never cases. Candidates then have their exact inner product taken.

One scan of the corpus serves any number of passages: a bit table of the passages' grams (at most
2**MAX_BITS bits, which is what is broadcast) tells the stretches of text that hold enough of them,
and the same scan counts their document frequencies. Only these stretches go on: they are sent, by
joining their grams, to the blocks of passages that could be in them. A block holds BLOCK characters
of passages; longer passages are cut into overlapping parts. Hot blocks are spread over tasks.

Passages are normalised by NFKC and lower case, then only letters and digits are kept.

Edge cases: null, empty and blank texts hold no case; items with null id or passage, or min_run
null or below 1, or longer than the passage, give none; repeated texts each give their rows,
repeated item ids count once; very long texts and passages are handled whole; other columns are
ignored. Texts with null doc_id are counted, but give no row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import cut

RANK = 32
BLOCK = 65_536  # characters of passages that one task holds
PART = 4096  # longer passages are cut into parts of this many characters
STRETCH, GRAM = 32, 8
SPREAD = 8  # tasks that share the stretches of one block
MIN_BITS, MAX_BITS = 20, 27
CHUNK = 1_000_000  # characters normalised and hashed together
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_DROP = regex.compile(r"[^\p{L}\p{N}]+")
CODE = regex.compile(r"\p{L}\p{N}{2,}")


def normalise(text: str | None) -> str:
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def gram_hashes(text: str, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < n:
        return np.empty(0, np.uint64)
    size = len(codes) - n + 1
    h = codes[:size].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):  # a polynomial in an odd 64-bit base
            h *= BASE
            h += codes[j : j + size]
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def stretch_of(min_run: int) -> tuple[int, int, int]:
    """g, step and n: every run of min_run characters holds a whole stretch of g of the grid of that step. Few different ones exist."""
    step = 1 << (min(max(1, min_run // 5), 8).bit_length() - 1)
    g = max(1, min(STRETCH, min_run - step + 1))
    return g, step, min(GRAM, g)


def stretches(n_chars: int, g: int, step: int) -> range:
    return range(0, max(1, n_chars - g + 1), step)


def common_run(a: str, b: str, least: int) -> bool:
    """Whether the texts share a run of `least` characters."""
    if len(a) > len(b):
        a, b = b, a
    held = {a[i : i + least] for i in range(len(a) - least + 1)}
    return bool(held) and any(b[i : i + least] in held for i in range(len(b) - least + 1))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def parts(items: DataFrame, share: float) -> DataFrame:
    """item_id, part, text, run, g, step, n, least (distinct grams that a window of it must hold)."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, passage, run in pdf.itertuples(index=False, name=None):
                text, run = normalise(passage), int(run)
                if len(text) < run:
                    continue
                g, step, n = stretch_of(run)
                size = max(PART, 2 * run)
                for k, at in enumerate(range(0, max(1, len(text) - run + 1), size - run + 1)):
                    t = text[at : at + size]
                    h = gram_hashes(t, n)
                    least = min(len(np.unique(h[i : i + g - n + 1])) for i in stretches(len(t), g, step))
                    out.append((int(item), k, t, run, g, step, n, max(1, int(np.ceil(share * least)))))
            yield pd.DataFrame(out, columns=["item_id", "part", "text", "run", "g", "step", "n", "least"])

    rows = items.filter("item_id is not null and passage is not null and min_run >= 1").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.struct("passage", "min_run")).alias("x"))
    return rows.select("item_id", "x.passage", "x.min_run").mapInPandas(cut_up, "item_id long, part int, text string, run int, g int, step int, n int, least int")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, parts_, blocks, ns, hs = [], [], [], [], []
        for item, part, block, n, text in zip(pdf["item_id"], pdf["part"], pdf["block"], pdf["n"], pdf["text"], strict=True):
            h = np.unique(gram_hashes(text, n)).view(np.int64)
            ids.append(np.full(len(h), item))
            parts_.append(np.full(len(h), part))
            blocks.append(np.full(len(h), block))
            ns.append(np.full(len(h), n))
            hs.append(h)
        if hs:
            yield pd.DataFrame({"item_id": np.concatenate(ids), "part": np.concatenate(parts_), "block": np.concatenate(blocks), "n": np.concatenate(ns), "gram": np.concatenate(hs)})


def bit_table(grams: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits, two of them set for each gram."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slot = np.unique(np.concatenate(_slots(pdf["gram"].to_numpy().view(np.uint64), bits)))
            start = np.flatnonzero(np.r_[True, slot[1:] >> 5 != slot[:-1] >> 5]) if len(slot) else np.empty(0, np.int64)
            value = np.bitwise_or.reduceat(np.left_shift(1, slot & 31), start) if len(slot) else slot
            yield pd.DataFrame({"at": (slot[start] >> 5).astype(np.int32), "word": value})

    got = grams.select("gram").mapInPandas(words, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["at"].to_numpy()] = got["word"].to_numpy().astype(np.uint32)
    return out


SCAN = "doc_id long, g int, n int, text string, gram long, count long, hits array<long>, piece long"


def scan(docs: DataFrame, table: np.ndarray, bits: int, classes: list[tuple[int, int, int, int]]) -> DataFrame:
    """The one pass over the corpus. classes: g, n, least distinct grams of a window, longest run.

    Rows with a piece number are stretches of text that may hold a passage, with their known grams;
    rows without one count the documents of a gram (n = 0: all documents).
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def known(h: np.ndarray) -> np.ndarray:
        a, b = _slots(h, bits)
        at = np.flatnonzero(sent.value[a >> 5] >> (a & 31).astype(np.uint32) & 1)
        b = b[at]
        return at[(sent.value[b >> 5] >> (b & 31).astype(np.uint32) & 1).astype(bool)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCAN.split(", ")]
        total = 0

        def framed(f: pd.DataFrame) -> pd.DataFrame:
            f = f.reindex(columns=cols)
            return f.assign(text=None, hits=None) if f["text"].isna().all() else f

        counts: dict[int, list] = {}
        made = 0

        def counted() -> list:
            out = []
            for n, parts_ in counts.items():
                h, back = np.unique(np.concatenate([p[0] for p in parts_]), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate([p[1] for p in parts_]))
                out.append(pd.DataFrame({"n": n, "gram": h.view(np.int64), "count": c.astype(np.int64)}))
            counts.clear()
            return out

        def search(ids: list, texts: list[str]) -> list[tuple]:
            joined = " ".join(texts)
            ends = np.cumsum([len(t) + 1 for t in texts])
            rows = []
            for n in sorted({c[1] for c in classes}):
                h = gram_hashes(joined, n)
                pos = known(h)
                if not len(pos):
                    continue
                hit = h[pos]
                owner = np.searchsorted(ends, pos, side="right")
                order = np.lexsort((hit, owner))
                one = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (hit[order][1:] != hit[order][:-1])]
                u, c = np.unique(hit[order][one], return_counts=True)
                counts.setdefault(n, []).append((u, c))
                for g, _, least, reach in (c for c in classes if c[1] == n):
                    # Window k holds the characters k*g to k*g + 2g; a gram lies in its own and maybe the window before.
                    k = pos // g
                    before = (k > 0) & (pos - (k - 1) * g + n <= 2 * g)
                    win, gram = np.concatenate([k, k[before] - 1]), np.concatenate([hit, hit[before]])
                    order = np.lexsort((gram, win))
                    win, gram = win[order], gram[order]
                    new = np.r_[True, (win[1:] != win[:-1]) | (gram[1:] != gram[:-1])]
                    win, size = np.unique(win[new], return_counts=True)
                    win = win[size >= least]
                    if not len(win):
                        continue
                    lo, hi = np.maximum(win * g - reach, 0), win * g + 2 * g + reach
                    start = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]])
                    stop = np.r_[start[1:], len(lo)] - 1
                    for c0, c1 in zip(lo[start], hi[stop], strict=True):
                        first, last = np.searchsorted(ends, [c0, c1], side="right")
                        for t in range(first, min(last + 1, len(texts))):  # a stretch may touch several short texts
                            a, b = max(c0, ends[t - 1] if t else 0), min(c1, ends[t] - 1)
                            inside = hit[np.searchsorted(pos, a) : np.searchsorted(pos, b - n, side="right")]
                            if len(inside) >= least and ids[t] is not None:
                                rows.append((ids[t], g, n, joined[a:b], np.unique(inside).view(np.int64)))
            return rows

        for pdf in batches:
            total += len(pdf)
            ids, texts, size, rows = [], [], 0, []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = normalise(t)
                if not s:
                    continue
                ids.append(None if pd.isna(d) else int(d))
                texts.append(s)
                size += len(s)
                if size > CHUNK:
                    rows += search(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                rows += search(ids, texts)
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "g", "n", "text", "hits"])
                out["piece"] = np.arange(made, made + len(out))
                made += len(out)
                yield framed(out)
            if sum(len(p[0]) for x in counts.values() for p in x) > 500_000:
                for f in counted():
                    yield framed(f)
        for f in [*counted(), pd.DataFrame({"n": [0], "gram": [0], "count": [total]})]:
            yield framed(f)

    # Pieces get a number unique in the whole corpus by the place of their text in the table.
    return docs.mapInPandas(run, SCAN)


def directions(h: np.ndarray, k: int) -> np.ndarray:
    """A row of k normal numbers for each gram, from the gram alone."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, 2 * ((k + 1) // 2) + 1, dtype=np.uint64) * BASE
        x = (x ^ (x >> np.uint64(30))) * MIX
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    half = u.shape[1] // 2
    r, a = np.sqrt(-2 * np.log(u[:, :half])), 2 * np.pi * u[:, half:]
    return np.concatenate([r * np.cos(a), r * np.sin(a)], axis=1)[:, :k]


def _summed(rows: DataFrame, k: int) -> np.ndarray:
    """The sum of k x k matrices given as rows of (at, x)."""
    out = np.zeros(k * k)
    for at, x in rows.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[at] = x
    return out.reshape(k, k)


def _whiten(m: np.ndarray) -> np.ndarray:
    """W with W.T m W = 1 on the directions that m has, 0 on others."""
    value, vector = np.linalg.eigh(m)
    ok = value > value.max(initial=0) * 1e-10
    return vector * np.where(ok, 1 / np.sqrt(np.where(ok, value, 1)), 0)


def latent(rows: DataFrame, k: int) -> DataFrame:
    """n, gram, z (k single-precision numbers) of every gram: the columns of z are an orthonormal basis of the latent space.

    rows: item_id, part, n, gram, idf, sorted by passage within partitions, each passage in one of them.
    """

    def passages(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range finder: each row's gram directions times its weights, summed by passage."""
        key = pdf[["item_id", "part"]].to_numpy()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        w = pdf["idf"].to_numpy()
        salt = pdf["n"].to_numpy().astype(np.uint64) * MIX
        return w, start, np.add.reduceat(directions(pdf["gram"].to_numpy().view(np.uint64) ^ salt, k) * w[:, None], start, axis=0)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches that end with a whole passage."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["item_id"] == pdf["item_id"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1]) if len(pdf) else None
            if last is None:
                continue
            cut_at = int(np.flatnonzero(~last.to_numpy())[-1]) + 1 if not last.all() else 0
            rest = pdf.iloc[cut_at:]
            if cut_at:
                yield pdf.iloc[:cut_at]
        if rest is not None and len(rest):
            yield rest

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.zeros((k, k))
        for pdf in whole(batches):
            part = passages(pdf)[2]
            y += part.T @ part
        yield pd.DataFrame({"at": np.arange(k * k), "x": y.ravel()})

    r = _whiten(_summed(rows.mapInPandas(first, "at int, x double"), k))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole(b.to_pandas() for b in batches):
            w, start, y = passages(pdf)
            size = np.diff(np.r_[start, len(pdf)])
            z = np.repeat(y @ r, size, axis=0) * w[:, None]
            order = np.lexsort((pdf["gram"].to_numpy(), pdf["n"].to_numpy()))
            n, gram = pdf["n"].to_numpy()[order], pdf["gram"].to_numpy()[order]
            at = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (n[1:] != n[:-1])])
            sums_ = np.add.reduceat(z[order], at, axis=0).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(sums_.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(n[at], pa.int32()), pa.array(gram[at]), lists], names=["n", "gram", "z"])

    sums = rows.mapInArrow(second, "n int, gram long, z array<float>").groupBy("n", "gram").agg(F.array(*(F.sum(F.col("z")[i]).cast("float") for i in range(k))).alias("z"))
    sums = cut(sums)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("z").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array((m.T @ m).ravel())], names=["at", "x"])

    w = _whiten(_summed(sums.select("z").mapInArrow(third, "at int, x double"), k))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = (matrix(batch) @ w).astype("<f4").tobytes()
            z = pa.array([flat[i : i + 4 * k] for i in range(0, len(flat), 4 * k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("gram"), z], names=["n", "gram", "z"])

    return sums.mapInArrow(packed, "n int, gram long, z binary")


class Passages:
    """The passages of one block with their vectors, as a task holds them."""

    def __init__(self, grams: pd.DataFrame, rows: pd.DataFrame, share: float) -> None:
        self.n = int(rows["n"].iloc[0])
        self.g, self.step = int(rows["g"].iloc[0]), int(rows["step"].iloc[0])
        h = grams["gram"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.vocab, self.idf = h[order], grams["idf"].to_numpy()[order]
        self.basis = np.frombuffer(b"".join(grams["z"]), "<f4").reshape(len(h), -1)[order]
        self.items, self.texts, self.runs = rows["item_id"].tolist(), rows["text"].tolist(), rows["run"].tolist()
        self.codes = [set(CODE.findall(t)) for t in self.texts]
        self.holds = np.zeros((len(self.vocab), len(rows)), np.float32)
        least, norm = [], []
        for i, t in enumerate(self.texts):
            place = np.searchsorted(self.vocab, gram_hashes(t, self.n))
            w2 = self.idf[place] ** 2
            self.holds[place, i] = 1
            norm.append((self.idf[np.unique(place)] ** 2).sum())
            least.append(min(w2[np.unique(place[a : a + self.g - self.n + 1], return_index=True)[1] + a].sum() for a in stretches(len(t), self.g, self.step)))
        self.least = share * np.array(least) * (1 - 1e-4)
        self.norm = np.sqrt(norm)
        self.coords = (self.holds * self.idf[:, None].astype(np.float32)).T @ self.basis
        self.left = np.sqrt(np.maximum(np.array(norm) - (self.coords.astype(np.float64) ** 2).sum(1), 0))

    def candidates(self, text: str) -> tuple[int, list[tuple[int, float, int]]]:
        """How many (window, passage) pairs the latent search lets through, and (passage, cosine, window start) of those whose inner product is enough."""
        h = gram_hashes(text, self.n)
        place = np.searchsorted(self.vocab, h)
        place[place == len(self.vocab)] = 0
        pos = np.flatnonzero(self.vocab[place] == h)
        if not len(pos):
            return 0, []
        place, g = place[pos], self.g
        k = pos // g
        before = (k > 0) & (pos - (k - 1) * g + self.n <= 2 * g)
        pair = np.unique(np.concatenate([k, k[before] - 1]) * len(self.vocab) + np.concatenate([place, place[before]]))
        win, gram = pair // len(self.vocab), pair % len(self.vocab)
        start = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
        weight = np.add.reduceat(self.idf[gram] ** 2, start)
        seen, best = 0, {}
        for lo in range(0, len(start), 1024):  # a bounded number of windows at a time
            s = start[lo : lo + 1024]
            a, b = s[0], start[lo + 1024] if lo + 1024 < len(start) else len(win)
            wt = weight[lo : lo + 1024]
            some = np.flatnonzero(wt >= self.least.min())
            if not len(some):
                continue
            z = np.add.reduceat(self.basis[gram[a:b]] * self.idf[gram[a:b], None].astype(np.float32), s - a, axis=0)[some]
            left = np.sqrt(np.maximum(wt[some] - (z.astype(np.float64) ** 2).sum(1), 0))
            score = z @ self.coords.T
            x, item = np.nonzero(score * (1 + 1e-5) + np.outer(left, self.left) + 1e-3 >= self.least)
            seen += len(x)
            for row in np.unique(x):
                w0 = some[row]
                own = gram[s[w0] : s[w0 + 1] if w0 + 1 < len(s) else b]
                which = item[x == row]
                inner = (self.idf[own] ** 2) @ self.holds[own][:, which]
                for i, v in zip(which[inner >= self.least[which]], inner[inner >= self.least[which]], strict=True):
                    cosine = float(v / (np.sqrt(wt[w0]) * self.norm[i]))
                    if cosine > best.get(int(i), (0.0, 0))[0]:
                        best[int(i)] = (cosine, int(win[s[w0]]) * g)
        return seen, [(i, c, at) for i, (c, at) in best.items()]


PAIR = "doc_id long, item_id long, leaked boolean, cosine double, lcs double, answers int, codes int, candidates long"


def scored(docs: DataFrame, items: DataFrame, share: float = 1.0, rank: int | None = None) -> DataFrame:
    """Every document and item of the search: leaked (a common run of min_run), cosine, lcs (share of the shorter in common order), answers (codes of the passage found) of codes, and the candidates that the latent search let through.

    A window must hold `share` of the weight of a whole stretch; 1 suffices for common runs, less finds paraphrases.
    docs: doc_id, text. items: item_id, passage, min_run.
    """
    k = RANK if rank is None else rank
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = cut(parts(items, share))
    empty = docs.sparkSession.createDataFrame([], PAIR)
    kinds = p.groupBy("g", "n").agg(F.min("least").alias("least"), F.max("run").alias("run"), F.sum(F.length("text")).alias("size")).collect()
    if not kinds:
        return empty
    # Blocks: passages of one kind, spread by hash over as many as their size asks for.
    n_blocks = F.create_map(*(F.lit(x) for r in kinds for x in (r.g * 100 + r.n, r.size // BLOCK + 1)))[F.col("g") * 100 + F.col("n")]
    p = p.withColumn("block", (F.col("g") * 100 + F.col("n")).cast("long") * 1_000_000_000 + F.pmod(F.xxhash64("item_id", "part"), n_blocks))
    grams = cut(p.select("item_id", "part", "block", "n", "text").mapInPandas(_grams, "item_id long, part int, block long, n int, gram long"))
    bits = min(max((64 * max(grams.count(), 1)).bit_length(), MIN_BITS), MAX_BITS)
    table = bit_table(grams, bits)
    seen = cut(scan(base, table, bits, [(r.g, r.n, r.least, r.run) for r in kinds]).withColumn("piece", F.when(F.col("piece").isNotNull(), F.monotonically_increasing_id())))
    counts = seen.filter("piece is null").groupBy("n", "gram").agg(F.sum("count").alias("count"))
    total = counts.filter("n = 0").agg(F.sum("count")).first()[0] or 0
    idf = F.log((F.lit(float(total)) + 1) / (F.coalesce("count", F.lit(0)) + 1)) + 1
    weighed = grams.join(counts, ["n", "gram"], "left").select("item_id", "part", "block", "n", "gram", idf.alias("idf"))
    weighed = cut(weighed.repartition("item_id", "part").sortWithinPartitions("item_id", "part", "gram"))
    z = latent(weighed, k)
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    in_block = weighed.groupBy("block", "n", "gram").agg(F.first("idf").alias("idf"))
    # A stretch goes to the blocks that hold enough of its grams.
    pieces = seen.filter("piece is not null").select("piece", "doc_id", "g", "n", "text", "hits")
    least = F.create_map(*(F.lit(x) for r in kinds for x in (r.g * 100 + r.n, r.least)))[F.col("g") * 100 + F.col("n")]
    met = pieces.select("piece", "g", "n", F.explode("hits").alias("gram")).join(in_block.select("block", "n", "gram", F.floor(F.col("block") / 1_000_000_000).alias("kind")), ["n", "gram"]).filter(F.col("kind") == F.col("g") * 100 + F.col("n"))
    met = met.groupBy("piece", "block", "g", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("piece", "block")
    sent = pieces.join(met, "piece").select("block", F.pmod(F.xxhash64("piece"), F.lit(SPREAD)).cast("int").alias("salt"), "doc_id", "text")
    zero = lambda t: F.lit(0).cast(t)  # noqa: E731  no nulls: they would turn whole numbers into floats
    none, vector = F.lit(None).cast("string"), F.lit(None).cast("binary")
    union = (
        in_block.join(z, ["n", "gram"]).select("block", spread.alias("salt"), F.lit(0).alias("kind"), "gram", "idf", "z", *(zero("int").alias(c) for c in ("n", "g", "step", "run")), zero("long").alias("id"), none.alias("text"))
        .unionByName(p.select("block", spread.alias("salt"), F.lit(1).alias("kind"), zero("long").alias("gram"), zero("double").alias("idf"), vector.alias("z"), "n", "g", "step", "run", F.col("item_id").alias("id"), "text"))
        .unionByName(sent.select("block", "salt", F.lit(2).alias("kind"), zero("long").alias("gram"), zero("double").alias("idf"), vector.alias("z"), *(zero("int").alias(c) for c in ("n", "g", "step", "run")), F.col("doc_id").alias("id"), "text"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block's grams and passages come before its stretches."""
        now, grams_, rows, held = None, [], [], None
        for pdf in batches:
            out: dict[tuple, tuple] = {}
            cuts = np.flatnonzero((pdf["block"].to_numpy()[1:] != pdf["block"].to_numpy()[:-1]) | (pdf["salt"].to_numpy()[1:] != pdf["salt"].to_numpy()[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if not len(part):
                    continue
                key = (part["block"].iloc[0], part["salt"].iloc[0])
                if key != now:
                    now, grams_, rows, held = key, [], [], None
                kind = part["kind"].to_numpy()
                if (kind == 0).any():
                    grams_.append(part.loc[kind == 0, ["gram", "idf", "z"]].astype({"gram": np.int64}))
                if (kind == 1).any():
                    rows.append(part.loc[kind == 1].rename(columns={"id": "item_id"}))
                for doc, text in zip(part["id"][kind == 2], part["text"][kind == 2], strict=True):
                    if held is None:
                        held = Passages(pd.concat(grams_), pd.concat(rows), share)
                        grams_, rows = [], []
                    n, pairs = held.candidates(text)
                    for i, cosine, at in pairs:
                        passage, run = held.texts[i], held.runs[i]
                        near = text[max(0, at - len(passage)) : at + 2 * held.g + len(passage)]
                        lcs = lcs_length(passage, near) / min(len(passage), len(near))
                        found_ = sum(c in near for c in held.codes[i])
                        was = out.get((int(doc), int(held.items[i])), (False, 0.0, 0.0, 0, 0, 0))
                        out[int(doc), int(held.items[i])] = (was[0] or common_run(text, passage, run), max(was[1], cosine), max(was[2], lcs), max(was[3], found_), max(was[4], len(held.codes[i])), was[5] + n)
            yield pd.DataFrame([(*k_, *v) for k_, v in out.items()], columns=[c.split()[0] for c in PAIR.split(", ")])

    hits = union.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInPandas(search, PAIR)
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("leaked", "cosine", "lcs", "answers", "codes", "candidates")))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document sharing a run of at least min_run characters with the item's passage."""
    return scored(docs, items).filter("leaked").select("doc_id", "item_id")


def paraphrases(docs: DataFrame, items: DataFrame, share: float = 0.35, common: float = 0.7) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answers of documents that tell a passage in other words: no common run, but `common` of it in common order and all of its answer codes."""
    out = scored(docs, items, share).filter(~F.col("leaked") & (F.col("lcs") >= common) & (F.col("answers") >= F.col("codes")))
    return out.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"), "answers")
