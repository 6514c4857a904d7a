"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming.

A text is cut into blocks at blank lines. In a block, every end mark that something follows is a
candidate (and in Thai every space without a digit or Latin letter beside it). The program selects
the division of a block into whole spans of the greatest total score. A span's score joins

* its closing: the class of the word and mark it ends with, together with what follows;
* its opening: a span that comes right after a quotation nobody has introduced, and itself names the
  speaker, belongs to that quotation (`ATTRIBUTION`); so does one that goes on in lower case;
* what it holds: a span that is a list number only is no sentence (`LIST_ONLY`), quotations and
  brackets must be balanced (`UNBALANCED`);
* its length, by a bounded log-normal term.

Whether a span names a speaker, is a list number or has a usual length depends on both its ends, so
the division isn't the sum of local decisions: `local_spans` gives that sum, and differs.

The program is exact and close to linear. With the length term between -LENGTH and 0, a cut adds at
least its closing less 2 LENGTH less the penalties it can bring about; where that is positive no
best span passes over it. A cut adds at most its closing plus LENGTH plus the penalties it can
avoid; where that is negative it is in no best division.

Weights are per class (WEIGHTS). `fit` trains them on labelled texts, by the structured perceptron;
pass its result as `weights`. Labelled texts are bounded by MAX_LABELLED rows.

Rows: sent_no from 1, start_pos and end_pos (exclusive) in Unicode code points, without outer white
space. Edge cases: null, empty and blank texts have no rows; null ids are kept as null; very long
texts are handled whole, and no window bounds how far a speaker or a word may be; repeated rows each
get their rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "doc_id long, sent_no int, start_pos int, end_pos int"

# Abbreviations (lower case, without the last full stop).
TITLES = set(
    "mr mrs ms dr prof eng st messrs rev hon gen col capt lt sgt sr sra srta dra ing arq lic d dña don mgr bc mgr. "
    "judr mudr phdr rndr doc dipl herr fr frl hr डॉ श्री श्रीमती पं प्रो कु د أ م إ ا".split()
)
BEFORE = set(
    "approx ca cca circa vs v cf e.g i.e eg ie viz no nos nr fig figs sec secs ch chap vol pp p pg eq ref refs art tab tbl app acc incl excl "
    "bzw z.b u.a d.h o.ä s vgl evtl ggf inkl sog abs bd hrsg str abb kap zb dh ua z u "
    "aprox pág págs núm fig ej p.ej av avda dpto ud uds vid "
    "tj tzn např resp č str obr kap tab ul nám odst popř sv atp km2 "
    "कि से मि ई रु".split()
)
EITHER = set("etc usw atd apod inc ltd co corp rd ave blvd ln sq min max cm mm km m kg jr ph.d u.s u.k u.s.a a.m p.m am pm al ev jan feb mar apr jun jul aug sep sept oct nov dec dept est".split())
MONTHS = set(
    "january february march april may june july august september october november december januar februar märz april mai juni juli august september oktober november dezember "
    "jänner ledna února března dubna května června července srpna září října listopadu prosince leden únor březen duben květen červen červenec srpen říjen listopad prosinec".split()
)
SPEECH = regex.compile(
    r"\b(?:said|says|say|asked|asks|shouted|wrote|writes|replied|added|called|cried|told|noted|answered|explained|warned|insisted|complained|reported|remarked|"
    r"fragte|sagte|rief|schrieb|meinte|antwortete|erklärte|notierte|dijo|preguntó|gritó|escribió|respondió|añadió|comentó|"
    r"zeptal|zeptala|řekl|řekla|napsal|napsala|zvolal|zvolala|dodal|dodala)\b|"
    r"说|道|写|问|喊|答|話|書|言|述べ|尋ね|叫|कहा|पूछा|लिखा|बोला|बोली|चिल्लाया|قال|قالت|سأل|سألت|كتب|كتبت|صاح|صرخ",
    regex.IGNORECASE,
)

STRONG = "!?。！？｡؟۔।॥‼⁇⁈⁉"
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
END = ".!?…。！？｡؟۔।॥．‼⁇⁈⁉"
WIDE_END = "。！？｡।॥"
OPEN, CLOSE = "“«「『（(【［[〈《‹", "”»」』）)】］]〉》›"
PAIR = dict(zip(CLOSE, OPEN, strict=True))
OPENING = "\"„" + OPEN
CLOSERS = CLOSE + "\"'’“"
CANDIDATE = regex.compile(rf"[{regex.escape(END)}]+[{regex.escape(CLOSERS)}]*")
BLANK = regex.compile(r"(?>\r\n|[\n\r \x85])[^\S\n\r]*(?>\r\n|[\n\r \x85])\s*| \s*")
THAI = regex.compile(r"(?<=[\p{Thai}\p{P}\p{S}])[^\S\n\r]+(?=[\p{Thai}\p{P}\p{S}])")
LIST_NO = regex.compile(r"\(?(?:[0-9]{1,3}|[a-zA-Z])[.)]")
BREAKS = "([{“„«\"‘/!?…"
GLUED = regex.compile(r"^.*\p{Ll}\p{Ll}[.](?=\p{Lu})")  # a sentence without a space after its end
NEXT_NO = regex.compile(r"\(?[0-9]{1,3}[.)]\s")

MARKS = regex.compile(rf"[\"„{regex.escape(OPEN + CLOSE)}]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
LETTER = regex.compile(r"\p{L}")
DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
SHORT_NO, LONG_NO = regex.compile(r"[0-9]{1,2}"), regex.compile(r"[0-9]{1,3}")
HINDI = regex.compile(r"\p{Devanagari}$")
THAI_CHAR = regex.compile(r"\p{Thai}")
ODD = regex.compile(r"[_/@.\\0-9]|://")

# Start weights of `fit`, and the weights used by default.
WEIGHTS = {
    "strong": 6.0, "strong glued": 4.0, "strong lower": -6.0, "strong within": -10.0, "dots": 4.0, "dots glued": 2.0, "dots caseless": -2.0, "dots lower": -10.0,
    "stop": 5.0, "stop caseless": 4.0, "stop glued": 2.5, "stop lower": -14.0, "thai": 6.0, "after quote": -6.0,
    "list number": -1.0, "day": -6.0, "number digit": -4.0, "letter": -7.0, "letter unit": -8.0, "letter digit": -3.0, "title": -9.0, "before": -9.0, "devanagari": -6.0,
    "either": 3.0, "either digit": -4.0, "dotted upper": -5.0, "dotted": 1.0, "dotted lower": -4.0,
    "unbalanced": -24.0, "attribution": -14.0, "attribution caseless": -3.0, "list only": -20.0,
}
LENGTH, USUAL, SPREAD = 1.9, 60.0, 1.1  # the length term: its bound, its best length, its width in logarithms
MAX_LABELLED = 100_000
SPAN_FEATURES = ("unbalanced", "attribution", "attribution caseless", "list only")


def _pairs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets of a block, as (place of the opener, place of the closer)."""
    out, stack = [], []
    held = dict.fromkeys('"„' + OPEN, 0)  # openers on the stack, so that a closer without one costs nothing

    def close(kinds: str, at: int) -> bool:
        if not any(held[k] for k in kinds):
            return False
        while True:
            k, o = stack.pop()
            held[k] -= 1
            if k in kinds:
                out.append((o, at))
                return True

    for m in MARKS.finditer(text, a, b):
        i, c = m.start(), text[m.start()]
        if c == '"' and close('"', i) or c == "“" and close("„", i):
            continue
        if c in held:
            stack.append((c, i))
            held[c] += 1
        elif c in PAIR:
            close(PAIR[c] + "„" if c == "”" else PAIR[c], i)
    return out


def _last_word(text: str, a: int, at: int) -> str:
    """The word that ends at a place."""
    i = at
    while i > a and text[i - 1] not in BREAKS and not text[i - 1].isspace():
        i -= 1
    return text[i:at]


def _plain_before(text: str, a: int, at: int) -> bool:
    """Whether the word that ends at a place has two letters or more and no sign of a file name, an address or a number."""
    i = at
    while i > a and text[i - 1] not in BREAKS and not text[i - 1].isspace():
        if ODD.match(text, i - 1):
            return False
        i -= 1
    return at - i > 1


def _next_word(text: str, i: int, b: int) -> str:
    m = WORD.match(text, i, b)
    return m[0] if m else ""


def _closing(text: str, a: int, at: int, mark: str, nxt: int, b: int, gap: bool) -> str | None:
    """Class of an end after `mark` (the end marks) that starts at `at`; None where nothing can end. nxt: where the next word or sign starts."""
    c = text[nxt]
    start = nxt
    while start < b and text[start] in "“\"'«‘„¿¡([「『（" + "🙂":
        start += 1
    o = text[start] if start < b else c
    upper, lower, digit = o.isupper() or o in "¿¡", o.islower(), o.isdigit()
    caseless = o.isalpha() and not upper and not lower
    if c in ",;:，；：、،؛)]}）】」』”»%":
        return None
    if "." not in mark and any(x in STRONG for x in mark):
        if any(x in WIDE_END or x in "！？" for x in mark):
            return "strong"
        if lower:
            return "strong lower" if gap else None
        return "strong" if gap else "strong glued" if upper or caseless else "strong within"
    if mark.startswith("…") or mark.startswith("..."):
        if lower or not gap:
            return "dots glued" if upper and not gap else "dots lower"
        return "dots"
    # a full stop
    if not gap:
        before = text[at - 1] if at > a else ""
        follows = start + 1 < b and (text[start + 1].islower() or text[start + 1] in "'’" or text[start + 1].isspace())
        return "stop glued" if upper and follows and (before.islower() or before in ")]") and _plain_before(text, a, at) else None
    if lower:
        return "stop lower"
    word = GLUED.sub("", _last_word(text, a, at).rstrip("'’\"”)"))
    low = word.lower()
    if digit and NEXT_NO.match(text, start, b) and not SHORT_NO.fullmatch(word):
        upper, digit = True, False  # a list number opens the next sentence
    if LONG_NO.fullmatch(word):
        k = at - len(word)
        while k > a and text[k - 1].isspace():
            k -= 1
        if k == a or text[k - 1] in END + CLOSERS:
            if not (k > a and text[k - 1] == "." and _last_word(text, a, k - 1).lower() in BEFORE):
                return "list number"
    if LETTER.fullmatch(word):  # an initial before a name, or a short unit or label that ends a sentence
        if low in ("z", "u", "d", "o", "s", "p", "e", "i", "v", "č") and word.islower():
            return "letter unit"
        return "letter" if upper or caseless else "letter digit"
    if DOTTED.fullmatch(word):
        if low in BEFORE:
            return "before"
        if low in EITHER:
            return "either" if upper or caseless else "dotted lower"
        return "dotted upper" if upper and word.isupper() else "dotted" if upper else "dotted lower"
    if low in TITLES:
        return "title"
    if low in BEFORE:
        return "before"
    if HINDI.search(word):
        return "devanagari"
    if low in EITHER:
        return "either digit" if digit and low in SHORT_MONTHS else "either"
    if SHORT_NO.fullmatch(word) and (digit or _next_word(text, start, b).lower() in MONTHS):
        return "number digit" if digit else "day"
    return "stop caseless" if caseless else "stop"


class Block:
    """The candidates of a block: where spans may end (stop) and start (begin), and what their scores need."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.text = text
        pairs = _pairs(text, a, b)
        openers, closers = {o for o, _ in pairs}, {c: o for o, c in pairs}
        found: dict[int, tuple[int, str, int]] = {}
        for m in CANDIDATE.finditer(text, a, b):
            k, e = m.span()
            mark_end = k
            while mark_end < e and text[mark_end] in END:
                mark_end += 1
            # A quote that opens something is no closer of this sentence.
            while e > mark_end and (text[e - 1] in OPENING and e - 1 in openers or text[e - 1] in "\"“" and e - 1 not in closers or text[e - 1] == "'" and e < b and text[e].isalnum()):
                e -= 1
            nxt = e
            while nxt < b and text[nxt].isspace():
                nxt += 1
            if nxt >= b:
                continue
            kind = _closing(text, a, k, text[k:mark_end], nxt, b, nxt > e)
            if kind is None and e > mark_end and nxt == e and text[nxt] not in ",;:，；：、،؛)]}）】」』”»%":
                kind = "after quote"
            if kind is not None:
                quote = closers.get(e - 1, -1) if e > mark_end and text[e - 1] not in ")]）】］" else -1
                found[e] = (nxt, kind, quote)
        for m in THAI.finditer(text, a, b) if THAI_CHAR.search(text, a, b) else ():
            p, n = text[m.start() - 1], text[m.end()]
            if (THAI_CHAR.match(p) or THAI_CHAR.match(n)) and not (p in ",;:(" or n in ",;:)"):
                found[m.start()] = (m.end(), "thai", -1)
        places = sorted(found)
        self.begin = [a, *(found[e][0] for e in places)]
        self.stop = [*places, b]
        self.kind = [found[e][1] for e in places]
        # Cutting inside a matched quotation or bracket leaves it unbalanced on both sides.
        step = [0] * (len(places) + 1)
        for o, c in pairs:
            step[bisect_left(places, o + 1)] += 1
            step[bisect_left(places, c + 1)] -= 1
        self.depth, d = [], 0
        for x in step[:-1]:
            d += x
            self.depth.append(d)
        # How the span that starts after each candidate may owe its speaker to the quotation before: see _owes.
        self.owes = [None, *(_owes(text, a, found[e][2], found[e][0], found[e][0] > e) if found[e][2] >= 0 else None for e in places)]
        self.speech = [m.start() for m in SPEECH.finditer(text, a, b)] if "speech" in self.owes else []

    def features(self, i: int, j: int) -> list[str]:
        """What the span from start i to end j holds."""
        s, e = self.begin[i], self.stop[j]
        out = []
        owes = self.owes[i]
        if owes == "speech":
            k = bisect_left(self.speech, s)
            if k < len(self.speech) and self.speech[k] < e:
                out.append("attribution")
        elif owes:
            out.append(owes)
        if e - s <= 5 and LIST_NO.fullmatch(self.text, s, e):
            out.append("list only")
        return out

    def cuts(self, w: dict[str, float]) -> list[int]:
        """The candidates of the best division, in order."""
        n = len(self.kind)
        if not n:
            return []
        gain = [w[k] + w["unbalanced"] * d for k, d in zip(self.kind, self.depth, strict=True)]
        owe = -min(w["attribution"], w["attribution caseless"], 0)
        lone = -min(w["list only"], 0)
        must, keep, debt = [False] * n, [False] * n, False
        for k in range(n):
            short = self.stop[k] - self.begin[k] <= 5 or self.stop[k + 1] - self.begin[k + 1] <= 5
            must[k] = gain[k] - 2 * LENGTH - (owe if self.owes[k + 1] else 0) - (lone if short else 0) > 0
            # Cutting here may shorten a span that owes a speaker, or free one from a debt.
            keep[k] = gain[k] + LENGTH + (owe if debt else 0) > 0
            debt = bool(self.owes[k + 1]) or debt and not must[k]
        at = [k for k in range(n) if keep[k]]
        m = len(at)
        best, back = [0.0] + [float("-inf")] * (m + 1), [0] * (m + 2)
        starts, stops = [0, *(k + 1 for k in at)], [*at, n]
        for i in range(m + 1):
            for j in range(i, m + 1):
                s = best[i] + (gain[stops[j]] if stops[j] < n else 0.0) + self.score(starts[i], stops[j], w)
                if s > best[j + 1]:
                    best[j + 1], back[j + 1] = s, i
                if stops[j] < n and must[stops[j]]:
                    break
        out, j = [], m + 1
        while back[j] > 0:
            j = back[j]
            out.append(at[j - 1])
        return out[::-1]

    def score(self, i: int, j: int, w: dict[str, float]) -> float:
        """The span's score apart from its closing."""
        x = math.log(max(self.stop[j] - self.begin[i], 1) / USUAL) / SPREAD
        return sum(w[f] for f in self.features(i, j)) - LENGTH * (1 - math.exp(-x * x / 2))

    def spans(self, cuts: list[int]) -> list[tuple[int, int]]:
        return list(zip([self.begin[0], *(self.begin[k + 1] for k in cuts)], [*(self.stop[k] for k in cuts), self.stop[-1]], strict=True))

    def counts(self, cuts: list[int]) -> Counter:
        """Features of a division, for training."""
        out = Counter(self.kind[k] for k in cuts)
        out["unbalanced"] = sum(self.depth[k] for k in cuts)
        for i, j in zip([0, *(k + 1 for k in cuts)], [*cuts, len(self.kind)], strict=True):
            out.update(self.features(i, j))
        return out


def _owes(text: str, a: int, opener: int, nxt: int, gap: bool) -> str | None:
    """How the words after a quotation may belong to it: a feature, 'speech' if they do once they name a speaker, or None."""
    o = text[nxt]
    if not gap and o in "とっ":
        return "attribution"
    k = opener
    while k > a and text[k - 1].isspace():
        k -= 1
    if k > a and text[k - 1] not in END + CLOSE + '"':
        return None  # the words before it have introduced it
    if o.islower():
        return "attribution"
    if o in "“\"«「『„":
        return None
    return "speech"


def blocks(text: str) -> Iterator[Block]:
    at = 0
    for a, b in [*((m.start(), m.end()) for m in BLANK.finditer(text)), (len(text), len(text))]:
        s, e = at, a
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            yield Block(text, s, e)
        at = b


def spans(text: str, weights: dict[str, float] = WEIGHTS) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end)."""
    return [x for b in blocks(text) for x in b.spans(b.cuts(weights))]


def local_spans(text: str, weights: dict[str, float] = WEIGHTS) -> list[tuple[int, int]]:
    """What cutting at every end of positive closing would give, without whole spans: for comparison."""
    return [x for b in blocks(text) for x in b.spans([k for k, (c, d) in enumerate(zip(b.kind, b.depth, strict=True)) if weights[c] + weights["unbalanced"] * d > 0])]


def fit(labelled: list[tuple[str, list[tuple[int, int]]]], start: dict[str, float] | None = None, rounds: int = 10) -> dict[str, float]:
    """Weights trained on texts and their sentences (start, end) by the averaged structured perceptron.

    start: weights to begin with (default: none of any class speaks for or against an end). At most
    MAX_LABELLED texts. Sentences that no candidate ends teach nothing.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled texts")
    w = dict.fromkeys(WEIGHTS, 0.0) | (start or {})
    total, n = Counter(), 0
    data = [(b, [k for k, e in enumerate(b.stop[:-1]) if e in ends]) for text, sents in labelled for ends in [{e for _, e in sents}] for b in blocks(text)]
    for _ in range(rounds):
        for b, gold in data:
            got = b.cuts(w)
            if got != gold:
                for f, x in b.counts(gold).items():
                    w[f] += x
                for f, x in b.counts(got).items():
                    w[f] -= x
                for f in SPAN_FEATURES:
                    w[f] = min(w[f], 0.0)
            total.update(w)
            n += 1
    return {f: total[f] / n for f in w} if n else w


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, sent_no, start_pos, end_pos of every sentence. weights: a result of `fit`."""
    w = WEIGHTS if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, lo, hi = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for i, (s, e) in enumerate(spans(t, w) if t else (), 1):
                    rows.append(r)
                    no.append(i)
                    lo.append(s)
                    hi.append(e)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (no, lo, hi))], names=["doc_id", "sent_no", "start_pos", "end_pos"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.filter("text is not null and text <> ''").mapInArrow(run, ROW)
