"""The semi-Markov program against all divisions, its weights from labelled texts, and what only whole spans tell."""

import itertools
import random

from tarmac.llm import sentences

WHOLE = [
    "Depth was approx. 8.1 cm, i.e. above the 5.9 cm of last year.", '"Was this lane ever sealed?" asked Prof. E. L. Marsh.', "It rained; the crew left.", "“Stop here!” someone on Mill Lane shouted, and the van braked.",
    "Traffic was opened again at 9:48 a.m.", "The U.S. guide and the Dutch guide differ.", "See Fig. 4 and Sec. 2 for the rest, e.g. the ones with slurry.", "Dr. A. Voss and Ms. K. Lind labelled sheet D1 twice.",
    "Die Tiefe beträgt ca. 7,8 cm, d. h. mehr als im Vorjahr.", "Am 4. März 2024 kamen Meldungen aus Kiel usw. und blieben offen.", "„Ist das ein Riss?“, fragte die Prüferin.", "Dr. Zorn prüfte z. B. die Abschnitte 5 bis 9.",
    "El tramo se cerró a las 6:31 p. m. por obras.", "«¿Cuándo van a arreglarlo?», preguntó un vecino.", "Ing. Novák zkontroloval 99 snímků, např. a_1.png, a nic nenašel.", "Dne 20. 5. 2025 byla nalezena trhlina.",
    "Version v0.2.5 drops rows without label.", "Why does it score 0.4 here but 0.9 elsewhere?", "The patch lasted 10 days, not 43 weeks!",
    '"متى تصلحون الطريق؟" سأل سائق من هنا.', '"यहाँ गड्ढा हो गया!" एक दुकानदार ने कहा।', "“路面又塌了！”街上的居民说。",
]


def joined(rnd, n):
    text, ends = "", []
    for k in range(n):
        text += (" " if text else "") + rnd.choice(WHOLE)
        ends.append(len(text))
    return text, [(0, e) for e in ends]


def test_cuts_like_all_divisions():
    rnd = random.Random(3)
    parts = ["Ab", "cd", ". ", "! ", "? ", ".", "“", "”", '"', " ", "1. ", "said ", "Dr. ", "etc. ", "a.m. ", "x", "Yz", "... ", "。", "「", "」", "(", ")"]
    w = sentences.WEIGHTS
    seen = 0
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(3, 30)))
        for b in sentences.blocks(t):
            n = len(b.kind)
            if n > 8:
                continue

            def value(cuts, b=b, n=n):
                ends = [*cuts, n]
                return sum(w[b.kind[k]] + w["unbalanced"] * b.depth[k] for k in cuts) + sum(b.score(i, j, w) for i, j in zip([0, *(k + 1 for k in cuts)], ends, strict=True))

            best = max(value(c) for r in range(n + 1) for c in itertools.combinations(range(n), r))
            assert abs(value(b.cuts(w)) - best) < 1e-9, t
            seen += n > 1
    assert seen > 1000


def test_whole_spans_decide():
    rnd = random.Random(5)
    texts = [joined(rnd, 6) for _ in range(200)]
    ends = lambda spans: [e for _, e in spans]
    assert sum(ends(sentences.spans(t)) == ends(g) for t, g in texts) == 200
    assert sum(ends(sentences.local_spans(t)) == ends(g) for t, g in texts) < 150


def test_a_speaker_may_be_far_away():
    far = "that old " * 60
    assert len(sentences.spans(f'"Is it a crack?" The woman from {far}house said. It rained.')) == 2
    assert len(sentences.spans(f'"Is it a crack?" The woman from {far}house left. It rained.')) == 3


def test_line_breaks_of_two_characters():
    assert len(sentences.spans("It rained in\r\nthe night.\r\nThe crew left.\r\n \r\nOpen points\r\n\r\nNone.")) == 4


def test_no_word_is_too_long():
    assert len(sentences.spans("Seen at " + "x" * 300 + ". It rained.")) == 2
    assert len(sentences.spans(" ".join(["x" * 100_000 + "."] * 3 + ["It rained."]))) >= 1
    assert sentences.spans("A.A" * 200_000)  # linear without a gap


def test_weights_from_labelled_texts():
    rnd = random.Random(7)
    learn, held = [joined(rnd, 5) for _ in range(400)], [joined(rnd, 5) for _ in range(200)]
    w = sentences.fit(learn, rounds=5)
    hits = made = true = 0
    for t, g in held:
        got, want = {e for _, e in sentences.spans(t, w)}, {e for _, e in g}
        hits, made, true = hits + len(got & want), made + len(got), true + len(want)
    assert hits / made > 0.99 and hits / true > 0.99
    assert w["title"] < w["stop"] and w["attribution"] < 0 < w["strong"]
