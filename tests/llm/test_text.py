"""Lexicon encoding, leakage and sentences against brute force, and the defined edge cases."""

import os
import random

import pytest

from tarmac.llm import leakage, lexicon, sentences

DOC = "doc_id long, text string, lang string, ids string, sent_no int, item_id long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in enumerate(texts)], DOC)


ODD = [None, "", " ", "\n\n \t", "a", "😡" * 3, "<|endoftext|> x", "x" * 70_000, " ".join(f"w{i}" for i in range(30_000)), "ก" * 20_000, "日本語の文。" * 500, "é ﬁ ­ ​", "a\r\nb", " ", "don't I'LL 12,3", "a b", "a b"]


def test_ids_like_the_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    rnd = random.Random(4)
    some = ["".join(rnd.choice("ab c'\n .!ñ日ก😡1é\t") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts = ODD + some
    for words in (0, 50, 5000):
        got = {r.doc_id: list(r.ids) for r in lexicon.encode(docs(spark, texts), lexicon_words=words).collect()}
        assert got == {i: (tk.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts)}
    assert lexicon.encode(docs(spark, []).limit(0)).count() == 0
    nulls = docs(spark, ["a b"]).selectExpr("cast(null as long) as doc_id", "text")
    assert [(r.doc_id, list(r.ids)) for r in lexicon.encode(nulls).collect()] == [(None, tk.encode("a b").ids)]


def test_transducer_holds_exactly_its_words(tmp_path):
    with open(os.path.join(lexicon.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = lexicon.ranks_of(f.read())
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))).encode() for _ in range(4000)} | {b" walking", b" talking", b" walked", b" talked"})
    entries = {w: lexicon.merge(w, ranks) for w in words}
    data = lexicon.compile_lexicon(entries)
    path = tmp_path / "lex.bin"
    path.write_bytes(data)
    lex = lexicon.Lexicon.mapped(str(path))
    assert all(lex.get(w) == ids for w, ids in entries.items())
    assert all(lex.get(w + b"zz") is None and lex.get(w[:-1] + b"\xff") is None for w in words[:500])
    rows = [*words[::7], b"", b"zzz", b" walkin", b"\xff" * 9]
    held, size, ids = lex.walk(rows, lex.tables())
    at = 0
    for w, h, n in zip(rows, held, size, strict=True):
        assert h == (w in entries) and ids[at : at + n].tolist() == (entries[w] if h else [])
        at += n
    empty = lexicon.Lexicon(lexicon.compile_lexicon({}))
    assert not empty.walk([b"a", b"bc"], empty.tables())[0].any()
    assert lex.get(b"") is None and lexicon.Lexicon(lexicon.compile_lexicon({})).get(b"a") is None
    assert len(lex.final) < sum(map(len, words)) / 2  # suffixes are shared


def test_leaks_like_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(40)), rnd.choice([3, 20, 35, 50])) for i in range(40)] + [(90, "too short", 50), (91, None, 5), (None, "abc" * 40, 5), (92, "abc" * 40, None), (93, "", 1), (94, "q", 1)]
    texts = list(ODD)
    for _ in range(150):
        _, p, m = rnd.choice(items[:40])
        a = rnd.randint(0, 100)
        part = p[a : a + rnd.choice([m - 3, m, m + 12, 90])]
        styled = rnd.choice([str.upper, lambda s: s.replace(" ", " - "), lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in s), lambda s: s.replace("e", "e­")])(part)
        texts.append(" ".join(word() for _ in range(rnd.randint(0, 60))) + " " + styled + " " + " ".join(word() for _ in range(rnd.randint(0, 60))))
    it = spark.createDataFrame([(*r, "s", 7) for r in items], "item_id long, passage string, min_run int, suite string, doc_id long")
    got = [tuple(r) for r in leakage.found(docs(spark, texts), it.union(it)).collect()]
    want = set()
    for d, t in enumerate(texts):
        s = leakage.normalise(t)
        for i, p, m in items:
            n = leakage.normalise(p)
            if i is not None and m and any(n[k : k + m] in s for k in range(len(n) - m + 1)):
                want.add((d, i))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert leakage.found(docs(spark, []).limit(0), it).count() == 0 and leakage.found(docs(spark, texts[:5]), it.limit(0)).count() == 0


def test_rank_blocks_and_parts_lose_nothing(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i, "".join(rnd.choice("abcdefghijklmnop ") for _ in range(150)), 30) for i in range(30)]
    items.append((77, "".join(rnd.choice("abcdefghijklmnop ") for _ in range(3000)), 40))
    texts = ["zz " * 30 + p[40:85] + " yy" * 30 for _, p, _ in items] + [items[-1][1][a : a + 55] for a in range(0, 2900, 97)]
    it = spark.createDataFrame(items, "item_id long, passage string, min_run int")
    base = leakage.scored(docs(spark, texts), it).collect()
    want = {(r.doc_id, r.item_id) for r in base if r.leaked}
    assert len(want) >= 60
    few = leakage.scored(docs(spark, texts), it, rank=2).collect()
    assert {(r.doc_id, r.item_id) for r in few if r.leaked} == want
    full = leakage.scored(docs(spark, texts), it, rank=64).collect()
    # the latent space decides how much is searched: the more it holds, the fewer candidates
    assert sum(r.candidates for r in full) < sum(r.candidates for r in few)
    monkeypatch.setattr(leakage, "BLOCK", 700)
    monkeypatch.setattr(leakage, "PART", 300)
    assert {tuple(r) for r in leakage.found(docs(spark, texts), it).collect()} == want


def test_latent_basis_is_nearly_the_best(spark):
    np = leakage.np
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 200)) * 5 + rng.standard_normal((60, 200)) * 0.1
    rows = [(i, 0, 8, j * 7919, float(dense[i, j])) for i in range(60) for j in range(200)]
    df = spark.createDataFrame(rows, "item_id long, part int, n int, gram long, idf double").repartition(4, "item_id", "part").sortWithinPartitions("item_id", "part", "gram")
    got = sorted(leakage.latent(df, 8).collect(), key=lambda r: r.gram)
    basis = np.stack([np.frombuffer(r.z, "<f4") for r in got]).astype(float)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-3)
    best = (np.linalg.svd(dense, compute_uv=False)[:8] ** 2).sum()
    assert ((dense @ basis) ** 2).sum() > 0.999 * best


def test_paraphrases_are_found(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.randint(5, 9)))
    items = [(i, " ".join([*(word() for _ in range(12)), f"K{rnd.randint(1000, 9999)}", *(word() for _ in range(12))]), 60) for i in range(40)]
    texts, want = [], set()
    for i, p, _ in items:
        words = p.split()
        texts.append(" ".join(w if k % 6 != 5 else word() for k, w in enumerate(words)))  # every sixth word told otherwise
        want.add((len(texts) - 1, i))
        texts.append(" ".join(word() for _ in range(25)))  # nothing of it
        texts.append(" ".join(w if w[0] != "K" else "K77" for w in " ".join(words[::-1]).split()))  # other order, other code
    it = spark.createDataFrame(items, "item_id long, passage string, min_run int")
    got = {(r.doc_id, r.item_id) for r in leakage.paraphrases(docs(spark, texts), it).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_common_order():
    assert leakage.lcs_length("abcbdab", "bdcaba") == 4 and leakage.lcs_length("", "a") == 0
    assert leakage.common_run("xxhellozz", "ahellob", 5) and not leakage.common_run("hello", "help", 4)


CASES = [
    ("Depth was approx. 8.13 cm, i.e. well above the 5.9 cm seen in 2024. It rained; the contractor left.", 2),
    ('"Was this lane ever resurfaced?" asked Prof. E. L. Nettleworth. Loss went NaN at epoch 7.', 2),
    ("“It is not a crack,” said Ms. Ruskstead, “it is a joint.” Too many ruts again?!", 2),
    ('He wrote in the log: "The seam opened again."\tI\'d call it noise.', 2),
    ("Traffic was opened again at 9:48 a.m. The patch lasted 10 days, not 43 weeks!", 2),
    ("1. Nobody knows why it drifted\nin strong glare...but it did. 2. What happened at km 5.46?", 2),
    ("It was opened at 9:02 a.m. 4. Please fix it!", 2),
    ("Results vs. baseline\n \nThe U.S. guide differs.", 2),
    ("Die Tiefe beträgt ca. 7,8 cm, d. h. mehr als im Vorjahr. Am 23. März 2024 kamen Meldungen aus Zenncroft usw. und blieben offen.", 2),
    ("„Ist das ein Längsriss?“, fragte die Prüferin. Dr. Yarldale prüfte z. B. die Abschnitte.", 2),
    ("Proč se nic neopravilo?Ing. Yarlbury zkontroloval 99 snímků, např. a_1.png, a nic nenašel. Dne 20. 5. 2025 byla nalezena trhlina.", 3),
    ("El tramo se cerró a las 6:31 p. m. por obras. «¿Cuándo van a arreglarlo?», preguntó un vecino.", 2),
    ("「横ひび割れではない！影だ。」と検査員は書いている。カメラが止まり……その後の枚は黒い。", 2),
    ("“这不是裂缝。这是接缝。”检查员写道。相机停了……之后的图全是黑的。", 2),
    ('डॉ. Aldermere ने 58 तस्वीरें जाँचीं। गहराई 5.9 से.मी. है। "यहाँ गड्ढा हो गया!" एक दुकानदार ने कहा।', 3),
    ('فحص د. Elskstead نحو 58 صورة. "متى تصلحون الطريق؟" سأل سائق من Wendby. هل هذا شق؟', 3),
    ("พบรอยแตก ทีมวัดได้ 5.3 เซนติเมตร กล้องหยุดทำงานและภาพ 26 ภาพหายไป\nต่อ", 3),
]


@pytest.mark.parametrize("text,n", CASES)
def test_sentences_of_many_scripts(text, n):
    got = sentences.spans(text)
    assert len(got) == n, [text[a:b] for a, b in got]


def test_spans_cover_the_text_and_edge_cases(spark):
    rnd = random.Random(11)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "B", ".", "!", "?", " ", "\n", "\n\n", "“", "”", '"', "(", ")", "1", "。", "ก", "Dr", " ", "...", "「", "」"]) for _ in range(rnd.randint(0, 40)))
        at = 0
        for a, b in sentences.spans(t):
            assert at <= a < b and not t[at:a].strip() and t[a:b] == t[a:b].strip()
            at = b
        assert not t[at:].strip()
    rows = sentences.found(docs(spark, ODD + ["One. Two."])).collect()
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append((r.sent_no, r.start_pos, r.end_pos))
    assert not set(per) & {0, 1, 2, 3} and sorted(per[len(ODD)]) == [(1, 0, 4), (2, 5, 9)]
    assert sentences.found(docs(spark, []).limit(0)).count() == 0
    nulls = docs(spark, ["One. Two."]).selectExpr("cast(null as long) as doc_id", "text")
    assert [r.doc_id for r in sentences.found(nulls).collect()] == [None, None]
