"""Decontamination against alignment of every text with every item; repeated
windows whatever their hashes."""

import random
import re

import pyarrow as pa
import pytest

from cadenza.llm import decontaminate as D
from cadenza.llm import quality

_RNG = random.Random(21)
POOL = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru sa te vi wo".split() for b in "ran lit mos ket dun far".split()]


def _words(n):
    return [_RNG.choice(POOL) for _ in range(n)]


JA = "これは漢字と仮名を混ぜて書いた空白のない問題文であり全部で三十六字より長いものである"
TH = "ข้อความภาษาไทยไม่มีการเว้นวรรคระหว่างคำในประโยค"
ITEMS = {1: " ".join(_words(30)), 2: " ".join(_words(120)), 3: " ".join(_words(7)), 4: JA, 5: " ".join(_words(3)), 6: "two words",
         7: " ".join(_words(500)), 8: TH, 9: "", 10: None, 11: " ".join(_words(15))}


def _edited(text, every):
    w = text.split()
    for i in range(every // 2, len(w), every):
        w[i] = "changed"
    return " ".join(w)


def _inside(text):
    return " ".join(_words(60)) + ". " + text + ", " + " ".join(_words(60))


DOCS = {
    1: _inside(ITEMS[1].upper()), 2: _inside(" ".join(ITEMS[2].split()[40:90])), 3: _inside(ITEMS[3]), 4: "前置き。" + JA + "。後書き",
    5: _inside(ITEMS[5]), 6: _inside("two words"), 7: _inside(" ".join(ITEMS[7].split()[100:300])), 8: TH,
    9: _inside(_edited(ITEMS[1], 9)), 10: _inside(_edited(ITEMS[2], 12)), 11: _inside(" ".join(ITEMS[3].split()[:6])),
    12: _inside(" ".join(ITEMS[2].split()[:20])), 13: "", 14: None, 15: JA[:10] + "違" + JA[12:24], 16: _inside(_edited(ITEMS[11], 10)),
    **{i: _inside("") for i in range(20, 40)}}
FOUND = {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 7), (8, 8), (9, 1), (10, 2), (15, 4), (16, 11)}


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"),
            spark.createDataFrame(list(ITEMS.items()), "item_id long, text string"))


def test_matches_equal_alignment_of_all_pairs(tables):
    docs, bench = tables
    got = {(r.doc_id, r.item_id): r.score for r in D.matches(docs, bench).collect()}
    assert FOUND <= set(got)
    items = {i: D.word_hashes(pa.array([t], pa.string()))[0] for i, t in ITEMS.items()}
    wanted = {}
    for d, text in DOCS.items():
        words = D.word_hashes(pa.array([text], pa.string()))[0]
        for i, item in items.items():
            if len(item) >= D.N and len(words):
                best = int(D.smith_waterman([words], [item])[0][0])
                if D.accepted(best, len(item), D.MIN_SCORE):
                    wanted[d, i] = best / (D.MATCH * len(item))
    assert got == pytest.approx(wanted)
    assert {d for d, _ in got}.isdisjoint(range(20, 40))


def test_leaking_rows_go(tables):
    docs, bench = tables
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} == set(DOCS) - {d for d, _ in FOUND}


def test_words_of_unspaced_scripts_are_characters():
    texts = ["ab漢字cd ef", "plain", None, "ไทย x", "a漢", "漢"]
    words = D.Words()
    for _ in range(2):
        h, at = words(pa.array(texts))
        want = [D._hash(x) for t in texts for x in re.findall(r"[a-z]+|[漢字ไทย]", t or "")]
        assert h.tolist() == want and at.tolist() == [0, 5, 6, 6, 10, 12, 13]


def test_edited_copies_are_found(spark):
    """One word in eight changed at random, in 200 documents: at least nine in ten are found."""
    rng = random.Random(9)
    items = [" ".join(_words(rng.randrange(15, 60))) for _ in range(50)]
    rows = []
    for i in range(200):
        w = items[i % 50].split()
        for j in rng.sample(range(len(w)), len(w) // 8):
            w[j] = rng.choice(POOL)
        rows.append((i, _inside(" ".join(w))))
    rows += [(1000 + i, _inside("")) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in D.matches(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(got & {(i, i % 50) for i in range(200)}) >= 180
    assert all(d < 1000 for d, _ in got)


def test_repeated_windows_whatever_their_hashes(spark):
    # the first words' hashes agree in their low 33 bits: one repeat does not hide the other
    text = "w450978 b c q1 w482540 b c q2 w450978 b c q3 w482540 b c q4"
    rows = [(1, text), (2, " ".join(text.split()[:8])), (3, "a a a a"), (4, "a b a b a b")]
    got = {r.doc_id: r.n_repeat_words for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 12, 2: 0, 3: 4, 4: 6}
