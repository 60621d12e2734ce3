"""Fill-in-middle, filter audit and fingerprints against brute force and edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import filter_audit, fim, sketch

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n string, form long, part long, digest string, "
          "sketch string, _at long, _next string, bits string, output long, edited string")
_RNG = random.Random(11)


def _words(n, pool=300):
    return " ".join(f"w{_RNG.randrange(pool)}" for _ in range(n))


SHARED = _words(250)
TEXTS = ["", " ", " \n\t ", "word", " lead and trail \n", "a b c", "é ü\tß\x0bx", "日本語のテキスト", "A B C D " * 40, "has <P> mark inside it",
         "x " * 4000, "q" * 50_000, "\n".join([SHARED] * 3), SHARED, SHARED, "#tag 50% of | all", "nbsp is a word here",
         *[_words(n) + " " + SHARED + " " + _words(n) for n in (3, 50, 200)], *[_words(30 * i + 1) for i in range(30)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i + 5, t, ["en", "fr", None][i % 3], "s") for i, t in enumerate(TEXTS)]
    rows += [(None, SHARED, "en", None), (None, SHARED, None, None), (900, None, "", "s"), (5, "", "en", "s"), (44, SHARED, "fr", "s"),
             (44, SHARED, "fr", "s"), (-7, SHARED, "en", "s"), (10 ** 15, "the last one of them all", "en", "s")]
    return spark.createDataFrame([(*r, "n", 1, 2, "d", "s", 3, "x", "b", 4, "e") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 1), (44, 1, 1), (44, 0, 0), (None, 1, 1), (-7, 1, None), (47, None, 1)],
                                 "doc_id long, quality int, toxic int")


def _rows(docs):
    return [(r.doc_id, r.text or "", r.lang or "") for r in docs.select("doc_id", "text", "lang").collect()]


# --- 11 ------------------------------------------------------------------------

def _fim(doc_id, text, rate=50):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, form, len(pre), len(mid), out


@pytest.mark.parametrize("rate", [50, 100])
def test_fim_equals_brute_force(docs, rate):
    made = fim.fill_in_middle(docs, rate=rate)
    got = [tuple(r) for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    wanted = [(i, *_fim(i, t, rate), t) for i, t, _ in _rows(docs)]
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("window,bits,longest", [(1, 1, 5), (2, 2, 7), (4, 3, 1000), (16, 8, 64), (16, 8, 16384)])
def test_fim_cuts_at_every_unit_whatever_the_chunks(window, bits, longest):
    texts = [t.encode() for t in TEXTS if len(t) < 9000]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    table = fim.ChunkTable(max_bytes=20_000)  # is emptied on the way
    for _ in range(2):
        cutter = fim.Cutter(data, at, table, window=window, bits=bits, longest=longest)
        for d, text in enumerate(texts):
            units = UNIT.findall(text.decode())
            assert cutter.units[d] == len(units)
            for u in {0, 1, 2, 3, len(units) // 2, len(units) - 1, len(units)} & set(range(len(units) + 1)):
                place, chars = cutter.cut(d, u)
                pre = "".join(units[:u])
                assert (place - at[d], chars) == (len(pre.encode()), len(pre))


def test_fim_chunks_follow_content():
    shared = SHARED.encode() * 4
    chunks = []
    for lead in (b"", b"something before ", _words(40).encode()):
        text = lead + shared
        b = fim.chunk_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()
        chunks.append({text[i:j] for i, j in zip(b[:-1], b[1:])})
    assert len(chunks[0] & chunks[1] & chunks[2]) >= 0.6 * len(chunks[0])
    run = np.full(100_000, 97, np.uint8)
    assert np.diff(fim.chunk_bounds(run, np.array([0, 100_000]))).max() <= fim.LONGEST


# --- 12 ------------------------------------------------------------------------

def _audit(rows, labels):
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    fails = []
    for i, t, lang in rows:
        w = WORD.findall(t)
        f = {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if any(j is not None and i is not None and j < i and u == t for j, u, _ in rows) else set()
        fails.append((i, lang, f))
    out = {}
    for part in {x[1] for x in fails}:
        mine = [x for x in fails if x[1] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                cut = [m for m in left if x in m[2]]
                left = [m for m in left if x not in m[2]]
                shapley[x] += len(cut)
                out[part, "".join(order), k + 1] = [
                    len(left), len(cut), sum(x in m[2] and bool(m[2] & set(order[:k])) for m in mine),
                    sum(m[2] == {x} for m in mine), sum(m[0] in good for m in cut), sum(m[0] in toxic for m in cut)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(docs, labels):
    counts = filter_audit.failures(docs, labels)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(counts).collect()}
    wanted = _audit(_rows(docs), [tuple(r) for r in labels.collect()])
    assert got == wanted
    assert len(got) == 600 * 3


def test_transducer_measures(docs):
    got = sorted((r.digest, r.n_words, r.n_distinct, r.n_capitals, r.n_points, r.n_symbols)
                 for r in filter_audit.measure(docs).collect())
    assert got == sorted((hashlib.sha256(t.encode()).digest(), len(WORD.findall(t)), len(set(WORD.findall(t))),
                          len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))) for _, t, _ in _rows(docs))


def test_audit_without_labels_or_rows(docs, labels, empty):
    assert filter_audit.audit(filter_audit.failures(empty, labels)).count() == 0
    none = filter_audit.audit(filter_audit.failures(docs, labels.limit(0)))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


# --- 13 ------------------------------------------------------------------------

def _sketch(text, k=sketch.K):
    w = WORD.findall(text)
    found = {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in found})[:k]


def _near(a, b, k=sketch.K):
    most = min(a[-1] if len(a) >= k else "g", b[-1] if len(b) >= k else "g")
    a, b = {h for h in a if h <= most}, {h for h in b if h <= most}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_fingerprints_equal_brute_force(spark, docs, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                       None if r.near_next is None else round(r.near_next, 9)) for r in sketch.fingerprints(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    named = sorted((r for r in _rows(docs) if r[0] is not None), key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest()))
    pairs = [(*r[:2], named[(i + 1) % len(named)][1]) for i, r in enumerate(named)]
    pairs += [(None, t, None) for i, t, _ in _rows(docs) if i is None]
    wanted = Counter()
    for i, t, after in pairs:
        half = len(t) // 2
        e = t[:len(t) - half] + (after or "")[:half]
        a, b = _sketch(t), _sketch(e)
        wanted[i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(a), "".join(b), round(_near(a, b), 9),
               None if after is None else round(_near(a, _sketch(after)), 9)] += 1
    assert got == wanted


def test_fingerprints_of_one_and_no_row(docs, empty):
    assert sketch.fingerprints(empty).count() == 0
    one = sketch.fingerprints(docs.where("doc_id = 900 OR doc_id IS NULL")).where("doc_id = 900").first()
    assert (one.fingerprint, one.near_edited, one.near_next, one.n_shingles) == ("", 1.0, 1.0, 0.0)
    alone = sketch.fingerprints(docs.where("doc_id = -7")).first()
    assert alone.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(5)
    words = [f"t{rng.randrange(10 ** 6)}" for _ in range(9000)]
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = df.select("a", "b", sketch.merged(F.col("a"), F.col("b")).alias("m"), sketch.resemblance(F.col("a"), F.col("b")).alias("j"),
                  sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.n_distinct(F.col("a")).alias("n"),
                  sketch.parts(sketch.digest(F.col("a"))).alias("again")).first()
    assert (r.a, r.b) == (_sketch(a), _sketch(b)) and r.again == r.a
    assert r.m == sorted(set(r.a) | set(r.b))[:sketch.K]
    assert abs(r.j - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.15 and abs(r.n / 5996 - 1) < 0.3


def test_group_sketches(docs):
    got = {r.lang: (r.sketch, r.n_distinct) for r in sketch.group_sketches(docs, "lang").collect()}
    rows = [(r.lang, r.text or "") for r in docs.select("lang", "text").collect()]
    for lang in {x for x, _ in rows}:
        every = sorted({h for x, t in rows if x == lang for h in _sketch(t, 10 ** 9)})
        assert got[lang][0] == every[:sketch.K]
        assert abs(got[lang][1] / max(len(every), 1) - 1) < 0.4 or not every


def test_fingerprints_use_no_python(docs):
    plan = sketch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
