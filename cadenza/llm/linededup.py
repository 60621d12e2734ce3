"""Operator 8, line dedup by an exact set-similarity join.

A line's tokens are its distinct words; lines without a word take no part.  Two lines match when the Jaccard similarity of
their token sets is at least ``PERCENT`` percent; of matching lines the later
one (by doc_id, text hash, line number) is removed.

1. Token counts over all texts, folded into ``2 ** BUCKET_BITS`` hash buckets, give one
   order of all tokens, rare ones first.  Any common order makes the join
   exact; the counts make it cheap.
2. Lines with equal token sets fold into one class, so a line that is repeated
   very often is one row in the join.
3. A class sends its rarest tokens (its prefix) to the join: two sets over the
   threshold share a token of their prefixes.  The join condition holds the
   length filter, the positional filter (what is left after the shared token
   must suffice for the overlap) and a parity sketch of 64 or 128 bits, which differs
   in at most as many bits as the sets differ in tokens, so it rejects no match.
4. Tokens that very many classes share (large groups of near copies) are
   joined with a share of them first, then with larger shares for what is still
   unmatched; a line needs only one earlier match.
5. The pairs left are verified on the words themselves, read again from the
   few lines that the pairs name; they travel as text.

Everything is built-in column functions.  The bucket counts and the filters of
wanted texts and lines are arrays of bounded size; every shuffle is of narrow rows; all
joins are plain equi-joins that Spark may split where a key is hot.

Edge cases: null and empty texts have no line; a null doc_id comes last in the
order (doc_ids are below 2 ** 62); rows with the same doc_id and text are one
document and share their fate (texts over 2 ** 24 lines are out of range); an
empty table gives no rows; other columns, whatever their names, are kept by
``dedup`` and ignored by ``removed_lines``."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import WS, saved

PERCENT, MIN_TOKENS = 80, 1
BUCKET_BITS = 18
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 14, 1 << 18  # 64 bits each
# a token shared by more classes than this is compared by hubs first
HOT = 512
LONG = 100  # lines with more tokens than this get 128 bits of parity
NO_ID = 1 << 62  # places from here on are of texts without doc_id


def _texts(docs: DataFrame) -> DataFrame:
    t = F.col("text").cast("string")
    return docs.select(_first_place(), t.alias("text"), F.xxhash64(t).alias("h")).where("text IS NOT NULL AND text <> ''")


def _first_place() -> Column:
    other = F.xxhash64(F.lit(1), F.col("text").cast("string")).bitwiseAND(F.lit(NO_ID - 1).cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), other.bitwiseOR(F.lit(NO_ID).cast("long"))).alias("p1")


def _by_slot(rows: DataFrame, slot: str, value: Column, n: int) -> Column:
    """``value`` aggregated per slot 0 to n - 1 as one array, for use in expressions."""
    found = rows.groupBy(slot).agg(value.alias("x"))
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias(slot))
    filled = every.join(found, slot, "left").select(slot, F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(slot, "x"))), lambda s: s["x"])
    return filled.agg(listed.alias("x")).scalar()


def _words(line: str = "line") -> Column:
    """Words of ``line``, with empty strings between repeated separators.  A
    line whose only white space is the space takes the cheap split."""
    other = reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"))
    return F.when(other, F.split(line, WS)).otherwise(F.split(line, " "))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def _token_order(docs: DataFrame) -> Column:
    """Rarity class (0 the rarest, up to 126) of each hash bucket, as a
    constant array: at most ``2 ** BUCKET_BITS`` counts reach the driver."""
    # lines end at a word's end: the text is cut into words at once
    words = _texts(docs).select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")).select(F.explode(_words()).alias("w"))
    # four buckets a row: a quarter of the groups, which a task's table holds at less cost
    b = words.select(_bucket(F.xxhash64("w")).alias("b"))
    counts = b.groupBy(F.shiftright("b", 2).alias("slot")).agg(*[F.count_if(F.col("b").bitwiseAND(F.lit(3)) == i) for i in range(4)])
    classes = ["0"] * (1 << BUCKET_BITS)
    for slot, *four in counts.collect():
        classes[4 * slot:4 * slot + 4] = [str(int(2 * math.log2(max(n, 1)))) for n in four]
    return F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>")


def _line_rows(docs: DataFrame, percent: int) -> DataFrame:
    """Per line its place, set size, class key, prefix and parity sketch."""
    order = _token_order(docs)
    line = _lines(_texts(docs))

    def packed(h: Column) -> Column:
        # the class in the top bits, so that sorting the longs is sorting by rarity
        # without nulls by its type, so that arrays of it are sorted as plain longs
        rarity = F.coalesce(F.get(order, _bucket(h)).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(rarity, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(_words(), lambda w: F.xxhash64(w))
    distinct = F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))
    # no filter here: Spark would push it below and build the tokens twice
    tokens = line.select("p1", "p2", F.sort_array(F.transform(distinct, packed)).alias("s"))
    s, n = F.col("s"), F.size("s")

    def parity(half: bool) -> Column:
        def flip(a: Column, x: Column) -> Column:
            flipped = a.bitwiseXOR(_one_bit(x))
            return F.when(x.bitwiseAND(F.lit(64).cast("long")) != 0, flipped).otherwise(a) if half else flipped
        return F.aggregate(s, F.lit(0).cast("long"), flip)

    kept = F.greatest(n - F.floor((n * percent + 99) / 100).cast("int") + 1, F.lit(0))
    built = tokens.select(
        "p1", "p2", n.alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64(n, "s").alias("k2"),
        F.transform(F.slice("s", 1, kept), _short_token).alias("prefix"), parity(False).alias("par"),
        F.when(n > LONG, parity(True)).otherwise(F.lit(0).cast("long")).alias("par1"))
    # 128 bits in two halves for long lines; the halves' xor is the 64 bits of a short one
    return built.select("p1", "p2", "n", "k1", "k2", "prefix", F.col("par").bitwiseXOR(F.col("par1")).alias("par0"), "par1")


def _short_token(x: Column) -> Column:
    """32 bits of a token: 7 of its rarity class, 25 of its hash."""
    return (F.shiftright(x, 31) - (1 << 31)).cast("int")


def _lines(texts: DataFrame) -> DataFrame:
    """Place and text of every line.  A place is the doc_id (for null a second
    hash of the text, above all ids) and the text's hash (40 bits) with the line
    number: later lines compare greater."""
    split = texts.select("p1", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.select("p1", F.shiftleft("h", 24).bitwiseOR(F.col("line_no").cast("long")).alias("p2"), "line")


def _one_bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _prefix_rows(classes: DataFrame) -> DataFrame:
    """One row per class and prefix token.  ``meta`` packs the set's size, the
    tokens from this one on, and whether the class is still open."""
    meta = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft((F.col("n") - F.col("i")).cast("long"), 1)) \
            .bitwiseOR(F.col("open").cast("long"))
    return classes.select("p1", "p2", "n", "par0", "par1", "open", F.posexplode("prefix").alias("i", "token")) \
                  .select("token", "p1", "p2", meta.alias("meta"), "par0", "par1")


def _candidates(earlier: DataFrame, later: DataFrame, percent: int) -> DataFrame:
    """Places of classes that share a prefix token and pass all filters, the
    later one still open.  (That is the lowest bit of ``meta``; asked of both sides
    at once, it leaves a self-join one shuffle.)"""
    na, nb = "shiftright(a.meta, 32)", "shiftright(b.meta, 32)"
    left = f"least(a.meta & {(1 << 32) - 1}L, b.meta & {(1 << 32) - 1}L) div 2"
    on = F.expr(f"""a.token = b.token AND (a.p1 < b.p1 OR a.p1 = b.p1 AND a.p2 < b.p2) AND (a.meta & 1) + 2 * (b.meta & 1) >= 2
        AND 100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})
        AND ({left}) * {100 + percent} >= {percent} * ({na} + {nb})
        AND CASE WHEN least({na}, {nb}) > {LONG} THEN bit_count(a.par0 ^ b.par0) + bit_count(a.par1 ^ b.par1)
            ELSE bit_count(a.par0 ^ a.par1 ^ b.par0 ^ b.par1) END * {100 + percent} <= {100 - percent} * ({na} + {nb})
        """)
    return earlier.alias("a").join(later.alias("b"), on).select(
        F.col("a.p1").alias("a1"), F.col("a.p2").alias("a2"), F.col("b.p1").alias("b1"), F.col("b.p2").alias("b2")).distinct()


def _filter_words(keys: int) -> int:
    """Words of a filter of so many keys: about 16 bits a key, within bounds."""
    return min(max(1 << (keys // 4).bit_length(), FILTER_WORDS), MOST_FILTER_WORDS)


def _seen(rows: DataFrame, key: Column, n: int) -> Callable[[Column], Column]:
    """A test that holds for every value of ``key`` in ``rows`` and few others: one bit per value in ``n`` words."""
    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(n - 1).cast("long")).cast("int")

    def bit(x: Column) -> Column:
        return _one_bit(F.shiftright(x, 20))
    words = _by_slot(rows.select(place(key).alias("slot"), bit(key).alias("bit")), "slot", F.bit_or("bit"), n)
    return lambda x: words[place(x)].bitwiseAND(bit(x)) != 0


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that match on their words, with the similarity."""
    wanted = saved(pairs.select(F.col("a1").alias("p1"), F.col("a2").alias("p2")).unionByName(
        pairs.select(F.col("b1").alias("p1"), F.col("b2").alias("p2"))).distinct(), "wanted-lines")
    # texts that hold a wanted line, and then lines, by a bit per hash; the join decides
    n = _filter_words(wanted.count())
    h = F.shiftright("p2", 24)
    held = _seen(wanted, h, n)(F.shiftright(F.shiftleft("h", 24), 24))
    own = _seen(wanted, F.xxhash64("p1", "p2"), n)(F.xxhash64("p1", "p2"))
    # rows with the same doc_id and text are one document: their lines are equal
    lines = _lines(_texts(docs).where(held)).where(own).join(wanted, ["p1", "p2"]).dropDuplicates(["p1", "p2"])
    # whole lines travel, cut into words where a pair meets: as text they take a fraction of the room of arrays
    lines = saved(lines.select("p1", "p2", "line"), "wanted-texts")

    def matching(some: DataFrame) -> DataFrame:
        """Per later line the first of its pairs that match."""
        both = some.join(lines.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("line").alias("a")), ["a1", "a2"]) \
                   .join(lines.select(F.col("p1").alias("b1"), F.col("p2").alias("b2"), F.col("line").alias("b")), ["b1", "b2"])
        sets = both.select("a1", "a2", "b1", "b2", *[F.array_remove(F.array_distinct(_words(x)), "").alias(x) for x in "ab"])
        common = sets.select("a1", "a2", "b1", "b2", F.size(F.array_intersect("a", "b")).alias("c"),
                             (F.size("a") + F.size("b")).alias("total"))
        union = F.col("total") - F.col("c")
        # no filter: Spark would push it below and build the words twice
        match = F.min(F.when(F.col("c") * 100 >= union * percent, F.struct("a1", "a2", (-F.col("c") / union).alias("minus")))).alias("m")
        return common.groupBy("b1", "b2").agg(match).where("m IS NOT NULL").select("b1", "b2", "m.*")

    # nearly every line matches the earliest line that passed the filters; the others try all of theirs
    earliest = pairs.groupBy("b1", "b2").agg(F.min(F.struct("a1", "a2")).alias("a")).select("a.*", "b1", "b2")
    most = saved(matching(earliest), "earliest-matches")
    rest = matching(pairs.join(most.select("b1", "b2"), ["b1", "b2"], "left_anti"))
    return most.unionByName(rest).select(F.col("b1").alias("p1"), F.col("b2").alias("p2"), "a1", "a2", "minus")


def _settled_by_hubs(docs: DataFrame, classes: DataFrame, percent: int, hot: int) -> DataFrame | None:
    """Matches of classes that share a token with more than ``hot`` others.
    Such classes are compared with every 512th, 64th and 8th of them first
    (by hash), those still unmatched each time; so a large group of near
    copies settles in few comparisons and not in all pairs."""
    # so many classes have a token only if its rarity class is that high
    least = (int(2 * math.log2(hot)) << 25) - (1 << 31)
    tokens = classes.select(F.explode("prefix").alias("token")).where(F.col("token") >= least) \
                    .groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot)
    tokens = saved(tokens, "hot-tokens")
    most = tokens.agg(F.max("k")).first()[0]
    if most is None:
        return None
    rows = saved(_prefix_rows(classes).join(tokens.select("token"), "token"), "hot-rows")
    found = None
    for share in (512, 64, 8):
        if share * 32 > most:
            continue  # so few hubs would settle little
        hubs = rows.where(F.pmod(F.xxhash64("p2", "p1"), F.lit(share)) == 0)
        later = rows if found is None else rows.join(found.select("p1", "p2"), ["p1", "p2"], "left_anti")
        more = _verified(docs, saved(_candidates(hubs, later, percent), "hub-pairs"), percent)
        found = saved(more if found is None else found.unionByName(more), "settled")
    return found


def _removed(docs: DataFrame, percent: int, min_tokens: int, hot: int) -> DataFrame:
    """Per removed line its place, n_tokens, the place of an earlier line that it
    matches (``m1, m2``), and their similarity."""
    lines = saved(_line_rows(docs, percent), "lines").where(F.col("n") >= min_tokens)
    classes = saved(lines.groupBy("k1", "k2").agg(
        F.min(F.struct("p1", "p2", "n", "par0", "par1", "prefix")).alias("c"), F.count(F.lit(1)).alias("members"))
        .select("k1", "k2", "members", "c.*"), "line-classes").withColumn("open", F.lit(1))
    settled = _settled_by_hubs(docs, classes, percent, hot)
    if settled is not None:
        classes = classes.drop("open").join(settled.select("p1", "p2", F.lit(0).alias("open")), ["p1", "p2"], "left") \
                         .withColumn("open", F.coalesce("open", F.lit(1)))
    rows = _prefix_rows(classes)
    links = _verified(docs, saved(_candidates(rows, rows, percent), "line-pairs"), percent)
    if settled is not None:
        links = links.unionByName(settled)
    # of a class the first line goes if it matches an earlier class, the others always
    linked = classes.select("k1", "k2", "members", F.col("p1").alias("f1"), F.col("p2").alias("f2")) \
        .join(links.select(F.col("p1").alias("f1"), F.col("p2").alias("f2"), "a1", "a2", "minus"), ["f1", "f2"], "left") \
        .where("members > 1 OR a1 IS NOT NULL")
    placed = lines.select("k1", "k2", "n", "p1", "p2").join(saved(linked, "matched-classes"), ["k1", "k2"])
    match1, match2 = F.coalesce("a1", "f1"), F.coalesce("a2", "f2")
    return placed.where("p1 <> f1 OR p2 <> f2 OR a1 IS NOT NULL").select(
        "p1", "p2", F.col("n").alias("n_tokens"), match1.alias("m1"), match2.alias("m2"),
        F.coalesce(-F.col("minus"), F.lit(1.0)).alias("jaccard")).distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS, hot: int = HOT) -> DataFrame:
    """One row per removed line: doc_id, h (40 bits of the text's hash),
    line_no (from 0), n_tokens, an earlier line that it matches, and their
    similarity."""
    return _removed(docs, percent, min_tokens, hot).select(
        _doc_id(F.col("p1")).alias("doc_id"), F.shiftrightunsigned("p2", 24).alias("h"), _line_no(F.col("p2")).alias("line_no"),
        "n_tokens", _doc_id(F.col("m1")).alias("match_doc_id"), _line_no(F.col("m2")).alias("match_line_no"), "jaccard")


def _doc_id(p1: Column) -> Column:
    return F.when(p1 < F.lit(NO_ID).cast("long"), p1)


def _line_no(p2: Column) -> Column:
    return p2.bitwiseAND(F.lit((1 << 24) - 1).cast("long")).cast("int")


def dedup(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; every row and column
    stays, and ``n_chars``, where there is one, is counted anew."""
    gone = _removed(docs, percent, min_tokens, HOT).groupBy("p1", F.shiftrightunsigned("p2", 24).alias("h")).agg(
        F.collect_set(_line_no(F.col("p2"))).alias("gone"))
    # the row's own columns stay together under one name, so none can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _first_place(),
                       F.shiftrightunsigned(F.shiftleft(F.xxhash64(F.col("text").cast("string")), 24), 24).alias("h"))
    joined = rows.join(gone, ["p1", "h"], "left")
    lines = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    cut = {"text": F.array_join(lines, "\n")}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.length(cut["text"]).cast(docs.schema["n_chars"].dataType)
    own = lambda c: F.col("row").getField(c)
    return joined.select(*[F.when(F.col("gone").isNull(), own(c)).otherwise(cut[c]).alias(c) if c in cut else own(c).alias(c)
                           for c in docs.columns])
