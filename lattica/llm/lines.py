"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words; lines of one set are a class, whose place is its first occurrence. Words are ordered by
rarity: by how much of the corpus their hash bucket holds (in steps of the square root of two, counted over all
documents), then by hash; any order that all lines share gives an exact join. Of two sets of Jaccard similarity t or more, the
larger has the first word that both share among its first n - ceil(t n) + 1, the smaller among its first
n - ceil(2 t n / (1 + t)) + 1 (prefix filter). Lengths, the places of that word and 128 parity bits bound what they can share
at most; 256 parity bits of the words, read again from the lines, bound it closer. What is left is verified on the words' 64-bit hashes.

Classes that share rare words with many others form families. A family's core are the words that most of its classes
have; a class is the core but for its edits. Most links within a family follow from the numbers of edits alone and are counted
without making pairs; the rest share edits and meet by these. Families only say how links are found, never which: whatever the
core, all pairs of similar classes are found, also within large groups. A line is removed if an earlier one is similar; each
class has the number of its links to other classes besides.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release, small_join, stage

_BITS = 17
_BUCKETS = 1 << _BITS
_LEVELS = 5  # bits of a rank that hold a word's rarity
_NONE = -(1 << 63)  # stands for a null doc_id
_ID_BITS = 46  # bits of a class's id; a family's number stands above them in postings
_PLACE = ["d", "th", "line"]


def _spaced(text: F.Column) -> F.Column:
    """text with a space for each other blank but the newline, so that words stand between spaces."""
    odd = F.lit(False)
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _split(spaced: F.Column) -> F.Column:
    return F.array_remove(F.split(spaced, " "), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, th, text): d is the doc_id, least of all if null; th, the text's hash, tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE).cast("long")).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """rows(d, th, text) to (d, th, line, t): the lines with words; t has spaces for blanks."""
    lines = rows.select("d", "th", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "t"))
    return lines.where(F.trim("t") != "")


@contextmanager
def _fast_map_bits(spark: SparkSession, bits: int):
    """While it is open, sums by a number are kept in the fast map of generated code up to 1 << bits groups, not 1 << 16."""
    key = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(bits))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _shares(docs: DataFrame) -> list[int]:
    """For each bucket of word hashes a level from 0 to 31: 16 and twice the binary logarithm of how many times the mean it holds."""
    spaced = F.replace(_spaced(F.col("text").cast("string")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(spaced, " ")).alias("w")).where("w <> ''")
    counts = words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - _BITS).alias("b")).groupBy("b").count()
    with _fast_map_bits(docs.sparkSession, _BITS):
        counts = stage(counts, "shares")
    mean = (counts.agg(F.sum("count")).first()[0] or 0) / _BUCKETS
    table = [0] * _BUCKETS
    # A row for each bucket at most; empty ones stay at 0.
    top = (1 << _LEVELS) - 1
    for b, n in counts.collect():
        table[b] = max(0, min(top, (top + 1) // 2 + math.floor(2 * math.log2(n / mean))))
    discard(counts)
    return table


def _ranks(spaced: F.Column, table: list[int]) -> F.Column:
    """The sorted set of a line's words: each is its level before the rest of its hash."""
    levels = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # a constant: folded before it runs
    hashes = F.array_distinct(F.transform(_split(spaced), lambda x: F.xxhash64(x)))
    # Levels are shifted here: the JVM shares its objects of small numbers, so that the table stays in a core's cache. What is
    # never null is sorted as plain numbers.
    own = lambda x: F.coalesce(F.get(levels, F.shiftrightunsigned(x, 64 - _BITS).cast("int")), F.lit(0).cast("long"))
    level = lambda x: F.call_function("shiftleft", own(x), F.lit(63 - _LEVELS))
    return F.sort_array(F.transform(hashes, lambda x: level(x).bitwiseOR(F.shiftrightunsigned(x, 1 + _LEVELS))))


def line_classes(docs: DataFrame, table: list[int], num: int = 4, den: int = 5) -> DataFrame:
    """One row for each distinct set of words: id (any number of its own), d, th, line (where it first stands), n (size),
    prefix (its first words by rarity), sig and sig2 (parity bits), key (the two words of least hash in a prefix of four or more)."""
    rows = _lines(_keyed(docs)).select("d", "th", "line", _ranks(F.col("t"), table).alias("w"))
    size = F.size("w")
    prefix = F.slice("w", 1, size - F.floor((size * num + den - 1) / F.lit(den)).cast("int") + 1)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # The low bits of a rank are all hash: six pick the parity bit, the next one the half.
    half = lambda b: F.filter("w", lambda x: x.bitwiseAND(F.lit(64)) == b)
    parity = lambda b: F.aggregate(half(b), zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    # A hash, the size and 128 parity bits tell sets apart.
    keyed = rows.select(F.xxhash64("w").alias("k"), size.alias("n"), parity(0).alias("sig"), parity(64).alias("sig2"), F.struct("d", "th", "line", prefix.alias("prefix")).alias("at"))
    first = keyed.groupBy("k", "n", "sig", "sig2").agg(F.min("at").alias("at")).select("n", "sig", "sig2", "at.*")
    plain = F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << (63 - _LEVELS)) - 1)))
    key = F.when(F.size("prefix") >= 4, F.xxhash64(F.slice(F.sort_array(plain), 1, 2)))
    return stage(first.withColumn("key", key).withColumn("id", F.monotonically_increasing_id()), "classes")


def _joined(classes: DataFrame, least: int) -> DataFrame:
    """(id, g): classes by family, numbered from the largest; those of no family are left out.

    A family is nominated by least classes or more whose prefixes have the same two words of least hash: the rarest words
    of near copies are often their edits. Its classes have half of the words, and three at least, that half of the
    nominated ones have in their prefixes.
    """
    keyed = classes.where("key IS NOT NULL").select("id", "prefix", "key")
    hot = keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    hot = hot.withColumn("g", F.row_number().over(Window.orderBy(F.desc("m"), "key")).cast("long"))
    # Numbers beyond the bits in a posting: such classes meet by pairs like those of no family.
    hot = stage(hot.where(F.col("g") < 1 << (63 - _ID_BITS)), "hot")
    words = small_join(keyed, hot, ["key"]).select("g", "m", F.explode("prefix").alias("word"))
    words = words.groupBy("g", "m", "word").agg(F.count("*").alias("c")).where(F.col("c") * 2 >= F.col("m"))
    words = words.select("word", "g", F.count("*").over(Window.partitionBy("g")).alias("of"))
    words = stage(words, "words")
    met = small_join(keyed.select("id", F.explode("prefix").alias("word")), words, ["word"], max_rows=500_000)
    met = met.groupBy("id", "g", "of").agg(F.count("*").alias("c")).where("c >= 3 and 2 * c >= of")
    out = stage(met.groupBy("id").agg(F.min("g").alias("g")), "joined")
    discard(hot, words)
    return out


def families(classes: DataFrame, docs: DataFrame, num: int = 4, den: int = 5, least: int = 24) -> DataFrame:
    """(id, g, at, x, room, edits): the classes similar to their family's core, and the hashes of the words that they have or
    lack beyond it. Two classes of a family are similar if x + x' <= room + (num + den) * (number of edits that both have)."""
    joined = _joined(classes, least)
    wanted = stage(small_join(classes.select("id", *_PLACE), joined, ["id"], max_rows=500_000), "wanted")
    found, one = _first_lines(wanted, docs)
    sets = stage(one.select("id", "g", F.struct(*_PLACE).alias("at"), _hashes().alias("w")), "family_sets")
    sizes = sets.groupBy("g").agg(F.count("*").alias("m"))
    words = sets.select("g", F.explode("w").alias("word")).groupBy("g", "word").agg(F.count("*").alias("c"))
    core = words.join(sizes, "g").where(F.col("c") * 2 > F.col("m")).groupBy("g").agg(F.collect_list("word").alias("core"))
    lacks, has = F.array_except("core", "w"), F.array_except("w", "core")
    own = sets.join(core, "g").select("id", "g", "at", lacks.alias("lacks"), has.alias("has"), ((den - num) * F.size("core")).alias("room"))
    own = own.select("id", "g", "at", (F.size("lacks") * den + F.size("has") * num).alias("x"), "room", F.concat("lacks", "has").alias("edits"))
    out = stage(own.where(F.col("x") <= F.col("room")), "families")
    discard(joined, wanted, found, sets)
    return out


def _edit_pairs(own: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of families() that are similar for edits that both have: they meet by the least of these."""
    side = lambda p: own.select("g", F.explode("edits").alias("e"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "at", "x", "edits")), F.col("room").alias(f"{p}_room"))
    over = F.col("a_x") + F.col("b_x") - F.col("a_room")
    few = F.least(F.size("a_edits"), F.size("b_edits")) * (num + den)
    common = F.array_intersect("a_edits", "b_edits")
    both = side("a").join(side("b"), ["g", "e"])
    return both.where((F.col("a_id") < F.col("b_id")) & (over > 0) & (few >= over) & (F.size(common) * (num + den) >= over) & (F.array_min(common) == F.col("e")))


def _family_links(own: DataFrame, num: int, den: int) -> DataFrame:
    """families() to (id, d, th, line, links, gone) within families, in several rows for a class."""
    # Similar whatever their edits: counted by x.
    steps = own.groupBy("g", "x").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    steps = steps.groupBy("g").agg(F.collect_list(F.struct("x", "n", "first")).alias("steps"))
    near = F.filter("steps", lambda s: s.x + F.col("x") <= F.col("room"))
    within = own.join(steps, "g").select("id", "at", "x", "room", near.alias("near"))
    count = F.aggregate("near", F.lit(0).cast("long"), lambda a, s: a + s.n) - F.when(F.col("x") * 2 <= F.col("room"), 1).otherwise(0)
    within = within.select("id", "at.*", count.alias("links"), F.exists("near", lambda s: s.first < F.col("at")).cast("int").alias("gone"))
    both = _edit_pairs(own, num, den)
    ends = both.select(F.explode(F.array(_end("a_id", "a_at", "b_at"), _end("b_id", "b_at", "a_at"))).alias("e"))
    return within.union(ends.select("e.id", "e.at.*", F.lit(1).cast("long"), "e.later"))


def _end(of: str, at: str, other: str) -> F.Column:
    return F.struct(F.col(of).alias("id"), F.col(at).alias("at"), (F.col(at) > F.col(other)).cast("int").alias("later"))


def candidate_pairs(classes: DataFrame, num: int = 4, den: int = 5, own: DataFrame | None = None) -> DataFrame:
    """(a, b), ids of classes that pass the prefix, length, position and parity filters; each pair once, a is the larger set.
    Pairs within one of the families own(id, g) are left out."""
    if own is not None:
        classes = small_join(classes, own.select("id", "g"), ["id"], "left", 500_000)
        above = F.call_function("shiftleft", F.coalesce("g", F.lit(0).cast("long")), F.lit(_ID_BITS))
        classes = classes.withColumn("id", above.bitwiseOR(F.col("id")))
    # The smaller set's side has fewer words, and so rows of its own: far fewer of both meet.
    fewer = F.slice("prefix", 1, F.col("n") - F.floor((F.col("n") * (2 * num) + (num + den - 1)) / F.lit(num + den)).cast("int") + 1)
    large = _postings(classes, F.col("prefix"))
    small = _postings(classes, fewer).select("word", *(F.col(x).alias(f"b_{x}") for x in ("id", "np", "sig", "sig2")))
    size = lambda p: F.shiftright(F.col(p + "np"), 32)
    place = lambda p: F.col(p + "np").bitwiseAND(F.lit(0xFFFFFFFF))
    na, nb = size(""), size("b_")
    ordered = (nb < na) | ((nb == na) & (F.col("b_id") < F.col("id")))
    # What both share is t / (1 + t) of both sizes together at least; no more than reach is left from the word on.
    reach = F.least(na - place(""), nb - place("b_"))
    differ = F.bit_count(F.col("sig").bitwiseXOR(F.col("b_sig"))) + F.bit_count(F.col("sig2").bitwiseXOR(F.col("b_sig2")))
    apart = F.lit(True)
    if own is not None:
        apart = (F.col("id") < 1 << _ID_BITS) | (F.col("id").bitwiseXOR(F.col("b_id")) >= 1 << _ID_BITS)
    # Cheap and telling conditions first: they are tried in this order.
    bounds = (nb * den >= na * num) & (differ * (num + den) <= (na + nb) * (den - num)) & (reach * (num + den) >= (na + nb) * num)
    both = large.join(small, "word").where((nb <= na) & bounds & ordered & apart)
    low = F.lit((1 << _ID_BITS) - 1 if own is not None else -1).cast("long")
    return both.select(F.col("id").bitwiseAND(low).alias("a"), F.col("b_id").bitwiseAND(low).alias("b")).distinct()


def _postings(classes: DataFrame, prefix: F.Column) -> DataFrame:
    """A row for each class and word of its prefix: word, id, np (size and the word's place), sig, sig2; nothing is null."""
    posting = classes.select(F.posexplode(prefix).alias("pos", "word"), "id", "n", "sig", "sig2")
    size_place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    # Saying that nothing here is ever null keeps filters for nulls out.
    sure = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    return posting.select(sure(F.col("word"), "word"), sure(F.col("id"), "id"), sure(size_place, "np"), sure(F.col("sig"), "sig"), sure(F.col("sig2"), "sig2"))


def _hashes() -> F.Column:
    """The set of the words of t, by 64-bit hashes."""
    return F.array_distinct(F.transform(_split(F.col("t")), lambda x: F.xxhash64(x)))


def _first_lines(wanted: DataFrame, docs: DataFrame, most_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """The lines of docs where wanted(id, d, th, line, ...) stand, with their text t: the stage, and one of its rows for each id."""
    rows = _keyed(docs)
    # Rows of 28 bytes each, 36 with a family: most_rows bounds what is broadcast.
    if wanted.limit(most_rows + 1).count() <= most_rows:
        rows = rows.join(F.broadcast(wanted.select("d").distinct()), "d", "left_semi")
        found = _lines(rows).join(F.broadcast(wanted), _PLACE)
    else:
        found = _lines(rows).join(wanted, _PLACE)
    found = stage(found.withColumn("u", F.monotonically_increasing_id()), "found")
    # Rows of docs that repeat give a line more than once: the first by number stands for all.
    return found, small_join(found, found.groupBy("id").agg(F.min("u").alias("u")).select("u"), ["u"], "left_semi", most_rows)


def _parities(sets: DataFrame) -> DataFrame:
    """sets(id, t) to (id, n, s0 to s3): the number of a line's words and 256 bits, each the parity of the words dealt to it."""
    words = sets.select("id", F.explode(F.array_distinct(_split(F.col("t")))).alias("x")).select("id", F.xxhash64("x").alias("h"))
    slot = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(3))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    parts = [F.bit_xor(F.when(slot == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(4)]
    return words.groupBy("id").agg(F.count("*").alias("n"), *parts)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int, own: DataFrame | None = None) -> DataFrame:
    """For each class in pairs(a, b) that are similar, or in own of families(): id, d, th, line, links (number of similar
    classes) and gone (whether one of them stands earlier). Words are read again from the lines where the classes first stand, and compared by 64-bit hashes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stage(classes.select("id", "d", "th", "line").join(ids, "id", "left_semi"), "wanted")
    found, one = _first_lines(wanted, docs)
    parities = stage(_parities(one), "parities")
    near = pairs
    for p in ("a", "b"):
        near = near.join(parities.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "s0", "s1", "s2", "s3"))), p)
    differ = sum(F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(4))
    both = F.col("a_n") + F.col("b_n")
    near = stage(near.where(differ * (num + den) <= both * (den - num)).select("a", "b"), "near")
    sets = one.join(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    sets = stage(sets.select("id", F.struct(*_PLACE).alias("at"), _hashes().alias("w")), "sets")
    side = lambda p: sets.select(F.col("id").alias(p), F.col("at").alias(f"{p}_at"), F.col("w").alias(f"{p}_w"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_w", "b_w"))
    similar = both.where(common * (num + den) >= (F.size("a_w") + F.size("b_w")) * num)
    ends = similar.select(F.explode(F.array(_end("a", "a_at", "b_at"), _end("b", "b_at", "a_at"))).alias("e"))
    ends = ends.select("e.id", "e.at.*", F.lit(1).cast("long").alias("links"), F.col("e.later").alias("gone"))
    if own is not None:
        ends = ends.union(_family_links(own, num, den))
    out = stage(ends.groupBy("id", *_PLACE).agg(F.sum("links").alias("links"), F.max("gone").alias("gone")), "similar")
    discard(wanted, found, parities, near, sets)
    return out


def kept_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(d, th, kept, links) for the texts where a class first stands: the numbers (from 0) of the lines that stay of those
    with words, and (line, n) for each line that is the first of a class with n > 0 links to similar classes.

    A line stays if none of the lines before it (smaller doc_id, th, line) has a set of words of Jaccard similarity
    num / den or more; all lines are judged on the input. d is the doc_id, th the text's hash: rows that repeat a doc_id and
    text are one document.
    """
    classes = line_classes(docs, _shares(docs), num, den)
    release(docs.sparkSession)
    # An id too large for the bits that postings give it (more than 8,192 tasks): all classes meet by pairs.
    own = families(classes, docs, num, den) if classes.where(F.col("id") >= 1 << _ID_BITS).isEmpty() else None
    pairs = stage(candidate_pairs(classes, num, den, own), "pairs")
    release(docs.sparkSession)
    linked = _verified(pairs, classes, docs, num, den, own)
    discard(pairs, *([own] if own is not None else []))
    release(docs.sparkSession)
    rows = classes.select("d", "th", "line", F.lit(None).cast("long").alias("links"), F.lit(0).alias("gone"))
    rows = rows.union(linked.select("d", "th", "line", "links", "gone"))
    every = rows.groupBy("d", "th").agg(F.collect_list(F.struct("line", "links", "gone")).alias("e"))
    of = lambda keep, out: F.transform(F.filter("e", keep), out)
    kept = F.array_except(of(lambda x: x.links.isNull(), lambda x: x.line), of(lambda x: x.gone == 1, lambda x: x.line))
    links = of(lambda x: x.links > 0, lambda x: F.struct(x.line.alias("line"), x.links.alias("n")))
    return every.select("d", "th", kept.alias("kept"), F.sort_array(links).alias("links"))


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_lines, n_removed, removed (numbers of the removed lines),
    links ((line, n): a line where a class first stands, which is the class's id, and its number of similar classes, if any).

    Lines without words always stay. Null texts have no lines; empty ones have one, without words. Null doc_ids stand
    before all others. Texts are read whole, however long; rows that repeat doc_id and text are one document and give
    equal rows; of equal lines the earliest stays. An empty table gives no rows. Other columns are not read.
    """
    kept = kept_lines(docs, num, den)
    rows = _keyed(docs).select("d", "th", F.split(_spaced(F.col("text")), "\n").alias("t"))
    full = F.filter(F.transform("t", lambda x, i: F.when(F.trim(x) != "", i)), lambda x: x.isNotNull())
    rows = rows.select("d", "th", F.coalesce(full, F.array().cast("array<int>")).alias("full"), F.when(F.col("t").isNull(), 0).otherwise(F.size("t")).cast("long").alias("n_lines"))
    both = rows.join(kept, ["d", "th"], "left")
    removed = F.array_except("full", F.coalesce("kept", F.array().cast("array<int>")))
    doc_id = F.when(F.col("d") != F.lit(_NONE).cast("long"), F.col("d"))
    return both.select(doc_id.alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), F.coalesce("links", F.array().cast("array<struct<line:int,n:bigint>>")).alias("links"))
