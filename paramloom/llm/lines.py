"""Line dedup by an exact set-similarity join. DataFrame functions only.

A line is the set of its lower-cased words. Lines stand in the order of doc_id (nulls first), then of the text's hash
where a doc_id repeats, then of their place; a line is removed if an earlier line of the whole table has a Jaccard
similarity of 0.8 or more to it, whether or not that one is removed as well.

Lines of equal word sets are one class (grouped with map-side combining, by a 64-bit hash of the words' sorted 64-bit
hashes and, up to SPELT words, one of the sorted words). For the others,
tokens are ordered by rarity: by how often their hash slot (65,536 of them, a fixed bound) occurs in all distinct lines
(in classes, eight to a doubling), then by the token. Two lines of similarity t share one of their first n - ceil(t n) + 1 tokens, and of the shorter one's
first m - ceil(2t / (1 + t) m) + 1; postings of those are joined under the length, the positional and a 128-bit parity
filter, a 256-bit one follows (all exact). Tokens with many postings first meet their earliest line only (a star, not
all pairs); lines which that removes need no more partners. Tokens with very many are dealt into parts.

Words stand as 32-bit hashes where pairs are searched: words that share one only add pairs. The pairs left over are
verified on the words themselves, read again from the documents that hold them.

Defined cases: null and empty texts have no lines to remove and stay as they are; lines without words stay; rows equal
in doc_id and text are one document and keep the same lines; a text whose lines all go becomes empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, few, materialize

SLOTS = 1 << 16
#: postings of a token up to which its lines are simply joined, and from which on they are dealt into parts of so many
FEW, SPLIT = 16, 8192
#: distinct words up to which a second hash of the words themselves tells sets apart
SPELT = 8
#: rows of a few longs up to which a side is broadcast after counting it; beyond, both sides are shuffled
BROADCAST_ROWS = 1_000_000
#: writer's options for columns of hashes, for which dictionaries are made in vain
HASHES = {"parquet.enable.dictionary": "false"}


def words(line: Column) -> Column:
    """Distinct words of a line, whose white space is spaces, in order."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(line), " "), "")))


def _lines(numbered: DataFrame, bits: int) -> DataFrame:
    """(id, line) of every line, white space as spaces; numbered: _doc, text."""
    text = F.col("text").cast("string")
    other = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    plain = F.when(other, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)
    # outer: else the optimizer adds a filter that splits each text again; split never gives an empty array
    lines = numbered.where("text is not null").select("_doc", F.posexplode_outer(F.split(plain, "\n")).alias("place", "line"))
    return lines.select(F.shiftleft("_doc", bits).bitwiseOR(F.col("place")).alias("id"), "line")


def _numbered(docs: DataFrame) -> tuple[DataFrame, Column, int]:
    """docs with the order number _doc of each row, and the bits that places take in a line's id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low, high, most, rows, ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length(text)), F.count(F.lit(1)), F.count("doc_id")).first()
    bits = max(1, int(most or 0).bit_length())  # a text has no more line breaks than bytes
    if rows == ids and (rows == 0 or high - low < 1 << (62 - bits)):
        repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
        if not repeats:
            return docs.withColumn("_doc", F.col("doc_id").cast("long") - F.lit(low or 0)), bits
    # repeated, missing or far-flung ids: dense numbers by (doc_id, text hash)
    keyed = docs.withColumn("_key", F.xxhash64(text, F.lit(11)))
    keys = keyed.select("doc_id", "_key").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "_key").select("doc_id", "_key", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("i"))
    keys = materialize(keys, "order")
    sizes = sorted((r["p"], r["n"]) for r in keys.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    starts, at = {}, 0
    for p, n in sizes:
        starts[p], at = at, at + n
    begin = F.element_at(F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s))]), F.col("p")) if starts else F.lit(0)
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), (begin + F.col("i")).cast("long").alias("_doc"))
    return keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))).drop("_id", "_k", "_key"), bits


def removed_lines(docs: DataFrame) -> DataFrame:
    """(_doc, place) of every line that goes; docs: _doc, text, and bits as by _numbered."""
    numbered, bits = docs
    lines = _lines(numbered, bits)
    plain = F.array_remove(F.split(F.lower("line"), " "), "")
    # sorted as 64-bit hashes, which are primitives; short sets, of which many differ in one word, are told by the words too
    hashes = F.sort_array(F.array_distinct(F.transform(plain, lambda w: F.xxhash64(w))))
    sets = lines.where(F.ltrim("line") != "").select("id", "line", hashes.alias("h"))  # a filter on h would build it twice
    # the words of short sets are split once more, so that no row carries the words of all
    spelt = F.when(F.size("h") <= SPELT, F.xxhash64(F.lit(5), words(F.col("line")))).otherwise(F.xxhash64(F.lit(5), "h"))
    sets = sets.select("id", F.transform("h", lambda h: F.hash(h)).alias("t"), F.size("h").cast("int").alias("n"), F.xxhash64("h").alias("s1"), spelt.alias("s2"))
    sets = materialize(sets, "lines", **HASHES)
    # lines of equal word sets: all but the first go
    firsts = sets.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s1", "s2", "first")
    firsts = materialize(firsts, "firsts")
    hint = F.broadcast(firsts) if few(firsts, BROADCAST_ROWS) else firsts
    same = materialize(sets.select("id", "s1", "s2").join(hint, ["s1", "s2"]).where("id <> first").select("id"), "same")
    hint = F.broadcast(same) if few(same, BROADCAST_ROWS) else same
    near = _near(sets.select("id", "n", "t").where("n >= 4").join(hint, "id", "left_anti"), numbered, bits)
    discard(sets, firsts)
    gone = same.unionByName(near)
    return gone.select(F.shiftright("id", bits).alias("_doc"), F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("place"))


def _near(sets: DataFrame, numbered: DataFrame, bits: int) -> DataFrame:
    """id of each set that an earlier one (smaller id) is similar to."""
    slot = F.col("x").bitwiseAND(F.lit(SLOTS - 1))
    counts = sets.select(F.explode_outer("t").alias("x")).groupBy(slot.alias("slot")).count()
    class_ = [_class(0)] * SLOTS
    for r in counts.collect():  # SLOTS rows at most
        class_[r["slot"]] = _class(r["count"])
    table = F.expr(f"cast(split('{','.join(map(str, class_))}', ',') as array<bigint>)")
    # by the slot's class, then by the token as a signed number: the lower 32 bits stay the token's
    ranked = lambda x: F.shiftleft(F.get(table, x.bitwiseAND(F.lit(SLOTS - 1))), 32) + x.cast("bigint")
    rare = F.sort_array(F.transform("t", lambda x: F.coalesce(ranked(x), F.lit(0).cast("bigint"))))  # never null: sorted as primitives
    # prefix: n - ceil(0.8 n) + 1
    length = F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1
    # parities of the tokens' counts by 128 hash slots, even and odd ones together and odd ones alone: they differ in
    # no more slots than the sets in tokens; a token's slot is its sign and its lowest six bits, which a shift takes alone
    odd = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.shiftrightunsigned(x, 31).cast("bigint"), x)))
    maps = [_parity("t").alias("map0"), odd.alias("map1")]
    # written a row a set, and multiplied as it is read; outer, as above: no prefix is empty
    held = materialize(sets.select("id", "n", *maps, F.slice(rare, 1, length).alias("prefix")), "postings", **HASHES)
    posts = held.select("id", "n", "map0", "map1", F.posexplode_outer("prefix").alias("i", "token"))
    posts = posts.select(F.col("token").bitwiseAND(F.lit(0xFFFFFFFF)).cast("bigint").alias("token"), "id", "n", "i", "map0", "map1")
    sizes = posts.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    hot = materialize(sizes.where(F.col("k") > FEW), "hot")
    small = few(hot, BROADCAST_ROWS)
    hot_ = F.broadcast(hot) if small else hot
    # both sides of the light join read one shuffle, as in _crossed
    light = posts.join(hot_.select("token"), "token", "left_anti").where(_known(posts.columns)).repartition("token")
    heavy = posts.join(hot_, "token") if small else materialize(posts.join(hot_, "token"), "heavy")
    star = materialize(heavy.where("id = first").select(*posts.columns), "star")
    star_ = F.broadcast(star) if small else star
    found = _verified(_candidates(posts if small else heavy, star_).unionByName(_candidates(light, light)).distinct(), sets, numbered, bits)
    rest = _crossed(heavy.where(F.col("k") <= SPLIT), found)
    giant = hot.where(F.col("k") > SPLIT).limit(1).count()
    if giant:
        rest = rest.unionByName(_crossed(heavy.where(F.col("k") > SPLIT), found, F.ceil(F.col("k") / SPLIT)))
    more = _verified(rest.distinct(), sets, numbered, bits)
    discard(held, hot, star, *([] if small else [heavy]))
    return found.unionByName(more).distinct()


def _class(count: int) -> int:
    """A count as one of 256 classes, eight to a doubling: small numbers, of which the JVM keeps one object each, so that the table stays in cache."""
    return min(255, int(8 * math.log2(count + 1))) - 128


def _known(columns: list[str]) -> str:
    """The condition that no column is null, which joins infer for either side: stated before a shuffle that both share."""
    return " and ".join(f"{c} is not null" for c in columns)


def _crossed(heavy: DataFrame, found: DataFrame, parts: Column | None = None) -> DataFrame:
    """Candidates (id, partner) among the postings of a token whose later line is not in found.

    The longer line's whole prefix meets the first tokens of the shorter one. With parts, a token's longer lines are dealt
    and its shorter ones go to each part.
    """
    few_ = few(found, BROADCAST_ROWS)
    lost = found.select("id", F.lit(0).alias("zero"))
    lost = F.broadcast(materialize(lost, "lost")) if few_ else lost
    columns = ["token", "id", "n", "i", "map0", "map1"]
    # shorter lines: m - ceil(8/9 m) + 1 tokens
    least = F.col("n") - F.floor((8 * F.col("n") + 8) / 9).cast("int") + 1
    if parts is None:
        # both sides read one shuffle: the conditions that the join infers for either stand here for both
        dealt = heavy.select(*columns).where(_known(columns)).repartition("token").join(lost, "id", "left")
        longer = dealt.withColumn("part", F.lit(0))
        # zero keeps this filter above the shuffle that both sides read
        shorter = dealt.where(F.col("i") + F.coalesce("zero", F.lit(0)) < least).withColumn("part", F.lit(0))
        keys = ["token"]
    else:
        dealt = heavy.withColumn("parts", parts.cast("int")).join(lost, "id", "left")
        longer = dealt.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
        shorter = dealt.where(F.col("i") < least).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["token", "part"]
    a = longer.select(*columns, "part", F.col("zero").isNotNull().alias("lost"))
    b = shorter.select("token", "part", F.col("id").alias("partner"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("map0").alias("other0"), F.col("map1").alias("other1"), F.col("zero").isNotNull().alias("gone"))
    order = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("partner") < F.col("id")))
    wanted = F.when(F.col("id") > F.col("partner"), ~F.col("lost")).otherwise(~F.col("gone"))
    found = a.join(b.drop("part") if parts is None else b, keys).where((5 * F.col("m") >= 4 * F.col("n")) & order & _fits() & wanted)
    return found.select(F.greatest("id", "partner").alias("id"), F.least("id", "partner").alias("partner"))


def _parity(hashes: Column | str) -> Column:
    """Parities of the hashes' counts by 64 slots (the lowest six bits)."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))


def _share(hashes: Column | str, bits: int, q: int) -> Column:
    """The hashes whose bits from the sixth on are q, as many of them as `bits`."""
    return F.filter(hashes, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit((1 << bits) - 1)) == q)


def _fits() -> Column:
    """Length, positional and parity filter on lines of n and m tokens that share the i-th of one and the j-th of the other."""
    low, high = F.least("n", "m"), F.greatest("n", "m")
    # overlap needed: 4/9 (n + m); at most what both have from this token on, and what both have before it
    fits = (5 * low >= 4 * high) & (9 * (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + F.least("i", "j")) >= 4 * (F.col("n") + F.col("m")))
    # n + m - 2 * overlap >= slots that differ
    whole, odd = F.col("map0").bitwiseXOR(F.col("other0")), F.col("map1").bitwiseXOR(F.col("other1"))
    return fits & (9 * (F.bit_count(odd) + F.bit_count(whole.bitwiseXOR(odd))) <= F.col("n") + F.col("m"))


def _candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs (id, partner), partner < id, that share a prefix token and pass the filters."""
    b = earlier.select("token", F.col("id").alias("partner"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("map0").alias("other0"), F.col("map1").alias("other1"))
    return later.select("token", "id", "n", "i", "map0", "map1").join(b, "token").where((F.col("partner") < F.col("id")) & _fits()).select("id", "partner")


def _verified(pairs: DataFrame, sets: DataFrame, numbered: DataFrame, bits: int) -> DataFrame:
    """Distinct ids of pairs whose Jaccard similarity is at least 0.8, by their words: 9 * overlap >= 4 * (n + m)."""
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("id", "partner")).alias("id")).distinct(), "wanted")
    some = sets.select("id", "t").join(F.broadcast(wanted) if few(wanted, BROADCAST_ROWS) else wanted, "id", "left_semi")
    # long sets differ in most of 128 slots anyway: 256 slots decide about them before their words are read
    maps = [_parity(_share("t", 2, q)) for q in range(4)]
    marks = materialize(some.select("id", F.size("t").alias("n"), *[m.alias(f"m{q}") for q, m in enumerate(maps)]), "marks")
    small = few(marks, BROADCAST_ROWS)
    other = marks.select(F.col("id").alias("partner"), F.col("n").alias("m"), *[F.col(f"m{q}").alias(f"o{q}") for q in range(4)])
    apart = sum((F.bit_count(F.col(f"m{q}").bitwiseXOR(F.col(f"o{q}"))) for q in range(4)), F.lit(0))
    near = pairs.join(F.broadcast(marks) if small else marks, "id").join(F.broadcast(other) if small else other, "partner")
    close = materialize(near.where(9 * apart <= F.col("n") + F.col("m")).select("id", "partner"), "close")
    # the words of these lines, read from their documents
    ids = materialize(close.select(F.explode(F.array("id", "partner")).alias("id")).distinct(), "ids")
    small = few(ids, BROADCAST_ROWS)
    docs = ids.select(F.shiftright("id", bits).alias("_doc")).distinct()
    held = _lines(numbered.join(F.broadcast(docs) if small else docs, "_doc", "left_semi"), bits).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    said = materialize(held.select("id", words(F.col("line")).alias("w")).dropDuplicates(["id"]), "words")
    a, b = said, said.select(F.col("id").alias("partner"), F.col("w").alias("u"))
    overlap = F.size(F.array_intersect("w", "u"))
    found = close.join(a, "id").join(b, "partner").where(9 * overlap >= 4 * (F.size("w") + F.size("u"))).select("id").distinct()
    found = materialize(found, "found")
    discard(pairs, wanted, marks, close, ids, said)
    return found


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs with their texts' kept lines, and lines, removed: how many lines there were and went."""
    numbered, bits = _numbered(docs)
    lost = materialize(removed_lines((numbered, bits)), "removed")
    small = few(lost, BROADCAST_ROWS)
    gone = materialize(lost.groupBy("_doc").agg(F.collect_set("place").alias("_gone")), "gone")
    out = numbered.join(F.broadcast(gone) if small else gone, "_doc", "left")
    all_ = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(all_, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone_n = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    out = out.withColumns({"_text": text, "lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(all_)).cast("long"), "removed": gone_n.cast("long")})
    columns = [F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, "lines", "removed")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "text", "lines", "removed")
