"""I-Match fingerprints: hashes of a text's sorted distinct terms in several fixed, randomised subsets of a lexicon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import buckets_for, range_bucket
from .spans import let
from .store import settle

#: Runs of letters, in lower case.
TERM_GAP = r"[^\p{L}]+"
#: The lexicon's band: terms in this many documents at least, and in this share of them at most.
LEAST_DOCS, MOST_SHARE = 2, 0.05
#: Subsets of the lexicon: CHAINS of each density from 1 / 2^SPARSEST up to 1 / 2^DENSEST, the sparsest first. A term is in
#: the subset of density 1 / 2^l of chain c if l bits of its name, from bit STEP * c on, are 0; so a chain's subsets are
#: each part of the denser one, and a text's terms are sifted once more for each. Most terms are in no subset.
DENSEST, SPARSEST, CHAINS, STEP = 5, 10, 11, 5
#: Subsets that are compared: of those that have a term of either text, the sparsest.
COMPARED = 16
#: Rows of the lexicon, or sets with copies (16 bytes each), up to which they are broadcast; beyond that they are joined by a
#: shuffle.
BROADCAST_ROWS = 3_000_000

HASHES = (SPARSEST - DENSEST + 1) * CHAINS


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TERM_GAP), lambda t: t != ""))


def names(text: Column) -> Column:
    """The sorted names of a text's distinct terms: 62 bits of their hashes."""
    return F.sort_array(F.transform(terms(text), lambda t: F.shiftright(F.xxhash64(t), 2)))


def in_subset(x: Column) -> Column:
    """Whether a name is in a subset of any chain."""
    out = F.lit(False)
    for c in range(CHAINS):
        out = out | (x.bitwiseAND(F.lit(((1 << DENSEST) - 1) << (STEP * c)).cast("long")) == 0)
    return out


def lexicon(docs: DataFrame, least: int = LEAST_DOCS, share: float = MOST_SHARE) -> tuple[DataFrame, DataFrame]:
    """((term), (term)): names of the terms within the band of document frequency that are in a subset, and of those above it.

    Document frequency is counted over all distinct term sets: texts with the same terms count once, so that copies don't
    make their terms common. For this the copies of each set are counted first, by a hash of its sorted names, and each of
    its terms then weighs one by the number of copies; so terms are combined before they are shuffled, and sets aren't moved.
    The inverse document frequency of a kept term is between -ln(share) and ln(n / least), n being the number of distinct
    sets. Terms above the band are at most the mean size of a set divided by ``share``, or few enough to be in less than
    ``least`` sets.
    """
    sets = docs.select(names(F.col("text")).alias("terms")).select("terms", F.xxhash64("terms").alias("set"))
    counts = settle(sets.groupBy("set", (F.size("terms") > 0).alias("whole")).agg(F.count("*").alias("copies")), "sets").where("whole")
    n = counts.count()
    twice = counts.where("copies > 1").select("set", "copies")
    weighed = sets.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, "set", "left")
    each = weighed.select(F.explode_outer("terms").alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("weight")).where("term is not null")
    seen = settle(each.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("docs")).where(F.col("docs") >= least), "terms")
    most = max(least, math.floor(share * n))
    return seen.where((F.col("docs") <= most) & in_subset(F.col("term"))).select("term"), seen.where(F.col("docs") > most).select("term")


def with_next(docs: DataFrame) -> DataFrame:
    """(range, pos, guest, doc_id, text, next): each row with the text of the next in the order of doc_id, round in a ring.

    Rows are dealt by ranges of the id and each range also gets the first row of the next one as a guest at its end, so no
    task sees all rows; ``pos`` is a row's place in its range. Rows of one id follow one another in the order of their
    texts; those without an id come first, in the order of a hash of their texts, by which they are dealt.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    ranged = docs.withColumn("range", range_bucket(docs, "doc_id", buckets_for(docs), "tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    place = F.struct(F.coalesce("doc_id", "tie").alias("at"), F.col("doc_id").isNull().alias("none"))
    # one row a range comes to the driver: the least id in it, or the least hash where rows have none
    first = {r["range"]: r["least"] for r in ranged.groupBy("range").agg(F.min(place).alias("least")).collect()}
    used = sorted(first) or [0]
    # the first row of a range goes to the range before it as well, the very first to the last range
    ids = F.array(*(F.lit(first[i]["at"] if i in first else None).cast("long") for i in range(used[-1] + 1)))
    least = ranged.where(F.coalesce("doc_id", "tie") == F.get(ids, F.col("range"))).groupBy("range", "doc_id", "tie").agg(F.min("text").alias("text"))
    before = F.array(*(F.lit(used[used.index(i) - 1] if i in first else None).cast("int") for i in range(used[-1] + 1)))
    guests = least.select(F.get(before, F.col("range")).alias("range"), "doc_id", "tie", "text", F.lit(True).alias("guest"))
    rows = ranged.select("range", "doc_id", "tie", "text", F.lit(False).alias("guest")).union(guests)
    follow = Window.partitionBy("range").orderBy("guest", *order)
    return rows.select("range", F.row_number().over(follow).alias("pos"), "guest", "doc_id", "text", F.lead("text").over(follow).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by the beginning of the following text."""
    half = F.call_function("div", F.char_length(text), F.lit(2)).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def hashes(found: Column) -> Column:
    """One 32-bit hash a subset, from the sorted names of a text's terms; 0 where the text has no term of it.

    Null where no subset has a term of the text.
    """
    named = lambda terms: F.when(F.size(terms) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    levels = SPARSEST - DENSEST + 1

    def chain(terms: Column, c: int) -> Column:
        masks = [((1 << DENSEST) - 1) << (STEP * c), *(1 << (STEP * c + i) for i in range(DENSEST, SPARSEST))]
        sifted = lambda acc, bits: F.concat(acc, F.array(F.filter(F.element_at(acc, -1), lambda x: x.bitwiseAND(bits) == 0)))
        every = F.aggregate(F.lit(masks).cast("array<bigint>"), F.array(terms), sifted)
        return F.transform(F.slice(every, 2, levels), named)

    flat = let(found, lambda t: F.concat(*(chain(t, c) for c in range(CHAINS))))
    places = F.lit([c * levels + level for level in reversed(range(levels)) for c in range(CHAINS)])
    ordered = let(flat, lambda h: F.transform(places, lambda k: F.get(h, k)))
    return let(ordered, lambda h: F.when(F.exists(h, lambda x: x != 0), h))


def written(h: Column, bare: Column) -> Column:
    """The fingerprint: the hashes in hexadecimal, or the digest of a text without a term."""
    return F.when(h.isNull(), bare).otherwise(F.array_join(F.transform(h, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes, among the COMPARED sparsest subsets that have a term of either text.

    A subset of density d keeps its hash when none of its terms is lost or added, so sparse ones tell half-equal texts from
    unlike ones and dense ones tell copies from near copies. Equal fingerprints are alike, whatever they are; other
    fingerprints without hashes aren't.
    """
    part = lambda f, i: F.substr(f, i * 8 + 1, F.lit(8))
    both = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.struct(part(a, i).alias("a"), part(b, i).alias("b")))
    used = F.slice(F.filter(both, lambda x: (x["a"] != "00000000") | (x["b"] != "00000000")), 1, COMPARED)
    share = let(used, lambda u: F.size(F.filter(u, lambda x: x["a"] == x["b"])) / F.size(u))
    return F.when(a == b, F.lit(1.0)).when((F.char_length(a) != HASHES * 8) | (F.char_length(b) != HASHES * 8), F.lit(0.0)).otherwise(share)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Null is taken as an empty text. A text without a lexicon term in a subset is hashed over all its terms by the same
    rule; if none of these is in a subset either, all its hashes are that of its sorted terms together, and one without a
    term, as one without a letter, has the SHA-256 of itself and is like equal texts only. Repeated rows are repeated: rows
    of one id and text follow one another. Rows of one id come in the order of their texts, those without an id first. One
    row is its own next. Texts may be of any length. An empty table gives an empty one; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, above = lexicon(docs)
    known = settle(known, "lexicon")
    rows = with_next(docs).withColumn("edited", F.when(~F.col("guest"), edited(F.col("text"), F.col("next"))))
    base = rows.select("range", "pos", "guest", "doc_id", "text", "edited", names(F.col("text")).alias("one"), names(F.col("edited")).alias("two"))
    # one array a row: its facts at item 0, and the names of both texts' terms that are in a subset, the lowest bit telling the
    # texts apart; no array is empty, and explode_outer doesn't make each twice to see that
    kind = "struct<guest:boolean,doc_id:bigint,n_chars:bigint,edited_sha256:string,one:bigint,two:bigint,bare_one:string,bare_two:string>"
    together = lambda t: F.when(F.size(t) > 0, F.xxhash64(t).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    bare = lambda t, text: F.when(F.size(t) == 0, F.sha2(text, 256))
    fact = F.struct("guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), together("one").alias("one"), together("two").alias("two"), bare("one", "text").alias("bare_one"), bare("two", "edited").alias("bare_two"))
    entry = lambda item, facts: F.struct(item.alias("item"), facts.cast(kind).alias("facts"))
    side = lambda t, which: F.transform(F.filter(t, in_subset), lambda x: entry(F.shiftleft(x, 2).bitwiseOR(F.lit(which).cast("long")), F.lit(None)))
    items = F.concat(F.array(entry(F.lit(0).cast("long"), fact)), side("one", 0), side("two", 1))
    each = base.select("range", "pos", items.alias("items")).select("range", "pos", F.explode_outer("items").alias("x")).select("range", "pos", "x.item", "x.facts")
    each = each.withColumn("term", F.shiftright("item", 2))
    known = known.withColumn("known", F.lit(2).cast("long"))
    if known.count() <= BROADCAST_ROWS:
        kept = each.join(F.broadcast(known), "term", "left")
    else:
        # the terms above the band, which most texts have, aren't looked up; they are few
        each = settle(each.join(F.broadcast(above.withColumn("above", F.lit(True))), "term", "left"), "terms")
        looked_up = F.col("above").isNull() & (F.col("item") != 0)
        kept = each.where(~looked_up).withColumn("known", F.lit(None).cast("long")).unionByName(each.where(looked_up).join(known, "term", "left"))
    # the second lowest bit of an item says that the lexicon has it
    found = F.collect_list(F.when(F.col("item") != 0, F.col("item").bitwiseOR(F.coalesce("known", F.lit(0).cast("long")))))
    whole = kept.select("range", "pos", "item", "facts", "known").groupBy("range", "pos").agg(F.max("facts").alias("facts"), found.alias("found"))
    of = lambda bits, value: F.sort_array(F.transform(F.filter("found", lambda x: x.bitwiseAND(F.lit(bits).cast("long")) == value), lambda x: F.shiftright(x, 2)))
    alike = lambda h: F.when(h.isNotNull(), F.array_repeat(h, HASHES))
    mark = lambda which, whole: F.coalesce(hashes(of(3, 2 + which)), hashes(of(1, which)), alike(F.col(f"facts.{whole}")))
    marked = whole.select("range", "pos", "facts.guest", "facts.doc_id", "facts.n_chars", "facts.edited_sha256", written(mark(0, "one"), F.col("facts.bare_one")).alias("fingerprint"), F.when(~F.col("facts.guest"), written(mark(1, "two"), F.col("facts.bare_two"))).alias("edited_fingerprint"))
    marked = settle(marked, "prints")
    marked = marked.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("pos"))).where("not guest")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next").alias("near_next"))
