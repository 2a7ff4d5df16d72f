"""Document fingerprints by Order MinHash, in DataFrame functions only.

The symbols are words (runs between white space).  Every k-mer of words gets
its occurrence number in the text, so that a text is a set of (k-mer, number);
each is hashed once.  A tuple ranks all elements by its own hash, the remainder
of theirs by its modulus, and takes the two of least rank; they are put in text
order and hashed together.  Two texts agree in a tuple if they share both
elements in the same order, which edits that move text break as well.  Only the
elements whose rank is under a bound are compared, unless fewer than two are.

Sorting packed 64-bit integers stands for a table of occurrences: a text never
leaves its row, and no k-mer is exploded.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KMER = 2
TUPLES = 32
NEAR = 10  # elements expected among the low ranks that are looked at first
# of each tuple, 2**40 to 2**41; fixed, as fingerprints of different runs are compared
MODULI = [1 << 40 | int.from_bytes(hashlib.sha256(b"tuple %d" % t).digest()[:5]) | 1 for t in range(TUPLES)]
PLACE_BITS = 27  # place of a k-mer; the rest of 63 bits is hash

_MASK = (1 << PLACE_BITS) - 1


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmers(text: Column) -> Column:
    """Sorted array of hash << PLACE_BITS | place, one per k-mer.  A text of
    fewer words has one k-mer of them all; a text without a word has none."""
    words = F.filter(F.split(F.translate(text, "\t\n\r\f\x0b", "     "), " "), lambda w: w != "")

    def of(w: Column) -> Column:
        hashes = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))
        hashes = F.when(F.size(w) <= _MASK, hashes).otherwise(F.raise_error(F.lit(f"a text has over {_MASK} words")).cast("array<bigint>"))
        return F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(i.cast("long"))))

    return _let(words, of)


def _numbered(s: Column) -> Column:
    """The occurrence number of each element of a sorted k-mer array."""

    def of(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))

    new = lambda i: (i == 0) | (F.shiftright(F.get(s, i), PLACE_BITS) != F.shiftright(F.get(s, i - 1), PLACE_BITS))
    return _let(F.filter(_range(F.size(s)), new), of)


def signature(text: Column) -> Column:
    """TUPLES hashes (null for a text without a word)."""

    def pick(s: Column) -> Column:
        elements = F.zip_with(s, _numbered(s), lambda x, o: F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE_BITS), o), 1))
        place = lambda es, e: F.get(s, (F.array_position(es, e) - 1).cast("int")).bitwiseAND(F.lit(_MASK))

        def tuples(es: Column) -> Column:
            def one(m: Column) -> Column:
                low = _let(F.floor(m / F.size(es) * NEAR), lambda bound: F.filter(es, lambda e: e % m < bound))
                return _let(F.when(F.size(es) <= NEAR, es).otherwise(low), lambda c: least(m, F.when((F.size(c) >= 2) | (F.size(es) < 2), c).otherwise(es)))

            def least(m: Column, some: Column) -> Column:
                return _let(some, lambda c: _let(F.transform(c, lambda e: e % m), lambda ranks: _let(F.array_min(ranks), lambda r: both(c, ranks, r, F.array_min(F.filter(ranks, lambda x: x > r))))))

            def both(c: Column, ranks: Column, r: Column, r2: Column) -> Column:
                at = lambda x: F.get(c, (F.array_position(ranks, x) - 1).cast("int"))
                return _let(F.struct(at(r).alias("a"), at(r2).alias("b")), ordered)

            ordered = lambda p: F.when(p.b.isNull() | (place(es, p.a) <= place(es, p.b)), F.xxhash64(p.a, p.b)).otherwise(F.xxhash64(p.b, p.a))
            return F.transform(F.array(*[F.lit(m) for m in MODULI]), one)

        return _let(elements, tuples)

    none = F.array_repeat(F.lit(None).cast("long"), TUPLES)
    return _let(kmers(text), lambda s: F.when(F.size(s) > 0, pick(s)).otherwise(none))


def shown(sig: Column) -> Column:
    """A signature as text: 8 hex digits a tuple, dashes for an empty one."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-" * 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of tuples, of those that either has, in which two signatures
    agree; 1 for two texts without words, 0 if one is missing."""
    held = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda v: v))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda v: v))
    return F.when(a.isNull() | b.isNull(), 0.0).when(held == 0, 1.0).otherwise(same / held)


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next): each distinct id and the next larger one, after the last
    the first.  Ids are dealt into ranges of like numbers of rows, of which
    only the first ids (at most 512) are put in order together."""
    distinct = ids.where("id is not null").distinct()
    n = distinct.count()
    parts = min(512, max(1, n // 2000))
    edges = [int(x) for x in distinct.approxQuantile("id", [k / parts for k in range(1, parts)], 0.002)] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in sorted(set(edges))]), lambda e: e <= F.col("id"))) if edges else F.lit(0)
    dealt = distinct.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.min("id").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    first = F.min("head").over(Window.partitionBy(F.lit(0)))
    follow = heads.select("part", F.coalesce(F.lead("head").over(order), first).alias("follow"))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return dealt.withColumn("inside", inside).join(F.broadcast(follow), "part").select("id", F.coalesce("inside", "follow").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the
    first as many of the next document by id (after the last, the first).  Null
    text counts as empty.  Rows with a null id have no next document: their
    end is cut off, and near_next is 0.  Where an id stands in several rows,
    each of them gives a row, and its predecessor's next document is the row
    whose text has the smallest hash, so repeated rows change nothing.  Texts
    of over 2**27 words are an error.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    known = base.where("id is not null")  # the same in both joins, so that texts are shuffled once
    sized = known.groupBy("id").agg(F.max(F.floor(F.length("t") / 4)).alias("cut"))
    links = next_ids(base.select("id")).join(sized, "id").select(F.col("next").alias("id"), F.col("id").alias("for_id"), "cut")
    tail = F.min(F.struct(F.xxhash64("t").alias("h"), F.expr("left(t, cut)").alias("tail")))
    tails = known.join(links, "id").groupBy(F.col("for_id").alias("to")).agg(tail.alias("m"), F.min("id").alias("next"))
    both = known.join(tails.select(F.col("to").alias("id"), "next", F.col("m.tail").alias("tail")), "id")
    signed = _signed(both)
    # every row goes to its next document as one that asks and to its own as one that is asked for: the likenesses
    # take one shuffle of signatures, which are neither computed twice nor written as a table
    ask = F.struct(F.col("next").alias("key"), F.struct("h", "s", "id", "n_chars", "edited_sha256", "es").alias("row"), F.lit(None).cast(_SIGNED).alias("given"))
    give = F.struct(F.col("id").alias("key"), F.lit(None).cast(_ROW).alias("row"), F.struct("h", "s").alias("given"))
    met = signed.select(F.inline(F.array(ask, give)))
    found = met.withColumn("ns", F.min("given").over(Window.partitionBy("key")).getField("s")).where("row is not null").select("row.*", "ns")
    rest = _signed(base.where("id is null").select("id", "t", F.lit("").alias("tail"))).withColumn("ns", F.lit(None).cast("array<bigint>"))
    return found.unionByName(rest).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("ns")).alias("near_next"),
    )


_SIGNED = "struct<h: bigint, s: array<bigint>>"
_ROW = "struct<h: bigint, s: array<bigint>, id: bigint, n_chars: bigint, edited_sha256: string, es: array<bigint>>"


def _signed(both: DataFrame) -> DataFrame:
    """Rows of t and tail with hash, length and signature of the text, and hash and signature of the edited one."""
    edited = F.expr("concat(left(t, length(t) - floor(length(t) / 4)), left(tail, floor(length(t) / 4)))")
    texts = both.withColumn("e", edited)
    kept = [c for c in ("id", "next") if c in both.columns]
    return texts.select(*kept, F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), signature(F.col("t")).alias("s"), signature(F.col("e")).alias("es"))
