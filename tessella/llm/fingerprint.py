"""Document fingerprints by Order MinHash (native).

Every run of K words (of K characters in a text of under MIN_WORDS words) is a k-mer; the o-th occurrence of a k-mer in
a text is an element of its own, (k-mer, o). Each of 64 bins has an order of its own over all elements, selects the L
least of the whole text, puts them back into text order and hashes the tuple of their k-mers. Texts whose words are the
same but in another order thus differ, as under edit distance. A fingerprint is the list of bins with their tuples;
likeness is the share of the bins filled in either text that hold the same tuple.

A bin's order is: the elements that a first hash deals to it, by that hash; those that a second hash deals to it; those
that a third does; then all others by a hash of (element, bin). It doesn't depend on the text, and by symmetry each
order of the elements is equally likely, as Order MinHash asks. A bin that was dealt L elements has its selection among
these, so later hashes are worked out only for texts that leave a bin with fewer, and only the bins that have fewer
after the last, which very short texts have, read the whole text again.

All steps are array functions on longs: hash and place share a long, so a plain sort of longs brings equal k-mers, and
later each bin's elements, together. Work is O(n log n) in the words of a text, and n for each bin with too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, L = 3, 3
BIN_BITS = 6
#: Texts of fewer words are cut into characters, since so few words leave next to no choice of L k-mers.
MIN_WORDS = K + L + 2
#: Hashes that deal elements to bins (4 at most: two bits of a long hold the number).
DEALS = 3
#: A bin that reads the whole text sorts about so many of its least elements (all, where this leaves under L).
LOOK = 16
#: Low bits of a long that hold a place. 2**28 words are more than the arrays of words of one row can hold in practice:
#: as a Spark string is under 2 GB, only a text of more words of under 8 bytes each could pass that.
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1
_TOP, _MIDDLE = -1 << (64 - BIN_BITS), ((1 << 56) - 1) & ~_PLACE
#: Documents of an order bucket, and most buckets (their bounds are the only thing that is collected).
BUCKET_ROWS, MAX_BUCKETS = 2048, 100_000
FIRST = -(1 << 63)  # stands for a null doc_id, which comes last in descending order


def _runs(values: Column, shift: int) -> Column:
    """Places where the high bits of a sorted array change."""
    return F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: ~F.shiftright(F.get(values, i), shift).eqNullSafe(F.shiftright(F.get(values, i - 1), shift)),
    )


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: array of longs, one for each of the 64 bins, bin in the high bits; empty for a text without words."""
    w, h, s, r, e, p, f, t, m, c, g = (f"_{out}_{x}" for x in "whsrepftmcg")
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(w, words)
    few = F.size(w).between(1, MIN_WORDS - 1)
    df = df.withColumn(w, F.when(few, F.split(F.array_join(w, " "), "")).otherwise(F.col(w)))
    n = F.size(w)
    kmers = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(K)]))
    df = df.withColumn(h, F.when(n >= K, kmers).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<long>"))).drop(w)
    df = df.withColumn(s, F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_PLACE))))))
    df = df.withColumn(r, F.when(F.size(s) > 0, _runs(F.col(s), PLACE_BITS)).otherwise(F.array().cast("array<int>")))

    def number(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(F.col(r), j + 1), F.size(s))
        return F.transform(
            F.slice(F.col(s), start + 1, stop - start),
            lambda x, o: F.xxhash64(F.shiftright(x, PLACE_BITS), o).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE))),
        )

    df = df.withColumn(e, F.sort_array(F.flatten(F.transform(F.col(r), number)))).drop(s, r)
    bin_ = 64 - BIN_BITS
    df = df.withColumn(p, F.filter(F.col(e), lambda x, i: ~F.shiftright(x, bin_).eqNullSafe(F.shiftright(F.get(F.col(e), i - L), bin_))))
    # starts of the bins with L elements of their own: the last of these is in the same bin
    starts = F.filter(_runs(F.col(p), bin_), lambda i: F.shiftright(F.get(F.col(p), i), bin_).eqNullSafe(F.shiftright(F.get(F.col(p), i + (L - 1)), bin_)))
    df = df.withColumn(r, F.when(F.size(p) > 0, starts).otherwise(F.array().cast("array<int>")))
    half = 1 << (BIN_BITS - 1)
    every = F.array(*[F.lit(b).cast("long") for b in range(-half, half)])
    none = F.array().cast("array<long>")
    df = df.withColumn(f, F.when(F.size(p) > 0, F.array_except(every, F.transform(F.col(r), lambda i: F.shiftright(F.get(F.col(p), i), bin_)))).otherwise(none))
    df = df.withColumn(t, F.when(F.size(e) > LOOK, (F.lit(LOOK * 2.0**64) / F.size(e) - F.lit(2.0**63)).cast("long")).otherwise(F.lit((1 << 63) - 1)))
    df = df.withColumn(m, F.aggregate(F.col(f), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")))))
    wanted = lambda x: F.call_function("shiftrightunsigned", F.col(m), F.shiftright(x, bin_).cast("int")).bitwiseAND(F.lit(1)) == 1

    def dealt_by(k: int) -> Column:
        """Bin, k, hash and place of each element, as one long."""

        def code(x: Column) -> Column:
            v = x if k == 0 else F.xxhash64(F.shiftright(x, PLACE_BITS), F.lit(k))
            return v.bitwiseAND(F.lit(_TOP)).bitwiseOR(F.lit(k << 56)).bitwiseOR(F.shiftrightunsigned(v, 2).bitwiseAND(F.lit(_MIDDLE))).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))

        return F.filter(F.transform(F.col(e), code), wanted)

    df = df.withColumn(c, F.when(F.size(f) > 0, F.sort_array(F.concat(*[dealt_by(k) for k in range(DEALS)]))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(c) > 0, _runs(F.col(c), bin_)).otherwise(F.array().cast("array<int>")))

    def tuple_(bin_no: Column, places: Column) -> Column:
        code = F.xxhash64(F.transform(F.sort_array(places), lambda i: F.get(F.col(h), i)))
        return F.shiftleft(bin_no, bin_).bitwiseOR(F.shiftrightunsigned(code, BIN_BITS))

    place_of = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")

    def dealt_first(start: Column) -> Column:
        return tuple_(F.shiftright(F.get(F.col(p), start), bin_), F.transform(F.slice(F.col(p), start + 1, L), place_of))

    def of_all(b: Column, places: Column) -> Column:
        """The tuple of a bin whose hashes dealt it fewer than L elements, at these places."""
        key = lambda x: F.xxhash64(F.shiftright(x, PLACE_BITS), b).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
        least = F.filter(F.transform(F.col(e), key), lambda x: x <= F.col(t))
        enough = F.transform(F.array(least), lambda x: F.when(F.size(x) >= 2 * L, x).otherwise(F.transform(F.col(e), key)))
        others = F.array_except(F.transform(F.sort_array(F.get(enough, F.lit(0))), place_of), places)
        return tuple_(b, F.slice(F.concat(places, others), 1, L))

    def dealt_later(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(F.col(g), j + 1), F.size(c))
        places = F.array_distinct(F.transform(F.slice(F.col(c), start + 1, stop - start), place_of))
        b = F.shiftright(F.get(F.col(c), start), bin_)
        one = F.transform(F.array(places), lambda x: F.when(F.size(x) >= L, tuple_(b, F.slice(x, 1, L))).otherwise(of_all(b, x)))
        return F.get(one, F.lit(0))

    missed = F.array_except(F.col(f), F.transform(F.col(g), lambda i: F.shiftright(F.get(F.col(c), i), bin_)))
    bins = (F.transform(F.col(r), dealt_first), F.transform(F.col(g), dealt_later), F.transform(missed, lambda b: of_all(b, F.array().cast("array<int>"))))
    return df.withColumn(out, F.sort_array(F.concat(*bins))).drop(h, p, r, e, f, t, m, c, g)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the bins filled in either that are equal; 1 for two texts without words."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 64 - BIN_BITS))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(filled, F.lit(1)))


def as_text(fingerprint: str) -> Column:
    """Ten hex digits for each bin: the bin's number and 34 bits of its tuple's hash."""
    return F.array_join(F.transform(F.col(fingerprint), lambda v: F.lpad(F.lower(F.hex(F.shiftrightunsigned(v, 24))), 10, "0")), "")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, in two steps over lists of about sqrt(len(bounds))."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")  # noqa: E731  # folded into one literal
    coarse = F.size(F.filter(constant(bounds[::width]), lambda x: x <= key))
    fine = F.size(F.filter(F.slice(constant(bounds), F.greatest(coarse - 1, F.lit(0)) * width + 1, F.lit(width)), lambda x: x <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + fine)


def with_next_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and _next: the text of the next document by descending doc_id (after the last: of the first).

    Documents go to buckets of near id (bounds from approximate quantiles, collected: MAX_BUCKETS numbers at most), and
    the first document of each bucket also goes to the end of the bucket before. The texts are shuffled once, and no
    task gets more than a bucket in one window. Nulls come last; rows of equal doc_id are ordered by a hash of the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    ids = rows.select(key.alias("key"))
    n = ids.count()
    wanted = min(MAX_BUCKETS, max(64, n // BUCKET_ROWS))
    cuts = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(ids.agg(F.percentile_approx("key", cuts, 10 * wanted)).first()[0] or []))
    bucket = _bucket(F.col("key"), bounds)
    tops = ids.groupBy(bucket.alias("b")).agg(F.max("key").alias("top")).collect()  # a row for each bucket
    tops = sorted(((r["b"], r["top"]) for r in tops), reverse=True)
    keyed = rows.withColumn("key", key)
    home = keyed.withColumn("b", bucket).withColumn("guest", F.lit(False))
    if tops:
        after = {b: tops[(i + 1) % len(tops)][1] for i, (b, _) in enumerate(tops)}
        first_of = docs.sparkSession.createDataFrame([(b, t) for b, t in after.items()], "b int, g_key long")
        # of the rows that share the key, one comes first
        order = Window.partitionBy("b").orderBy(F.xxhash64("text"), "text")
        guests = keyed.join(F.broadcast(first_of), F.col("key") == F.col("g_key")).drop("g_key").withColumn("_o", F.row_number().over(order)).where("_o = 1").drop("_o")
        home = home.union(guests.select("doc_id", "text", "key", "b", F.lit(True).alias("guest")))
    return home.withColumn("_next", F.lead("text").over(next_order())).withColumn("_next", F.coalesce("_next", F.lit("")))


def next_order():
    return Window.partitionBy("b").orderBy("guest", F.desc("key"), F.xxhash64("text"), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last floor(n/2) of its n code points give way to
    the first as many (or all) of the next document's, by descending doc_id (after the last: the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the
    edited and to the next text). A null text counts as empty; an empty text has an empty fingerprint, and two of these
    have likeness 1. Equal texts have equal fingerprints. A single document is its own next. Other columns aren't read.
    """
    df = with_next_text(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("_next"), half))
    df = with_fingerprint(df, "text", "fp")
    df = df.withColumn("next_fp", F.lead("fp").over(next_order())).where("not guest").withColumn("edited", edited).drop("_next", "text")
    df = df.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    df = with_fingerprint(df, "edited", "edited_fp")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", F.coalesce("next_fp", "fp")).alias("near_next"),
    )
