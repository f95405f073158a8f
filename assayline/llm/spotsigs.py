"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature is an anchor, a very common word, with the chain of content words that follows
it, further common words being skipped. A document's fingerprint is the set of its signatures'
hashes. Fingerprints are compared by Jaccard likeness; where only pairs above a threshold are
wanted, documents are partitioned by the size of their sets, and a pair is verified only if its
sizes and its shared rare signatures allow the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The anchors, very common words of four languages.
ANCHORS = (
    "the of and to in a is that for it was with be by on not this "
    "der die das und ist von mit auf den ein eine nicht zu "
    "de la le les et des en un une du que est "
    "el los las y no lo su se por con para").split()
CHAIN = 2
_MISSING = -(1 << 63)


def normalised(text: Column) -> Column:
    """Lower-case words between single blanks, one blank at each end; no words: two blanks or one."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signature hashes of a text, sorted.

    A text without any signature has one of its whole word sequence, so equal texts always have
    equal sets and a set is never empty.
    """
    words = normalised(text)
    split = lambda t: F.transform(F.array(_content(t)), lambda at: _chains(t, at, chain))[0]
    hashed = F.transform(F.array(F.split(F.trim(words), " ", -1)), split)[0]  # an array is bound once as a lambda's variable
    return F.array_sort(F.when(F.size(hashed) > 0, F.array_distinct(hashed)).otherwise(F.array(F.hash(F.trim(words)))))


def _content(words: Column) -> Column:
    """Where the content words stand."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).isin(*ANCHORS))


def _chains(words: Column, at: Column, chain: int) -> Column:
    """The hash of every run of ``chain`` content words that follows an anchor: one where the place before its first word is skipped."""
    follows = lambda j: (j + chain <= F.size(at)) & (F.get(at, j) - F.coalesce(F.get(at, j - 1), F.lit(-1)) > 1)
    run = lambda j: F.concat(*[x for k in range(chain) for x in (F.lit(" "), F.get(words, F.get(at, j + k)))])
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(at)), follows), lambda j: F.hash(run(j)))


def fingerprint(hashes: Column) -> Column:
    """The set as text: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.right(F.lower(F.lpad(F.hex(h.cast("long")), 16, "0")), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    listed = F.array(*[F.lit(c).cast("long") for c in cuts])
    move = lambda at, s: F.when((at + s <= len(cuts)) & (F.element_at(listed, F.least(at + s, F.lit(len(cuts)))) < key), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows it by descending doc_id; after the last: the first.

    Ids are cut into ``buckets`` ranges by quantiles, and each range is ordered for itself. The
    first row of a range is also put, as a ghost, at the end of the range before it. Null ids
    come last; rows of equal id are ordered by the hash of their text.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_MISSING)))
    shares = [i / buckets for i in range(1, buckets)]
    got = keyed.agg(F.percentile_approx("_k", shares or [0.5], 100000)).first()[0] if shares else []
    cuts = sorted(set(got or []))
    keyed = keyed.withColumn("_b", _bucket(F.col("_k"), cuts))
    tops = {r[0]: r[1] for r in keyed.groupBy("_b").agg(F.max("_k")).collect()}
    order = sorted(tops, reverse=True)
    follow = [(tops[order[(i + 1) % len(order)]], b) for i, b in enumerate(order)]
    if not follow:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("_top"), F.lit(b).alias("_to")) for k, b in follow])
    ghosts = spark.range(1).select(F.inline(pairs))
    ghosts = keyed.join(F.broadcast(ghosts), keyed["_k"] == ghosts["_top"]).withColumn("_b", F.col("_to")).drop("_top", "_to")
    both = keyed.withColumn("_ghost", F.lit(0)).unionByName(ghosts.withColumn("_ghost", F.lit(1)))
    w = Window.partitionBy("_b").orderBy("_ghost", F.desc("_k"), F.xxhash64("text"))
    led = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where(F.col("_ghost") == 0).drop("_k", "_b", "_ghost")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the text replaced by as many first characters of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited_comparison(docs: DataFrame) -> DataFrame:
    """Each text, its edited form and the next document, compared by their fingerprints.

    Result: doc_id, n_chars, edited (text), hashes, edited_hashes, near_edited, near_next. A null
    text counts as empty; a lone row follows itself. Repeated rows give a row each.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    led = with_next(rows.withColumn("hashes", signatures(F.col("text"))), ["text", "hashes"], buckets)
    both = led.select("doc_id", F.length("text").alias("n_chars"), edited_text(F.col("text"), F.col("next_text")).alias("edited"), "hashes", "next_hashes")
    both = both.withColumn("edited_hashes", signatures(F.col("edited")))
    return both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "hashes", "edited_hashes",
                       likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, near) for all pairs of signature sets with a likeness of ``threshold`` or more.

    Rows of equal sets are one class, named by its smallest doc_id; a and b are such names, a < b.
    Sets are partitioned by size into bands a factor 1/threshold wide, so that partners lie in the
    same band or the next; each set is filed under its rarest signatures, as many as a partner
    must share one of, and pairs are verified once, after the sizes are compared.
    """
    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", signatures(F.col("text").cast("string")).alias("s")).groupBy("s").agg(F.min("doc_id").alias("id"))
    spread = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    rarity = spread.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    prefix = spread.join(rarity, "h").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    filed = prefix.select("id", "n", "h", band.alias("band"))
    left = filed.select(F.col("id").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = filed.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h", "band")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    found = left.join(right, ["h", "band"]).where(fits & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    named = sets.select("id", "s")
    full = found.join(named.toDF("a", "sa"), "a").join(named.toDF("b", "sb"), "b").withColumn("near", likeness(F.col("sa"), F.col("sb")))
    return full.where(F.col("near") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near")
