"""Canonical exact digests, in DataFrame operations only.

Canonical text: Unicode compatibility composition (NFKC), full case folding, NFKC again, runs of white space as one
space, none at the ends. Fingerprint: two chained xxhash64 of it and its length, 40 hex digits. Inside a bucket of
equal fingerprints the canonical bytes are compared; in a bucket where they differ the fingerprint gets the sha256 of
the canonical text added, so that equal fingerprints mean equal canonical texts. The same holds for edited texts,
which are compared by that sha256.

A null text is empty; empty and all-white texts share one fingerprint. Rows with the same doc_id are kept; which of
them is next is decided by a hash of the text where they are so many that they are dealt over several ranges, then by
the text. doc_ids are integers; null ones come last. An empty table gives an empty result. Names of other columns don't
matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few

#: Unicode White_Space and the other separators that a regular expression of Java takes as such; those within ASCII.
_SPACE, _PLAIN_SPACE = r"[\s\p{Z}\x{85}]+", r"[ \t\n\x0B\f\r]+"
#: A bucket's row is a fingerprint and a count or key, some 80 bytes: 8 MB at most.
BROADCAST_ROWS = 100_000
#: Ranges of doc_ids at most: so many numbers come to the driver.
MOST_RANGES = 65_536
#: A range's number leaves room for the slices of a frequent doc_id.
_SLICE_BITS = 20


def canonical(text: Column) -> Column:
    """Normalised, folded text; null is empty."""
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    # ASCII has no normalisation, its folding is lower case, and it has few kinds of white space.
    plain = F.length(text) == F.octet_length(text)
    return F.trim(F.when(plain, F.regexp_replace(F.lower(text), _PLAIN_SPACE, " ")).otherwise(F.regexp_replace(compose(fold(compose(text))), _SPACE, " ")))


def digest(canon: Column) -> Column:
    """40 hex digits: 64 bits, 64 bits seeded by another prefix, 32 bits of the length."""
    word = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(word(F.xxhash64(canon)), word(F.xxhash64(F.lit("canonical"), canon)), F.lpad(F.lower(F.hex(F.octet_length(canon))), 8, "0"))


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key (of the text as it is)."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))


def _printed(df: DataFrame, text: Column, name: str, sha: str, digest_of: Callable[[Column], Column]) -> DataFrame:
    """Adds a fingerprint and the sha256 of the canonical text, which is made once."""
    canon = df.withColumn("canon", canonical(text))
    return canon.withColumns({name: digest_of(F.col("canon")), sha: F.unhex(F.sha2(F.col("canon").cast("binary"), 256))}).drop("canon")


def shared_buckets(prints: DataFrame) -> DataFrame:
    """fingerprint, copies: the buckets with two rows or more."""
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def _collided(src: DataFrame, prints: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints whose bucket holds different bytes. Texts of buckets with two rows or more meet as their least and greatest, taken where the rows are first."""
    members = scratch.keep(prints.join(few(shared.select("fingerprint"), BROADCAST_ROWS), "fingerprint", "left_semi").select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), "fingerprint").distinct(), "members")
    held = src.join(few(members, BROADCAST_ROWS), F.expr("doc_id <=> m_id AND key = m_key")).select("fingerprint", canonical(F.col("text")).alias("canon"))
    return held.groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).filter("least <> most").select("fingerprint")


def _resolved(prints: DataFrame, bad: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds the sha256 to the fingerprints of bad buckets: pairs of a fingerprint's column and its sha256's."""
    for name, sha in pairs:
        found = few(bad.select(F.col("fingerprint").alias("bad")), BROADCAST_ROWS)
        prints = prints.join(found, F.col(name) == F.col("bad"), "left").withColumn(name, F.when(F.col("bad").isNotNull(), F.concat(name, F.lit("-"), F.lower(F.hex(sha)))).otherwise(F.col(name))).drop("bad")
    return prints


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """doc_id, fingerprint, copies (rows with this fingerprint)."""
    scratch, src = Scratch(df.sparkSession, "fingerprints"), _source(df, id_col, text_col)
    prints = scratch.keep(_printed(src, F.col("text"), "fingerprint", "sha", digest_of).drop("text"), "prints")
    shared = scratch.keep(shared_buckets(prints), "shared")
    bad = scratch.keep(_collided(src, prints, shared, scratch), "bad")
    if not bad.isEmpty():
        prints = scratch.keep(_resolved(prints, bad, [("fingerprint", "sha")]), "resolved")
        shared = scratch.keep(shared_buckets(prints), "shared-now")
    scratch.drop("members")
    return prints.select("doc_id", "fingerprint").join(few(shared, BROADCAST_ROWS), "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("copies", F.lit(1)).alias("copies"))


def _numbers(values: list[int]) -> Column:
    """An array of integers as one literal of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are under the value: first among every side-th, then among the side after that."""
    side = math.isqrt(len(cuts) - 1) + 1
    coarse = F.size(F.filter(_numbers(cuts[::side]), lambda x: x < value))
    fine = F.slice(_numbers(cuts), F.greatest(coarse - 1, F.lit(0)) * side + 1, F.lit(side))
    return F.when(coarse > 0, (coarse - 1) * side + F.size(F.filter(fine, lambda x: x < value))).otherwise(0)


def _ranges(ids: DataFrame, bucket_rows: int) -> tuple[Column, Column]:
    """The number of a row's range, higher ones first, and the hash that orders rows of a frequent doc_id (else null).

    Quantiles of the ids cut them into ranges of about bucket_rows rows. An id that fills several quantiles, and null,
    are cut further by a hash of the text; such an id is the largest of its range.
    """
    got = ids.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id")).first()
    n = max(1, min(MOST_RANGES, got["n"] // bucket_rows))
    marks = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [] if n > 1 else []
    cuts, times = sorted(set(marks)), Counter(marks)
    slices = {v: 1 << (m - 1).bit_length() for v, m in times.items() if m > 1}
    no_id = 1 << max(0, (-(-(got["n"] - got["with_id"]) // bucket_rows) - 1)).bit_length()
    place, share = F.col("doc_id"), F.lit(no_id if no_id > 1 else None).cast("bigint")
    if slices:
        held = sorted(slices)
        at = F.array_position(_numbers(held), place)
        share = F.when(place.isNull(), share).when(at > 0, F.element_at(_numbers([slices[v] for v in held]), F.greatest(at, F.lit(1)).cast("int")))
    else:
        share = F.when(place.isNull(), share)
    tie = F.when(share.isNotNull(), F.col("key"))
    # Slices of equal width over the hashes, in their order.
    part = F.floor((tie.cast("double") / 2.0**64 + 0.5) * share).cast("bigint")
    base = F.when(place.isNull(), -1).otherwise(_below(cuts, place) if cuts else 0).cast("bigint") * (1 << _SLICE_BITS)
    return base + F.coalesce(share - F.least(part, share - 1), F.lit(0)), tie


def with_next(df: DataFrame, carry: list[str], bucket_rows: int = 2000) -> DataFrame:
    """Adds next_<c> for each column c to carry, of the next row in descending doc_id; after the last comes the first.

    A window in each range of doc_ids finds the neighbour. The first row of a range goes to the range before it too, as
    a guest at its end, so that rows are shuffled once, and only ids are read to know which they are. Needs the columns
    doc_id and key.
    """
    bucket, tie = _ranges(df.select("doc_id"), bucket_rows)
    place = df.select("doc_id", "key").select(bucket.alias("bucket"), "doc_id", F.bitwise_not(tie).alias("tie"))
    top = place.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top")).select("bucket", "top.*")
    order = Window.orderBy(F.col("bucket").desc())  # a row for each range alone
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = top.select(F.col("bucket").alias("top_bucket"), F.col("doc_id").alias("top_id"), F.col("tie").alias("top_tie"), F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole)).alias("guest_of"))
    placed = df.withColumns({"bucket": bucket, "tie": tie}).join(F.broadcast(heads), F.expr("bucket = top_bucket AND doc_id <=> top_id AND ~tie <=> top_tie"), "left")
    own, guest = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))
    dealt = placed.select(*df.columns, "tie", F.explode(F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    over = Window.partitionBy("at.bucket").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), "tie", *carry)
    found = dealt.select("*", *(F.lead(c).over(over).alias(f"next_{c}") for c in carry))
    return found.filter("NOT at.guest").drop("at", "tie")


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """Each document beside an edited text of its own and beside the next document in descending doc_id.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1 or 0: canonical
    texts are equal or not), copies. Texts are read twice: once whole, once those of buckets with two rows or more.
    """
    scratch, src = Scratch(df.sparkSession, "neighbours"), _source(df, id_col, text_col)
    beside = with_next(_printed(src, F.col("text"), "fingerprint", "sha", digest_of), ["text", "fingerprint", "sha"])
    half = F.floor(F.length("text") / 2).cast("int")
    beside = beside.withColumn("edited", F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 2) AS int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    beside = _printed(beside, F.col("edited"), "edited_fingerprint", "edited_sha", digest_of)
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    rows = scratch.keep(
        beside.select(
            "doc_id", "key", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "sha", "edited_fingerprint", "edited_sha",
            same("sha", "edited_sha").alias("near_edited"), same("sha", "next_sha").alias("near_next"),
        ), "rows",
    )
    shared = scratch.keep(shared_buckets(rows), "shared")
    both = rows.select(F.explode(F.array(F.struct("fingerprint", "sha"), F.struct(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_sha").alias("sha")))).alias("p")).select("p.*")
    unlike = both.groupBy("fingerprint").agg(F.min("sha").alias("least"), F.max("sha").alias("most")).filter("least <> most").select("fingerprint")
    bad = scratch.keep(_collided(src, rows, shared, scratch).unionByName(unlike).distinct(), "bad")
    if not bad.isEmpty():
        rows = scratch.keep(_resolved(rows, bad, [("fingerprint", "sha"), ("edited_fingerprint", "edited_sha")]), "resolved")
        shared = scratch.keep(shared_buckets(rows), "shared-now")
    scratch.drop("members")
    out = rows.join(few(shared, BROADCAST_ROWS), "fingerprint", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies")
