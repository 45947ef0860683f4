"""Canonical exact digests of texts, in DataFrame expressions only.

A text is normalised (NFKC), case-folded, normalised again, and its white space folded to single spaces; the
digest is two independent 64-bit xxhashes of the result. Texts of equal digest form a bucket; inside a bucket
every canonical text is compared byte by byte with the bucket's first (smallest id), and one that differs gets
a digest extended by its SHA-256, so that equal fingerprints mean equal canonical texts.

Defined results: a null text counts as empty; a null id sorts last; repeated ids are ordered by text; an empty
table gives no rows; extra columns are ignored. Likeness of two digests is 1.0 if the canonical texts are equal
and else 0.0: a digest carries no finer measure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import stage_table

#: Rows of one bucket are compared in this many tasks.
SALTS = 16
#: Documents of neighbouring ids that one window partition holds, and the most partitions.
RANGE_ROWS, MOST_RANGES = 2000, 100_000


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, white space runs to one space, ends trimmed."""
    call = lambda cls, method, x: F.call_function("reflect", F.lit(cls), F.lit(method), x, F.lit(True))
    compose = lambda x: call("com.ibm.icu.text.Normalizer", "compose", x)
    folded = compose(call("com.ibm.icu.lang.UCharacter", "foldCase", compose(F.coalesce(text, F.lit("")))))
    return F.btrim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half(1), half(2))


def with_next(docs: DataFrame, columns: tuple[str, ...], key: str = "_key") -> DataFrame:
    """Rows with ``next_<c>`` of the next row in descending ``key`` order; after the last comes the first.

    The order is cut into ranges of keys (bounds: one pair per range on the driver); a window runs inside each
    range, to which the first row of the range below is added as a guest.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    keys = docs.select(key).repartitionByRange(ranges, key)
    spans = sorted(
        (r["lo"], r["hi"])
        for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    )
    lows = [lo for lo, _ in spans] or [0]
    highs = [hi for _, hi in spans] or [0]
    depth = len(lows).bit_length()
    bounds = f"array({', '.join(f'CAST({x} AS BIGINT)' if x > -(2**63) else 'CAST(-9223372036854775807 AS BIGINT) - 1L' for x in lows)})"
    tops = f"array({', '.join(f'CAST({x} AS BIGINT)' if x > -(2**63) else 'CAST(-9223372036854775807 AS BIGINT) - 1L' for x in highs)})"
    search = (
        f"aggregate(sequence({depth}, 0, -1), 0, (a, k) -> CASE WHEN a + shiftleft(1, k) <= {len(lows)}"
        f" AND {bounds}[least(a + shiftleft(1, k), {len(lows)}) - 1] <= {key} THEN a + shiftleft(1, k) ELSE a END) - 1"
    )
    placed = docs.withColumn("_r", F.expr(search))
    homes = F.expr(
        f"""CASE WHEN {key} = {tops}[_r] THEN array(named_struct('r', _r, 'guest', 0),
              named_struct('r', (_r + 1) % {len(lows)}, 'guest', 1))
            ELSE array(named_struct('r', _r, 'guest', 0)) END"""
    )
    spread = placed.withColumn("_h", F.explode(homes)).withColumn("_r", F.col("_h.r")).withColumn("_guest", F.col("_h.guest")).drop("_h")
    w = Window.partitionBy("_r").orderBy(F.col("_guest"), F.col(key).desc(), *[F.col(c) for c in columns])
    led = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where("_guest = 0").drop("_guest", "_r")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text, with bytes compared inside equal buckets."""
    own = docs.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint"))
    return _verified(docs, stage_table(own, "digests"))


def _verified(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``own`` with the fingerprints of texts that differ from their bucket's first text extended."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    multi = own.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(key).alias("rep")).where("n > 1")
    salted = multi.select("fingerprint", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    members = own.select("doc_id", "fingerprint", salt).join(salted, ["fingerprint", "salt"]).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "fingerprint", "rep", "salt"
    ).distinct()
    texts = docs.select(key.alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(members, "k").select(
        "k", "fingerprint", "rep", "salt", canonical(F.col("text")).alias("canon")
    )
    # a repeated id may bring several texts; the smallest stands for the bucket
    texts = stage_table(texts.where(digest(F.col("canon")) == F.col("fingerprint")), "bucket-texts")
    first = texts.where("k = rep").groupBy("fingerprint").agg(F.min("canon").alias("first"))
    first = first.select("fingerprint", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    odd = (
        texts.join(first, ["fingerprint", "salt"])
        .where("canon <> first")
        .select(F.col("k").alias("odd_k"), F.col("fingerprint").alias("odd_f"), F.sha2("canon", 256).alias("more"))
        .groupBy("odd_k", "odd_f")
        .agg(F.min("more").alias("more"))
    )
    joined = own.join(odd, (key == odd.odd_k) & (own.fingerprint == odd.odd_f), "left")
    extended = F.when(F.col("more").isNotNull(), F.concat("fingerprint", F.lit("-"), "more")).otherwise(F.col("fingerprint"))
    return joined.withColumn("fingerprint", extended).drop("odd_k", "odd_f", "more")


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to it and to the next document."""
    docs = docs.select("doc_id", "text")
    base = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"),
        F.coalesce("text", F.lit("")).alias("t"),
    ).withColumn("f", digest(canonical(F.col("t"))))
    led = with_next(base, ("t", "f"))
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr("next_t", F.lit(1), half))
    led = led.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    led = led.withColumn("fe", digest(F.col("edited_canon")))
    same = lambda f, other: F.when(F.col("f") != f, 0.0).when(canonical(F.col("t")) == other, 1.0).otherwise(0.0)
    own = stage_table(
        led.select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.col("f").alias("fingerprint"),
            F.col("fe").alias("edited_fingerprint"),
            same(F.col("fe"), F.col("edited_canon")).alias("near_edited"),
            same(F.col("next_f"), canonical(F.col("next_t"))).alias("near_next"),
        ),
        "digests",
    )
    out = _verified(docs, own)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
