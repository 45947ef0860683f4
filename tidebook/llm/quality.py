"""Rule bitmask ledger for document quality.

Every rule is evaluated once into a measurement and one bit of ``fail_bits``. Versioned policies are
masks over those bits, so changing a policy, or asking what a rule alone rejects, reads the ledger and
never the texts.

Defined results: a null or empty text has no words and no lines (bit 0 set, all measurements 0); repeated
rows and null ids are judged row by row; an empty table gives an empty ledger; extra columns are ignored
by :func:`ledger` unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import SPACES, stage_table, words

#: Symbols that the symbol measurement counts.
SYMBOLS = "#*$%&|<>"

#: name -> failing condition over the measurements. The position is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 7 * n_lines",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "few_letter_words": "10 * n_letter_words < 6 * n_words",
    "bulleted": "10 * n_bullet_lines > 9 * n_lines",
    "ellipsis_lines": "10 * n_ellipsis_lines > 3 * n_lines",
    "shouting": "10 * n_upper > 6 * n_letters",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policy versions: the rules that reject. "base" is the contract's floor.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_mean_word", "long_mean_word"),
    "v2": tuple(RULES),
}
#: The version used by the query and the pipeline.
CURRENT = "v2"


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _hashes(ws: str) -> str:
    """SQL for the 64-bit hashes of the 3-word windows of array ``ws``, in text order."""
    return f"CASE WHEN size({ws}) >= 3 THEN transform(slice({ws}, 1, size({ws}) - 2), (x, i) -> xxhash64(x, {ws}[i + 1], {ws}[i + 2])) END"


def _places(hs: str) -> str:
    """SQL for the windows of array ``hs`` as (hash, position) in hash order; null where no two hashes are equal.

    ``sort_array`` compares natively, ``array_sort`` through a lambda. The cost is n log n in the words of one text,
    paid by texts that repeat a window only, and nothing leaves the row.
    """
    return f"CASE WHEN size(array_distinct({hs})) < size({hs}) THEN sort_array(transform({hs}, (x, i) -> struct(x AS h, i AS i))) END"


def _repeat_words(sorted_: str) -> str:
    """SQL for the words that lie in windows whose hash equals a neighbour's in array ``sorted_``."""
    same = f"filter({sorted_}, (x, k) -> coalesce(x.h = get({sorted_}, k - 1).h, false) OR coalesce(x.h = get({sorted_}, k + 1).h, false))"
    return f"CASE WHEN {sorted_} IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform({same}, x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT) END"


def _trails(line: Column, mark: str) -> Column:
    """Whether the line ends in mark and white space; a regex's ``$`` would pass over U+0085, U+2028 and U+2029 too."""
    return F.contains(line, F.lit(mark)) & F.endswith(F.rtrim(line, F.lit(SPACES)), F.lit(mark))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep`` columns, measurements and ``fail_bits``."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*[F.col(c) for c in keep], t.alias("_t"), words(t).alias("_w"), F.split(t, "\n").alias("_l0"))
    base = base.withColumn("_lines", F.expr("filter(_l0, x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    placed = base.withColumn("_h", F.expr(_hashes("_w"))).withColumn("_s", F.expr(_places("_h")))
    long = lambda c: c.cast("long")
    n_chars = F.char_length("_t")
    measured = placed.select(
        *keep,
        long(F.size("_w")).alias("n_words"),
        long(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr(_repeat_words("_s")).alias("n_repeat_words"),
        long(F.expr("size(filter(_w, x -> x rlike '\\\\p{L}'))")).alias("n_letter_words"),
        long(F.expr("size(filter(_lines, x -> x rlike '^[\\\\x20\\\\x09]*[-*\\u2022\\u25cf]'))")).alias("n_bullet_lines"),
        long(F.size(F.filter("_lines", lambda x: _trails(x, "...") | _trails(x, "\u2026")))).alias("n_ellipsis_lines"),
        long(n_chars - F.char_length(F.regexp_replace("_t", "\\p{Lu}+", ""))).alias("n_upper"),
        long(n_chars - F.char_length(F.regexp_replace("_t", "\\p{L}+", ""))).alias("n_letters"),
    )
    bits: Column = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits + F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits)


def rejected_by(bits: Column, policy: str | tuple[str, ...] = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects; one bitwise aggregation."""
    m = F.lit(mask(policy)).cast("long")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    counted = led.groupBy(F.col("fail_bits").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    return (
        counted.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of documents as a written table: every rule is evaluated once, and policies and ablations read what was stored."""
    return stage_table(ledger(docs.select("doc_id", "text")), "ledger")


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The query's rows: all measurements, the base verdict and the policy's, read off the stored ledger."""
    base = rejected_by(F.col("fail_bits"), "base")
    return stored(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~rejected_by(F.col("fail_bits"), policy)).alias("kept"),
        "fail_bits", "n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "n_upper", "n_letters",
    )


def ablations(docs: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_failed_alone) of every policy, off one stored ledger."""
    led, out = stored(docs), None
    for policy in POLICIES:
        one = ablation(led, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_failed_alone")
        out = one if out is None else out.unionByName(one)
    return out


def accepted(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of docs that neither the base rules nor the policy reject, unchanged."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    led = ledger(packed, "_text", ("_row",))
    ok = ~rejected_by(F.col("fail_bits"), tuple({*POLICIES["base"], *POLICIES[policy]}))
    # a filter would be pushed below the measurements, which copies them into it again and again
    kept = led.select(F.explode_outer(F.when(ok, F.array("_row"))).alias("_kept")).where("_kept IS NOT NULL")
    return kept.select(*[F.col("_kept")[c].alias(c) for c in docs.columns])
