"""Personal data by weak supervision, in DataFrame expressions only.

Regular expressions propose candidate spans. Labelers (strict pattern, checksum or shape, gazetteer, context,
neighbourhood) vote +1, -1 or 0 on each. Votes and the span's length class form one small integer, so the whole
corpus reduces to at most ``4 * 3**5 * 4 = 3888`` counted patterns: expectation-maximisation over that table gives
each labeler's reliability and each pattern's posterior, and a logistic span classifier is fitted to the
posteriors. Its verdict per pattern is a literal in the second pass. Base spans (the contract's grammar) always
stay; the classifier decides on the others.

Positions count code points, ends are exclusive. Defined results: null text counts as empty and has no spans;
repeated rows and null ids are handled row by row; an empty table gives no rows (the classifier then keeps its
prior); extra columns are untouched by :func:`redact` and dropped by :func:`detect`. All patterns are linear in
the text: they use possessive quantifiers, and matches start only at the start of a run or where the last ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's grammar with possessive loops; lengths of cards and phones are part of the pattern.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])",
}
#: Wider candidates that the classifier decides on.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+.(-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
}
#: Words before a span that speak for its kind.
GAZETTEER = {
    "email": "e-?mail|mail|contact|contacto|courriel|correo|adresse|write|reply|schreib",
    "ip": "ip|host|server|address|adresse|addr|login|from",
    "card": "card|carte|karte|tarjeta|visa|mastercard|amex|credit|payment|pan|cc",
    "phone": "phone|tel|telephone|telefon|tél|téléphone|teléfono|call|mobile|cell|fax|whatsapp|sms",
}
#: Characters before a span that its context labelers read.
CONTEXT = 40
N_VOTES = 5
EM_ROUNDS = 25


_ARRAY = "ARRAY<STRUCT<kind:INT,s:INT,e:INT,m:STRING,base:BOOLEAN>>"


def _spans(pattern: str, kind: int, base: bool, needs: str) -> str:
    """SQL: array of candidate structs of one pattern over ``_t``, empty where the cheap test ``needs`` fails."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""CASE WHEN {needs} THEN
      aggregate(
        zip_with(regexp_extract_all(_t, '{p}', 0), split(_t, '{p}', -1), (m, g) -> named_struct('m', m, 'g', g)),
        named_struct('at', 0, 'out', CAST(array() AS {_ARRAY})),
        (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct('at', a.at + char_length(x.g) + char_length(x.m), 'out',
          concat(a.out, array(named_struct('kind', {kind}, 's', a.at + char_length(x.g), 'e', a.at + char_length(x.g) + char_length(x.m), 'm', x.m, 'base', {str(base).lower()})))) END,
        a -> a.out)
      ELSE CAST(array() AS {_ARRAY}) END"""


#: Cheap tests that spare most texts the patterns.
_NEEDS = {
    "email": "instr(_t, '@') > 0",
    "ip": "_t rlike '[0-9][.][0-9]'",
    "card": "_t rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'",
    "phone": "_t rlike '[+][0-9]'",
}
_WIDER_NEEDS = {
    "email": "_t rlike '[(\\\\[{]at[)\\\\]}]'",
    "ip": "_t rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'",
    "card": _NEEDS["card"],
    "phone": "_t rlike '[0-9][ .-][0-9]{4}'",
}
#: Checks that base matches must pass beyond their pattern.
_CHECK = {
    0: "true",
    1: "forall(split(x.m, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND CAST(concat('0', right(ltrim('0', p), 3)) AS INT) <= 255)",
    2: "luhn_check(regexp_replace(x.m, '[ -]', ''))",
    3: "true",
}


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_t`` (text, null as empty), ``_base`` (passing base spans) and ``_wide`` (candidates beside them)."""
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for k, kind in enumerate(KINDS):
        out = out.withColumn(f"_b{k}", F.expr(_spans(BASE[kind], k, True, _NEEDS[kind])))
        out = out.withColumn(f"_w{k}", F.expr(_spans(WIDER[kind], k, False, _WIDER_NEEDS[kind])))
    out = out.withColumn("_base", F.concat(*[F.expr(f"filter(_b{k}, x -> {_CHECK[k]})") for k in range(4)]))
    wide = F.expr("filter(concat(_w0, _w1, _w2, _w3), x -> NOT exists(_base, b -> b.s < x.e AND x.s < b.e))")
    return out.withColumn("_wide", wide).drop(*[f"_{c}{k}" for c in "bw" for k in range(4)])


def _votes(x: str) -> str:
    """SQL: the pattern code of candidate ``x``: kind, five votes in base 3 (1 is abstention), length class."""
    before = f"lower(substring(_t, greatest({x}.s - {CONTEXT}, 0) + 1, least({x}.s, {CONTEXT})))"
    after = f"substring(_t, {x}.e + 1, 1)"
    gaz = " ".join(f"WHEN {k} THEN '(?<![\\\\p{{L}}])(?:{GAZETTEER[n]})[^\\\\p{{L}}]*$'" for k, n in enumerate(KINDS))
    digits = f"regexp_replace({x}.m, '[^0-9]', '')"
    votes = [
        # strict pattern
        f"CASE WHEN {x}.base THEN 2 ELSE 0 END",
        # checksum or shape
        f"""CASE {x}.kind WHEN 0 THEN CASE WHEN {x}.m rlike '[.\\\\])}}] ?[A-Za-z]{{2,24}}$' THEN 2 ELSE 0 END
            WHEN 1 THEN CASE WHEN {x}.m rlike '[.:]' AND NOT {x}.m rlike '^0[.:]' THEN 2 ELSE 0 END
            WHEN 2 THEN CASE WHEN luhn_check({digits}) THEN 2 ELSE 0 END
            ELSE CASE WHEN char_length({digits}) >= 10 THEN 2 ELSE 0 END END""",
        # gazetteer word just before
        f"CASE WHEN {before} rlike CASE {x}.kind {gaz} END THEN 2 ELSE 1 END",
        # issuer, area or top-level domain
        f"""CASE {x}.kind WHEN 0 THEN CASE WHEN {x}.m rlike '(?i)(com|org|net|edu|gov|io|de|fr|es|uk|eu)$' THEN 2 ELSE 1 END
            WHEN 1 THEN 1
            WHEN 2 THEN CASE WHEN {digits} rlike '^(4|5[1-5]|2[2-7]|3[47]|6)' THEN 2 ELSE 0 END
            ELSE CASE WHEN {digits} rlike '^[2-9][0-9]{{2}}[2-9]' OR {x}.base THEN 2 ELSE 0 END END""",
        # neighbourhood: code, keys and identifiers speak against
        f"CASE WHEN {before} rlike '[=_/#\"a-z0-9]$' OR {after} rlike '[A-Za-z0-9_=\"/]' THEN 0 ELSE 1 END",
    ]
    code = f"{x}.kind"
    for v in votes:
        code = f"({code}) * 3 + ({v})"
    return f"({code}) * 4 + least(3, greatest(0, ({x}.e - {x}.s) div 8))"


def pattern_counts(found: DataFrame) -> DataFrame:
    """(code, n): how often each pattern of votes occurs in the corpus; at most 3888 rows at any size."""
    codes = F.expr(f"transform(concat(_base, _wide), x -> {_votes('x')})")
    return found.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def _decode(code: int) -> tuple[int, list[int], int]:
    code, size = divmod(code, 4)
    votes = []
    for _ in range(N_VOTES):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], size


def fit(counts: dict[int, int]) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """Posterior of each pattern after EM and the span classifier's fit, and each (kind, labeler)'s reliability.

    Works on the bounded pattern table only. A labeler's reliability is the chance that a vote of its is right;
    a symmetric prior of 4 right to 1 wrong votes keeps it above chance where a kind is rare.
    """
    reliability: dict[tuple[int, int], float] = {}
    posterior: dict[int, float] = {}
    for kind in range(len(KINDS)):
        rows = [(c, n, _decode(c)[1]) for c, n in counts.items() if _decode(c)[0] == kind]
        right, prior = [0.8] * N_VOTES, 0.5
        for _ in range(EM_ROUNDS):
            hit, cast, positive = [4.0] * N_VOTES, [5.0] * N_VOTES, 1.0
            for code, n, votes in rows:
                z = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
                posterior[code] = p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                positive += n * p
                for j, v in enumerate(votes):
                    if v:
                        hit[j] += n * (p if v > 0 else 1 - p)
                        cast[j] += n
            right = [min(0.99, max(0.51, h / c)) for h, c in zip(hit, cast, strict=True)]
            prior = min(0.99, max(0.01, positive / (2 + sum(n for _, n, _ in rows))))
        reliability |= {(kind, j): r for j, r in enumerate(right)}
    weights = [0.0] * (N_VOTES + 4 + len(KINDS))
    features = {c: _features(c) for c in counts}
    total = sum(counts.values()) or 1
    for _ in range(400):  # full-batch gradient steps on the posteriors
        slope = [1e-3 * w for w in weights]
        for code, n in counts.items():
            err = (_sigmoid(weights, features[code]) - posterior[code]) * n / total
            for j, x in features[code]:
                slope[j] += err * x
        weights = [w - 1.0 * g for w, g in zip(weights, slope, strict=True)]
    return {c: _sigmoid(weights, f) for c, f in features.items()}, reliability


def _features(code: int) -> list[tuple[int, float]]:
    kind, votes, size = _decode(code)
    return [(j, float(v)) for j, v in enumerate(votes) if v] + [(N_VOTES + size, 1.0), (N_VOTES + 4 + kind, 1.0)]


def _sigmoid(weights: list[float], features: list[tuple[int, float]]) -> float:
    z = sum(weights[j] * x for j, x in features)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def detect(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with ``_base`` and ``_spans`` (base spans and accepted others, by kind, then start)."""
    found = candidates(docs, text)
    counts = {r["code"]: r["n"] for r in pattern_counts(found).collect()}  # at most 3888 rows
    probability, _ = fit(counts)
    accepted = sorted(c for c, p in probability.items() if p >= threshold)
    chosen = F.expr(f"filter(_wide, x -> ({_votes('x')}) IN ({', '.join(map(str, accepted))}))") if accepted else F.expr("filter(_wide, x -> false)")
    return found.withColumn("_spans", F.array_sort(F.concat("_base", chosen)))


def _digest(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.s, ':', x.e)), ',')"


def query(docs: DataFrame) -> DataFrame:
    found = detect(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(_base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.expr(f"sha2({_digest('_base')}, 256)").alias("base_sha256"),
        F.expr(_digest("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span replaced by ``[KIND]``; other columns, and null texts, are unchanged.

    Overlapping spans are replaced as one, by the kind of the one that starts first, the longest of those.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    found = detect(packed, "_text").withColumn("_at", F.expr("array_sort(transform(_spans, x -> struct(x.s AS s, -x.e AS back, x.kind AS kind)))"))
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    rewritten = F.expr(
        f"""aggregate(_at, named_struct('at', 0, 'out', ''),
          (a, x) -> CASE WHEN x.s < a.at THEN named_struct('at', greatest(a.at, -x.back), 'out', a.out) ELSE named_struct('at', -x.back, 'out',
             concat(a.out, substring(_t, a.at + 1, x.s - a.at), element_at(array({kinds}), x.kind + 1))) END,
          a -> concat(a.out, substring(_t, a.at + 1)))"""
    )
    new: Column = F.when(F.size("_at") == 0, F.col("_text")).otherwise(rewritten)
    return found.withColumn("_new", new).select(*[(F.col("_new") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
