"""Exact n-gram Jaccard join by prefix filters under several global token orders.

Two sets of Jaccard likeness t or more share a token in their prefixes of ``n - ceil(t n) + 1`` tokens, whatever
global order the tokens are put in. Here every order puts rare tokens first (so that passages which many
documents share fall out of the prefixes) and differs in how it ranks the rest; a pair is verified only if its
prefixes meet under *every* order.

Steps, none of which gathers an unbounded group:

1. Each text becomes a set of 64-bit shingle hashes; equal sets form one class (its hash is its name), so exact
   copies are handled once, and before any shuffle within a task.
2. Shingles are dealt by hash range, packed in bytes, and each range finds the shingles of two or more classes
   and their frequency. Only these can be shared: classes with fewer than ceil(t n) of them are out. A shingle
   that alone would fill a good part of a range (HEAVY, counted over the whole table) is listed apart instead.
3. Every member is held against the two pivots that most of its prefix lists propose; a list proposes a member
   of its largest component. Verified links are joined to components, and lists that still hold several
   components propose anew, while that links.
4. Each member still outside its list's largest component meets every member its lists lead to, block by block.
   Pairs inside a component need no test, as the result is its components.

Memory: a range holds about RANGE_TOKENS shingles; the last step's blocks hold BLOCK members.
Defined results: null or word-less texts have an empty set, link with nothing and stand alone; repeated rows and
ids give one row each; a null id forms a class like others, but names no component; an empty table gives no
rows; extra columns are ignored by :func:`components` and kept by :func:`deduplicated`. Classes are named by 64-bit
hashes. A shingle is named by its range and 48 bits of its hash more (all 64 from 65,536 ranges on), so two given
texts of 1000 shingles each meet in one that they do not share once in 10**10 pairs at 64 ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow
from tidebook.llm.common import stage_table, unstage
from tidebook.llm.components import connected_components

#: Shingle occurrences of one hash range; occurrences in the whole table from which a shingle is listed apart; the
#: most such shingles that are sent to every task (rarer ones then take the common way); classes of one portion from
#: which a shingle is reported to the count.
RANGE_TOKENS = 2_000_000
HEAVY, MOST_HEAVY, REPORTED = RANGE_TOKENS // 16, 200_000, 4
#: Classes that a task remembers, so as not to deal a copy twice.
REMEMBERED = 200_000
#: Texts of one batch are worked on in portions of about this many characters, and dealt in ones of so many shingles.
PORTION, DEALT = 4_000_000, 1_500_000
#: Members of a component that one row of the exhaustive step holds; members that share a copy of the blocks there;
#: members whose blocks one task goes through.
BLOCK, PROBES, SLICE = 64, 512, 8192
#: Global orders: each ranks by (a function of the frequency, a hash), rare first.
ORDERS = ("x.df, x.token", "CAST(log2(x.df) AS INT), xxhash64(x.token), x.token", "CAST(log2(x.df) / 2 AS INT), xxhash64(x.token, 7), x.token")


def shingle_sets(texts, width: int) -> Iterator[tuple[int, object]]:
    """(row, sorted distinct uint64 shingle hashes) of each text of an Arrow array that has a word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    edges, total = [0], 0
    for i, s in enumerate(sizes):
        total += s
        if total > PORTION:
            edges.append(i + 1)
            total = 0
    edges.append(len(sizes))
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo == hi:
            continue
        body = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(lo, hi - lo), "")))
        lists = pc.split_pattern_regex(body.cast(pa.large_string()), pattern="[\\x20\\x09-\\x0D]+")
        coded = lists.flatten().dictionary_encode()
        names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
        words = names[np.asarray(coded.indices)]
        ends = np.asarray(lists.offsets)
        base = ends[0]
        mixed = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ words[k : k + len(mixed)]) * mult[k % 4] + np.uint64(k + 1)
            mixed ^= mixed >> np.uint64(29)
        empty = np.asarray(pc.equal(body, ""))
        for j in range(hi - lo):
            if empty[j]:
                continue
            a, b = ends[j] - base, ends[j + 1] - base
            if b - a >= width:
                yield lo + j, np.unique(mixed[a : b - width + 1])
            else:
                whole = xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=1)
                yield lo + j, np.array([whole], dtype=np.uint64)


def name_of(tokens) -> int:
    """A set's 64-bit name, as a signed number."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=2)
    return h - (1 << 64) if h >> 63 else h


def sets_of(docs: DataFrame, width: int, heavy_from: int = HEAVY) -> tuple[DataFrame, list[int]]:
    """(doc_id, key, n, sig) of every document, key being the text's hash, and the heavy shingles."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "key", "n", "sig", "token", "often"]
        long = lambda x: pa.array(x, pa.int64())

        def reported(parts):
            found, often = np.unique(np.concatenate(parts), return_counts=True)
            kept = often >= min(REPORTED, heavy_from)
            none = pa.nulls(int(kept.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, long(found[kept].view(np.int64)), long(often[kept])], names=names)

        for batch in batches:
            count, seen, parts, held = batch.num_rows, set(), [], 0
            n, sig = [0] * count, [None] * count
            for row, tokens in shingle_sets(batch.column(2), width):
                n[row], sig[row] = len(tokens), name_of(tokens)
                if sig[row] not in seen:
                    seen.add(sig[row])
                    parts.append(tokens)
                    held += len(tokens)
                if held >= DEALT:
                    yield reported(parts)
                    parts, held = [], 0
            if parts:
                yield reported(parts)
            none = pa.nulls(count, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), long(n), long(sig), none, none], names=names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = stage_table(arrow(texts).mapInArrow(scan, "doc_id long, key long, n long, sig long, token long, often long"), "sets")
    heavy = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("often").alias("often")).where(F.col("often") >= heavy_from)
    known = [r["token"] for r in heavy.orderBy(F.col("often").desc(), "token").limit(MOST_HEAVY).select("token").collect()]
    return rows.where("token IS NULL").select("doc_id", "key", "n", "sig"), known


def shared_tokens(docs: DataFrame, width: int, ranges_log2: int, heavy: list[int]) -> DataFrame:
    """(sig, token, df) of every shingle that two or more classes have; heavy ones with df 2**40."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast(sorted(heavy))  # at most MOST_HEAVY numbers
    texts = arrow(docs.select("text"))
    kept_bits = min(64, ranges_log2 + 48)

    def classes(batches):
        """(sig, tokens, is_heavy) of each class once per task, as far as remembered names go."""
        import numpy as np

        often = np.array(known.value, dtype=np.int64).view(np.uint64)
        often = np.sort(often)
        seen: set[int] = set()
        for batch in batches:
            out, held = [], 0
            for _, tokens in shingle_sets(batch.column(0), width):
                sig = name_of(tokens)
                if sig in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(sig)
                at = np.searchsorted(often, tokens)
                is_heavy = (often[np.minimum(at, len(often) - 1)] == tokens) if len(often) else np.zeros(len(tokens), bool)
                out.append((sig, tokens, is_heavy))
                held += len(tokens)
                if held >= DEALT:
                    yield out
                    out, held = [], 0
            yield out

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        shift = np.uint64(64 - ranges_log2)
        for found in classes(batches):
            light = [t[~h] for _, t, h in found]
            tokens = np.concatenate(light) if light else np.zeros(0, np.uint64)
            if not len(tokens):
                continue
            r = (tokens >> shift).astype(np.int32) if ranges_log2 else np.zeros(len(tokens), np.int32)
            order = np.argsort(r, kind="stable")
            r = r[order]
            low = (tokens << np.uint64(ranges_log2))[order] >> np.uint64(16)  # the 48 bits after the range's
            owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t in light])[order]
            del tokens, light, order
            low32, low16 = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)
            sigs = np.array([s for s, _, _ in found], dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            cols: tuple[list, ...] = ([], [], [], [], [])
            for a, b in zip(starts, [*starts[1:], len(r)], strict=True):
                own, count = np.unique(owner[a:b], return_counts=True)
                for col, v in zip(cols, (int(r[a]), low32[a:b].tobytes(), low16[a:b].tobytes(), count.astype(np.uint32).tobytes(), sigs[own].tobytes()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["r", "low32", "low16", "count", "sigs"])

    def match(table):
        import numpy as np
        import pyarrow as pa

        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(c)])
        low = join("low16", np.uint16).astype(np.uint64) << np.uint64(32)
        low |= join("low32", np.uint32)
        order = np.argsort(low, kind="stable")
        same = low[order[1:]] == low[order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]]
        sig = np.repeat(join("sigs", np.int64), join("count", np.uint32))[order]
        low = low[order]
        order = np.lexsort((sig, low))
        low, sig = low[order], sig[order]
        first = np.r_[True, (low[1:] != low[:-1]) | (sig[1:] != sig[:-1])] if len(low) else np.zeros(0, bool)
        low, sig = low[first], sig[first]  # a class once, however many tasks met it
        _, at, df = np.unique(low, return_inverse=True, return_counts=True)
        df = df[at] if len(low) else np.zeros(0, int)
        keep = df >= 2
        order = np.argsort(sig[keep], kind="stable")
        name = (low[keep] >> np.uint64(48 + ranges_log2 - kept_bits)) | (np.uint64(table.column("r")[0].as_py()) << np.uint64(kept_bits - ranges_log2))
        return pa.Table.from_arrays([pa.array(x[order]) for x in (sig[keep], name.view(np.int64), df[keep].astype(np.int64))], names=["sig", "token", "df"])

    out = texts.mapInArrow(deal, "r int, low32 binary, low16 binary, count binary, sigs binary").groupBy("r").applyInArrow(match, "sig long, token long, df long")
    if not heavy:
        return out

    def listed(batches):
        import numpy as np
        import pyarrow as pa

        drop = np.uint64(64 - kept_bits)
        for found in classes(batches):
            part = [(s, (t[h] >> drop).view(np.int64)) for s, t, h in found if h.any()]
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([s for s, _ in part], [len(t) for _, t in part])), pa.array(np.concatenate([t for _, t in part]))], names=["sig", "token"])

    frequent = texts.mapInArrow(listed, "sig long, token long").distinct()
    return out.unionByName(frequent.withColumn("df", F.lit(1 << 40).cast("long")))


def prefixes(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, tokens, p0, p1, ...) of the classes that may link: shared tokens and the prefix of each order.

    A class's shared tokens meet in one row, as its text did.
    """
    need = f"(({percent} * n + 99) div 100)"
    sizes = sets.where("sig IS NOT NULL").groupBy("sig").agg(F.max("n").alias("n"))
    gathered = shared.groupBy("sig").agg(F.collect_list(F.struct("token", "df")).alias("ts")).join(sizes, "sig").where(f"size(ts) >= {need}")
    ranked = [f"transform(slice(array_sort(transform(ts, x -> struct({o}))), 1, size(ts) - CAST({need} AS INT) + 1), y -> y.token) AS p{k}" for k, o in enumerate(ORDERS)]
    return gathered.selectExpr("sig", "n", "array_sort(transform(ts, x -> x.token)) AS tokens", *ranked)


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes meet under every order and whose likeness reaches the threshold."""
    side = lambda s: held.select(*[F.col(c).alias(f"{c}_{s}") for c in held.columns])
    meet = " AND ".join(f"arrays_overlap(p{k}_a, p{k}_b)" for k in range(len(ORDERS)))
    both = pairs.join(side("a"), F.col("a") == F.col("sig_a")).join(side("b"), F.col("b") == F.col("sig_b"))
    near = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {meet}")
    size = "size(array_intersect(tokens_a, tokens_b))"
    return near.where(f"100 * {size} >= {percent} * (n_a + n_b - {size})").select("a", "b")


def _open_lists(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(token, sig, part, main) of the lists that hold several components; main is the one of most members."""
    if parts is None:
        named = lists.withColumn("part", F.col("sig"))
    else:
        named = lists.join(parts, lists.sig == parts.node, "left").select("token", "sig", F.coalesce("component", "sig").alias("part"))
    named = stage_table(named, "named")
    counted = named.groupBy("token", "part").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("token").agg(F.max_by("part", F.struct("c", F.xxhash64("part"), "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = stage_table(mixed.select("token", "main"), "mixed")
    out = stage_table(named.join(mixed, "token"), "open")
    unstage(named, mixed)
    return out


def _proposed(apart: DataFrame, turn: int) -> DataFrame:
    """(a, b): every member outside its lists' main components with the two pivots that most of its lists propose."""
    drawn = F.xxhash64("sig", F.lit(turn))
    pivots = apart.where("part = main").groupBy("token").agg(F.min_by("sig", F.struct(drawn, F.col("sig"))).alias("pivot"))
    pivots = stage_table(pivots, "pivots")
    votes = apart.where("part <> main").join(pivots, "token").groupBy("sig", "pivot").agg(F.count("*").alias("votes"))
    best = votes.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "pivot")), asc=False), 1, 2).alias("best"))
    out = stage_table(best.select("sig", F.explode("best.pivot").alias("pivot")).select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct(), "pairs")
    unstage(pivots)
    return out


def links_of(held: DataFrame, percent: int) -> DataFrame:
    """(node, component) over the classes that have a link, and lose no link between components.

    Rounds of pivots come first: large groups of near copies join without their pairs. They end when a round links
    under a tenth of the members still apart. Those are then held against all others, in blocks.
    """
    entries = stage_table(held.select("sig", F.explode("p0").alias("token")), "entries")
    several = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    lists = stage_table(entries.join(several, "token"), "lists")
    unstage(entries)
    links: list[DataFrame] = []
    parts, turn, found = None, 0, 0
    while True:
        apart = _open_lists(lists, parts)
        minors = apart.where("part <> main").select("sig").distinct().count()
        if turn and not minors:
            break
        if turn and 10 * found < minors:
            parts = _exhausted(held, links, parts, apart, percent)
            break
        pairs = _proposed(apart, turn)
        links.append(stage_table(_verified(pairs, held, percent), "links"))
        found = links[-1].count()
        turn += 1
        unstage(pairs, apart)
        if found or parts is None:
            if parts is not None:
                unstage(parts)
            parts = connected_components(_united(links), "a", "b")
    unstage(lists, apart, *links)
    return parts


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _exhausted(held: DataFrame, links: list[DataFrame], parts: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Components after every member outside its list's main component met all members its lists lead to.

    Lists that share members form a cluster; a cluster's members lie in blocks, and a row of the join is one
    such member with one block, tested inside the row. No pair becomes a row but those that link. The members of
    a large cluster that are to be tested are dealt to several tasks, each with a copy of the blocks, and its blocks to
    several more, each with a copy of the members. The blocks stream by: what a task holds of one key are about PROBES
    members, however large the cluster.
    """
    tops = apart.groupBy("token").agg(F.min("sig").alias("top"))
    clusters = connected_components(apart.join(tops, "token").select("sig", "top").distinct(), "sig", "top")
    prefix = [f"p{k}" for k in range(len(ORDERS))]
    asks = apart.where("part <> main").select("sig").distinct().withColumn("asks", F.lit(True))
    named = parts.select(F.col("node").alias("sig"), F.col("component").alias("linked"))
    placed = clusters.select(F.col("node").alias("sig"), F.col("component").alias("cluster")).join(named, "sig", "left").join(asks, "sig", "left")
    placed = stage_table(placed.select("sig", "cluster", F.coalesce("linked", "sig").alias("part"), F.coalesce("asks", F.lit(False)).alias("asks")), "placed")
    wide = placed.groupBy("cluster").agg(F.count("*").alias("c"), F.count_if("asks").alias("asking"))
    shares, slices = f"CAST((asking + {PROBES - 1}) div {PROBES} AS INT)", f"CAST((c + {SLICE - 1}) div {SLICE} AS INT)"
    members = stage_table(held.join(placed.join(wide, "cluster"), "sig"), "members")
    blocks = members.groupBy("cluster", F.expr(f"pmod(xxhash64(sig), (c + {BLOCK - 1}) div {BLOCK})").alias("block")).agg(
        F.first(F.expr(shares)).alias("shares"), F.first(F.expr(slices)).alias("slices"), F.collect_list(F.struct("sig", "part", "n", "tokens", *prefix)).alias("ys")
    )
    # not written: Parquet's reader takes 4096 rows at a time, which would be so many blocks
    blocks = blocks.select("cluster", F.expr("CAST(pmod(block, slices) AS INT)").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "ys")
    probes = members.where("asks").select(
        F.col("sig").alias("a"), F.col("cluster").alias("at"), F.expr(f"CAST(pmod(xxhash64(sig, 3), {shares}) AS INT)").alias("turn"),
        F.explode(F.expr(f"sequence(0, {slices} - 1)")).alias("piece"), F.struct("part", "n", "tokens", *prefix).alias("own"),
    )
    meet = " AND ".join(f"arrays_overlap(own.{k}, y.{k})" for k in prefix)
    size = "size(array_intersect(own.tokens, y.tokens))"
    hits = F.expr(
        f"transform(filter(ys, y -> y.part <> own.part AND 100 * least(own.n, y.n) >= {percent} * greatest(own.n, y.n)"
        f" AND {meet} AND 100 * {size} >= {percent} * (own.n + y.n - {size})), y -> y.sig)"
    )
    # a merge join holds all rows of a key of its right side at once: that is the members to be tested, which are few
    same = (probes["at"] == blocks.cluster) & (probes["turn"] == blocks.share) & (probes["piece"] == blocks.slice)
    met = blocks.join(probes, same).select("a", F.explode(hits).alias("b"))
    met = stage_table(met, "links")
    out = connected_components(_united([*links, met]), "a", "b")
    unstage(clusters, placed, members, met, parts)
    return out


def _placed(docs: DataFrame, width: int, percent: int, heavy_from: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, sig) of every document, and (sig, part) of every class: part names its component."""
    sets, heavy = sets_of(docs, width, heavy_from)
    total = sets.agg(F.sum("n")).first()[0] or 0
    ranges_log2 = min(30, max(0, math.ceil(math.log2(max(1, total / RANGE_TOKENS)))))
    held = stage_table(prefixes(shared_tokens(docs, width, ranges_log2, heavy), sets, percent), "prefixes")
    parts = links_of(held, percent)
    unstage(held)
    classes = sets.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    named = classes.join(parts, classes.sig == parts.node, "left").select("sig", "rep", F.coalesce("component", "sig").alias("part"))
    named = stage_table(named, "classes")
    unstage(parts)
    return sets, named


def components(docs: DataFrame, width: int = 5, percent: int = 80, heavy_from: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    sets, named = _placed(docs, width, percent, heavy_from)
    smallest = stage_table(named.groupBy("part").agg(F.min("rep").alias("component_id")), "smallest")
    ids = stage_table(named.join(smallest, "part").select("sig", "component_id"), "named")
    unstage(named, smallest)
    return sets.join(ids, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group kept: that of the smallest id, a null id last, equal ids by their text's hash.

    A document is its id and text: of rows that are equal in both, one stays. A document without words stands alone.
    """
    sets, named = _placed(docs, width, percent, HEAVY)
    rows = sets.groupBy("doc_id", "key", "sig").agg(F.count("*").alias("c"))
    rows = stage_table(rows.join(named.select("sig", "part"), "sig", "left"), "rows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    first = rows.where("part IS NOT NULL").groupBy("part").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.key")
    kept = first.union(rows.where("part IS NULL").select("doc_id", "key")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    repeated = not rows.where("c > 1").isEmpty()
    held = docs.withColumn("_of", F.xxhash64("text"))
    out = held.join(stage_table(kept, "kept"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_key")), "left_semi")
    unstage(named, rows)
    return (out.dropDuplicates(["doc_id", "_of"]) if repeated else out).drop("_of")


def query(docs: DataFrame) -> DataFrame:
    return components(docs, width=4, percent=85)
