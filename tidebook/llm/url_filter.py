"""URL filter with redirect equivalence, in DataFrame expressions only.

Explicit rules judge first (longest fitting rule wins). URLs that are the same page - equal up to scheme, a
leading ``www.``, a trailing slash, the fragment and tracking parameters, or tied by a canonical link or a
redirect - form components, found by distributed minimum labels. A block decision reaches every alias in its
component, unless the component holds an explicit allow; a page with a rule of its own keeps that rule's verdict.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule, no aliases and verdict
allow; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored. A key shared
by many pages is pre-aggregated, and its lookup is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import connected_components

#: (action, host, path) of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rows of one key meet in this many tasks.
SALTS = 16
#: Parameters that do not change the page.
TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_key(url: Column) -> Column:
    """The canonical form under which URLs count as one page; null where there is no ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}=")), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    key = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, key)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, nulls where none fits. The rule list is a small constant."""
    rule: Column = F.lit(None).cast("string")
    action: Column = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones overrule
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _with(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later steps read as it is: the optimizer would copy its expression to every use."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def unescaped(rows: DataFrame, name: str) -> DataFrame:
    """rows with the column's character references by number, and the five named ones that URLs hold, spelled out."""
    for pattern, lead, base in (("&#([0-9]{1,7});", "&#", 10), ("&#[xX]([0-9A-Fa-f]{1,6});", "&#[xX]", 16)):
        code = lambda n: F.conv(n, base, 10).cast("int")
        found = F.array_distinct(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)))
        valid = F.filter(found, lambda n: code(n).between(1, 0xD7FF) | code(n).between(0xE000, 0x10FFFF))
        marks = F.transform(valid, lambda n: F.struct(F.concat(F.lit(lead), n, F.lit(";")).alias("m"), F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32").alias("c")))
        rows = _with(rows, name, F.aggregate(marks, F.col(name), lambda t, x: F.regexp_replace(t, x["m"], F.regexp_replace(x["c"], F.lit(r"([\\$])"), F.lit(r"\\$1")))))
    text = F.col(name)
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return _with(rows, name, text)


def absolute(rows: DataFrame, target: str, base: str) -> DataFrame:
    """rows with ``target`` as a page at the URL ``base`` means it, without ``.`` and ``..`` segments."""
    rows = rows.withColumn("_origin", F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)).withColumn("_path", path_of(F.col(base)))
    folder = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.regexp_extract("_path", "^(.*/)", 1))
    t = F.col(target)
    full = (
        F.when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t))
        .when(F.startswith(t, F.lit("/")), F.concat("_origin", t))
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(F.startswith(t, F.lit("?")), F.concat("_origin", "_path", t))
        .when(F.startswith(t, F.lit("#")), F.col(base))
        .otherwise(F.concat("_origin", folder, t))
    )
    rows = _with(rows, target, full)
    steps = F.split(F.regexp_extract(t, r"^[^:/?#]*://[^/?#]*/([^?#]*)", 1), "/")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    clean = F.concat(F.regexp_extract(t, r"^([^:/?#]*://[^/?#]*/)", 1), F.array_join(kept, "/"), F.regexp_extract(t, r"^[^?#]*(.*)$", 1))
    return _with(rows, target, F.when(t.rlike(r"^[^:/?#]*://[^?#]*/\.\.?(?:[/?#]|$)"), clean).otherwise(t)).drop("_origin", "_path")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) keys of all canonical links and meta redirects in the html, whatever the order of their attributes, and dst's host and path."""
    html = F.col("html")
    value, canonical, refresh = r"\s*=\s*[\"']?\s*([^\"'\s>]+)", r"\brel\s*=\s*[\"']?canonical\b", r"\bhttp-equiv\s*=\s*[\"']?refresh\b"
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    targets = F.concat(
        every(rf"(?is)<link\b[^>]*{canonical}[^>]*\bhref{value}"),
        every(rf"(?is)<link\b[^>]*\bhref{value}[\"']?[^>]*{canonical}"),
        every(rf"(?is)<meta\b[^>]*{refresh}[^>]*\burl{value}"),
        every(rf"(?is)<meta\b[^>]*\burl{value}[\"']?[^>]*{refresh}"),
    )
    found = (
        pages.select("url", "html")
        .where(html.rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"))
        .select("url", F.explode(F.array_distinct(F.filter(targets, lambda x: x != ""))).alias("t"))
    )
    full = absolute(unescaped(found, "t"), "t", "url")
    keys = _with(_with(full, "src", url_key(F.col("url"))), "dst", url_key(F.col("t")))
    return keys.where("src <> dst").select("src", "dst", host_of(F.col("t")).alias("host"), path_of(F.col("t")).alias("path")).distinct()


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and how the verdict came about.

    ``edges`` (src, dst URLs' keys) may add redirects known from elsewhere, such as a crawl log.
    """
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        rule.alias("rule"), action.alias("action"), url_key(F.col("url")).alias("key"),
    )
    found = alias_edges(pages)
    if edges is not None:
        by_key = (F.regexp_extract("dst", "^([^/?]*)", 1).alias("host"), F.regexp_extract("dst", r"^[^/?]*([^?]*)", 1).alias("path"))
        found = found.unionByName(edges.select("src", "dst", *by_key))
    links = found.select("src", "dst")
    parts = connected_components(links)
    keys = (
        parsed.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    )
    # targets that no page has are judged by the rules as well
    _, target = rule_of(F.col("host"), F.col("path"), rules)
    ends = found.select("dst", "host", "path").distinct().withColumn("a", target)
    keys = keys.unionByName(ends.select(F.col("dst").alias("key"), (F.col("a") == "block").alias("blocked"), (F.col("a") == "allow").alias("allowed")))
    placed = keys.join(parts, keys.key == parts.node, "left").select(
        F.coalesce("component", "key").alias("component"), "blocked", "allowed"
    )
    hit = (
        placed.groupBy("component")
        .agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
        .where("blocked AND NOT coalesce(allowed, false)")
        .select("component")
    )
    named = parts.select(F.col("node").alias("key"), "component")
    reached = named.join(hit, "component").select("key").union(hit.select(F.col("component").alias("key"))).distinct()
    reached = reached.select(F.col("key").alias("hit_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hit_salt"))
    asked = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = asked.join(
        reached, (asked.key == reached.hit_key) & (asked.salt == reached.hit_salt) & asked.rule.isNull(), "left"
    )
    by_alias = F.col("hit_key").isNotNull()
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(by_alias, F.lit("block")).otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit("rule")).when(by_alias, F.lit("alias")).otherwise("default").alias("reason"),
    )
