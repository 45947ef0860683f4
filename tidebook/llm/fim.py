"""Fill-in-middle transformation by run-length class encoding.

A text is stored as its maximal runs of characters of one class (for lines: new-lines and all else), each with its
start and the number of units that end up to its own end. A cut after ``u`` units is found by binary search of the
run in which the u-th unit ends and by arithmetic inside that run: no list of units is built. Which cuts and which form
a document gets follows from a hash of the seed and its id alone, so a task that is run again gives the same rows.

Defined results: a null text counts as empty; an empty text, one that holds a sentinel, and one that the rate leaves
out stay as they are (form ``plain``, no lengths); a null id is hashed as an empty one; repeated rows get the same
result each; an empty table gives no rows; extra columns pass through :func:`transform`, whose result is one struct
column under a name that is not taken. Texts are read whole; results leave a task in blocks of bounded size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Seed, per cent of texts that are transformed, and per cent of those that put the suffix first.
SEED, RATE, SPM = 7, 100, 50
#: How a run of a class ends units: at each of its characters, once at its end, or only where the text ends.
EACH, ONCE, OPEN = 0, 1, 2
#: unit -> (code points of class 1 or None for all, how class 0 ends units, how class 1 does).
UNITS = {
    "line": ((10,), OPEN, EACH),
    "word": ((9, 10, 11, 12, 13, 32), OPEN, ONCE),
    "char": (None, EACH, EACH),
}
#: Characters of output after which a task hands on what it has.
BLOCK = 1 << 23
RESULT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


class Runs:
    """The run table of a text: ``start`` (and the text's end), ``each`` and ``ended``, the units that end up to each run's end."""

    def __init__(self, text: str, unit: str = "line"):
        import numpy as np

        marks, *rule = UNITS[unit]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if marks is None:
            kind = np.zeros(len(points), dtype=bool)
        elif len(marks) == 1:
            kind = points == marks[0]
        else:
            kind = np.isin(points, marks)
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        self.start = np.concatenate(([0], turns, [len(points)])) if len(points) else np.zeros(1, dtype=np.int64)
        rules = np.where(kind[self.start[:-1]], rule[1], rule[0])
        self.each = rules == EACH
        units = np.where(self.each, np.diff(self.start), (rules == ONCE).astype(np.int64))
        if len(units) and rules[-1] == OPEN:
            units[-1] = 1
        self.ended = np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.ended[-1]) if len(self.ended) else 0

    def cut(self, u: int) -> int:
        """Characters in the first ``u`` units."""
        if u == 0:
            return 0
        run = int(self.ended.searchsorted(u))
        if self.each[run]:  # counted from the run's end, where ended[run] units have ended
            return int(self.start[run + 1] - (self.ended[run] - u))
        return int(self.start[run + 1])


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def fill_in_middle(text: str | None, doc_id: object, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    runs, (h1, h2, h3, h4) = Runs(text, unit), draws(seed, doc_id)
    n = runs.n
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    first, last = sorted((runs.cut(h1 % (n + 1)), runs.cut(h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = sentinels
    if h4 % 100 < spm:
        return n, "spm", first, last - first, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, last - first, "".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS,
              text: str = "text", doc_id: str = "doc_id", column: str = "fim") -> DataFrame:
    """docs with a struct of n, form, prefix_chars, middle_chars and output."""
    while column in docs.columns:
        column += "_"
    at, key = docs.columns.index(text), docs.columns.index(doc_id)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` {RESULT}"

    def transformed(batches):
        import pyarrow as pa

        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        names = [f.name for f in kind]

        def block(batch, since, rows):
            values = pa.array([dict(zip(names, row, strict=True)) for row in rows], kind)
            return pa.RecordBatch.from_arrays([*batch.slice(since, len(rows)).columns, values], names=[*batch.schema.names, column])

        for batch in batches:
            rows, size, since = [], 0, 0
            for body, own in zip(batch.column(at), batch.column(key), strict=True):
                rows.append(fill_in_middle(body.as_py(), own.as_py(), unit, seed, rate, spm, sentinels))
                size += len(rows[-1][-1])
                if size > BLOCK:
                    yield block(batch, since, rows)
                    since, rows, size = since + len(rows), [], 0
            if rows:
                yield block(batch, since, rows)

    return arrow(docs).mapInArrow(transformed, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from, found by its sentinels alone."""
    p, s, m = sentinels

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        second, third = F.instr(output, two), F.instr(output, m)
        begin, middle = len(one) + 1, third + len(m)
        return (
            F.substr(output, F.lit(begin), second - begin),
            F.substr(output, second + len(two), third - second - len(two)),
            F.substr(output, middle),
        )

    prefix, suffix, middle = parts(p, s)
    suffix_first, prefix_second, middle_last = parts(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )


def query(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths of prefix and middle, and digests of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
