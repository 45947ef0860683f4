"""Every stage against a brute-force version on the smallest tables, and the queries' oracles."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_llm_operators import base_spans, groups
from tidebook.llm import jaccard, quality, registry, toxicity
from tidebook.llm.common import read, stage_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage_table(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["toxicity"]
    model = toxicity.train(before, read(spark, SF, "labels"))
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.score(r.text) < 0.5)
    before, after = seen["quality_rules"]
    assert ids(after) == sorted(r.doc_id for r in quality.judged(before).collect() if r.kept)
    before, after = seen["ngram_jaccard_join"]
    assert ids(after) == sorted(set(groups([(r.doc_id, r.text) for r in before.collect()], 5, 80).values()))
    before, after = seen["pii"]
    assert ids(before) == ids(after) and not [r.doc_id for r in after.collect() if base_spans(r.text)]
    whole = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == whole[r.doc_id] for r in after.collect() if not base_spans(whole[r.doc_id]))  # nothing else is touched
    before, after = seen["best_fit_packing"]
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder, rows = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), after.collect()
    length = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    assert {d: sum(r.length for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}} == length
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert all(o == sum(n for _, n in own[:i]) for i, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 1024
    assert jaccard.deduplicated(read(spark, SF, "documents").limit(0)).count() == 0


def test_stages_on_edges(spark):
    """Nulls in any column, repeated rows, an extra column with a clashing name, and no rows at all."""
    body = " ".join(f"Word{i} runs, over {i} hills." for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, sig string"
    rows = [(1, body, "en", "a", len(body), "x"), (1, body, "en", "a", len(body), "x"), (None, body, None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "a", 0, ""),
            (None, "Mail " + body.replace("hills", "dales") + " ann@mail.org", None, None, None, None)]
    for given in (rows, []):
        docs, left = spark.createDataFrame(given, schema), []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage_table(stage(spark, docs, SF), name)
            left.append(docs.count())
        if not given:
            assert left == [0] * 5
        else:
            # nothing is toxic; empty texts fail the rules; of three copies the one with an id stays, once
            assert left[:4] == [6, 4, 2, 2] and {r.doc_id for r in docs.collect()} == {1, None}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    df = registry.queries()[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = db.execute(registry.oracle_sql()[name])
    have, cols = [c[0] for c in cursor.description], sorted(df.columns)
    assert sorted(have) == cols
    assert sorted((tuple(r[have.index(c)] for c in cols) for r in cursor.fetchall()), key=repr) == sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
