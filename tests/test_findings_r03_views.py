"""Views that are there already are read, not worked out again."""

from tidebook import tables
from tidebook.storage import stage_table

SF = "/root/testdata/sf0.001"


def test_a_given_view_takes_the_place_of_its_text(spark):
    numbered = stage_table(tables.view(spark, SF, "numbered"), "numbered")
    spans = tables.view(spark, SF, "level_spans", {"numbered": numbered})
    files = spans.inputFiles()
    assert files and all("/numbered-" in f for f in files)
    assert sorted(map(repr, spans.collect())) == sorted(map(repr, tables.view(spark, SF, "level_spans").collect()))
