import pytest

from lumenfold.sources.journal import parse_journals


def parse(spark, *texts, separator=None):
    df = spark.createDataFrame([(f"j{i}", t) for i, t in enumerate(texts)], "journal_id string, content string")
    rows = parse_journals(df, separator=separator).orderBy("journal_id", "line_no").collect()
    return [(r.dream_id, r.date, r.date_precision, r.date_sort, r.tags, r.text, r.word_count) for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("0/0/00\nx", [("dream-2000-0-0-0", "0/0/2000", "unknown", None, [], "x", 1)]),
        ("0/0/22\nx", [("dream-2022-0-0-0", "0/0/2022", "year", "2022-01-01", [], "x", 1)]),
        ("3/0/22\nx", [("dream-2022-3-0-0", "3/0/2022", "month", "2022-03-01", [], "x", 1)]),
        ("2/31/22\nx", [("dream-2022-2-31-0", "2/31/2022", "day", "2022-02-31", [], "x", 1)]),
        ("1/1/70\nx", [("dream-1970-1-1-0", "1/1/1970", "day", "1970-01-01", [], "x", 1)]),
        ("1/1/69\nx", [("dream-2069-1-1-0", "1/1/2069", "day", "2069-01-01", [], "x", 1)]),
        ("1/1/2022\n#a #b\n#a\nx y", [("dream-2022-1-1-0", "1/1/2022", "day", "2022-01-01", ["a", "b", "a"], "x y", 2)]),
        ("1/1/22\r\nx\r\n#a\r\n", [("dream-2022-1-1-0", "1/1/2022", "day", "2022-01-01", [], "x\n#a", 2)]),
        ("", []),
        ("\n\n", []),
    ],
)
def test_headings_and_tags(spark, text, want):
    assert parse(spark, text) == want


def test_separator_is_found(spark):
    assert [r[5] for r in parse(spark, "1/1/22\nx\n\ny\n\n\nz")] == ["x\n\ny", "z"]
    assert [(r[4], r[5]) for r in parse(spark, "1/1/22\n#a\n\nx")] == [(["a"], ""), ([], "x")]
    assert [(r[4], r[5]) for r in parse(spark, "1/1/22\n\n#a\nx\n\n\nz")] == [([], "#a\nx"), ([], "z")]


def test_repeated_heading_repeats_ids(spark):
    assert [r[0] for r in parse(spark, "1/1/22\nx\n1/1/22\ny")] == ["dream-2022-1-1-0"] * 2


def test_journals_are_apart_and_null_ones_empty(spark):
    rows = parse(spark, "1/1/22\nx\n\ny", None, "1/2/22\nz", separator=1)
    assert [r[0] for r in rows] == ["dream-2022-1-1-0", "dream-2022-1-1-1", "dream-2022-1-2-0"]


def test_errors(spark):
    with pytest.raises(Exception, match="before the first date heading"):
        parse(spark, "x\n1/1/22\ny")
    with pytest.raises(ValueError):
        parse(spark, "1/1/22\nx", separator=0)


def test_words_of_any_script(spark):
    assert parse(spark, "1/1/22\nété don't naïve x")[0][6] == 4
