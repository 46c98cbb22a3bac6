"""Chunkers, markdown elements and tables (TXT-1..5, WIN-1/2, SET-1)."""

from docmetrics.functions.text import greedy_word_chunks, line_chunks, markdown_elements
from docmetrics.operators import chunk as C


def lengths(chunks):
    return [len(c) for c in chunks]


def test_word_chunker_edges():
    assert greedy_word_chunks("") == []
    assert greedy_word_chunks("   \n\t ") == []
    assert lengths(greedy_word_chunks("a " * 1000)) == [799, 799, 399]
    assert lengths(greedy_word_chunks("x" * 900 + " b")) == [900, 1]
    assert lengths(greedy_word_chunks("y" * 799)) == [799]
    assert lengths(greedy_word_chunks("x" * 798 + " b")) == [798, 1]
    assert lengths(greedy_word_chunks("x" * 797 + " b")) == [799]


def test_word_chunker_splits_like_python():
    # U+00A0, U+3000 and U+001C all separate words, as in str.split().
    assert greedy_word_chunks("a b　c\u001cd") == ["a b c d"]


def test_word_chunker_max_word():
    assert lengths(greedy_word_chunks("z" * 1700, max_word=800)) == [800, 800, 100]


def test_chunk_words_spark_equals_python(spark):
    texts = ["", "a " * 1000, "x" * 900 + " b", "x" * 797 + " b", None, "one two  three"]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got = {}
    for r in C.chunk_words(df).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.text))
    for i, t in enumerate(texts):
        want = greedy_word_chunks(t)
        assert [x for _, x in sorted(got.get(i, []))] == want


def test_line_chunker_heads_and_limit():
    text = "intro\n一、環境\nline a\n第二章 社會\n2. item\n\n\n"
    assert line_chunks(text) == ["intro", "一、環境\nline a", "第二章 社會", "2. item"]
    long = "\n".join(["x" * 500, "y" * 400, "z"])
    assert line_chunks(long) == ["x" * 500, "y" * 400 + "\nz"]


def test_markdown_elements_report_a():
    from docmetrics.sources.fixtures import REPORT_A
    el = markdown_elements(REPORT_A)
    assert [k for _, k, _ in el] == ["text", "table"]
    assert el[0][2].splitlines()[0] == "# 永續報告書 2023" and len(el[0][2].splitlines()) == 7  # blank lines are dropped
    assert el[1][2].splitlines()[0] == "| 指標 | 數值 |"


def test_blocks_are_runs_of_equal_kind():
    kinds = lambda text: [(k, t) for _, k, t in markdown_elements(text)]
    assert kinds("a\n\n\nb\n|x|\n|y|\n\n|z|\nc") == [("text", "a\nb"), ("table", "|x|\n|y|"), ("table", "|z|"), ("text", "c")]
    assert kinds("\n \n|x|\n\n") == [("table", "|x|")]
    assert kinds("") == kinds(" \n\t") == kinds(None) == []
    assert kinds("|x|\na\n \n|y|") == [("table", "|x|"), ("text", "a"), ("table", "|y|")]


def test_table_cells_and_verbalize(spark, reports):
    cells = {(r.document_id, r.row_no, r.col_no): (r.header, r.value)
             for r in C.table_cells(reports).collect()}
    assert cells[("B", 1, 1)] == ("指標", "能源使用量")
    assert cells[("B", 1, 2)] == ("數值", "1,234,567 kWh")
    assert cells[("A", 2, 2)] == ("數值", "42.5 小時/人")
    texts = {r.document_id: r.text for r in C.table_verbalize(reports).collect()}
    assert texts["A"].startswith("\n表格 1:\n欄位: 指標, 數值\n")
    assert "溫室氣體排放量 12,345 公噸CO2e" in texts["A"]


def test_ragged_table(spark):
    md = "| a | b |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\n"
    df = spark.createDataFrame([("r", md)], "document_id string, text string")
    rows = sorted((r.row_no, r.col_no, r.header, r.value) for r in C.table_cells(df).collect())
    assert rows == [(1, 1, "a", "1"), (1, 2, "b", None),
                    (2, 1, "a", "2"), (2, 2, "b", "3"), (2, 3, None, "4")]


def test_table_without_separator_is_not_parsed(spark):
    df = spark.createDataFrame([("r", "| a | b |\n| 1 | 2 |\n")], "document_id string, text string")
    assert C.table_cells(df).count() == 0
    assert C.markdown_elements(df).filter("kind = 'table'").count() == 1


def test_document_chunks_order_and_metadata(spark, reports):
    rows = sorted(C.document_chunks(reports).collect(), key=lambda r: (r.document_id, r.chunk_index))
    a = [r for r in rows if r.document_id == "A"]
    assert [(r.chunk_index, r.source_kind) for r in a] == [(0, "text"), (1, "table")]
    assert {r.total_chunks for r in a} == {2} and {r.tables_found for r in a} == {1}
    assert a[0].text.startswith("# 永續報告書 2023 ## 環境指標 溫室氣體排放量：12,345 公噸CO2e 用水量")
    assert a[1].text.startswith("表格 1: 欄位: 指標, 數值")


from hypothesis import given, settings
from hypothesis import strategies as st

_word = st.text(alphabet=st.characters(blacklist_categories=("Zs", "Zl", "Zp", "Cc", "Cs")),
                min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(_word, max_size=200), st.integers(min_value=5, max_value=120))
def test_word_chunker_properties(words, limit):
    text = " ".join(words)
    words = text.split()
    chunks = greedy_word_chunks(text, limit)
    # every word kept, in order, nothing added
    assert [w for c in chunks for w in c.split(" ")] == words
    for i, c in enumerate(chunks):
        parts = c.split(" ")
        # a chunk fits (the first one pays one extra), unless it is a single oversize word
        budget = limit - 1 if i == 0 else limit
        assert len(c) <= budget or len(parts) == 1
        # greedy: the next chunk's first word would not have fitted
        if i + 1 < len(chunks):
            nxt = chunks[i + 1].split(" ")[0]
            assert len(c) + 1 + len(nxt) + (1 if i == 0 else 0) > limit
