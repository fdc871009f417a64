"""Packers of units against literals: overlaps, large units, topics, headers, and rows without text."""

import pytest

from loam.operators import packers as P


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, chunk string")


def chunks(df, *more):
    return [tuple(r) if more else r[0] for r in df.orderBy("id", *(["section"] if "section" in df.columns else []), "chunk_no").select("chunk", *more).collect()]


def test_lines_repeat_whole_lines(spark):
    text = "\n".join(f"{c} {c} {c}" for c in "abcde")
    assert chunks(P.line_packs(frame(spark, text), 8, 1), "lead") == [("a a a\nb b b", 0), ("b b b\nc c c", 1), ("c c c\nd d d", 1), ("d d d\ne e e", 1)]
    assert chunks(P.line_packs(frame(spark, text), 8)) == ["a a a\nb b b", "c c c\nd d d", "e e e"]


def test_paragraphs_repeat_words_and_cut_large_ones(spark):
    text = "a b c\n\nd e f\n\ng h i\n\nOne two three four. Five six seven eight! Nine\n\nj"
    got = chunks(P.paragraph_packs(frame(spark, text), 8, 1))
    assert got == ["a b c\n\nd e f", "f\n\ng h i", "One two three four", "four Five six seven eight Nine", "j"]


def test_a_topic_ends_the_chunk_it_stands_in(spark):
    text = "a b c. However d e. f g. h i j k l m n o p q"
    assert chunks(P.semantic_packs(frame(spark, text), 10)) == ["a b c However d e", "f g h i j k l m n o p q"]
    assert chunks(P.semantic_packs(frame(spark, text), 10, 2)) == ["a b c However d e", "d e f g h i j k l m n o p q"]


def test_sections_keep_titles_and_bodies(spark):
    text = "before\n# One\na b\n\nc\n2. Two\n" + "\n\n".join(f"{c} {c} {c} {c}" for c in "xyz") + "\n# Empty\n"
    got = chunks(P.section_packs(frame(spark, text, "no header\n\nat all"), 8), "title", "section", "n_chunks")
    assert got == [("before", "Introduction", 0, 1), ("a b\n\nc", "# One", 1, 1), ("x x x x", "2. Two", 2, 3), ("y y y y", "2. Two", 2, 3), ("z z z z", "2. Two", 2, 3), ("no header\n\nat all", None, 0, 1)]


def test_pages_keep_their_numbers(spark):
    got = P.page_packs(frame(spark, "a b\f \fc d\fe f g h i j"), 8)
    assert chunks(got, "pages", "first_page", "last_page") == [("a b\n\nc d", [1, 3], 1, 3), ("e f g h i j", [4], 4, 4)]


def test_slides_objects_items_and_rows(spark):
    assert chunks(P.slide_packs(frame(spark, "a\n---\nb\nc\n---\n\n---\nd"), 3), "slide_count") == [("a", 1), ("b\nc", 1), ("d", 1)]
    assert chunks(P.object_packs(frame(spark, '{"k": "a b", "l": {"m": 1}, "n": null}'), 6), "keys") == [("k: a b", ["k"]), ('l: {"m":1}\nn: null', ["l", "n"])]
    assert chunks(P.object_packs(frame(spark, "no object. at all"), 60), "keys") == [("no object at all", [])]
    assert chunks(P.item_packs(frame(spark, '["a b", {"c": 1}, null, "d e f"]', "x\ny"), 5), "start_index", "end_index") == [("a b\n{\"c\":1}", 0, 1), ("null", 2, 2), ("d e f", 3, 3), ("x\ny", None, None)]
    assert chunks(P.row_packs(frame(spark, "h,i\na b\nc d\n\ne f", "lone"), 7), "start_row", "end_row", "has_header") == [("h,i\na b\nc d", 1, 2, True), ("h,i\ne f", 3, 3, True), ("lone", 1, 1, False)]


def test_entries_without_blanks_at_their_ends(spark):
    assert chunks(P.object_packs(frame(spark, '{"k": "a b ", " l": " ", "m": "", "n": "c\\n"}'), 10), "keys") == [("k: a b\nl:\nm:\nn: c", ["k", " l", "m", "n"])]


def test_blank_lines_of_objects_as_in_their_sql(spark, monkeypatch):
    import duckdb

    from loam.plans import packers as Q
    from loam.plans.registry import ORACLES

    texts = ["", " ", "a\n\nb", "a b \nc", "a\nb\n", " a\n\n \nb", "a\t\nb", None]
    monkeypatch.setattr(Q, "docs", lambda *_: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    own = duckdb.connect()
    own.execute("CREATE TABLE documents AS SELECT unnest(range(len($t))) AS doc_id, unnest($t::VARCHAR[]) AS text", {"t": texts})
    got = Q.pack_objects(spark, "")
    want = own.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['pack_objects']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chapters_keep_titles(spark):
    from pyspark.sql import functions as F

    told = [("A", "a b"), ("B", "c d"), ("C", "One two three four. Next five six seven. Eight nine"), ("D", "e"), ("E", None)]
    df = spark.createDataFrame([(0, told), (1, []), (2, None)], "id int, c array<struct<title:string,text:string>>")
    got = chunks(P.chapter_packs(df, F.col("c"), 8), "titles")
    assert got == [("a b\n\nc d", ["A", "B"]), ("One two three four Next five six seven", ["C"]), ("Eight nine", ["C"]), ("e", ["D"])]


@pytest.mark.parametrize("packer", [P.line_packs, P.paragraph_packs, P.semantic_packs, P.section_packs, P.page_packs, P.slide_packs, P.object_packs, P.item_packs, P.row_packs])
def test_texts_without_words_give_no_chunk_and_long_ones_keep_all(spark, packer):
    assert packer(frame(spark, None, "", " \n\n \f\n"), 8).count() == 0
    assert packer(frame(spark, "x").where("id < 0"), 8).count() == 0
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(7)) + "." for i in range(300))
    got = packer(frame(spark, long, long), 40)
    assert got.columns.count("chunk") == 1
    kept = {i: set() for i in (0, 1)}
    for r in got.select("id", "chunk").collect():
        kept[r.id] |= set(r.chunk.replace(".", " ").split())
    assert kept[0] == kept[1] == {f"w{i}x{j}" for i in range(300) for j in range(7)}


def test_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        P.line_packs(frame(spark, "x"), 0)
