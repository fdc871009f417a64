"""Line removal against plain Python, with every awkward input."""

from __future__ import annotations

import random

import pytest

from loam.llm import lines

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, threshold=2):
    """[(id, text)] -> [(id, number of lines, lines dropped, text that stays)]; rows without id are one last document."""
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stays = []
        for line in own:
            k = key(line)
            named = [x for x in holders[k] if x is not None]
            if len(k) < least or not named or len(holders[k]) < threshold or min(named) == i:
                stays.append(line)
        out.append((i, len(own), len(own) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in lines.drop_shared_lines(df, **more).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


ROWS = [
    (1, "a line that repeats\n\tA LINE THAT REPEATS  \nonly here, it is so\n"),
    (2, "short\nshort\n  a Line that repeats\r\nÉcole DES LIGNES\n\n\n"),
    (3, "École des lignes\nécole des lignes and more\nshort"),
    (3, "École DES lignes\nanother text of the same id\nan id's own repeat\nan id's own repeat"),
    (4, None), (5, ""), (6, "\n"), (None, "a line that repeats\nof no id at all"), (None, "of no id at all\nx"), (None, None),
    (2, "short\nshort\n  a Line that repeats\r\nÉcole DES LIGNES\n\n\n"),
    (7, "\n".join(f"line number {i % 700:05d}" for i in range(3000))), (8, "\n".join(f"LINE number {i:05d}" for i in range(650, 760))),
    (9, "nine chars\n ninechars \nnine chars"), (10, "nine chars\nninechars"), (11, "ａｂｃｄｅｆｇｈｉｊ"), (12, "ａｂｃｄｅｆｇｈｉｊ\x85"), (13, " ａｂｃｄｅｆｇｈｉｊ\x0b"),
]


@pytest.mark.parametrize("threshold", [2, 3])
def test_awkward_rows(spark, threshold):
    assert found(spark, ROWS, threshold=threshold) == plain(ROWS, threshold=threshold)


def test_hot_lines_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 1 / 3)
    draw = random.Random(5)
    rows = [(i, "\n".join(draw.choice(["the same old line"] * 5 + [f"line of number {draw.randrange(60)}", "tiny"]) for _ in range(draw.randrange(12)))) for i in range(200)]
    assert found(spark, rows) == plain(rows)


def test_bounds_and_columns(spark):
    df = spark.createDataFrame([(1, "a repeated line", 5, 6, "x"), (2, "a repeated line", 7, 8, "y")], "doc_id long, text string, n_lines int, h int, kept string")
    out = lines.drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "h", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, out.collect())) == [(1, "a repeated line", 6, 1, 0, "a repeated line"), (2, "a repeated line", 8, 1, 1, "")]
    assert lines.drop_shared_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.drop_shared_lines(df, least=0)
    assert found(spark, [(1, "a"), (2, "A\na\nb")], least=1) == plain([(1, "a"), (2, "A\na\nb")], least=1)
