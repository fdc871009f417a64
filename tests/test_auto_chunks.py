"""Every document keeps all of its words, whatever its type."""

import re

from loam.operators import chunking


def test_auto_chunks_cover_every_document(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(60))
    texts = ["one two", long, long.replace("\n", "\n\n"), long.replace("\n", "\f"), "[1] " + long, '[{"a": "b c"}, {"d": 5}, "e f"]', '{"a": 1}\n{"b": [2, 3]}']
    rows = [(f"{kind}{i}", kind, t) for kind in ("txt", "md", "csv", "json", "pdf") for i, t in enumerate(texts)]
    got = {}
    for r in chunking.auto_chunks(spark.createDataFrame(rows, "id string, file_type string, text string"), 64).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    for id_, _, text in rows:
        assert set(re.findall(r"\w+", " ".join(got.get(id_, [])))) == set(re.findall(r"\w+", text)), id_
    assert all(c.startswith("w0x0 ") for c in got["csv1"]) and len(got["csv1"]) > 1
    assert got["json5"] == ['{"a":"b c"}\n{"d":5}\ne f']
    assert len(got["pdf3"]) > 1
