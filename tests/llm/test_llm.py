"""Every operator against a plain version, on small tables with the awkward cases among them."""


import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loam.llm import context_tree, jaccard, packing, personal, pieces, quality, search, substrings, toxicity

rng = random.Random(4)
VOCABULARY = ["the", "of", "And", "river", "stone", "cloud", "ämter", "grün", "x", "42", "end."]


def words(n):
    return [rng.choice(VOCABULARY) + rng.choice(["", "", "a", "b", "c", "dd"]) for _ in range(n)]


def corpus():
    """(doc_id, text): nulls, empties, copies, near copies, shared passages, a long text, repeated rows."""
    base, passage = words(120), words(50)
    near = base[:]
    near[60] = "changed"
    far = [w if i % 7 else "zz" for i, w in enumerate(base)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  TWO"), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base))]
    rows += [(9, " ".join(far)), (10, " ".join(words(20) + passage + words(20))), (11, " ".join(passage + words(30))), (12, " ".join(words(6000)))]
    rows += [(13, " ".join(passage[:34])), (14, " ".join(["same"] * 80)), (15, "mail a.b@c.de or +49 (30) 1234-5678, 10.0.0.1"), (15, "mail a.b@c.de or +49 (30) 1234-5678, 10.0.0.1")]
    return rows + [(16 + i, " ".join(words(rng.randint(1, 90)))) for i in range(30)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # further columns with names that operators use themselves
    return spark.createDataFrame([(i, t, 1, "k", 0.5) for i, t in ROWS], "doc_id long, text string, n_words int, block string, score double")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i, _ in ROWS] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_classes(docs, nothing):
    sets = {i: shingle_set(t) for i, t in ROWS}
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    got = jaccard.similar_classes(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), of[i]) for i, _ in ROWS)
    assert {of[6], of[7], of[8]} == {6} and of[9] == 9
    assert jaccard.similar_classes(nothing).count() == 0


def test_jaccard_prefixes_keep_every_similar_pair():
    r = np.random.default_rng(1)
    every = [np.unique(jaccard.mix(r.integers(0, 1 << 60, int(r.integers(1, 60))).astype(np.uint64))) for _ in range(60)]
    every += [np.unique(np.concatenate([a[: max(1, int(len(a) * r.uniform(0.8, 1)))], jaccard.mix(r.integers(0, 1 << 60, len(a) // 9).astype(np.uint64))])) for a in every]
    for bits in (9, 12, 40):  # with few bits many hashes fall together
        cut = [jaccard.tokens(s, bits) for s in every]
        df = Counter(t for c in cut for t in c.tolist())
        prefixes = []
        for c in cut:
            shared = sorted((df[t], t) for t in c.tolist() if df[t] > 1)
            e, take = jaccard.level(len(c), np.array([n for n, _ in shared]), 75)
            prefixes.append(({t for _, t in shared[:take]}, e))
        for i, a in enumerate(every):
            for j, b in enumerate(every[:i]):
                both = len(np.intersect1d(a, b))
                assert len(np.intersect1d(cut[i], cut[j])) >= both
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    (p, x), (q, y) = prefixes[i], prefixes[j]
                    assert len(p & q) >= min(x, y)


def test_jaccard_planes():
    x = np.array([0, 1, 255, 256, 1 << 40], np.int64)
    assert (jaccard.unplaned(jaccard.planes(x)) == x).all() and (jaccard.risen(jaccard.rising(x)) == x).all()
    assert len(jaccard.unplaned(jaccard.planes(x[:0]))) == 0


def family(n):
    """Copies of one text around the bound, so that many are similar to some but not to others; ids may be null."""
    r, base = random.Random(7), [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        own = base[:]
        for j in r.sample(range(0, 100, 6), r.choice([1, 2, 3, 4])):
            own[j] = f"x{i}-{j}"
        rows.append((None if i % 40 == 3 else i, " ".join(own)))
    return rows + [(n, rows[5][1]), (None, rows[5][1]), (n + 1, None), (None, None), (None, " ")]


@pytest.mark.parametrize("bound", [("CELL", 100_000), ("CELL", 500), ("COMMON", 2), ("BLOCK", 300)])
def test_jaccard_families_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard, *bound)
    rows = family(150)
    sets = [shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(x):
        return x if of[x] == x else root(of[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(-1 if d is None else d, len(sets[i]), least.get(root(i), -1)) for i, (d, _) in enumerate(rows)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == sorted(want)
    assert len({c for _, _, c in want}) > 5


def test_context_tree(docs, nothing):
    training = [t or "" for i, t in ROWS if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in training for w in [*lowered(t), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in context_tree.scores(docs).collect()}
    for i, t in ROWS:
        own = [*lowered(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(w in counts for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0
    assert got[12].score > got[12].base_score * 1.2
    assert context_tree.scores(nothing).count() == 0


def test_context_tree_predictions_are_distributions():
    data = np.frombuffer(b"abracadabra, abracadabra", np.uint8)
    keys, back = context_tree.distinct(context_tree.grams(data, np.array([0, len(data)]))[0])
    assert len(np.unique(keys)) == len(keys) and len(back) == len(data) + 1
    n = np.bincount(back)
    size = int(context_tree._STARTS[-1])
    times, parent, before = np.zeros((2, size)), np.zeros(size, np.int64), context_tree.contexts(keys)
    for bit in range(8):
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        for d in range(context_tree.DEPTH + 1):
            at = context_tree.nodes(before[d], keys, d, bit)
            np.add.at(times, (one, at), n)
            if d:
                parent[at] = context_tree.nodes(before[d - 1], keys, d - 1, bit)
    chance, weight = context_tree.weigh(times[0], times[1], parent)
    for context in keys[:5]:
        every = (context & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** context_tree.log_probability(every, chance, weight)).sum(), 1, rel_tol=1e-6)


def vectors(spark, width=16, n=400):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(n, width)), 2)
    x[50:60] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * width), (1003, [float("inf")] * width), (1020, [0.0] * width)]
    return spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int"), dict(rows)


def plain_search(rows, score, k, skip=()):
    held = {i: v for i, v in rows.items() if v is not None and all(c is not None and math.isfinite(c) for c in v) and i not in skip}
    for q in held:
        if q % 20 == 0:
            best = sorted(((-score(held[q], held[c]), c) for c in held if c != q))[:k]
            yield from ((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))


def test_threshold_search(spark):
    frame, rows = vectors(spark)
    score = lambda a, b: sum(math.floor(64 * float(np.float32(x))) * math.floor(64 * float(np.float32(y))) for x, y in zip(a, b, strict=True))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.exact_top_k(frame).collect())
    assert got == sorted(plain_search(rows, score, 20))
    assert search.exact_top_k(frame.limit(0)).count() == 0


def test_cross_polytope_search(spark):
    frame, rows = vectors(spark)
    score = lambda a, b: float(np.float32(a).astype(float) @ np.float32(b).astype(float))
    truth = {(q, c): s for q, _, c, s in plain_search(rows, score, 20, skip=(1020,))}
    got = search.approximate_top_k(frame).collect()
    assert np.mean([(r.query_id, r.vec_id) in truth for r in got]) >= 0.9
    assert all(math.isclose(r.score, score(rows[r.query_id], rows[r.vec_id]), rel_tol=1e-9) for r in got)
    assert search.approximate_top_k(frame.limit(0)).count() == 0


def plain_kept(rows, length=35):
    own = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + length]) for w in own for i in range(len(w) - length + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings(docs, nothing, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    got = substrings.keep_unrepeated(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted((i, *k) for (i, _), k in zip(ROWS, plain_kept(ROWS), strict=True))
    assert any(0 < r.n_removed < r.n_words for r in got)
    assert substrings.keep_unrepeated(nothing).count() == 0


def test_automaton_counts_occurrences():
    r = random.Random(1)
    for _ in range(60):
        seqs = [[r.randrange(3) for _ in range(r.randrange(4, 14))] for _ in range(4)]
        count = Counter(tuple(s[i : i + 4]) for s in seqs for i in range(len(s) - 3))
        for s, mask in zip(seqs, substrings.repeated(seqs, [1] * 4, 4), strict=True):
            assert mask == sum(1 << i for i in range(len(s) - 3) if count[tuple(s[i : i + 4])] > 1)


def test_quality_learns(spark, nothing, labels):
    rows = [(i, " ".join(words(40)) if i % 3 else " ".join(w.upper() + "!!" for w in words(40))) for i in range(400)]
    frame = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.scores(frame, marks).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 400]) > 0.95
    assert quality.scores(nothing, labels).count() == 0


def test_toxicity_learns(spark, nothing, labels):
    bad = ["wretch", "villain", "scoundrel"]
    rows = [(i, " ".join(w if i % 4 or j % 9 else rng.choice(bad) for j, w in enumerate(words(60)))) for i in range(600)]
    frame = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(frame, marks).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert toxicity.scores(nothing, labels).count() == 0


def test_personal_data(docs, nothing):
    got = {r.doc_id: r for r in personal.with_spans(docs, redact=True).collect()}
    r = got[15]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.base == "email:5:13,phone:17:35,ip:37:45" and set(r.base.split(",")) <= set(r.spans.split(","))
    assert r.text == "mail [EMAIL] or [PHONE], [IP]"
    assert got[1].text is None and got[1].spans == "" and got[2].text == ""
    assert personal.with_spans(nothing).count() == 0


def test_personal_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice("ab@.+-_ 0123456789()é") for _ in range(rng.randint(0, 60)))
        own = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert sorted(own) == [s for s in personal.base_spans(t) if s[1] < 2]
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")


def test_tagger_gradients():
    r = np.random.default_rng(0)
    x, y = r.integers(0, personal.CLASSES, (2, 6)), r.integers(0, personal.TAGS, (2, 6))
    t = personal.Tagger()

    def loss():
        e = t.emissions(x)[0]
        a = e[:, 0]
        for i in range(1, 6):
            z = a[:, :, None] + t.w["move"]
            a = e[:, i] + np.log(np.exp(z).sum(axis=1))
        gold = np.take_along_axis(e, y[:, :, None], 2).sum() + t.w["move"][y[:, :-1], y[:, 1:]].sum()
        return np.log(np.exp(a).sum(axis=1)).sum() - gold

    e, states, kf, _ = t.emissions(x)
    p, _ = t.marginals(e)
    np.put_along_axis(p, y[:, :, None], np.take_along_axis(p, y[:, :, None], 2) - 1, 2)
    _, gh = t._back(x, "f", kf, (p @ t.w["o"].T)[:, :, : personal.HIDDEN])
    before = loss()
    t.w["hf"][3, 5] += 1e-5
    assert math.isclose((loss() - before) / 1e-5, gh[3, 5], rel_tol=1e-3, abs_tol=1e-6)


STRANGE = ["", " ", "   a", "a  b \n\t c ", "▁x▁", "ﬁ ½ \x00x\x01", "漢字🙂é", "a" * 300, " " * 100 + "z", "it's we'll I'm '' 'sa !'s", "<|endoftext|> x", "12 345", "  x"]


def test_pieces(spark, docs, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["".join(rng.choice("ab  cde \n▁éß漢🙂the ing") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(STRANGE + more)], "doc_id long, text string"))
    for r in pieces.encode_decode(frame, path, keep=("doc_id", "text")).collect():
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    assert pieces.encode_decode(nothing, path).count() == 0


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), [*dict(ROWS).items(), *((100 + i, t) for i, t in enumerate(STRANGE))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(packing.pieces(frame, path)).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    filled = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and (r.length == 2048 or r.piece == 0)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) == packing.lower_bound(Counter(r.length for r in got), 2048)
    assert packing.pack(packing.pieces(nothing, path)).count() == 0


def test_bin_completion_finds_few_bins():
    r = random.Random(3)
    for _ in range(20):
        counts = Counter(r.randint(1, 100) for _ in range(200))
        found = packing.bin_completion(dict(counts), 100)
        used = Counter()
        for held, n in found:
            assert sum(s * k for s, k in held.items()) <= 100
            used.update({s: k * n for s, k in held.items()})
        assert used == counts
        assert sum(n for _, n in found) <= min(sum(n for _, n in packing.best_fit(dict(counts), 100)), packing.lower_bound(counts, 100) + 2)


def test_pipeline(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.select("doc_id", "text").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")  # one class: the filter keeps all
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = {r.doc_id: r.text for r in frame.collect()}
        done = stage(spark, frame, str(tmp_path))
        assert done.columns == frame.columns
        after = {r.doc_id: r.text for r in done.collect()}
        if name == "ngram_jaccard":
            assert set(before) - set(after) == {5, 7, 8}
        if name == "substring_dedup":
            kept = {i: k for (i, _), k in zip(before.items(), plain_kept(list(before.items())), strict=True)}
            assert after == {i: k[2] if k[1] else before[i] for i, k in kept.items()}
        if name == "pii":
            assert after[15] == "mail [EMAIL] or [PHONE], [IP]" and all(after[i] == t for i, t in before.items() if i != 15 and not re.search("[0-9@]", t or ""))
        frame = done
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


