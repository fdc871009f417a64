"""Personal data: fixed patterns, and beside them a character-level bidirectional LSTM with CRF transitions.

The patterns (email, ip, card, phone) give the base spans. The tagger is trained in numpy on a bounded
sample of windows that the patterns label, with some labelled numbers rewritten (a phone number without
its plus, other separators), so that it also learns forms the patterns miss. All four kinds hold a digit
or an @, so windows lie around every digit and @ of a text and nowhere else; overlapping windows are decoded
one by one and their spans reconciled over the whole text: surest first, none over another or over a base span.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import flat

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TEXTS, SAMPLE_WINDOWS = 1500, 2400  #: bounds of the training sample
WINDOW, STRIDE = 64, 32
HIDDEN, EPOCHS, BATCH = 16, 5, 80
SURE = 0.98  #: least probability of every tag of a span that the tagger adds
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TAGS = 1 + 2 * len(KINDS)  #: 0 outside, 2k + 1 first and 2k + 2 further character of kind k
CLASSES = 20


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' valid matches, in order."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:  # of one run before an @, the leftmost start is the only one that matters
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_CLASS = np.full(0x110000 + 1, 1, np.uint8)
_CLASS[0x110000] = 0  # beyond the text
for _i, _c in enumerate("@.+-_%()/: \n#*$", 5):
    _CLASS[ord(_c)] = _i
_CLASS[[*range(48, 58)]], _CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]] = 2, 3, 4


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def windows(code: np.ndarray) -> np.ndarray:
    """Starts of windows of WINDOW characters, STRIDE apart, that cover every digit and @ with their surroundings."""
    hit = np.flatnonzero((code == 64) | (code >= 48) & (code < 58))
    if not len(hit):
        return hit
    near = np.unique(np.concatenate([(hit - STRIDE // 2) // STRIDE, hit // STRIDE, (hit + STRIDE // 2) // STRIDE]))
    return np.unique(np.concatenate([near - 1, near])) * STRIDE


def inputs(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.full(WINDOW, 0x110000), code, np.full(2 * WINDOW, 0x110000)])
    return _CLASS[padded[starts[:, None] + WINDOW + np.arange(WINDOW)]].astype(np.int64)


def tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, k, b in spans:
        out[a:b] = 2 * k + 2
        out[a] = 2 * k + 1
    return out


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Weights of two LSTMs, of the tags' scores and of the transitions, by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.w = weights or {f"{n}{d}": rng.normal(0, 0.2, s) for d in "fb" for n, s in (("x", (CLASSES, 4 * h)), ("h", (h, 4 * h)))} | {"o": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}

    def _run(self, x: np.ndarray, d: str):
        """Hidden states (n, steps, hidden) of one direction, with what the backward pass needs."""
        n, steps = x.shape
        h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((n, steps, HIDDEN)), []
        before = self.w[f"x{d}"][x]
        for t in range(steps):
            z = before[:, t] + h @ self.w[f"h{d}"]
            gate = sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((i, f, o, g, old_c, old_h, tc))
        return out, kept

    def _back(self, x, d, kept, grad):
        gx, gh = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"])
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, old_c, old_h, tc = kept[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(gx, x[:, t], z)
            gh += old_h.T @ z
            dh, dc = z @ self.w[f"h{d}"].T, dc * f
        return gx, gh

    def emissions(self, x: np.ndarray):
        forth, kf = self._run(x, "f")
        back, kb = self._run(x[:, ::-1], "b")
        states = np.concatenate([forth, back[:, ::-1]], axis=2)
        return states @ self.w["o"] + self.w["bias"], states, kf, kb

    def marginals(self, e: np.ndarray):
        """(probability of every tag at every place, and summed over places of every move between tags)."""
        n, steps, _ = e.shape
        move = self.w["move"]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        fold = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for t in range(1, steps):
            a[:, t] = e[:, t] + fold(a[:, t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            b[:, t] = fold(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = fold(a[:, -1], 1)
        pair = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        return np.exp(a + b - z[:, None, None]), pair

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of every window."""
        n, steps, k = e.shape
        best, back = e[:, 0], np.zeros((n, steps, k), np.int64)
        for t in range(1, steps):
            x = best[:, :, None] + self.w["move"]
            back[:, t] = x.argmax(axis=1)
            best = e[:, t] + x.max(axis=1)
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        """Adam on the CRF's log likelihood."""
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                bx, by = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
                e, states, kf, kb = self.emissions(bx)
                p, pair = self.marginals(e)
                gold = np.zeros_like(pair)
                np.add.at(gold, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
                de = p
                np.put_along_axis(de, by[:, :, None], np.take_along_axis(de, by[:, :, None], 2) - 1, 2)
                ds = de @ self.w["o"].T
                grads = {"o": np.einsum("nth,ntk->hk", states, de), "bias": de.sum(axis=(0, 1)), "move": pair - gold}
                grads["xf"], grads["hf"] = self._back(bx, "f", kf, ds[:, :, :HIDDEN])
                grads["xb"], grads["hb"] = self._back(bx[:, ::-1], "b", kb, ds[:, ::-1, HIDDEN:])
                step += 1
                for name, g in grads.items():
                    g = np.clip(g / len(bx), -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    self.w[name] = self.w[name] - 0.02 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with phone numbers without their plus and with card separators changed, and the spans there."""
    out, moved, last = [], [], 0
    for a, k, b in spans:
        if a < last:
            continue
        own = text[a:b]
        own = own[1:] if k == 3 else own.replace(" ", ".").replace("-", ".") if k == 2 else own
        out.append(text[last:a])
        start = sum(map(len, out))
        out.append(own)
        moved.append((start, k, start + len(own)))
        last = b
    return "".join([*out, text[last:]]), moved


def labelled(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, tags) of all windows of a text and of its rewritten form."""
    xs, ys = [], []
    spans = base_spans(text)
    for own, marks in [(text, spans)] + ([rewritten(text, spans)] if spans else []):
        code = codes(own)
        starts = windows(code)
        y = np.concatenate([np.zeros(WINDOW, np.int64), tags(len(own), marks), np.zeros(2 * WINDOW, np.int64)])
        xs.append(inputs(code, starts))
        ys.append(y[starts[:, None] + WINDOW + np.arange(WINDOW)])
    return np.concatenate(xs), np.concatenate(ys)


def fit(documents: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Weights of a tagger trained on at most SAMPLE_WINDOWS windows of SAMPLE_TEXTS texts, chosen by hash."""

    def cut(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                x, y = labelled(t)
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.uint8).tobytes() for r in x], pa.binary()), pa.array([r.astype(np.uint8).tobytes() for r in y], pa.binary())], ["x", "y"])

    own = F.col(text).cast("string")
    marked = documents.select(own.alias("text")).where(own.rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    # hashes alone find the bound, so that no task sorts texts; copies of a chosen text give the same windows
    bound = marked.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h").alias("h")).first()["h"]
    chosen = marked.where(F.col("h") <= F.lit(bound)).select("text")
    rows = chosen.mapInArrow(cut, "x binary, y binary").distinct().orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_WINDOWS).collect()
    tagger = Tagger()
    if rows:
        rows.sort(key=lambda r: (bytes(r["x"]), bytes(r["y"])))
        x, y = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64) for c in ("x", "y"))
        tagger.train(x, y)
    else:
        tagger.w["bias"][0] = 20.0
    return tagger.w


def plausible(kind: int, part: str) -> bool:
    """What a span that the tagger adds must hold in any case."""
    digits = sum(c in "0123456789" for c in part)
    return (part.count("@") == 1 and "." in part, part.count(".") == 3 and digits >= 4, 12 <= digits <= 19, 9 <= digits <= 15)[kind] and not any(c.isspace() and c != " " for c in part)


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text."""
    out, xs, where = [], [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, list(base)))
        code = codes(t)
        starts = windows(code)
        if len(starts):
            xs.append(inputs(code, starts))
            where += [(i, int(s)) for s in starts]
    if not xs:
        return out
    x = np.concatenate(xs)
    found: dict[int, list[tuple[float, int, int, int]]] = {}
    for a in range(0, len(x), 2048):
        e = tagger.emissions(x[a : a + 2048])[0]
        best = tagger.decode(e)
        some = np.flatnonzero((best > 0).any(axis=1))
        if not len(some):
            continue
        sure = np.take_along_axis(tagger.marginals(e[some])[0], best[some][:, :, None], 2)[:, :, 0]
        for row, p in zip(some, sure, strict=True):
            y, (i, start) = best[row], where[a + row]
            for t in np.flatnonzero((y > 0) & (y % 2 == 1)):
                end = t + 1
                while end < WINDOW and y[end] == y[t] + 1:
                    end += 1
                if 0 < t and end < WINDOW and (score := float(p[t:end].min())) >= SURE:  # spans cut by a window's edge are whole in another
                    found.setdefault(i, []).append((-score, start + int(t), int(y[t]) // 2, start + int(end)))
    for i, spans in found.items():
        taken = [(a, b) for a, _, b in out[i][0]]
        for _, a, k, b in sorted(set(spans)):
            if 0 <= a and b <= len(texts[i]) and plausible(k, texts[i][a:b]) and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out[i][1].append((a, k, b))
        out[i][1].sort()
    return out


def with_spans(documents: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """The rows with n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined).

    Offsets are code points, ends exclusive. redact: also replaces every span in the text by its kind in
    brackets. Null counts as the empty text (and stays null); repeated rows are treated alike; an empty
    table gives no rows; input columns of these names give way, all others stay.
    """
    lean(documents.sparkSession)
    added = [f"n_{k}" for k in KINDS] + ["base", "spans"]
    source = documents.drop(*added)
    held, names = source.sparkSession.sparkContext.broadcast(fit(source, text)), source.columns

    def run(batches):
        tagger = Tagger(held.value)
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            data, offsets = flat(column)
            hit = np.append(0, np.cumsum((data == 64) | (data >= 48) & (data < 58)))
            rows = np.flatnonzero(hit[offsets[1:]] > hit[offsets[:-1]])
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows]
            counts, base, spans, changed = np.zeros((len(KINDS), batch.num_rows), np.int64), [""] * batch.num_rows, [""] * batch.num_rows, {}
            for i, t, (own, every) in zip(rows.tolist(), texts, all_spans(texts, tagger), strict=True):
                for _, k, _ in own:
                    counts[k, i] += 1
                base[i], spans[i] = written_out(own), written_out(every)
                if redact and every:
                    parts, last = [], 0
                    for a, k, b in every:
                        if b > last:
                            parts += [t[last:a], f"[{KINDS[k].upper()}]"] if a >= last else []
                            last = b
                    changed[i] = "".join([*parts, t[last:]])
            columns = list(batch.columns)
            if changed:
                columns[names.index(text)] = pa.array([changed.get(i, x) for i, x in enumerate(column.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{schema}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
