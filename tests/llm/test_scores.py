"""The scores of the three classifiers, recomputed one text at a time in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
RNG = random.Random(31)
TEXTS = [
    "",
    "One. Two two two! three",
    "no end here",
    "É à la mode?  Ünïcode words, ok.\nNext line: 42 items",
    "...",
    " ".join(RNG.choice(["alpha", "Beta,", "gamma.", "delta!", "be", "extraordinarily", "x\ny", "7"]) for _ in range(150)),
]


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def hashed(word):
    return mixed(sum((b + 1) * pow(BASE, j, 1 << 64) for j, b in enumerate(word)) + len(word) & M)


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def runs(raw, inside):
    out, at = [], 0
    while at < len(raw):
        if inside(raw[at]):
            to = at
            while to < len(raw) and inside(raw[to]):
                to += 1
            out.append((at, to))
            at = to
        else:
            at += 1
    return out


def sigmoid(z):
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def test_toxicity_scores():
    from ledgerlake.llm import toxicity as t

    model = t.Model(np.random.RandomState(1).normal(0, 0.7, 1 << t.BITS), -1.5, 0.3)
    got = model.annotate(pa.array(TEXTS))
    for text, score, n, offending in zip(TEXTS, got["score"].to_pylist(), got["n_sentences"].to_pylist(), got["offending"].to_pylist(), strict=True):
        raw = text.encode()
        sentences, before = {}, None
        for a, b in runs(raw, lambda x: 48 <= x < 58 or 65 <= x < 91 or 97 <= x < 123 or x >= 128):
            word = lower(raw[a:b])
            ids = [hashed(word) >> 64 - t.BITS]
            for k in t.STEMS:
                ids.append((hashed(word[:k]) ^ (k * BASE & M)) >> 64 - t.BITS if len(word) > k else 0)
            ids = [0] * len(ids) if word == before else ids
            before = word
            key = sum(x in b"\n\r!.?" for x in raw[:a])
            s = sentences.setdefault(key, [model.bias, a, b])
            s[0] += sum(float(model.weights[i]) for i in ids)
            s[2] = b
        p = [sigmoid(z) for z, _, _ in sentences.values()] or [sigmoid(model.bias)]
        clear = math.prod(1 - x for x in p)
        assert abs(score - sigmoid(math.log((1 - clear) / clear) + model.shift)) < 1e-6
        assert n == len(sentences)
        assert [(o["start"], o["end"]) for o in offending] == [(a, b) for (z, a, b) in sentences.values() if sigmoid(z) >= 0.5]


def test_quality_scores():
    from ledgerlake.llm import quality as q

    rng = np.random.RandomState(2)
    p = {k: rng.normal(0, 0.3, s) for k, s in {"W": (q.WIDTH, q.HIDDEN), "b": q.HIDDEN, "V": (q.HIDDEN, q.GATE), "U": (q.HIDDEN, q.GATE), "w": q.GATE, "c": q.HIDDEN, "d": 1}.items()}
    mean, scale = rng.normal(0, 0.1, q.WIDTH), rng.uniform(0.5, 2, q.WIDTH)
    got = q.Model(mean, scale, p, shift=0.2).annotate(pa.array(TEXTS))
    kinds = len(q.CLASSES) + 1

    def kind(b):
        return next((i for i, ranges in enumerate(q.CLASSES) if any(lo <= b <= hi for lo, hi in ranges)), kinds - 1)

    for text, score, n, top in zip(TEXTS, got["score"].to_pylist(), got["n_passages"].to_pylist(), got["top_passage"].to_pylist(), strict=True):
        raw = text.encode()
        words = runs(raw, lambda b: kind(b) not in (3, 4))
        passages = max(1, -(-len(words) // q.PASSAGE))
        owner, at = [], -1
        starts = {a for a, _ in words}
        for i in range(len(raw)):
            at += i in starts
            owner.append(max(at, 0) // q.PASSAGE)
        spoken = [lower(raw[a:b]) for a, b in words]
        hs = []
        for k in range(passages):
            x = [0.0] * q.WIDTH
            own = [i for i in range(len(raw)) if owner[i] == k]
            if words:
                mine = range(k * q.PASSAGE, min((k + 1) * q.PASSAGE, len(words)))
                lengths = [words[j][1] - words[j][0] for j in mine]
                for i in own:
                    x[kind(raw[i])] += 1 / max(len(own), 1)
                    if i and owner[i - 1] == k:
                        x[kinds + kind(raw[i - 1]) * kinds + kind(raw[i])] += 1 / max(len(own), 1)
                x[-5] = sum(lengths) / len(lengths) / 10
                x[-4] = math.sqrt(sum(v * v for v in lengths) / len(lengths)) / 10
                x[-3] = sum(j > k * q.PASSAGE and spoken[j] == spoken[j - 1] for j in mine) / len(lengths)
                x[-2] = sum(spoken[j] in spoken[:j] for j in mine) / len(lengths)
                x[-1] = min(math.log1p(len(lengths)), 4) / 4
            v = (np.sqrt(x) - mean) / scale
            hs.append([math.tanh(sum(v[i] * p["W"][i, j] for i in range(q.WIDTH)) + p["b"][j]) for j in range(q.HIDDEN)])
        e = []
        for h in hs:
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(q.HIDDEN))) * sigmoid(sum(h[i] * p["U"][i, j] for i in range(q.HIDDEN))) for j in range(q.GATE)]
            e.append(math.exp(sum(gate[j] * p["w"][j] for j in range(q.GATE))))
        z = [sum(a * h[j] for a, h in zip(e, hs, strict=True)) / sum(e) for j in range(q.HIDDEN)]
        assert abs(score - sigmoid(sum(z[j] * p["c"][j] for j in range(q.HIDDEN)) + p["d"][0] + 0.2)) < 1e-9
        assert n == passages and top == e.index(max(e))


def test_language_scores():
    from ledgerlake.llm import langid as g

    names = ["aa", "bb", "cc", "dd"]
    code = g.codewords(4)
    rng = np.random.RandomState(3)
    model = g.Model(names, code, rng.normal(0, 1, (code.shape[1], 1 << g.BITS)), rng.dirichlet(np.ones(code.shape[1])), 2.0)
    got = model.annotate(pa.array(TEXTS))
    for text, lang, score, ambiguous in zip(TEXTS, got["lang_pred"].to_pylist(), got["score"].to_pylist(), got["ambiguous"].to_pylist(), strict=True):
        if not any(c.isalpha() for c in text):
            assert (lang, score, ambiguous) == ("und", 0.0, False)
            continue
        raw = lower(text.encode())
        raw = b" " + bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in raw) + b"    "
        places = len(raw) - 4
        margins = [0.0] * code.shape[1]
        for size, m in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
            for i in range(places):
                f = (int.from_bytes(raw[i : i + size]) * m & 0xFFFFFFFF) >> 32 - g.BITS
                for b in range(len(margins)):
                    margins[b] += float(model.weights[b, f]) / places / 3
        loss = [sum(t * math.log1p(math.exp(-m * c * 2.0)) for t, m, c in zip(model.trust, margins, code[l], strict=True)) for l in range(4)]
        share = [math.exp(-(x - min(loss)) * code.shape[1]) for x in loss]
        assert lang == names[loss.index(min(loss))] and abs(score - max(share) / sum(share)) < 1e-4
        assert ambiguous == (score < 0.6)
