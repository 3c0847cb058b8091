"""Operators of the training-data subpackage against brute force, round trips and edge cases."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import chat, common, decontaminate, graph, htmltext, langid, licenses, mixing, native, neardup, neighbours, secrets, suffixdedup
from wayfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def docs(spark, texts, **extra):
    """Rows (doc_id, text, lang, source, n_chars) with clashing extra columns."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] if not texts or not isinstance(texts[0], tuple) else texts
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("hits", "items", "n_words", "spans", "score", "rep", "node", "block", "low", "kept", "label"):
        df = df.withColumn(name, F.lit(1))
    return df


def test_words_split_like_the_pattern():
    text = "Ab-c é_ÀX 12\x7f\t日本 x"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [w.decode() for w in common.words(text.encode())] == want
    assert common.words(None) == common.words(b"") == []


# 1


def windows_in(text, item, size=10):
    w, p = common.words((text or "").encode()), common.words((item or "").encode())
    hit = set()
    for i in range(max(1, len(p) - size + 1) if p else 0):
        q = p[i : i + size]
        hit |= {k for s in range(len(w) - len(q) + 1) if w[s : s + len(q)] == q for k in range(s, s + len(q))}
    return hit


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination(spark, block):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "Short item!"), (3, None), (4, "..."), (None, "no id here"), (2, "Short item!"), (7, "a a a a a a a a a a a")], "item_id long, text string")
    texts = ["x " + item + " y", item.upper().replace(" ", "--"), "a short, ITEM b short item", "one two three", None, "", "no id here", "a " * 30, "z " * 3000 + item, item[4:]]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench, block_windows=block).collect()}
    items = {1: item, 2: "Short item!", None: "no id here", 7: "a a a a a a a a a a a"}
    for i, t in enumerate(texts):
        hits = {k: windows_in(t, v) for k, v in items.items()}
        assert {k for s in got[i].hits for k in range(s.start, s.end)} == set().union(*hits.values())
        assert got[i]["items"] == sorted(k for k, h in hits.items() if h and k is not None)
        assert got[i].n_words == len(common.words((t or "").encode()))
    none = decontaminate.decontaminate(docs(spark, texts), bench.limit(0))
    assert none.where(F.size("hits") > 0).count() == 0 and none.count() == len(texts)
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


# 2


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)) + 3 * rng.standard_normal((6, 8))[rng.integers(0, 6, 600)]
    x[100:300] = x[100]  # many copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [1.0, None] + [1.0] * 6), (1004, [1.0]), (None, [1.0] * 8), (1005, []), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("part", F.lit(1))
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, sample=256, rows_per_part=64)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hit = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(600) if i != q)[:10]
        assert [s for s, _ in by[q]] == sorted(s for s, _ in by[q]) and len(by[q]) == 10
        hit += len({i for _, i in want} & {i for _, i in by[q]})
    assert hit >= 0.9 * 120
    assert set(by) == set(range(0, 600, 50))
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.search(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2, 3]


def test_probes_hold_for_rows_outside_the_fit():
    x = np.random.default_rng(4).standard_normal((3072, 24))
    router = neighbours.fit(x[:1024], 16, 0.9)
    fresh = np.arange(1024, 3072)
    scores = router.scores(x)
    order = np.argsort(-scores[fresh], axis=1)[:, : router.probes]
    near = neighbours.knn(x, x[fresh], 11)
    hit = (scores.argmax(1)[near][:, :, None] == order[:, None, :]).any(2)[near != fresh[:, None]].mean()
    assert hit >= 0.87


def recall_of(found, x, ids, queries, k=10):
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(by[ids[q]] & {ids[i] for i in np.lexsort((ids, d))[:k]})
    return hit / (k * len(queries))


def test_neighbours_of_two_levels(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 8)) + 4 * rng.standard_normal((20, 8))[rng.integers(0, 20, 6000)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0, sample=512, rows_per_part=100, width=8).collect()
    assert len(got) == 600 and recall_of(got, x, np.arange(6000), range(0, 6000, 100)) >= 0.9


def test_recall_on_embeddings(spark):
    """The query itself, on the largest table, against brute force."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    got = QUERIES["op2_nearest_neighbours"](spark, sf).collect()
    assert recall_of(got, x, ids, [i for i, v in enumerate(ids) if v % 100 == 0]) >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(0).standard_normal((256, 4))
    label = neighbours.balanced_parts(x, neighbours.knn(x, x, 5, own=True), 8)
    assert set(np.bincount(label)) == {32}


# 3


def test_secrets(spark):
    blob = hashlib.sha512(b"x").hexdigest()[:40]
    key = "Zm9vQmFyMTIzNDU2Nzg5MGFiY2RlZkdISUpLTE1OT1A"
    texts = ['password = "hunter22"', "TOKEN:abc", "secret: token: abcdefgh", "é AKIA" + "ABCD1234" * 2 + " z", "AKIA123", f"x {blob} y " + blob, None, "", "plain words only", "token=" + "a" * 5 + " token=" + "b" * 6, "日本 api-key:abcdef api_key:abcdef", "q " * 500 + blob]
    texts += [f"see {hashlib.sha256(str(i).encode()).hexdigest().upper()[:48]} end" for i in range(5)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in got[i].spans if s.kind < 3] == sorted(want)
        assert [tuple(s) for s in got[i].spans] == sorted(map(tuple, got[i].spans))
    assert any(s.kind == 3 for i in range(len(texts) - 5, len(texts)) for s in got[i].spans)
    assert got[8].spans == []
    red = secrets.find_secrets(docs(spark, texts)).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("r")).collect()
    red = {r.doc_id: r.r for r in red}
    assert red[5] == "x [SECRET] y [SECRET]" and red[8] == texts[8] and red[6] is None and "hunter22" not in red[0]
    assert key and secrets.find_secrets(docs(spark, [])).count() == 0
    clash = docs(spark, texts).withColumn("Spans", F.lit(2)).drop("spans").withColumn("base", F.lit(3)).withColumn("_TRIED", F.lit(4))
    again = secrets.find_secrets(clash)
    assert [c for c in again.columns if c.lower() == "spans"] == ["spans"] and {r.doc_id: r.spans for r in again.collect()} == {i: r.spans for i, r in got.items()}


def battery(s):
    """The combined p of a string, written out."""
    normal = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    alphabet = next((a for a in secrets.ALPHABETS.values() if set(s) <= set(a)), "".join(sorted(set("".join(secrets.ALPHABETS.values())))))
    n, k, v = len(s), len(alphabet), [alphabet.index(c) for c in s]
    chi, free = sum((s.count(c) - n / k) ** 2 / (n / k) for c in alphabet), k - 1
    even = 2 * normal(-abs(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))))
    above = [x >= k / 2 for x in v]
    a, b = sum(above), n - sum(above)
    turns, mean = 1 + sum(x != y for x, y in zip(above, above[1:])), 2 * a * b / n + 1
    runs = 2 * normal(-abs(turns - mean) / math.sqrt(max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9)))
    m = sum(v) / n
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / max(sum((x - m) ** 2 for x in v), 1e-9)
    y = -sum(math.log(max(p, 1e-100)) for p in (even, runs, 2 * normal(-abs(r + 1 / n) * math.sqrt(n))))
    return math.exp(-y) * (1 + y + y * y / 2)


def test_random_strings(spark):
    rng = random.Random(3)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    drawn = [draw(secrets.ALPHABETS[a], n) for a in ("base62", "base64url", "BASE36") for n in (24, 40, 80) for _ in range(40)]
    plain = ["the_order_of_2_words_" * n + str(i) for n in (1, 2, 4) for i in range(60)] + ["a1" * 12, "0" * 30 + "a"]
    strings = drawn + plain
    found = {r.doc_id: r.x for r in docs(spark, [f"see {s} there" for s in strings]).select("doc_id", secrets.candidates(F.col("text")).alias("x")).collect()}
    counts = {}
    for i, s in enumerate(strings):
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
            assert found[i] == []
            continue
        (x,) = found[i]
        p = battery(s)
        assert (x.start, x.end) == (4, 4 + len(s)) and abs(x.bin + 20 * math.log(max(p, 1e-300))) <= 1.5 or x.bin > 300 and p < math.exp(-15)
        key = ((len(s) >= 32) + (len(s) >= 64), x.bin)
        counts[key] = counts.get(key, 0) + 1
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs(spark, [f"see {s} there" for s in strings])).collect()}
    most = secrets.largest_bins(counts, 0.05)
    assert all(bool(got[i]) == any(x.bin <= most[getattr(x, "class")] for x in found[i]) or any(s.kind < 3 for s in got[i]) for i in range(len(strings)))
    hits = [i for i in range(len(strings)) if any(s.kind == 3 for s in got[i])]
    assert len([i for i in hits if i < len(drawn)]) > 0.9 * len(drawn) and len([i for i in hits if i >= len(drawn)]) < 0.1 * len(hits)


def test_redaction(spark):
    rng = random.Random(1)
    rows = []
    for i in range(30):
        text = "".join(rng.choice("ab é日\n𝄞") for _ in range(rng.choice((10, 4095, 4096, 4097, 20_000))))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.choice((1, 4, 60)) * 2)))
        spans = sorted((a, rng.randrange(4), min(len(text), b + rng.choice((0, 0, 5)))) for a, b in zip(cuts[::2], cuts[1::2]))
        rows.append((i, text, spans))
    rows += [(98, "all", [(0, 0, 3)]), (99, "", []), (97, None, [])]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start: bigint, kind: int, end: bigint>>")
    got = {r.i: r.r for r in df.select("i", secrets.redact(F.col("text"), F.col("spans")).alias("r")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for k, (a, _, b) in enumerate(spans):
            if a > at or k == 0:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i] == (out + text[at:] if spans else text)


def test_running_sums(spark):
    xs = [list(range(n)) for n in (0, 1, 2, 255, 256, 257, 700)]
    df = spark.createDataFrame([(x,) for x in xs], "x array<bigint>")
    got = {len(r.x): r.s for r in df.select("x", native.running(F.col("x")).alias("s")).collect()}
    assert all(got[len(x)] == [sum(x[:i]) for i in range(len(x) + 1)] for x in xs)


# 4


def removed(texts):
    """Bytes of each document that a string of 50 covers which starts in one of smaller id."""
    seen, out = {}, {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            seen[b[s : s + 50]] = min(seen.get(b[s : s + 50], i), i)
    for i, t in texts:
        b = (t or "").encode()
        gone = {k for s in range(len(b) - 49) if seen[b[s : s + 50]] < i for k in range(s, s + 50)}
        out[i] = bytes(x for k, x in enumerate(b) if k not in gone)
    return out


def test_suffix_dedup(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    p, q = word(130), word(60)
    texts = [word(300), p + word(40), word(20) + p[10:90] + word(20), p, p, None, "", "short", word(49), p[:50], p[:49], q + q + q, word(30) + q, "a" * 400, "a" * 120 + "b", word(5) + p[60:] + q[:55] + p[:70], word(4000) + p]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    want = removed([(r[0], r[1]) for r in rows])
    got = suffixdedup.remove_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in got)
    assert suffixdedup.remove_repeats(docs(spark, [])).count() == 0
    nulls = [(None, p, "", "", 0), (3, p + "x", "", "", 0), (None, p, "", "", 0), (3, p + "x", "", "", 0), (None, None, "", "", 0)]
    got = [(r.doc_id, bytes(r.kept).decode()) for r in suffixdedup.remove_repeats(docs(spark, nulls)).collect()]
    assert sorted(got, key=str) == sorted([(None, ""), (3, p + "x"), (None, ""), (3, p + "x"), (None, "")], key=str)


def test_suffix_dedup_compares_bytes(monkeypatch):
    """With names of 2 bits, and marks that all meet at one place."""
    rng = np.random.default_rng(9)
    strings = rng.integers(0, 2, (300, 5)).astype(np.uint8)
    docs_ = rng.integers(0, 40, 300)
    got = set(suffixdedup._repeats(strings, strings.sum(1).astype(np.uint64) % 4, docs_).tolist())
    assert got == {i for i in range(300) if any(docs_[j] < docs_[i] and (strings[j] == strings[i]).all() for j in range(300))}
    monkeypatch.setattr(suffixdedup._Marked, "mixed", staticmethod(lambda d, k: (k % np.uint64(3))))
    keys = rng.integers(0, 50, 200).astype(np.uint64)
    d, masks = rng.integers(0, 9, 200), rng.integers(1, 8, 200).astype(np.uint64)
    marked = suffixdedup._Marked([d[:90], d[90:]], [keys[:90], keys[90:]], [masks[:90], masks[90:]])
    for x in range(10):
        for k in range(52):
            want = np.bitwise_or.reduce(masks[(d == x) & (keys == k)], initial=np.uint64(0))
            assert marked.of(np.array([x]), np.array([k], np.uint64))[0] == want


# 5


def licenses_by_hand(text, templates, percent=80):
    w, out = licenses.sequence(text), {}
    for label, template in templates:
        need, n = licenses.tokens(template), -(-100 * len(licenses.sequence(template)) // percent)
        most = max((len(need & set(w[k : k + n])) for k in range(len(w))), default=0)
        if need and 100 * most >= percent * len(need):
            out[label] = max(out.get(label, 0), most / len(need))
    return out


def test_licenses(spark):
    texts = ["Released under the MIT License.", "x\nAll rights, reserved. All rights reserved", "CC-BY and cc BY", "General Public\nLicense", "overall rights reserved", "accc by", None, "", "Permission is granted, free of charge, to any person obtaining a copy of this software and documentation files hereby associated", "le mit est", "cc by " * 700]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in common.words((t or "").encode())]
        hits = sorted((s, label) for p, label in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == sorted({h[1] for h in hits})
        assert {m.label: m.share for m in r.matches} == pytest.approx(licenses_by_hand(t or "", licenses.TEMPLATES))
        assert [m.label for m in r.matches] == sorted({m.label for m in r.matches})
    assert licenses.scan(docs(spark, []), []).count() == 0


def test_licenses_across_lines(spark):
    wrap = lambda text, n, mark="": "\n".join(mark + " ".join(w[i : i + n]) for w in [text.split()] for i in range(0, len(w), n))
    spread = "\nx\n".join(f"filler {'word ' * 40}{x}" for x in licenses.TEMPLATES[0][1].split())
    texts = [f"Some\n\n{'prose ' * 30}{wrap(t, n, mark)}\nand {'more ' * 30}" for _, t in licenses.TEMPLATES for n, mark in ((3, ""), (5, " * "), (2, "\n# "))]
    got = {r.doc_id: {m.label: m.share for m in r.matches} for r in licenses.scan(docs(spark, [*texts, spread])).collect()}
    for i in range(len(texts)):
        label, template = licenses.TEMPLATES[i // 3]
        assert got[i].get(label) == 1.0, template
    assert got[len(texts)] == {}
    rng = np.random.default_rng(3)
    words = licenses.sequence(licenses.TEMPLATES[0][1])  # with words left out and put in
    odd = [wrap(" ".join(x for w in words for x in ([w] if rng.random() > 0.12 else []) + ["zz"] * int(rng.random() < 0.15)), 4) for _ in range(30)]
    found = {r.doc_id: {m.label: m.share for m in r.matches} for r in licenses.scan(docs(spark, odd)).collect()}
    assert all(found[i] == pytest.approx(licenses_by_hand(t, licenses.TEMPLATES)) for i, t in enumerate(odd))
    assert 0 < sum(map(bool, found.values())) < 30


def test_many_templates(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 60))
    templates = [(f"t{i % 90}", draw(int(rng.integers(1, 14)))) for i in range(300)] + [("none", "..."), ("t1", "")]
    texts = [draw(int(rng.integers(0, 60))) for _ in range(40)]
    for percent in (70, 100):
        got = {r.doc_id: {m.label: m.share for m in r.matches} for r in licenses.scan(docs(spark, texts), templates, percent, {}).collect()}
        assert all(got[i] == pytest.approx(licenses_by_hand(t, templates, percent)) for i, t in enumerate(texts))


# 6


def test_mixing(spark):
    texts = [(i, "w " * (1 + i % 7), "", "big" if i % 10 else f"small{i % 3}", 0) for i in range(400)] + [(900, None, "", "empty", 0), (901, "", "", None, 0), (902, "a b", "", None, 0)]
    df = docs(spark, texts)
    got = mixing.mix(df, entropy=0.9, repeats=3.0, blocks=8).collect()
    tokens = {i: len((t or "").split()) for i, t, *_ in texts}
    source = {i: s or "" for i, _, _, s, _ in texts}
    total = sum(tokens.values())
    by = {}
    for r in got:
        assert r.n_tokens == tokens[r.doc_id] and r.source == source[r.doc_id]
        by.setdefault(r.source, []).append(r)
    weights = {s: rows[0].weight for s, rows in by.items()}
    assert sum(weights.values()) == pytest.approx(1)
    held = {s: sum(tokens[i] for i in tokens if source[i] == s) for s in weights}
    for s, rows in by.items():
        quota = int(weights[s] * total + 1e-9)
        assert quota - 8 <= sum(r.n_tokens for r in rows) <= quota + 1
        assert max(r.epoch for r in rows) <= 3
        assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
        whole = [r.doc_id for r in rows if r.epoch == 0]
        assert quota < held[s] or set(whole) == {i for i in tokens if source[i] == s}
    most = held["big"]
    assert weights["big"] < most / total  # flattened
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(df, entropy=0.0, blocks=8).groupBy("source").agg(F.sum("n_tokens").alias("n")).where("source = 'big'").first().n >= most - 8


def exponent_by_hand(held, budget, entropy, repeats):
    """By trying 200,001 exponents."""
    at = np.linspace(0, 1, 200_001)[:, None]
    tokens = np.array(held, float)[None, :]
    w = tokens**at / (tokens**at).sum(1, keepdims=True)
    share = -(w * np.log(w)).sum(1) / np.log(tokens.shape[1])
    even = at[share >= entropy - 1e-9].max()
    rare = (w * budget / tokens).max(1) <= repeats
    return max(even, at[rare].min() if rare.any() else 1.0)


@pytest.mark.parametrize("held, budget, entropy, repeats", [([1000, 10, 10], None, 0.9, 4), ([1000, 10, 10], None, 0.0, 4), ([900, 300, 5, 40], None, 0.8, 100), ([900, 300, 5, 40], 200, 0.99, 2), ([7, 7], None, 0.5, 1), ([50, 3], 1000, 0.95, 4)])
def test_exponent(spark, held, budget, entropy, repeats):
    budget = budget or sum(held)
    sources = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(held)], "source string, tokens long")
    assert mixing.exponent(sources, budget, entropy, repeats) == pytest.approx(exponent_by_hand(held, budget, entropy, repeats), abs=1e-4)


def test_mixing_rows_without_ids(spark):
    rows = [(None, f"w{i} " * 3, "", "a", 0) for i in range(600)] + [(1, "x y", "", "b", 0)] * 5
    got = mixing.mix(docs(spark, rows), entropy=0.0, repeats=1.0).collect()
    assert sorted((r.doc_id or 0, r.source) for r in got) == [(0, "a")] * 600 + [(1, "b")] * 5
    assert len({r.block_rank for r in got if r.source == "a"}) > 100


# 7


def classes(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        return i if top[i] == i else root(top[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block, limit", [(256, 1 << 21), (6, 1 << 21), (256, 1 << 10)])
def test_near_duplicates(spark, block, limit, monkeypatch):
    monkeypatch.setattr(neardup, "LIMIT", limit)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 80)]
    texts = [" ".join(base)] * 5
    for _ in range(40):  # a chain of near copies around the threshold
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 4)):
            w[k] = f"v{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"x{x}" for x in rng.integers(0, 500, 60)) for _ in range(20)] + [None, "", "one", "One", "two words", "a b c", "A b\tc", "  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = classes(rows, 3, 85)
    got = neardup.near_duplicates(docs(spark, [(i, t, "", "", 0) for i, t in rows]), size=3, percent=85, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_a_long_chain(spark):
    """Each text shares bands with the next, so that candidates hang together; links are few."""
    words = [f"w{x}" for x in np.random.default_rng(6).integers(0, 10**6, 60_000)]
    texts = [" ".join(words[6 * i : 6 * i + 40]) for i in range(9_000)]
    texts[5000:5000] = [texts[100] + " end", texts[7000] + " end"]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=85).where("NOT kept").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5000, 100), (7002, 5001)}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.near_duplicates(docs(spark, [None, ""])).where("kept").count() == 2


def test_densified_bins_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(0)
    same = 0
    for _ in range(200):
        x = common.mix(rng.integers(0, 2**62, 40).astype(np.uint64))
        a, b = np.unique(x[:36]), np.unique(x[4:])
        same += (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same / 200 - 32 / 40) < 0.03


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    assert got == {i: root(i) for i in top}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 8


def test_language_id(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op8_language_id"](spark, SF).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.95
    model = langid.fit(df)
    odd = docs(spark, [None, "", "123 !?", "é", "a", "the " * 5000, "日本語"])
    pred = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [pred[i].lang_pred == "und" for i in range(7)] == [True, True, True, False, False, False, False]
    assert pred[0].score == 0 and pred[0].languages == []
    texts = {r.lang: r.text for r in df.where("lang IN ('en', 'de') AND n_chars > 2000").collect()}
    both = langid.identify(docs(spark, [texts["en"][:1500] + " " + texts["de"][:1500]]), model).first()
    assert {x.lang for x in both.languages} == {"en", "de"}
    none = langid.fit(df.limit(0))
    assert none.languages == [] and langid.identify(odd, none).where("lang_pred <> 'und'").count() == 0


def by_hand(model, text, most):
    """Shares of the chosen set, one segment and language at a time."""
    data = b" " + text.encode().translate(langid.LETTERS) + b" "
    cuts = range(0, max(1, len(data) - 2), langid.SEGMENT)
    like = []
    for lo in cuts:
        codes = [langid.cells(np.frombuffer(data[k : k + 3], np.uint8))[0] for k in range(lo, min(lo + langid.SEGMENT, len(data) - 2))]
        like.append([float(sum(model.logs[c, j] for c in codes)) for j in range(len(model.languages))])

    def em(own):
        share = {j: 1 / len(own) for j in own}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(own, 0.0)
            for row in like:
                top = max(row[j] for j in own)
                part = {j: share[j] * np.exp(row[j] - top) for j in own}
                for j in own:
                    new[j] += part[j] / sum(part.values()) / len(like)
            share = new
        return share, sum(np.log(sum(share[j] * np.exp(row[j] - max(row[i] for i in own)) for j in own)) + max(row[j] for j in own) for row in like)

    first, _ = em(range(len(model.languages)))
    order = sorted(first, key=lambda j: (-first[j], j))
    fits = [(em(order[:k]), k) for k in range(1, most + 1)]
    (share, _), _ = max(fits, key=lambda f: (f[0][1] - (f[1] - 1) * (np.log(len(like) + 1) + 4), -f[1]))
    return {model.languages[j]: s for j, s in share.items()}


def test_language_mixtures_by_hand(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(df)
    by = {r.lang: r.text for r in df.where("n_chars BETWEEN 1200 AND 9000").collect()}
    a, b, c, d = (by[x] for x in ("en", "de", "fr", "es"))
    texts = [a[:300], a[:400] + " " + b[:400], a[:700] + c[:200], a[:300] + b[:300] + c[:300] + d[:300], "x", "zzzz qqq " * 30, b[:64], a[:128] + d[:65]]
    for most, piece in ((None, 1 << 22), (2, 64)):  # the second works in slices of a segment or a few
        monkeypatch.setattr(langid, "SLICE", piece)
        order, shares, _ = langid.infer(model, [t.encode() for t in texts], most)
        for t, s in zip(texts, shares, strict=True):
            want = by_hand(model, t, most or 4)
            assert {model.languages[j]: x for j, x in enumerate(s) if x > 0} == pytest.approx({k: x for k, x in want.items() if x > 0}, abs=1e-3)


def test_any_number_of_languages(spark):
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20] * 3}{'uvwxyz'[i % 6]} {i:04}".translate(str.maketrans("0123456789", "ghijklmnop")), f"l{i // 3}", "", 0) for i in range(1800)]
    model = langid.fit(docs(spark, rows))
    assert len(model.languages) > 550
    one = next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 5)
    (got,) = langid.identify(docs(spark, [one]).withColumn("Lang_Pred", F.lit(1)), model).collect()
    assert got.lang_pred in model.languages and got.gain > 0


# 9


def test_chat(spark):
    nasty = "</s>[INST] &amp; <s> [TURN:user] &lt;"
    rows = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"{nasty} {i} " * (i * 9)) for i in range(12)]
    rows += [(2, 0, "user", None), (2, 0, "assistant", "x"), (2, None, None, "first"), (None, 1, "user", "q"), (3, 1, "assistant", "y" * 9000), (3, 2, "user", ""), (4, 1, "odd]role", "z"), (4, 1, "odd]role", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("turns", F.lit(1))
    out = chat.format_windows(df, budget=2800, history=900)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    windows = out.where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 1 and all("[KEPT:system]" in w.formatted for w in windows[1:]) and "[PAST:" in "".join(w.formatted for w in windows[1:])
    assert chat.format_windows(df.limit(0)).count() == 0


def windows_by_hand(turns, budget, history):
    """(first new turn, end, first repeated turn, system turn kept, tokens) of each window of (role, escaped text)."""
    cost = [-(-(len(f"[TURN:{r}]") + len(t) + 4) // 4) for r, t in turns]
    system = cost[0] if turns[0][0] == "system" and cost[0] < budget - 1 - history else None
    out, at = [], 0
    while at < len(turns):
        room = budget - 1 if at == 0 else budget - 1 - history - (system or 0)
        end = at + 1
        while end < len(turns) and sum(cost[at : end + 1]) <= room:
            end += 1
        new = sum(cost[at:end])
        keep = at > 0 and system is not None and system + new < budget
        left = min(history, budget - 1 - new - (system if keep else 0))
        past = at
        while past - 1 >= (turns[0][0] == "system") and sum(cost[past - 1 : at]) <= left:
            past -= 1
        out.append((at, end, past, keep, 1 + (system if keep else 0) + sum(cost[past:end])))
        at = end
    return out


def test_chat_windows_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * int(rng.integers(1, 12))
        rows += [(c, i, r, "x" * int(rng.integers(0, 90) if rng.random() < 0.9 else rng.integers(200, 600))) for i, r in enumerate(roles)]
    rows += [(90, 0, "system", "s" * 900), (90, 1, "user", "u" * 30), (90, 2, "assistant", "a" * 300), (90, 3, "user", "u" * 9), (90, 4, "assistant", "a" * 500)]
    rows += [(91, i, "user" if i % 2 else "assistant", "long") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((100, 30), (64, 0), (128, 100)):
        got = {}
        for w in chat.format_windows(df, budget, history).orderBy("conv_id", "window").collect():
            got.setdefault(w.conv_id, []).append(w)
        for c in got:
            turns = [(r[2], r[3]) for r in rows if r[0] == c]
            want = windows_by_hand(turns, budget, history)
            assert len(got[c]) == len(want)
            for w, (at, end, past, keep, tokens) in zip(got[c], want, strict=True):
                told = lambda kind, some: "".join(f"[{kind}:{r}]{t}</s>" for r, t in some)
                assert w.formatted == "<s>" + told("KEPT", turns[:1] if keep else []) + told("PAST", turns[past:at]) + told("TURN", turns[at:end])
                assert w.n_tokens == tokens >= len(w.formatted) / 4
                assert tokens <= budget or end - at == 1 and past == at and not keep
                assert [w.formatted[s.start : s.end] for s in w.loss_spans] == [t for r, t in turns[at:end] if r == "assistant"]


# 10


def test_html_lines():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div>
    <article><h1>Head &amp; more</h1><p><b>One<br> two
    three<br><p>Fo<i>ur</i>&nbsp;5 &lt;b&gt;</p><!-- <p>no</p> --><aside>side</aside><div class="comments"><p>said<div>x</div></div><form>f</form><p>last</article><footer>foot</footer>"""
    assert [t for t, kind in htmltext.lines(page) if kind == "main"] == ["Head & more", "One two three", "Four 5 <b>", "last"]
    assert htmltext.lines(None) == htmltext.lines("") == []
    assert htmltext.lines("a < b")[0] == ("a < b", "other")


def kept_lines(page):
    return [t for t, kind in htmltext.lines(page) if kind != "chrome"]


def test_html_open_elements():
    assert kept_lines("<article><ul><li class='social'>a<li>b</ul><p>rest") == ["b", "rest"]
    assert kept_lines("<article><div class=ad><p>x<p>y</div>z<table><tr><td class=ad>n<td>c<tr><td>d</table>e") == ["z", "n", "c", "d", "e"]
    assert kept_lines("<article><p>a<img alt=Bob's src=x>b</p><p title='x > y'>c</p><a href=/x?a='b>e</a>") == ["ab", "c", "e"]
    own = "<article><h2 id='related-work'>Related</h2><p id='share-prices'>Shares</p><section class='article-header'><h1>T</h1></section><header><h1>U</h1></header><p data-class='ad'>v"
    assert kept_lines(own) == ["Related", "Shares", "T", "U", "v"]
    assert kept_lines("<header>top</header><article>x</article></article><nav>n") == ["x"]


def test_html_layout_is_not_chrome():
    story = "<article><p>story</p><div class='post-comments'><article>said</article></div></article>"
    for mark in ("layout has-sidebar", "no-sidebar", "with-header", "share-enabled", "sidebar", "ad-slot", "siteHeader"):
        page = f"<body><div class='{mark}'><nav>menu</nav><div class='ad'>buy</div>{story}<p>more</p></div><p>end</p>"
        assert kept_lines(page) == ["story", "more", "end"], mark
    assert kept_lines(f"<form id=all>{story}</form><aside><article>side</article></aside>") == ["story"]
    for mark in ("sidebar", "x site-header", "ad-slot", "siteHeader", "related posts", "sidebar-left", "ad-2"):
        assert htmltext.lines(f"<div class='{mark}'>x</div>") == [("x", "chrome")], mark
    for mark in ("has-sidebar", "no-sidebar", "with-header", "share-enabled", "header-image-caption", "adverb"):
        assert htmltext.lines(f"<div class='{mark}'>x</div>") == [("x", "other")], mark


def test_html_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([(str(x), "other") for x in rng.integers(0, 6, rng.integers(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = [a[i] for i in sorted(htmltext.shared(a, b))]
        assert len(found) == best[-1, -1]
        rest = iter(b)
        assert all(x in rest for x in found)


def html_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("HOST", F.lit(1)).withColumn("text", F.lit(1))
    return htmltext.extract(df, **options).collect()


def test_html_differencing(spark):
    pages = [(i, f"http://h.org/a/{i}", f"<div>same top</div><p>own text {i}</p><div>same end</div>") for i in range(4)]
    pages += [(9, None, None), (10, "http://x.org/", "<p>alone</p>"), (11, "http://h.org/b", "<article><p>own</p></article><p>same top</p>"), (9, None, None), (12, "", "")]
    got = {(r.page_id, r.text) for r in html_rows(spark, pages)}
    assert got == {(9, ""), (10, "alone"), (12, ""), *((i, f"own text {i}") for i in range(4)), (11, "own")}
    assert len(html_rows(spark, pages)) == len(pages) and html_rows(spark, pages[:0]) == []


def test_html_neighbours_are_of_one_layout(spark):
    """Two layouts take turns on the paths of a host; no element or name tells their lines from the story."""
    page = "<p>top {1}</p><p>menu {1}</p><p>story {0}</p><p>end {1}</p>"
    rows = [(i, f"http://h.org/{i:02}", page.format(i, i % 2)) for i in range(12)]
    got = html_rows(spark, rows, marks=frozenset())
    assert {r.page_id: (r.text, r.n_shared, r.n_named) for r in got} == {i: (f"story {i}", 3, 0) for i in range(12)}


@pytest.mark.parametrize("n", [1, 3, 7, 40])
def test_html_neighbours_in_other_ranges(spark, n):
    page = "<div>same top</div><p>own text {}</p><div>same end</div>"
    rows = [(i if i % 5 else None, f"http://h{i // 4}.org/a/{i:03}", page.format(i)) for i in range(24)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = {r.url: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {url: f"own text {i}" for i, (_, url, _) in enumerate(rows)}


def test_html_differencing_beside_articles(spark):
    page = "<div>same top</div><article><p>teaser {0}</p><p>the same line</p></article><div>story {0}</div><div>same end</div>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in range(2)] + [(5, "http://x.org/", page.format(5))]
    got = {r.page_id: r.text.split("\n\n") for r in html_rows(spark, rows)}
    assert all("story" in " ".join(t) and "the same line" in t for t in got.values())
    assert htmltext.main_text(htmltext.lines(page.format(0)), htmltext.lines(page.format(1))) == ("teaser 0\n\nthe same line\n\nstory 0", 2, 0)


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_html_on_pages(spark):
    page = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, SF).collect():
        assert r.text == article(page[r.page_id]) and r.n_chars == len(r.text)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    df = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in df.collect()}
    kept = {i for i, (_, c) in classes([(i, r.text) for i, r in before.items()], 5, 80).items() if i == c}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i in kept if not any(windows_in(before[i].text, b) for b in bench)}
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= want
    step = df
    for name, f in cp.STAGES[:4]:
        step = f(spark, step, SF)
        assert step.columns == cp.COLUMNS, name
    left = {r.doc_id: r.text for r in step.collect()}
    assert set(left) == want
    for i, t in left.items():
        assert t == before[i].text or "[SECRET]" in t


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abcd")
    near = a.rsplit(" ", 1)[0]
    rows = [(7, a), (2, near), (1, b), (2, c), (7, d), (4, d + " " + d), (9, c), (4, d + " " + d), (None, a), (None, a), (3, "short"), (3, "other"), (None, "alone"), (None, "alone"), (5, None), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in cp.drop_near_duplicates(spark, df, SF).collect()), key=str)
    want = [(0, "alone"), (1, b), (2, near), (2, c), (3, "other"), (3, "short"), (4, d + " " + d), (5, None), (5, ""), (0, None)]
    sets = classes([(0, d), (1, d + " " + d)], 5, 80)
    assert got == sorted(want + ([(7, d)] if sets[1][1] == 1 else []), key=str)


def test_pipeline_edges(spark):
    import corpus_pipeline as cp

    known = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    real = {r.lang: r.text for r in known.where("n_chars BETWEEN 800 AND 3000").collect() if not any(windows_in(r.text, x) for x in items)}
    bench = items[0]
    rows = [(i, t, lang, None if i % 2 else "s", None) for i, (lang, t) in enumerate(sorted(real.items()))]
    rows += [(50, "", "en", "s", 0), (51, None, "en", "s", 0), (None, "Qzxqj vvkwx " * 30, None, None, None), (52, bench, None, "s", 3), (53, "token=abcdefgh1 " + real["de"], "de", "s", 3), (54, real["en"], "en", "s", 3), (54, real["en"], "en", "s", 3), (55, "1234 5678", None, "s", 1)]
    df = docs(spark, rows)
    kept = cp.identify_language(spark, df.select(*cp.COLUMNS).unionByName(known), SF).where("doc_id IS NULL OR doc_id < 1000").collect()
    assert sorted(r.doc_id or -1 for r in kept if r.doc_id != 0) == [1, 2, 3, 52, 53, 54, 54]
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in cp.identify_language(spark, unlabelled, SF).collect()} == {None, 0, 1, 2, 3, 52, 53, 54}
    assert {r.doc_id for r in cp.drop_contaminated(spark, df, SF).collect()} == {r[0] for r in rows} - {52}
    red = {r.doc_id: r for r in cp.redact_secrets(spark, df, SF).collect()}
    assert red[53].text == "[SECRET] " + real["de"] and red[53].n_chars == len(red[53].text) and red[51].text is None and red[54].n_chars == 3
    read = [(r.doc_id, r.source) for r in cp.mix_sources(spark, df, SF).collect()]
    assert {i for i, s in read if s == ""} == {1, 3, None} and {i for i, s in read if s == "s"} <= {0, 2, 50, 51, 52, 53, 54, 55}
    none = df.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
