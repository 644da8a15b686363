"""Repeated byte strings, infilling and vector codes against plain versions, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from acopio.llm import infill, repeats, vector_codes
from acopio.llm.words import chunks

WORDS = "stone river lamp grün 東京 carpet window Übung seven paper cloud quiet".split()
SCHEMA = "doc_id long, text string, k long, row string, spans int, col1 string, r1 string, packed string, salt int, form int, draw string"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "row", 2, "c", "r", "p", 3, 4, "d") for i, t in rows], SCHEMA)


def plain_spans(texts, size):
    """Removed runs of each text, by counting every string of size bytes."""
    seen, data = {}, [t.encode() for t in texts]
    for b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


@pytest.fixture(scope="module")
def repeated_texts():
    rnd = random.Random(5)
    passages = [prose(rnd, n) for n in (30, 45, 80)]
    texts = [prose(rnd, rnd.randrange(1, 150)) for _ in range(40)]
    for k in range(60):
        words = rnd.choice(passages).split()
        cut = words[rnd.randrange(6) :]
        if k % 3 == 0:
            cut[len(cut) // 2] = "changed"
        texts.append(f"{prose(rnd, rnd.randrange(12))} {' '.join(cut)} {prose(rnd, rnd.randrange(12))}")
    texts += [texts[3], texts[3], texts[4] + "x", "y" + texts[4], "a" * 199, "a" * 200, "b" * 201, "c" * 200, "c" * 200, "ab" * 900, "abc" * 70, "", "short"]
    texts += ["x" + passages[2][: 200 - k] + str(k) for k in range(4)]
    return texts


@pytest.mark.parametrize("size", [200, 150])
@pytest.mark.parametrize("group", [1 << 15, 5])
def test_repeats(spark, repeated_texts, size, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HEAVY", 20 if group == 5 else 1024)
    out = repeats.repeats(frame(spark, list(enumerate(repeated_texts))), size=size).collect()
    got = {r["doc_id"]: r for r in out}
    want = plain_spans(repeated_texts, size)
    assert len(out) == len(repeated_texts)
    for k, (text, spans) in enumerate(zip(repeated_texts, want, strict=True)):
        r, raw = got[k], text.encode()
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, k
        assert r["n_spans"] == len(spans) and r["n_removed"] == sum(b - a for a, b in spans) and r["n_bytes"] == len(raw)
        assert bytes(r["kept"]) == b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))


def test_every_window_has_one_anchor(repeated_texts):
    import pyarrow as pa

    for c in chunks(pa.array(repeated_texts)):
        found = repeats.Anchors(c, 200)
        starts = repeats.ranges(found.at - found.high, found.at - found.low)
        want = np.concatenate([np.arange(a, b - 199) for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True)])
        assert sorted(starts.tolist()) == want.tolist()
        assert (found.at - found.high >= c.bounds[found.of]).all() and (found.at - found.low + 200 <= c.bounds[found.of + 1]).all()


def test_repeats_edges(spark):
    long_ = prose(random.Random(1), 30_000)
    rows = [(1, None), (None, None), (2, ""), (3, "q" * 300), (3, "q" * 300), (None, "z" * 250 + "end"), (4, long_), (5, long_[1000:2000])]
    out = repeats.repeats(frame(spark, rows))
    assert set(out.columns) == set(SCHEMA.replace(",", "").split()[::2]) - {"text"} | {"kept", "n_bytes", "n_removed", "n_spans"}
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["k"], r["col1"]) for r in out.collect())
    assert len(got) == len(rows) and all(g[4:] == (1, "c") for g in got)
    assert got[0][:4] == (0, 0, 0, 0) and got[1][:4] == (0, 253, 250, 1)
    assert [g[:4] for g in got if g[0] == 3] == [(3, 300, 300, 1)] * 2
    n = len(long_[1000:2000].encode())
    assert [g[2:4] for g in got if g[0] in (4, 5)] == [(n, 1), (n, 1)]
    assert repeats.repeats(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        repeats.repeats(frame(spark, rows), size=40)


def plain_infill(id_, text):
    h = hashlib.sha256(f"1:{id_}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill(spark):
    rnd = random.Random(2)
    texts = [None, "", "a", " ", "<P>", "x <S> y", "end <M", "<", "<<", "<S" * 3, "\n\n", "日本 ab́c 🙂🙂", "\r\n\t", "one" * 4000, prose(rnd, 20_000)]
    rows = [*enumerate(texts), *((100 + k, prose(rnd, rnd.randrange(30)) + rnd.choice(["<", "<S", "<M", "", ">", "🙂"])) for k in range(300)), (-5, "minus five"), (7, "<"), (7, "<")]
    out = infill.infill(frame(spark, rows)).withColumn("back", infill.restored(F.col("text"), F.col("form"))).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "text"))) for r in out) == sorted((i, *map(str, plain_infill(i, t or ""))) for i, t in rows)
    held = {}
    for i, t in rows:
        held.setdefault(i, set()).add(t or "")
    assert all(r["back"] in held[r["doc_id"]] and r["salt"] == 3 for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert infill.infill(frame(spark, [(None, "no id at all")])).collect()[0]["n"] == 7
    assert infill.infill(frame(spark, rows).where("false")).count() == 0
    own = infill.infill(frame(spark, rows), sentinels=("⟦p⟧", "⟦s⟧", "⟦m⟧"), plain_percent=0, spm_percent=100)
    assert own.where("form = 'psm'").count() == 0 and own.where("doc_id = 4 and form = 'spm' and n = 3").count() == 1
    for bad in (("<a", "<b", ""), ("a", "a", "b"), ("<x<", "y", "z")):
        with pytest.raises(ValueError):
            infill.infill(frame(spark, rows), sentinels=bad)


def plain_codes(rows, entries=64):
    """Codes, errors and codebooks of (id, label, vector), one vector at a time."""
    v = np.array([[int(np.floor(np.float64(x) * 256)) for x in vec] for _, _, vec in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(v[k])))
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    w = v.shape[1] // 16
    for p in range(16):
        part = [tuple(x[p * w : p * w + w]) for x in v]
        book = [part[k] for k in order[:entries]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), c) for c, e in enumerate(book))  # noqa: B023, E731
        for _ in range(2):
            took = [near(x)[1] for x in part]
            book = [tuple(sum(x[i] for x, t in zip(part, took, strict=True) if t == c) // took.count(c) for i in range(w)) if c in took else e for c, e in enumerate(book)]
        for k, x in enumerate(part):
            far, c = near(x)
            codes[k].append(c)
            errors[k] += far
        books.append(book)
    return codes, errors, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [300, 40])
@pytest.mark.parametrize("heavy", [1024, 3])
def test_vector_codes(spark, n, heavy, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY", heavy)
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 7 == 0 else int(i % 5), (rng.integers(-6, 6, 32) / 16 + 0.01).astype(np.float32).tolist()) for i in rng.permutation(n)]
    hot = rows[5][2]
    rows += [(n + k, 1, hot) for k in range(n // 2)] + [(3, 2, hot), (3, 2, hot), (None, None, rows[0][2])]
    bad = [(-1, 1, None), (-2, 1, [0.5] * 31 + [None]), (-3, 1, [float("nan")] * 32), (-4, 1, [float("inf")] * 32), (-5, 1, []), (9999, 1, [0.25] * 16), (-6, 1, [0.5] * 31)]
    table = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("r")).withColumn("error", F.lit("e"))
    out, books = vector_codes.compress(table.repartition(5))
    codes, errors, digest = plain_codes(rows)
    sums = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    want = sorted((str(i), str(label), c, e, sums[label]) for (i, label, _), c, e in zip(rows, codes, errors, strict=True))
    assert sorted((str(r["vec_id"]), str(r["label"]), list(r["codes"]), r["error"], r["label_error"]) for r in out.collect()) == want
    assert vector_codes.digest(books) == digest


def test_vector_codes_edges(spark):
    schema = "vec_id long, label int, embedding array<double>"
    empty, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert empty.count() == 0 and books == [] and len(vector_codes.digest(books)) == 64
    assert vector_codes.compress(spark.createDataFrame([(1, 1, None)], schema))[0].count() == 0
    huge, _ = vector_codes.compress(spark.createDataFrame([(1, 1, [1e300] * 16), (2, None, [-1e300] * 16), (3, None, [0.0] * 16)], schema))
    assert sorted((r["vec_id"], r["error"]) for r in huge.collect()) == [(1, 0), (2, 0), (3, 0)]
