"""Hard negatives, whitening and decontamination against their SQL twins, brute force, and messy tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontamination as dc, hard_negatives as hn, queries, whitening as wh
from panelforge.llm.vectors import product

from .conftest import SF, messy_rows

VECTORS = "vec_id long, embedding array<float>, label int, score long, block long, x string, id string, at int"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ran = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    want = Counter(tuple(sorted(zip(names, r))) for r in ran.fetchall())
    assert want and Counter(tuple(sorted(r.items())) for r in rows(queries.queries()[name](spark, SF))) == want


# 11 ------------------------------------------------------------------------------------------------------------------


def test_curve_visits_all_cells_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hn.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(1 << (dims * bits)))
        along = cells[np.argsort(place)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[3 << 40, -5], [1, 1]]), np.array([[3 << 15, 7], [1 << 50, -9]])
    assert product(a, b).tolist() == [[(3 << 40) * (3 << 15) - 35, (3 << 90) + 45], [(3 << 15) + 7, (1 << 50) - 9]]


def clustered(n=3000, dims=6, seed=5):
    """Clouds that bounds can tell apart, with one vector that a third of all rows share, nulls, and clashing columns."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims)) * 2
    x = np.round((centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.1) * 64) / 64
    x[: n // 3] = x[0]
    labels = rng.integers(0, 4, n)
    out = [(i, [float(v) for v in x[i]], int(labels[i]), 0, 0, "", "", 0) for i in range(n)]
    out[5] = (5, None, 1, 0, 0, "", "", 0)
    out[6] = (6, [float("nan")] * dims, 1, 0, 0, "", "", 0)
    out[7] = (7, [None, *out[7][1][1:]], 1, 0, 0, "", "", 0)
    out[8] = (*out[8][:2], None, *out[8][3:])
    out[9] = (9, [1.0], 2, 0, 0, "", "", 0)
    return out + [out[50], out[50], (None, *out[60][1:]), (None, None, None, 0, 0, "", "", 0)]


def brute_negatives(given, every, rule):
    own = [(i, l, [math.floor(256 * c) for c in v]) for i, v, l, *_ in given if l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    most = Counter(len(v) for _, _, v in own).most_common(1)[0][0]
    own = [r for r in own if len(r[2]) == most]
    x = np.array([r[2] for r in own])
    last = 1 << 62
    out = []
    for k, (i, label, v) in enumerate(own):
        if i is None or i % every:
            continue
        scored = sorted((-int(s), j if j is not None else last, n) for n, (s, (j, *_)) in enumerate(zip(x @ np.array(v), own)) if n != k)
        best = [(j, -s) for s, j, n in scored if own[n][1] == label][: rule.positives]
        for p, score in best:
            fit = [(j, -s) for s, j, n in scored if own[n][1] != label and rule.low * score <= 100 * -s <= rule.high * score][: rule.negatives]
            out += [(i, p if p < last else None, r + 1, j if j < last else None, score, s) for r, (j, s) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("every", [50, 7])
def test_negatives_of_clouds(spark, monkeypatch, every):
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "GROUP", 16)
    monkeypatch.setattr(hn, "PAGE", 10)
    given = clustered()
    df = spark.createDataFrame(given, VECTORS).repartition(5)
    got = hn.mine(df, F.col("id") % every == 0)
    assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows(got)) == brute_negatives(given, every, hn.Rule())


def test_bounds_leave_blocks_unread(spark):
    """In clouds that lie apart, most blocks cannot hold what an anchor looks for."""
    own = hn.whole_vectors(spark.createDataFrame(clustered(4000), VECTORS), "vec_id", "label", "embedding", 256)
    placed = hn.with_place(own, 6)
    table = hn.blocks(placed, 6, 64).cache()
    groups = hn.blocks(placed.where("id % 50 = 0"), 6, 16).select(F.col("block").alias("group"), "ids", "labels", "x").cache()
    read = []

    def choose(groups, zones, *a, real=hn.choose):
        out = real(groups, zones, *a)
        read.append(out.select(F.size("at").alias("n")).agg(F.sum("n")).first()[0])
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(hn, "choose", choose)
        found = hn.positives(groups, table, 6, hn.Rule())
        hn.negatives(groups, found, table, 6, hn.Rule()).collect()
    everything = table.count() * groups.select(F.explode("ids")).count()
    assert 0 < read[1] < 0.4 * everything and 0 < read[2] < 0.6 * everything


def test_zone_maps_cover_their_blocks(spark):
    own = hn.whole_vectors(spark.createDataFrame(clustered(500), VECTORS), "vec_id", "label", "embedding", 256)
    held = rows(hn.blocks(hn.with_place(own, 6), 6, 32))
    assert sum(b["n"] for b in held) == own.count() and len({b["block"] for b in held}) == len(held)
    for b in held:
        x = np.array(b["x"]).reshape(b["n"], 6)
        assert x.min(axis=0).tolist() == b["low"] and x.max(axis=0).tolist() == b["high"] and b["ids"] == sorted(b["ids"])
        assert dict(zip(b["kinds"], b["kind_rows"])) == Counter(b["labels"]) and b["n"] <= 32


def test_negatives_of_nothing(spark):
    assert rows(hn.mine(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0)) == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, 0, 0, "", "", 0)], VECTORS)
    assert rows(hn.mine(alone, F.col("id") % 50 == 0)) == []
    short = spark.createDataFrame([(i, [], i % 2, 0, 0, "", "", 0) for i in range(60)], VECTORS)
    assert {(r["positive_score"], r["negative_score"]) for r in rows(hn.mine(short, F.col("id") % 50 == 0))} == {(0, 0)}


# 12 ------------------------------------------------------------------------------------------------------------------


def brute_whitening(vectors, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    away = x * n - s
    z = away.astype(float) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, (away * away).sum(axis=1), z @ axes[:, :components] / np.sqrt(values[:components]), values / values.sum()


@pytest.mark.parametrize("where", [SF, "/root/testdata/sf0.01"])
def test_whitening(spark, where):
    got = rows(queries.queries()["op12_embedding_whitening"](spark, where))
    table = spark.read.parquet(f"{where}/embeddings.parquet").collect()
    n, deviation, white, explained = brute_whitening([r["embedding"] for r in table], 32)
    place = {r["vec_id"]: k for k, r in enumerate(table)}
    assert len(got) == 32 * n and len({(r["vec_id"], r["component"]) for r in got}) == len(got)
    values = np.zeros((n, 32))
    for r in got:
        values[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[place[r["vec_id"]]] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    signs = np.sign((values * white).sum(axis=0))
    assert np.abs(values * signs - white).max() < 1e-6
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-9 and np.abs(values.T @ values / n - np.eye(32)).max() < 1e-9


def test_whitening_of_messy_rows(spark):
    given = clustered()
    good = [(i, v) for i, v, *_ in given if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, white, explained = brute_whitening([v for _, v in good], 6)
    got = rows(wh.whiten(spark.createDataFrame(given, VECTORS).repartition(7), components=32))
    key = lambda i, d: (i is None, i or 0, d)
    assert sorted(key(r["vec_id"], r["deviation"]) for r in got) == sorted(key(i, int(d)) for (i, _), d in zip(good, deviation))
    assert {len(r["whitened"]) for r in got} == {6} and np.allclose(got[0]["explained"], explained, rtol=1e-9) and got[0]["identity_error"] < 1e-9
    by = {i: w for (i, _), w in zip(good, white) if i is not None}
    signs = np.sign(sum(np.array(r["whitened"]) * by[r["vec_id"]] for r in got if r["vec_id"] is not None))
    assert max(np.abs(np.array(r["whitened"]) * signs - by[r["vec_id"]]).max() for r in got if r["vec_id"] is not None) < 1e-6


def test_a_shared_vector_is_dealt_to_many_parts(spark):
    """A vector that a third of all rows hold is whitened once, and no join key has a third of the rows."""
    plan = wh.whiten(spark.createDataFrame(clustered(), VECTORS))
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in joined
    own = wh.whole_vectors(spark.createDataFrame(clustered(), VECTORS))
    assert wh.distinct_vectors(own).count() < own.count() - 900


def test_whitening_by_distinct_vectors(spark):
    given = [(i, v, 0, 0, 0, "", "", 0) for i, v in enumerate([[0.0, 0.0]] * 50 + [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])]
    got = wh.whiten(spark.createDataFrame(given, VECTORS), weighted=False).collect()
    z = np.array([[-1.0, -1.0], [1.0, -1.0], [-1.0, 1.0], [1.0, 1.0]])
    assert len(got) == 53 and got[0]["n"] == 4 and np.allclose(got[0]["explained"], [0.5, 0.5]) and got[0]["identity_error"] < 1e-9
    assert all(math.isclose(sum(v * v for v in r["whitened"]), float((z[0] ** 2).sum())) for r in got)


def test_whitening_without_variance(spark):
    flat = [(i, [1.0, float(i)], 0, 0, 0, "", "", 0) for i in range(4)]
    got = rows(wh.whiten(spark.createDataFrame(flat, VECTORS)))
    assert len(got) == 4 and all(r["whitened"][1] is None and r["whitened"][0] is not None and r["identity_error"] < 1e-9 for r in got)
    same = rows(wh.whiten(spark.createDataFrame(flat[:1] * 3, VECTORS)))
    assert len(same) == 3 and all(r["whitened"] == [None, None] and r["deviation"] == 0 for r in same)
    assert rows(wh.whiten(spark.createDataFrame([], VECTORS))) == []


def test_deviations_beyond_a_long_are_null(spark):
    far = [(0, [1e13], 0, 0, 0, "", "", 0), (1, [0.0], 0, 0, 0, "", "", 0), (2, [1e20], 0, 0, 0, "", "", 0)]
    got = {r["vec_id"]: r for r in rows(wh.whiten(spark.createDataFrame(far, VECTORS)))}
    assert sorted(got) == [0, 1] and all(r["deviation"] is None and math.isclose(abs(r["whitened"][0]), 1.0) for r in got.values())


# 13 ------------------------------------------------------------------------------------------------------------------


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_leaks(docs, items, window=10):
    tests = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(t) for t in tests}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in tests:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in tests[t] if i is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(found)), tuple(sorted(hit))))
    return out


def messy_benchmark():
    long = [f"w{k % 97}" for k in range(6000)]
    items = [(1, "the same words again and again in every copy of this text"), (2, "The SAME words again, and again in every copy!"), (3, "été naïve"), (10, "été NAÏVE"), (4, None), (5, ""), (6, "..."), (None, "word " * 30)]
    return items + [(7, " ".join(long[4000:4300])), (7, "another text under the same id"), (8, "x")]


def messy_docs():
    long = [f"w{k % 97}" for k in range(6000)]
    rng = random.Random(1)
    short = [" ".join(rng.choice(["the", "same", "words", "again", "x", "été", "naïve"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = [t for _, t, *_ in messy_rows()] + [" ".join(long), "-".join(long[:4100]) + " été naïve", *short]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "été naïve x"), (3, "x"), (3, "x")]


def leaks(df):
    got = rows(df)
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(k for a in r["hit"] for k in range(a["start"], a["stop"]))) for r in got)


@pytest.mark.parametrize("bound", [64_000_000, 0])
def test_leaks_of_messy_rows(spark, monkeypatch, bound):
    """With the set broadcast, and joined by shuffles."""
    real = dc.test_windows
    monkeypatch.setattr(dc, "test_windows", lambda *a: real(*a, broadcast_bytes=bound))
    docs = spark.createDataFrame([(*r, 1, 2, "u", 3) for r in messy_docs()], "doc_id long, text string, uid int, w int, s string, hit int").repartition(5)
    tests = spark.createDataFrame([(*r, 1) for r in messy_benchmark()], "item_id long, text string, h int")
    assert leaks(dc.contamination(docs, tests)) == Counter(brute_leaks(messy_docs(), messy_benchmark()))


def test_full_filters_only_let_more_through(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_BITS", 64)
    docs = spark.createDataFrame(messy_docs(), "doc_id long, text string")
    tests = spark.createDataFrame(messy_benchmark(), "item_id long, text string")
    assert leaks(dc.contamination(docs, tests)) == Counter(brute_leaks(messy_docs(), messy_benchmark()))


def test_leaks_of_nothing(spark):
    docs, tests = spark.createDataFrame(messy_docs(), "doc_id long, text string"), spark.createDataFrame(messy_benchmark(), "item_id long, text string")
    assert rows(dc.contamination(docs.limit(0), tests)) == []
    clean = rows(dc.contamination(docs, tests.limit(0)))
    assert len(clean) == len(messy_docs()) and all(r["n_hit"] == 0 and r["items"] == [] for r in clean)


def test_removal(spark):
    docs, tests = spark.createDataFrame([(*r, 9) for r in messy_docs()], "doc_id long, text string, uid int"), spark.createDataFrame(messy_benchmark(), "item_id long, text string")
    want = brute_leaks(messy_docs(), messy_benchmark())
    kept = rows(dc.decontaminate(docs, tests))
    assert Counter((r["doc_id"], r["text"], r["uid"]) for r in kept) == Counter((i, t, 9) for (i, t), w in zip(messy_docs(), want) if not w[2])

    def cut(text, hit):
        """Words and what stands between them, plainly; gaps inside a hit range go with it."""
        parts = re.split(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", text)
        hit = set(hit)
        out = [p for k, p in enumerate(parts) if not (k % 2 and k // 2 in hit) and not (k % 2 == 0 and k // 2 in hit and k // 2 - 1 in hit)]
        return "".join(out)

    spans = rows(dc.decontaminate(docs, tests, remove="spans"))
    assert Counter((r["doc_id"], r["text"], r["uid"]) for r in spans) == Counter((i, t if not w[2] else cut(t, w[4]), 9) for (i, t), w in zip(messy_docs(), want))
    assert all(r["n_hit"] == 0 for r in rows(dc.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tests)))
    with pytest.raises(ValueError):
        dc.decontaminate(docs, tests, remove="words")


def test_leaks_are_found_natively(spark):
    plan = queries.queries()["op13_decontamination"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in rows(queries.queries()["op13_decontamination"](spark, SF))}
