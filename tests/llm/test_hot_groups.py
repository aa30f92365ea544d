"""Rows that repeat everything, samples of vast tables, and words of any length."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from panelforge.llm import cdc, langid, packing
from panelforge.llm.common import drawn, drawn_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_equal_pieces_are_packed_apart(spark, monkeypatch):
    """20,000 rows without an id and of one text: their ranks come from buckets that all have their share."""
    shares = []

    def cut(df, real=packing.cut):
        out = real(df)
        if "before" in out.columns:
            shares.append(Counter(r["bucket"] for r in out.collect()))
            before = sorted(r["before"] for r in out.collect())
            shares.append([b - a for a, b in zip(before, before[1:])])
        return out

    monkeypatch.setattr(packing, "cut", cut)
    one = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = packing.pack(one).collect()
    assert len(shares[0]) >= 60 and max(shares[1]) < 3 * 20_000 / len(shares[0])
    places = Counter((r["sequence_id"], r["offset"]) for r in got)
    assert len(places) == 20_000 and max(r["sequence_id"] for r in got) == -(-20_000 // 341) - 1 and {o % 3 for _, o in places} == {0}


def test_rows_that_repeat_are_dealt_by_number(spark):
    """Of 6,000 rows 3,000 repeat one: they are not one range, and all but the last are followed by their own text."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(200))
    rows = [(i, f"{i} {text[: 300 + i % 400]}") for i in range(3000)] + [(1500, "the hot one " + text)] * 3000 + [(None, "no id " + text)] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    followed, often = cdc.with_following(docs)
    ranges = Counter(r["r"] for r in followed.select("r").collect())
    assert sorted(r["more"] for r in often.collect()) == [899, 2999] and max(ranges.values()) < 600
    got = Counter((r["doc_id"], r["edited_sha256"], r["near_next"]) for r in cdc.edited_likeness(docs).collect())
    want = [x for x in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))]
    # both rows of id 1500 may come first; the brute force takes the order that the hash of the text gives
    import hashlib

    import xxhash

    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63)
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))
    plain = []
    for (i, t), (_, n) in zip(want, want[1:] + want[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, other = (cdc.chunk_sets([x.encode()])[0] for x in (t, n))
        plain.append((i, hashlib.sha256(edited.encode()).hexdigest(), cdc.contained(own, other)))
    assert got == Counter(plain)


def test_small_shares_draw_as_asked(spark):
    """A share far below one in a million draws about that many, so a sample of a vast table stays as small."""
    n = 4_000_000
    hashed = spark.range(n).select(F.xxhash64(F.col("id").cast("string"), F.lit("x")).alias("h"))
    counts = hashed.agg(*(F.count_if(drawn(s, F.col("h"))).alias(str(s)) for s in (1e-9, 1e-7, 1e-4, 0.5))).first()
    assert counts[0] <= 1 and counts[1] <= 5 and abs(counts[2] - 400) < 120 and abs(counts[3] - n / 2) < n / 200


def test_labels_are_bounded(spark):
    rows = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 2000, "en").otherwise(F.col("id").cast("string")).alias("lang"))
    got = Counter(r["lang"] for r in drawn_texts(rows, "text", 50, "s", by="lang", most_values=3).collect())
    assert len(got) == 3 and 20 < got["en"] < 100


def test_long_words_are_summed_exactly(monkeypatch):
    pieces = langid.vocabulary(RANKS)
    rng = np.random.default_rng(4)
    chances = rng.random((pieces.count + 1, 3)) / pieces.count
    chances[0] = 0.0
    monkeypatch.setattr(langid, "STRETCHES", 5)
    for n in (4_200, 6_000):
        word = langid.unit("".join(rng.choice(list("etaoinshré日"), n)))
        plain = np.zeros((len(word) + 1, 3))  # logs, one place after another
        plain[1:] = -np.inf
        table = {p: i for p, i in known(pieces).items()}
        for at in range(len(word)):
            for size in range(1, min(pieces.longest, len(word) - at) + 1):
                if i := table.get(word[at : at + size]):
                    plain[at + size] = np.logaddexp(plain[at + size], plain[at] + np.log(chances[i]))
        got = langid.log_likelihoods([b" a", word], pieces, chances)[1]
        assert np.allclose(got, plain[-1], rtol=1e-10)


def known(pieces):
    """Bytes of every piece -> its id, by walking the trie's keys."""
    out, names = {}, {0: b""}
    for node, key in enumerate(pieces.keys.tolist(), 1):
        names[node] = names[key // 256] + bytes([key % 256])
        if pieces.piece[node]:
            out[names[node]] = int(pieces.piece[node])
    return out


def test_a_word_of_a_megabyte_is_scored_in_seconds():
    import time

    pieces = langid.vocabulary(RANKS)
    chances = np.full((pieces.count + 1, 4), 1.0 / pieces.count)
    began = time.time()
    got = langid.log_likelihoods([b" " + b"acgt" * 250_000], pieces, chances)
    assert np.isfinite(got).all() and time.time() - began < 30
