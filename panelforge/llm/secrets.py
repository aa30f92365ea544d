"""Secret scans: fixed formats, and tokens that a random-string Markov model explains better. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant, cut, drawn_texts

# The base formats, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

TOKEN = "[A-Za-z0-9+/_=-]"  # what candidates and ordinary samples are made of
SYMBOLS = 67
REPEATED = r"(.)\1{2,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SPAN = "struct<start: int, kind: int, stop: int>"
TOP = 400  # scores are counted in whole steps up to here


def _running(values: Column, join: Callable[[Column, Column], Column], empty: Column) -> Column:
    """Running ``join`` (a sum, a maximum) of an array, by doubling: n log n steps for any length."""
    n = F.size(values)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))

    def double(sums: Column, k: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), k).cast("int"), n)
        moved = F.concat(F.array_repeat(empty, shift), F.slice(sums, F.lit(1), n - shift))
        return F.zip_with(sums, moved, join)

    return F.aggregate(rounds, values, double)


def _placed(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Array of ``(start, kind, stop)`` in code points for ``found``, the leftmost non-overlapping matches of ``pattern``.

    What stands between matches (``split``) and the matches themselves give all positions by running sums.
    """
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
    stops = _running(lengths, lambda a, b: a + b, F.lit(0))
    return F.zip_with(stops, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("stop")))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _spans(text: Column, pattern: str, kind: int, keep: int | None = None) -> Column:
    """:func:`_placed` matches; with ``keep``, those whose first group has fewer code points are dropped after matching."""
    spans = _placed(text, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pattern, kind)
    if keep is not None:
        long = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.length(v) >= keep)
        spans = _where(spans, long)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(_none())


def _where(spans: Column, marks: Column) -> Column:
    """The spans whose mark is true."""
    return F.filter(F.zip_with(spans, marks, lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())


def _pairs(token: Column) -> Column:
    """Indexes into a 128 x 128 table of neighbouring characters; 0 stands before the first. Three or more of one character count as one, so rulers say nothing."""
    codes = F.transform(F.split(F.regexp_replace(token, REPEATED, "$1"), ""), lambda c: F.ascii(c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * 128 + b + 1)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, random over ordinary, of neighbouring characters; the least accepted sum; the shortest token that is scored.

    ``held`` has the recall (of all random tokens, and by length) and the precision on held-out labelled tokens.
    """

    ratios: list[float]
    odds: float
    least: int
    held: dict[str, float] = field(default_factory=dict)

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a token."""
        ratios = constant(self.ratios, "array<double>")
        return F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at(ratios, p), F.lit(0.0)))


def _names(words: Column) -> Column:
    """Identifiers of three neighbouring words each: snake, kebab, path, camel case, and capitals with a number."""
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(1), F.size(words) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))

    def name(at: Column) -> Column:
        some = F.transform(F.slice(words, at, F.lit(3)), lambda w: F.lower(w))
        camel = F.concat(some[0], F.initcap(some[1]), F.initcap(some[2]))
        number = F.pmod(F.xxhash64(some, at), F.lit(1000)).cast("string")
        return F.array(F.array_join(some, "_"), F.array_join(some, "-"), F.concat(F.lit("/"), F.array_join(some, "/")), camel, F.concat(F.initcap(camel), number), F.upper(F.array_join(some, "_")))[F.pmod(F.floor(at / 3), F.lit(6)).cast("int")]

    return F.transform(starts, name)


def samples(docs: DataFrame, text_col: str, sample_docs: int, least: int) -> DataFrame:
    """Labelled tokens ``(random, held, token, n)`` of about ``sample_docs`` distinct texts; a quarter of all tokens is held out.

    Random: values that the base formats find, and the texts' digests written in several alphabets and cut to many lengths, random by
    construction. Ordinary: everything else that is written in the candidates' characters, and identifiers made of the texts' own words in
    the usual styles.
    """
    drawn = drawn_texts(docs, text_col, sample_docs, "train").withColumnRenamed(text_col, "text")
    values = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0))))
    digest = F.concat(F.unhex(F.sha2("text", 512)), F.unhex(F.sha2(F.concat("text", F.lit("2")), 512)))
    b64 = F.regexp_replace(F.base64(digest), "=+$", "")
    made = [
        b64, F.hex(digest), F.lower(F.hex(digest)), F.translate(b64, LOWER + "+/", UPPER + DIGITS[:2]), F.translate(b64, UPPER + DIGITS + "+/", LOWER + LOWER[:12]),
        F.translate(b64, LOWER + DIGITS + "+/", UPPER + UPPER[:12]), F.translate(b64, "+/", "-_"), F.translate(b64, "+/", "ab"),
    ]
    lengths = [least + F.pmod(F.xxhash64("text", F.lit(k)), F.lit(57)).cast("int") for k in range(len(made))]
    made = F.array(*(F.substring(m, F.lit(1), n) for m, n in zip(made, lengths)))
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    drawn = drawn.withColumns({"made": made, "values": values, "plain": plain}).withColumn("words", F.regexp_extract_all("plain", F.lit("[A-Za-z]{2,}"), F.lit(0)))
    labelled = drawn.select(F.explode(F.array(
        F.struct(F.lit(True).alias("random"), F.filter(F.concat("values", "made"), lambda v: F.length(v) >= least).alias("tokens")),
        F.struct(F.lit(False).alias("random"), F.concat(F.regexp_extract_all("plain", F.lit(TOKEN + "{4,}"), F.lit(0)), _names(F.col("words"))).alias("tokens")),
    )).alias("x"))
    tokens = labelled.select("x.random", F.explode("x.tokens").alias("token")).groupBy("random", "token").agg(F.count("*").alias("n"))
    return tokens.select("random", (F.pmod(F.xxhash64("token", F.lit("hold")), F.lit(4)) == 0).alias("held"), "token", "n")


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = 2_000, strength: float = 20.0, least: int = 8, rarity: float = 1e5, most_false: float = 1e-5) -> Model:
    """Fit both character models on labelled tokens of about ``sample_docs`` distinct texts (the documented bound of the fit), and calibrate.

    Both are first-order models, smoothed towards uniform with ``strength`` pseudo-counts a row. The accepted log-likelihood ratio is at
    least the logarithm of ``rarity`` (how many ordinary tokens there are to a secret), and so high that at most a share ``most_false`` of the
    held-out ordinary tokens, by occurrences, exceeds it. Copies of a text count once; null and empty texts teach nothing; an empty table
    gives a model of equal chances, which accepts nothing.
    """
    tokens = cut(samples(docs, text_col, sample_docs, least))
    counted = tokens.where("not held").select("random", "n", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts = counted.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 * 128 * 128 rows
    table = {True: [0.0] * 16_384, False: [0.0] * 16_384}
    for x in counts:
        if 1 <= x["pair"] <= 16_384:
            table[x["random"]][x["pair"] - 1] = float(x["n"])
    ratios = []
    for before in range(128):
        row = {k: v[before * 128 : before * 128 + 128] for k, v in table.items()}
        total = {k: sum(v) + strength for k, v in row.items()}
        ratios += [log((a + strength / SYMBOLS) / total[True]) - log((b + strength / SYMBOLS) / total[False]) for a, b in zip(row[True], row[False])]
    model = Model([round(x, 4) for x in ratios], log(rarity), least)

    length = F.least(F.floor(F.length("token") / 8) * 8, F.lit(64)).cast("int")
    step = F.greatest(F.lit(0), F.least(F.lit(TOP), F.ceil(model.score(F.col("token"))))).cast("int")
    scored = tokens.where("held").select("random", length.alias("length"), step.alias("step"), F.when(F.col("random"), 1).otherwise(F.col("n")).alias("n"))
    rows = scored.groupBy("random", "length", "step").agg(F.sum("n").alias("n")).collect()  # at most 2 * 9 * TOP rows
    ordinary = sum(x["n"] for x in rows if not x["random"])
    odds = model.odds
    while sum(x["n"] for x in rows if not x["random"] and x["length"] >= least and x["step"] > odds) > most_false * ordinary:
        odds += 1.0
    hits = {k: sum(x["n"] for x in rows if x["random"] is k and x["length"] >= least and x["step"] > odds) for k in (True, False)}
    held = {"random tokens": float(sum(x["n"] for x in rows if x["random"])), "ordinary tokens": float(ordinary)}
    if hits[True]:
        held |= {"precision": hits[True] / sum(hits.values()), "recall": hits[True] / held["random tokens"]}
    for n in sorted({x["length"] for x in rows if x["random"]}):
        own = [x for x in rows if x["random"] and x["length"] == n]
        held[f"recall, {n} or more characters" if n == 64 else f"recall, {n} to {n + 7} characters"] = sum(x["n"] for x in own if x["step"] > odds) / sum(x["n"] for x in own)
    return Model(model.ratios, odds, least, held)


def _apart(both: Column) -> Column:
    """Which of the spans, in order, are base ones or meet none: neighbours are compared by running maxima and minima, so cost is n log n."""
    last = F.lit(2**31 - 1)
    reach = _running(F.transform(both, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
    begins = F.reverse(F.transform(both, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(last)))
    begins = F.reverse(_running(begins, lambda a, b: F.least(a, b), last))
    near = F.zip_with(reach, begins, lambda a, b: F.struct(a.alias("reach"), b.alias("begin")))
    return F.zip_with(both, near, lambda s, n: (s["kind"] < 3) | ((n["reach"] <= s["start"]) & (n["begin"] >= s["stop"])))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_assign, n_access, n_hex, base, spans)``; spans are ``(start, kind, stop)`` by start, then kind.

    ``base`` are the fixed formats. ``spans`` adds, as kind ``random``, the tokens of ``model.least`` or more characters (letters, digits and
    ``+/_=-``) outside base spans whose log-likelihood ratio exceeds ``model.odds``; the model alone decides. Null and empty texts have no spans;
    any id, null too, is passed through and repeated rows stay repeated with equal spans; extra columns are ignored whatever their names; an empty table
    gives an empty result. Spans that begin together stand by kind. One narrow pass over whole texts, no shuffle.
    """
    pattern = f"{TOKEN}{{{model.least},}}"
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [_spans(text, p, i, k) for i, (p, k) in enumerate(((ASSIGN, 8), (ACCESS, None), (HEX, None)))]
    rows = rows.withColumns({f"k{i}": k for i, k in enumerate(kinds)})
    rows = rows.withColumns({"base": F.array_sort(F.concat("k0", "k1", "k2")), "tokens": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))})
    rows = rows.withColumn("marks", F.transform("tokens", lambda t: model.score(t) > model.odds))
    some = F.exists("marks", lambda m: m)
    rows = rows.withColumn("added", F.when(some, _where(_placed(text, F.col("tokens"), pattern, 3), F.col("marks"))).otherwise(_none()))
    counts = (F.size(f"k{i}").cast("long").alias(f"n_{KINDS[i]}") for i in range(3))
    rows = rows.select("doc_id", *counts, "base", F.when(some, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base")).alias("both"), some.alias("some"))
    spans = F.when(F.col("some"), _where(F.col("both"), _apart(F.col("both")))).otherwise(F.col("both"))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:3]), "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")
