"""Secrets in texts, with DataFrame functions only: known patterns, and runs of characters that pass a battery of randomness tests.

A run of characters is a candidate if it is long and mixes letters and digits. Its alphabet is inferred from its characters. Three tests ask
whether it could be drawn at random from that alphabet: chi-squared uniformity of the symbols, runs above and below the middle
of the alphabet, and serial correlation of neighbours. A rejection says "made of words or counted up, not a key".
Among many candidates some keys would be rejected by chance, so rejections are controlled at a false-discovery rate (Benjamini
and Hochberg), in bands of length, since the power of the tests grows with length. What is not rejected is reported as ``random``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract. Runs of hex digits and of access keys are maximal, so their least length can
# stand in the pattern; the least length of an assigned value cannot.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Alphabets in the order in which they are tried; the first that holds all characters is inferred. Symbols count by their place.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: First length of each band, the rate of keys that may be lost among rejections, and steps of -log10 p that p-values are counted in.
BANDS = (20, 28, 40, 64, 128)
RATE = 0.05
STEP, LAST_BIN = 0.05, 400


SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often a function inside ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost separate matches as structs (start, end, value), in code points; values are those of ``group``.

    Splitting at the matches gives the stretches between them, so the lengths of both add up to the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    matches = F.zip_with(whole, values, lambda w, v: F.struct(F.length(w).alias("length"), v.alias("value")))
    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    nothing = F.array().cast(SPANS)

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        end = start + p["match"]["length"]
        span = F.struct(start.alias("start"), end.alias("end"), p["match"]["value"].alias("value"))
        return F.when(p["match"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans")))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(nothing)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-7 (relative to 1), for z of any sign."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _alphabet(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for symbols in reversed(ALPHABETS.values()):
        out = F.when(F.translate(value, symbols, "") == "", F.lit(symbols)).otherwise(out)
    return out


def p_value(value: Column) -> Column:
    """How well the characters fit draws from the inferred alphabet: the least of three p-values, times three."""
    value = F.regexp_replace(value, "=+$", "")
    return _let(F.struct(value.alias("value"), _alphabet(value).alias("symbols")), lambda c: _battery(c["value"], c["symbols"]))


def _battery(value: Column, symbols: Column) -> Column:
    m = F.length(symbols).cast("double")
    n = F.length(value).cast("double")
    # Chi-squared of n draws over m symbols from the counts of those that occur; normal by its exact mean and variance.
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * m / n - n
    p_chi = _normal_tail((chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n))
    places = F.transform(chars, lambda c: (F.instr(symbols, c) - 1).cast("double") - (m - 1) / 2)
    # Runs: a change of side between neighbours has probability 1/2. Serial correlation: products of neighbours around the
    # middle have mean 0 and the square of the alphabet's variance.
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial"))

    def step(a: Column, x: Column) -> Column:
        first = a["last"].isNull()
        changed = F.when(first | ((a["last"] < 0) == (x < 0)), 0.0).otherwise(1.0)
        return F.struct(x.alias("last"), (a["changes"] + changed).alias("changes"), (a["serial"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("serial"))

    def combined(a: Column) -> Column:
        p_runs = 2 * _normal_tail(F.abs(a["changes"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
        p_serial = 2 * _normal_tail(F.abs(a["serial"]) / (F.sqrt(n - 1) * (m * m - 1) / 12))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return F.aggregate(places, start, step, combined)


def _band(length: Column) -> Column:
    out = F.lit(BANDS[0])
    for b in BANDS[1:]:
        out = F.when(length >= b, F.lit(b)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / STEP).cast("int"))


def candidates(text: Column) -> Column:
    """Runs that mix letters and digits, as structs (start, end, band, bin)."""
    mixed = F.filter(_found(text, CANDIDATE), lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]"))
    return F.transform(
        mixed,
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _band(F.length(c["value"])).alias("band"), _bin(p_value(c["value"])).alias("bin")),
    )


def rejection_bins(texts: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[int, int]:
    """For each band of length the bin from which on candidates are rejected; a band without rejections is not there.

    p-values are counted in bins of ``STEP``, so the table of counts has at most ``len(BANDS) * (LAST_BIN + 1)`` rows
    whatever the corpus; a bin is rejected as a whole, by its largest p-value.
    """
    from pyspark.sql import Window

    c = texts.select(F.explode(candidates(_plain(text_col))).alias("c")).groupBy("c.band", "c.bin").agg(F.count("*").alias("n"))
    extreme_first = Window.partitionBy("band").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = c.select("band", "bin", F.sum("n").over(extreme_first).alias("rank"), F.sum("n").over(Window.partitionBy("band")).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * STEP) <= F.lit(rate) * F.col("rank") / F.col("m"))
    return {r["band"]: r["bin"] for r in passed.groupBy("band").agg(F.min("bin").alias("bin")).collect()}  # one row a band


def _plain(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def secret_spans(text: Column, rejected: dict[int, int]) -> Column:
    """Spans of all kinds as structs (start, rank of the kind, kind, end), sorted by start, then kind."""

    def of(kind: str, found: Column) -> Column:
        rank = KINDS.index(kind)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(
        of("assign", F.filter(_found(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)),
        of("access", _found(text, ACCESS)),
        of("hex", _found(text, HEX)),
    )

    def unrejected(c: Column) -> Column:
        limit = F.lit(LAST_BIN + 1)
        for band, bin_ in rejected.items():
            limit = F.when(c["band"] == band, F.lit(bin_)).otherwise(limit)
        return c["bin"] < limit

    def joined(x: Column) -> Column:
        apart = F.filter(x["more"], lambda c: ~F.exists(x["base"], lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
        return F.array_sort(F.concat(x["base"], of("random", apart)))

    return _let(F.struct(base.alias("base"), F.filter(candidates(text), unrejected).alias("more")), joined)


def scan_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """All rows and columns of ``docs`` with the spans of secrets, in code points, end exclusive, as a column.

    Base kinds always stay; ``random`` ones are candidates that no test rejects and that meet no base span. A null text counts
    as empty and has no spans. Repeated rows are treated alike. An empty table gives an empty one. A column of the name of
    ``spans_col`` is replaced. The texts are read twice: once to count p-values, once for the spans.
    """
    rejected = rejection_bins(docs, text_col)
    return docs.withColumn(spans_col, secret_spans(_plain(text_col), rejected))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of the spans replaced, one mark for spans that meet."""
    merged = F.aggregate(
        spans,
        F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda a, s: F.when(s["start"] <= a["end"], F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(
            F.struct(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))).alias("done"), s["start"].alias("start"), s["end"].alias("end"))
        ),
        lambda a: F.filter(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))), lambda s: s["end"] >= 0),
    )
    pieces = lambda m: F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(m, lambda s: s["end"])),
        F.concat(F.transform(m, lambda s: s["start"]), F.array(F.length(text))),
        lambda low, high: F.substring(text, low + 1, high - low),
    )
    return F.when(F.size(spans) > 0, F.array_join(_let(merged, pieces), mark)).otherwise(text)
