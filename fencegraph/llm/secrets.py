"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame operations alone.

Besides what the patterns find, every run of 20 or more key characters that holds both a digit and a letter is a candidate.
Its encoding is inferred from its characters, and three tests ask whether it looks like random symbols of that encoding:
chi-squared of the symbol counts against equal shares, the runs of the lower and upper half of the alphabet, and the serial
correlation of neighbouring symbols. Fisher's method makes one p-value of the three. Short words pass such tests more
easily than long ones, so the bar is set for each encoding and length class by false-discovery control over all candidates
of the corpus: random strings have even p-values, so their share above one half is known, and the lowest bar is taken at which
it is not shown that more than ``FALSE_SHARE`` of those above the bar are others. Small classes borrow from the nearest lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.arrays import running_starts
from fencegraph.functions.lineage import cut

# The patterns of the scan. A match that is shorter than required is dropped, with the text it consumed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {  # name: (pattern, alphabet), tried in this order
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    "lower": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "upper": ("^[0-9A-Z]+$", _DIGITS + _LOWER.upper()),
    "base62": ("^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER),
    "base64": ("^[0-9A-Za-z+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
    "mixed": ("^.+$", _LOWER.upper() + _LOWER + _DIGITS + "+/-_="),
}
BARS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.5)
FALSE_SHARE = 0.05
SMALL, SURE = 50, 1.645


def _upper_tail(z: Column) -> Column:
    """1 - normal distribution function, by a rational approximation good to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(name: Column, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def _battery(tokens: Column) -> Column:
    """Tokens (struct<start,stop,body>) with their encoding, length class and p-value."""
    alphabets = {k: a for k, (_, a) in ENCODINGS.items()}
    halves = {k: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for k, a in alphabets.items()}
    keep = lambda s: [s["start"].alias("start"), s["stop"].alias("stop")]

    def inferred(s: Column) -> Column:
        name = F.lit("mixed")
        for k, (pattern, _) in reversed(list(ENCODINGS.items())[:-1]):
            name = F.when(s["body"].rlike(pattern), F.lit(k)).otherwise(name)
        return F.struct(*keep(s), s["body"].alias("body"), name.alias("enc"), F.length(s["body"]).cast("double").alias("n"), F.split(s["body"], "").alias("chars"))

    def measured(s: Column) -> Column:
        two = F.call_function("translate", s["body"], _pick(s["enc"], alphabets), _pick(s["enc"], halves))
        return F.struct(
            *keep(s), s["enc"].alias("enc"), s["n"].alias("n"), _pick(s["enc"], {k: float(len(a)) for k, a in alphabets.items()}).alias("k"),
            F.aggregate(F.array_distinct(s["chars"]), F.lit(0.0), lambda a, c: a + F.pow(s["n"] - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
            two.alias("two"), F.transform(s["chars"], lambda c: F.call_function("instr", _pick(s["enc"], alphabets), c).cast("double")).alias("v"),
        )

    def summed(s: Column) -> Column:
        v, n = s["v"], s["n"]
        add = lambda a, x: a + x
        return F.struct(
            *keep(s), s["enc"].alias("enc"), n.alias("n"), s["k"].alias("k"), (s["k"] / n * s["squares"] - n).alias("chi"),
            F.length(F.replace(s["two"], F.lit("0"), F.lit(""))).cast("double").alias("ones"), F.length(F.regexp_replace(s["two"], "0+|1+", "x")).cast("double").alias("runs"),
            (F.aggregate(v, F.lit(0.0), add) / n).alias("mean"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("xx"),
            F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: a * b), F.lit(0.0), add).alias("xy"),
            (F.element_at(v, 1) + F.element_at(v, -1)).alias("ends"),
        )

    def scored(s: Column) -> Column:
        n, df = s["n"], s["k"] - 1
        spread = F.lit(2.0) / (9 * df)
        chi = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        mu = 2 * s["ones"] * (n - s["ones"]) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        runs = F.when(var > 0, (s["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(9.0))
        power = s["xx"] - n * s["mean"] * s["mean"]
        across = s["xy"] - s["mean"] * (2 * n * s["mean"] - s["ends"]) + (n - 1) * s["mean"] * s["mean"]
        serial = F.when(power > 1e-9, across / F.greatest(power, F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.struct(*keep(s), s["enc"].alias("enc"), F.floor(F.log2(n)).cast("int").alias("len2"), chi.alias("chi"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"))

    def combined(s: Column) -> Column:
        logs = [F.log(F.greatest(p, F.lit(1e-300))) for p in (_upper_tail(s["chi"]), 2 * _upper_tail(s["runs"]), 2 * _upper_tail(s["serial"]))]
        return F.struct(*keep(s), s["enc"].alias("enc"), s["len2"].alias("len2"), (-(logs[0] + logs[1] + logs[2])).alias("half"))

    def final(s: Column) -> Column:
        h = s["half"]
        return F.struct(*keep(s), s["enc"].alias("enc"), s["len2"].alias("len2"), F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)).alias("p"))

    for step in (inferred, measured, summed, scored, combined, final):
        tokens = F.transform(tokens, step)
    return tokens


def _found(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Matches of a pattern as array<struct<start,stop,body>>: positions from the lengths of the matches and of what lies
    between them, in code points; ``body`` is the text of ``group``."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("__b", F.when(F.size("__m") > 0, F.split(text, pattern, -1)).otherwise(none)).withColumn("__g", F.when(F.size("__m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("__m"))
    df = df.withColumn("__p", F.transform(F.slice("__b", 1, F.size("__m")), F.length)).withColumn("__n", F.transform("__m", F.length))
    df = df.withColumn("__s", F.when(F.size("__n") > 0, F.zip_with(running_starts(F.zip_with("__p", "__n", lambda a, b: a + b)), "__p", lambda a, b: a + b)).otherwise(F.array().cast("array<int>")))
    spans = F.transform(F.arrays_zip("__s", "__n", "__g"), lambda z: F.struct(z["__s"].alias("start"), (z["__s"] + z["__n"]).alias("stop"), z["__g"].alias("body")))
    return df.withColumn(out, spans).drop("__m", "__b", "__g", "__p", "__n", "__s")


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def scan(docs: DataFrame, text: str, base: str = "base", added: str = "added") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (start, kind, stop), kind a place in ``KINDS``, ``base`` in order of
    start and kind, ``added`` without spans that touch one of ``base``. The text stays.

    Null texts are read as empty and stay null. Repeated rows are scanned each. Columns of the two new names are replaced, all
    others stay, whatever their names; an empty table stays empty.
    """
    kept = docs.drop(base, added)
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names).withColumn("__t", F.coalesce(F.col(names[kept.columns.index(text)]), F.lit("")))
    plain = _found(plain, "__t", ASSIGN, "__assign", 2)
    plain = _found(plain, "__t", ACCESS, "__access")
    plain = _found(plain, "__t", r"[0-9a-f]{24,}", "__hex")  # runs of hex digits that are long enough: same matches as HEX, filtered
    plain = _found(plain, "__t", CANDIDATE, "__cand")
    assign = F.filter("__assign", lambda s: F.length(s["body"]) >= 6)
    access = F.filter("__access", lambda s: F.length(s["body"]) >= 20)
    plain = plain.withColumn("base", F.array_sort(F.concat(_spans(assign, 0), _spans(access, 1), _spans(F.col("__hex"), 2))))
    trimmed = F.transform("__cand", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.rtrim(s["body"], F.lit("=")).alias("body")))
    live = F.filter(trimmed, lambda s: (F.length(s["body"]) >= 20) & s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    plain = plain.withColumn("__live", live).withColumn("cand", F.when(F.size("__live") > 0, _battery(F.col("__live"))).otherwise(F.array().cast("array<struct<start:int,stop:int,enc:string,len2:int,p:double>>")))
    seen = cut(plain.drop("__t", "__assign", "__access", "__hex", "__cand", "__live"), "scanned")
    bars = thresholds(seen.select(F.explode("cand").alias("c")).select("c.*"))
    found = F.filter("cand", lambda s: s["p"] >= _bar_of(s, bars))
    return seen.select(*names, "base", _spans(found, 3)).toDF(*kept.columns, base, added)


def _bar_of(s: Column, bars: dict[tuple[str, int], float]) -> Column:
    if not bars:
        return F.lit(2.0)
    table = F.create_map(*[x for (enc, len2), t in sorted(bars.items()) for x in (F.lit(f"{enc}:{len2}"), F.lit(t))])
    return F.coalesce(F.element_at(table, F.concat(s["enc"], F.lit(":"), s["len2"].cast("string"))), F.lit(2.0))


def thresholds(candidates: DataFrame) -> dict[tuple[str, int], float]:
    """The bar of each (encoding, length class). Counts cover all candidates; what is collected are as many rows as there are
    classes (9 encodings by 31 lengths at most)."""
    counts = [F.count(F.when(F.col("p") >= t, 1)).alias(f"c{i}") for i, t in enumerate(BARS)]
    rows = candidates.groupBy("enc", "len2").agg(F.count(F.when(F.col("p") > 0.5, 1)).alias("high"), *counts).collect()
    return bars_of({(r["enc"], r["len2"]): (r["high"], *[r[f"c{i}"] for i in range(len(BARS))]) for r in rows})


def bars_of(classes: dict[tuple[str, int], tuple[int, ...]]) -> dict[tuple[str, int], float]:
    """From the counts of each class: p-values above one half, and at each bar or above.

    A random string that reaches bar t has a p-value above one half with probability 1 / (2 - 2 t). A bar is refused only where
    fewer of those that reach it do than chance allows (``SURE`` standard deviations) with ``FALSE_SHARE`` of others among
    them. A class with fewer than ``SMALL`` strings is judged together with the nearest lengths of its encoding; if there are
    none, nothing speaks against its strings and the lowest bar holds.
    """
    out: dict[tuple[str, int], float] = {}
    for enc, length in classes:
        pooled, done = [0] * (len(BARS) + 1), 0
        for distance in range(64):
            for other in {length - distance, length + distance}:
                if (enc, other) in classes:
                    pooled = [a + b for a, b in zip(pooled, classes[enc, other])]
                    done += 1
            if pooled[1] >= SMALL or done == sum(e == enc for e, _ in classes):
                break
        for t, reached in zip(BARS, pooled[1:]):
            q = 0.5 / (1 - t)
            if pooled[0] >= (1 - FALSE_SHARE) * reached * q - SURE * math.sqrt(reached * q * (1 - q)):
                out[enc, length] = t
                break
    return out


def count_of(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. (A second parameter of the lambda, even one with a default, would be the place in the array.)"""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:stop`` in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str, mask: str = "[SECRET]", piece: int = 4096, base: str = "base", added: str = "added") -> DataFrame:
    """``scanned`` with its spans masked in the text; touching spans share a mask. Texts are cut from pieces of bounded
    length, so many spans in a long text cost no more than the text."""
    outer = scanned.columns
    inner = [{text: "text", base: "base", added: "added"}.get(c, f"c{i}") for i, c in enumerate(outer)]
    scanned, text = scanned.toDF(*inner), "text"
    spans = F.array_sort(F.concat("base", "added"))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,stop:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["stop"] >= s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.array_append(a, F.struct(s["start"].alias("start"), s["stop"].alias("stop")))),
    )
    some = F.size("base") + F.size("added") > 0
    cut_up = scanned.withColumn("__spans", F.when(some, merged)).withColumn("__parts", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / piece).cast("int"), F.floor(b / piece).cast("int")
        at = lambda i: F.coalesce(F.get("__parts", i), F.lit(""))
        one = F.substring(at(first), a - first * piece + 1, b - a)
        many = F.concat(F.substring(at(first), a - first * piece + 1, F.lit(piece)), F.array_join(F.slice("__parts", first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), b - last * piece))
        return F.when(first == last, one).otherwise(many)

    n = F.size("__spans")
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: between(F.coalesce(F.get("__spans", i - 1)["stop"], F.lit(0)), F.coalesce(F.get("__spans", i)["start"], F.length(text))))
    return cut_up.withColumn(text, F.when(some, F.array_join(gaps, mask)).otherwise(F.col(text))).select(*inner).toDF(*outer)
