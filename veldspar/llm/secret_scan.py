"""Secret scans with a randomness test battery, with built-in functions only.

Base findings (kinds assign, access, hex) are leftmost non-overlapping matches of fixed patterns. The method adds
spans of kind `random`: runs of 20 or more token characters that do not overlap a base span. For each run an encoding
is inferred (hex, base32, upper-case, lower-case, alphanumeric, base64) and three tests of randomness are made against
its alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and lag-one serial correlation. A
run that is random by all three is then held against ordinary writing: under that null hypothesis characters repeat as
often as in prose and few are digits or capitals. A run's p-value is 1 if a test of the battery rejects it, else that
of this comparison; so it stays one under the null hypothesis. The p-values of all runs of all documents go into
histograms by band of length, and the Benjamini-Hochberg step-up is made for each band alone, since short runs have
less power.

Edge cases: null and empty text has no findings and gives a row with counts of 0; null ids and repeated rows give a row
each; an empty table gives an empty result. Positions are code points, end exclusive. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.llm.store import cut, table
from veldspar.llm.text import let, normal_tail

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: (pattern, alphabet).
ENCODINGS = [
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/"),
]
#: Upper bounds of the bands of length; runs beyond the last share a band.
BANDS = (28, 40, 64)
#: Prose: chance that two, and three, characters are equal; share of digits and capitals.
PROSE_TWO, PROSE_THREE, PROSE_RARE = 0.066, 0.0055, 0.05
_SPANS = "array<struct<s:int,e:int,v:string>>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: start, end, and the value of `group`. The text between matches places them."""

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        parts = F.arrays_zip(gaps.alias("gap"), matches.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["p"] + F.char_length(x["gap"])
            end = start + F.char_length(x["m"])
            return F.struct(end.alias("p"), F.concat(acc["o"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).cast(_SPANS).alias("o"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("p"), F.array().cast(_SPANS).alias("o")), step)["o"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of assign, access and hex. Cheap substring tests keep texts without a finding away from the patterns."""
    small = F.lower(text)
    keyword = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("api_key") | small.contains("apikey")
    assign = F.filter(_if(keyword, found(text, ASSIGN, 2)), lambda x: F.length(x["v"]) >= 6)
    return assign, _if(text.contains("AKIA"), found(text, ACCESS)), _if(text.rlike(HEX), found(text, HEX))


def z_scores(token: Column) -> Column:
    """Struct of n (length), chi, runs, serial (standard scores under randomness) and prose (under ordinary writing)."""
    token = F.translate(token, "-_", "+/")
    encoding = F.coalesce(*[F.when(token.rlike(p), F.lit(a)) for p, a in ENCODINGS], F.lit(ENCODINGS[-1][1]))

    def measure(v: Column) -> Column:
        t, alphabet, xs = v["t"], v["a"], v["x"]
        n, k = F.size(xs).cast("double"), F.length(alphabet).cast("double")
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
        squares = total(F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(t, c, F.lit("")))), lambda c: c * c)
        # Chi-squared is k / n * (n + 2 * pairs) - n with the number of pairs of equal characters, all it depends on. Cells
        # hold less than one character here, so its tail is that of the pairs, a Poisson's by the gamma's cube root.
        pairs, rate = F.greatest((squares - n) / 2, F.lit(1e-9)), n * (n - 1) / (2 * k)
        z_chi = 3 * F.sqrt(pairs) * (1 - 1 / (9 * pairs) - F.pow(rate / pairs, F.lit(1 / 3)))

        above = total(xs, lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0))
        steps = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + total(steps, lambda s: F.when((s["a"] >= k / 2) != (s["b"] >= k / 2), 1.0).otherwise(0.0))
        mu = 2 * above * (n - above) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z_runs = F.when(var > 0, (runs - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(20.0)

        mean = total(xs, lambda x: x) / n
        spread = total(xs, lambda x: (x - mean) * (x - mean))
        z_serial = F.when(spread > 0, total(steps, lambda s: (s["a"] - mean) * (s["b"] - mean)) / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n)).otherwise(20.0)

        expected = n + n * (n - 1) * PROSE_TWO
        sigma = F.sqrt(2 * n * (n - 1) * (PROSE_TWO - PROSE_TWO**2) + 4 * n * (n - 1) * (n - 2) * (PROSE_THREE - PROSE_TWO**2))
        rare = F.length(F.regexp_replace(t, "[a-z+/]", ""))
        z_rare = (rare - PROSE_RARE * n) / F.sqrt(n * PROSE_RARE * (1 - PROSE_RARE))
        z_prose = ((expected - squares) / sigma + z_rare) / (2**0.5)
        return F.struct(n.cast("int").alias("n"), z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), z_prose.alias("prose"))

    def coded(v: Column) -> Column:
        xs = F.transform(F.split(v["t"], ""), lambda c: (F.position(c, v["a"]) - 1).cast("double"))
        return let(F.struct(v["t"].alias("t"), v["a"].alias("a"), xs.alias("x")), measure)

    return let(F.struct(token.alias("t"), encoding.alias("a")), coded)


def is_random(z: Column, alpha: float) -> Column:
    """Random by all three tests, each at a third of `alpha`."""
    two_sided = lambda x: 2 * normal_tail(F.abs(x))
    return (normal_tail(z["chi"]) >= alpha / 3) & (two_sided(z["runs"]) >= alpha / 3) & (two_sided(z["serial"]) >= alpha / 3)


def _band(n: Column) -> Column:
    band = F.lit(len(BANDS))
    for i, top in reversed(list(enumerate(BANDS))):
        band = F.when(n < top, i).otherwise(band)
    return band


def _bin(z: Column) -> Column:
    return F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(20.0), z)) * 8).cast("int")


def random_candidates(text: Column, base: Column) -> Column:
    """Runs that overlap no base span, with their scores."""
    free = F.filter(_if(text.rlike(RUN), found(text, RUN)), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), z_scores(x["v"]).alias("z")))


def cutoffs(candidates: DataFrame, q: float, alpha: float) -> dict[int, int]:
    """For each band the smallest bin of the prose score that Benjamini-Hochberg at level q still rejects."""
    bins = candidates.groupBy(_band(F.col("z.n")).alias("band"), F.when(is_random(F.col("z"), alpha), _bin(F.col("z.prose"))).otherwise(-81).alias("bin")).count()
    upward = W.partitionBy("band").orderBy(F.desc("bin"))
    ranked = bins.select("band", "bin", F.sum("count").over(upward).alias("above"), F.sum("count").over(W.partitionBy("band")).alias("m"))
    ok = ranked.filter((F.col("bin") > -81) & (normal_tail(F.col("bin") / 8) * F.col("m") <= q * F.col("above")))
    return {r["band"]: r["bin"] for r in ok.groupBy("band").agg(F.min("bin").alias("bin")).collect()}  # a row for each band


def scan_secrets(docs: DataFrame, q: float = 0.01, alpha: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans with kind), random (spans the battery adds)."""
    tag = lambda spans, i: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    assign, access, hexes = base_spans(F.col("t"))
    based = text.withColumn("base", F.sort_array(F.concat(tag(assign, 0), tag(access, 1), tag(hexes, 2))))
    runs = based.withColumn("c", random_candidates(F.col("t"), F.col("base")))
    level = cutoffs(cut(runs.select(F.explode_outer("c.z").alias("z")).filter("z IS NOT NULL"), "secret-runs"), q, alpha)

    def keep(x: Column) -> Column:
        limit = F.lit(9999)
        for b, v in level.items():
            limit = F.when(_band(x["z"]["n"]) == b, v).otherwise(limit)
        return is_random(x["z"], alpha) & (_bin(x["z"]["prose"]) >= limit)

    return runs.select("doc_id", "base", tag(F.filter("c", keep), 3).alias("random"))


def listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of base spans, their digest, and all spans."""
    out = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "random"))).alias("spans"),
    )
