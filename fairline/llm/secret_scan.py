"""Secret scans: fixed patterns, and a randomness test battery on encoded-looking tokens.

Patterns give the base spans. Beside them, every run of at least MIN_TOKEN encoding characters that has a letter and a digit
is a candidate. Its encoding is inferred (the smallest alphabet that holds it), and three tests look for structure:
chi-squared uniformity over the alphabet, runs above and below the alphabet's middle, and serial correlation of neighbours.
Fisher's method joins the three probabilities; a small one says the token is not random.

How small is decided by false-discovery control (Benjamini-Hochberg) over all candidates of a length class, as short tokens
show less structure than long ones: of what is put aside as structured, at most a share of ``alpha`` is expected to be random.
All others are reported with kind ``random`` unless a base span already covers part of them.

Everything is SQL expressions on the document's row; only a histogram of probabilities, at most CLASSES x BINS rows, is
aggregated over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.common import stage

MIN_TOKEN = 20
ALPHA = 0.05
CLASSES = 4  # of length: from 20, 32, 64 and 128 characters
BINS = 2000  # of the probability's negative logarithm, STEP wide
STEP = 0.01

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # as long as a run: every shorter run fails
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"

# The alphabets of common encodings, in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_OTHER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"


def _matches(text: Column, pattern: str, kind: str, order: int, value: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, order, end, kind, token), in code points; the gaps between matches
    give their places. Matches whose group ``value`` (or whole) is shorter than ``least`` are dropped."""
    kinds = "array<struct<start:int,ord:int,end:int,kind:string,token:string>>"
    none = F.array().cast(kinds)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = hits if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    # There is one gap more than matches: the last has no hit.
    zipped = F.transform(F.arrays_zip(F.split(text, pattern, -1), hits, own), lambda x: F.struct(x["0"].alias("gap"), x["1"].alias("hit"), x["2"].alias("own")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["own"].alias("token"))
        more = F.when(F.length(x["own"]) >= least, F.concat(a["out"], F.array(span).cast(kinds))).otherwise(a["out"])
        return F.struct(F.coalesce(end, start).alias("at"), more.alias("out"))

    spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _two_sided(z: Column) -> Column:
    """Probability of a normal value at least as far from 0 (polynomial approximation, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), 2 * 0.3989422804014327 * F.exp(-x * x / 2) * poly))


def _upper(z: Column) -> Column:
    return F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def _over(top: Column, bottom: Column) -> Column:
    """The quotient, 0 where the divisor is."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom))


def battery(token: Column) -> Column:
    """Struct of ``encoding`` and ``p``, the joint probability of so much structure in a random token."""
    encoding = F.coalesce(*[F.when(token.rlike(f"^[{a.replace('-', chr(92) + '-')}]+$"), F.lit(n)) for n, a in ALPHABETS.items()], F.lit("mixed"))
    return F.transform(F.array(F.struct(token.alias("token"), encoding.alias("encoding"))), _judged)[0]


def _judged(x: Column) -> Column:
    alphabet = F.coalesce(*[F.when(x["encoding"] == n, F.lit(a)) for n, a in ALPHABETS.items()], F.lit(_OTHER))
    codes = F.transform(F.split(x["token"], ""), lambda c: F.instr(alphabet, c) - 1)
    row = F.struct(x["encoding"].alias("encoding"), F.length(alphabet).cast("double").alias("k"), codes.alias("codes"))
    return F.transform(F.array(row), _summed)[0]


def _summed(x: Column) -> Column:
    """Sums over the symbols in one pass, then the tests."""
    half = x["k"] / 2
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "sum", "square", "cross", "runs", "high")], F.lit(-1).alias("last"))

    def step(a: Column, c: Column) -> Column:
        v, last = c.cast("double"), a["last"].cast("double")
        above, was = (v >= half).cast("double"), (last >= half).cast("double")
        begins = F.when((a["n"] == 0) | (above != was), 1.0).otherwise(0.0)
        return F.struct((a["n"] + 1).alias("n"), (a["sum"] + v).alias("sum"), (a["square"] + v * v).alias("square"), (a["cross"] + F.when(a["n"] == 0, 0.0).otherwise(v * last)).alias("cross"), (a["runs"] + begins).alias("runs"), (a["high"] + above).alias("high"), c.cast("int").alias("last"))

    sums = F.aggregate(x["codes"], start, step)
    counts = F.aggregate(F.array_distinct(x["codes"]), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x["codes"], lambda d: d == c)).cast("double"), F.lit(2.0)))
    ends = (F.element_at(x["codes"], 1) + F.element_at(x["codes"], -1)).cast("double")
    row = F.struct(x["encoding"].alias("encoding"), x["k"].alias("k"), sums.alias("s"), counts.alias("counts"), ends.alias("ends"))
    return F.transform(F.array(row), _tested)[0]


def _tested(x: Column) -> Column:
    s, k = x["s"], x["k"]
    n = s["n"]
    freedom = k - 1
    chi = k / n * x["counts"] - n
    spread = 2 / (9 * freedom)
    uniform = _upper((F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    low = n - s["high"]
    mean_runs = 2 * s["high"] * low / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    runs = _two_sided(_over(s["runs"] - mean_runs, F.sqrt(F.greatest(var_runs, F.lit(0.0)))))
    mean = s["sum"] / n
    around = s["square"] - n * mean * mean
    neighbours = s["cross"] - mean * (2 * s["sum"] - x["ends"]) + (n - 1) * mean * mean
    serial = _two_sided((_over(neighbours, around) + 1 / n) * F.sqrt(n))
    half = -(F.ln(F.greatest(uniform, F.lit(1e-300))) + F.ln(runs) + F.ln(serial))  # half of Fisher's statistic, 6 degrees
    joint = F.exp(-half) * (1 + half + half * half / 2)
    return F.struct(x["encoding"].alias("encoding"), joint.alias("p"))


def _length_class(token: Column) -> Column:
    size = F.length(token)
    return F.when(size < 32, 0).when(size < 64, 1).when(size < 128, 2).otherwise(3)


def _limits(candidates: DataFrame, alpha: float) -> dict[int, int]:
    """For each length class the lowest bin (of ``-log10 p``) that is rejected; classes without one are missing.

    The histogram and what is collected are bounded by CLASSES and BINS.
    """
    counts = candidates.groupBy("class", "bin").agg(F.count("*").alias("rows"))
    ordered = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("class", "bin", F.sum("rows").over(ordered).alias("rank"), F.sum("rows").over(Window.partitionBy("class")).alias("all"))
    # A bin's probabilities are at most 10 ** (-bin * STEP).
    rejected = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * STEP) <= alpha * F.col("rank") / F.col("all"))
    return {r["class"]: r["bin"] for r in rejected.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``base`` and ``added``, arrays of (start, ord, end, kind), by start and kind.

    Kinds are assign, access, hex (base) and random (added); places count code points, the end is exclusive. A null or empty
    text has no spans. Repeated rows get equal spans. Empty tables give empty results.
    """
    kept = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = F.col("text")
    base = F.concat(_matches(whole, ASSIGN, "assign", 0, 2, 8), _matches(whole, ACCESS, "access", 1, None, 16), _matches(whole, HEX, "hex", 2))
    tokens = F.filter(_matches(whole, TOKEN, "random", 3), lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]"))
    found = rows.select("row", F.array_sort(base).alias("base"), tokens.alias("tokens"))
    judged = F.transform("tokens", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], _length_class(s["token"]).alias("class"), battery(s["token"])["p"].alias("p")))
    tested = found.select("row", "base", judged.alias("tokens"))
    binned = F.transform("tokens", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], s["class"], F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(s["p"], F.lit(1e-300))) / STEP).cast("int")).alias("bin"), s["p"]))
    held = stage(tested.select("row", F.transform("base", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])).alias("base"), binned.alias("tokens")), "secrets")
    limits = _limits(held.select(F.explode("tokens").alias("t")).select("t.class", "t.bin"), alpha)

    def random(s: Column) -> Column:
        bound = F.coalesce(*[F.when(s["class"] == c, F.lit(b)) for c, b in limits.items()], F.lit(BINS))
        free = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["bin"] < bound) & free

    added = F.transform(F.filter("tokens", random), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))
    return held.select("row", "base", added.alias("added"))
