"""Secret scans in DataFrame functions only.

Base spans come from three patterns. Beyond them, runs of 16 and more letters
and digits are tested for randomness: the encoding is inferred from their
characters, and the codes are held against a uniform source by a chi-squared
test over cells of the alphabet, more of them in a longer run, a runs test about
the alphabet's middle and a test of serial correlation. The battery's p-value is
three times the least of the three; below ``LEVEL`` the run is not random.

False discoveries are ordinary words taken for random. The evidence against
words is the odds of the run's characters under either source, weakened by the
battery: odds / p. Odds of words are at most x with a chance of at most x when
words are what there is, and dividing by p <= 1 keeps that, so these are p-values
whose power grows with the length of a run. Benjamini and Hochberg's step-up rule
holds their false discovery rate over all runs of a document. Runs without a
letter are as likely as numbers as they are as keys: none is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.llm import common

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,kind:int,end:int>>"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
# a run that is long enough is found by the same start as one of any length, as runs end where their class does
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
LEVEL = 0.001  # of the battery
RATE = 0.001  # of false discoveries

#: How often letters occur in ordinary words, about, per thousand; digits, signs and inner capitals share the rest.
LETTERS = "e 126, t 80, a 78, o 72, n 72, i 71, s 65, r 64, h 50, d 42, l 42, u 33, c 31, m 26, f 20, g 20, p 20, w 18, y 16, b 15, v 11, k 7, j 2, x 2, z 2, q 1"
SIGN_SHARE = 0.002  # of each digit, sign or capital
BLOCK = 512  # spans that are put together, or passed over, at a time: the work of a text grows little faster than its spans


def _blocks(items: Column) -> Column:
    """An array in runs of ``BLOCK`` items, at least one run."""
    return let(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))


def _spans(text: Column, pattern: str, kind: int, length_of: int | None = None, least: int = 0) -> Column:
    """Structs start, kind, end, in code points, of the leftmost matches that do not overlap.

    What stands between matches and the matches themselves, in turn, add up to the places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(length_of)) if length_of else found
    # each pattern runs over the text once, not once for every match
    parts = F.struct(gaps.alias("gaps"), found.alias("found"), measured.alias("measured"))
    pairs = let(parts, lambda p: F.transform(p["found"], lambda m, i: F.struct(F.char_length(F.get(p["gaps"], i)).alias("gap"), F.char_length(m).alias("n"), F.char_length(F.get(p["measured"], i)).alias("m"))))
    empty = F.array().cast(SPANS)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["m"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    return F.aggregate(_blocks(pairs), first, block, lambda acc: F.flatten(acc["out"]))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a logistic curve, right to about 2e-4."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


#: Encodings in the order tried, smallest alphabet first.
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+", DIGITS + SMALL[:6]),
    ("[0-9A-F]+", DIGITS + LARGE[:6]),
    ("[a-z]+", SMALL),
    ("[A-Z]+", LARGE),
    ("[A-Z2-7]+", LARGE + "234567"),
    ("[0-9a-z]+", DIGITS + SMALL),
    ("[0-9A-Z]+", DIGITS + LARGE),
    ("[A-Za-z]+", LARGE + SMALL),
    ("[0-9A-Za-z]+", DIGITS + LARGE + SMALL),
    ("[0-9A-Za-z+/]+", LARGE + SMALL + DIGITS + "+/"),
    ("[0-9A-Za-z_-]+", LARGE + SMALL + DIGITS + "-_"),
    ("[0-9A-Za-z+/_-]+", LARGE + SMALL + DIGITS + "+/-_"),
)
LEAST_CELLS, MOST_CELLS, PER_CELL = 2, 8, 5  # cells of the chi-squared test, and codes that each should get


def _battery(codes: Column, k: Column) -> Column:
    """The battery's p-value for codes (array<int> from 0) of an alphabet of ``k``."""
    k, n = k.cast("double"), F.size(codes).cast("double")
    count = lambda a, f: F.size(F.filter(a, f)).cast("double")
    cells = F.greatest(F.lit(LEAST_CELLS), F.least(F.lit(MOST_CELLS), F.floor(n / PER_CELL))).cast("int")

    # cells of equal share of the alphabet, as near as it divides
    def cell(j: Column) -> Column:
        expected = n * (F.ceil((j + 1) * k / cells) - F.ceil(j * k / cells)) / k
        off = count(codes, lambda c: F.floor(c * cells / k) == j) - expected
        return off * off / expected

    chi = F.aggregate(F.transform(F.sequence(F.lit(0), cells - 1), cell), F.lit(0.0), lambda a, b: a + b)
    df = (cells - 1).cast("double")
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform(codes, lambda c: (c * 2 >= k).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, b: a + b).cast("double")
    n0 = n - n1
    pairs = F.arrays_zip(F.slice(high, 1, F.size(high) - 1).alias("a"), F.slice(high, F.lit(2), F.size(high) - 1).alias("b"))
    runs = 1 + count(pairs, lambda p: p["a"] != p["b"])
    mean_runs = 1 + 2 * n1 * n0 / n
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
    z_runs = F.abs(runs - mean_runs) / F.sqrt(var_runs)
    mean = F.aggregate(codes, F.lit(0.0), lambda a, b: a + b) / n
    var = F.greatest(F.aggregate(codes, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)), F.lit(1e-9))
    steps = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("b"))
    serial = F.aggregate(steps, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)) / var
    z_serial = F.abs(serial + 1 / n) * F.sqrt(n)
    return F.least(F.lit(1.0), 3 * F.least(_normal_tail(z_chi), 2 * _normal_tail(z_runs), 2 * _normal_tail(z_serial)))


def _random(text: Column, base: Column) -> Column:
    """Spans of runs that are taken for random and that no base span overlaps."""
    shares = dict(x.split() for x in LETTERS.split(", "))
    known = F.array(*(F.lit(float(share) / 1000) for share in shares.values()))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("run"), _spans(text, RUN, 3).alias("span"))

    def coded(x: Column) -> Column:
        """Evidence against words, and codes, of a run with a letter."""
        body = F.rtrim(x["run"], F.lit("="))
        alphabet = F.lit(None).cast("string")
        for pattern, letters in reversed(ENCODINGS):
            alphabet = F.when(body.rlike(f"^{pattern}$"), F.lit(letters)).otherwise(alphabet)
        letters, shouted = F.filter(F.split(body, ""), lambda c: c != ""), ~body.rlike("[a-z]")  # words in capitals are words
        share = lambda c: F.coalesce(F.get(known, F.instr(F.lit("".join(shares)), c) - 1), F.lit(SIGN_SHARE))

        def described(a: Column) -> Column:
            codes = F.transform(letters, lambda c: F.instr(a, c) - 1)
            odds = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.log(F.char_length(a) * share(F.when(shouted, F.lower(c)).otherwise(c))))
            return F.struct(x["span"].alias("span"), codes.alias("codes"), F.char_length(a).alias("k"), odds.alias("odds"))

        return let(alphabet, described)

    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ranges = F.transform(_blocks(base), lambda xs: F.struct(F.get(xs, F.lit(0))["start"].alias("start"), F.array_max(F.transform(xs, lambda x: x["end"])).alias("end"), xs.alias("spans")))

    def chosen(all_runs: Column) -> Column:
        # base spans come by start: whole blocks of them are passed over
        taken = lambda s, blocks: F.coalesce(F.exists(blocks, lambda b: F.when(overlaps(b, s), F.exists(b["spans"], lambda x: overlaps(x, s))).otherwise(False)), F.lit(False))
        lettered = let(ranges, lambda blocks: F.filter(all_runs, lambda x: x["run"].rlike("[A-Za-z]") & ~taken(x["span"], blocks)))
        # the odds are quick, the battery is for those that it can still matter to
        likely = F.filter(F.transform(lettered, coded), lambda x: x["odds"] <= F.log(F.lit(RATE)))
        tested = F.transform(likely, lambda x: F.struct(x["odds"].alias("odds"), _battery(x["codes"], x["k"]).alias("p"), x["span"].alias("span")))
        passed = F.filter(tested, lambda x: x["p"] >= LEVEL)
        ranked = F.sort_array(F.transform(passed, lambda x: F.struct(F.exp(F.greatest(x["odds"], F.lit(-700.0)) - F.log(x["p"])).alias("p"), x["span"].alias("span"))))
        # step-up over all runs of the text: as many as the largest rank within its level
        within = lambda r: F.aggregate(F.transform(r, lambda x, i: F.when(x["p"] <= RATE * (i + 1) / F.size(all_runs), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(ranked, lambda r: F.transform(F.slice(r, F.lit(1), within(r)), lambda x: x["span"]))

    return let(found, chosen)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Null text is empty and has no spans. A span is a whole match, its end not
    included. A null doc_id stays null; repeated rows are scanned alike; other
    columns are ignored; an empty table gives no rows."""
    none = F.array().cast(SPANS)
    text = F.col("t")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # most texts have nothing to place: one look with each pattern, no more
    d = d.select(
        "doc_id",
        "t",
        F.when(text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, 0, 2, 6)).otherwise(none).alias("assign"),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none).alias("hex"),
        text.rlike(RUN).alias("long"),
    )
    d = d.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    d = d.withColumn("random", F.when(F.col("long"), _random(text, F.col("base"))).otherwise(none))
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.sort_array(F.concat("base", "random"))).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; see ``scan`` for the defined cases."""
    return scan(common.documents(spark, sf_dir))
