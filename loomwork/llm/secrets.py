r"""Secret scans: pattern spans, and tokens that a battery of randomness tests finds random.

Any token of 20 or more characters of a hex, base-32, base-64 or one-case
alphanumeric alphabet is a candidate. Its encoding is inferred (it needs a letter
and a digit, base-64 letters of both cases), and as a sequence over that alphabet of K
symbols it has to pass three tests of randomness: chi-squared uniformity of the
symbols, the number of runs above and below the alphabet's middle, and lag-1
serial correlation. Their statistics' squares add up to about a chi-squared of
three degrees of freedom; a sum beyond PASS is no random token.

Short tokens pass such tests by chance, so each also gets the probability that
an ordinary token of its length would look so random: few equal pairs of
symbols (a Poisson number for symbols as uneven as in words) and many changes
between letters of either case and digits (a binomial number; where an alphabet
has one case, only digits make changes, and ordinary tokens have fewer). Within a
document the Benjamini-Hochberg procedure, weighted by length, controls the
false discoveries among all its candidates at the rate FALSE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import rewritten, table, text_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FALSE, PASS = 0.001, 16.3
EQUAL, CHANGES, ONE_CASE = 0.065, 0.25, 0.1
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789")
KINDS = ("assign", "access", "hex", "random")


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """Structs of start, end (code points, end exclusive) and the match, for all leftmost non-overlapping matches."""
    between = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, empty, step, lambda acc: acc["out"])).otherwise(empty["out"])


def _span(x: Column, kind: str) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _tested(found: Column, base: Column) -> Column:
    """Structs of start, end, length and p (1 if a test of randomness fails) for candidates clear of base spans."""
    clear = F.filter(found, lambda x: ~F.exists(base, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))

    def read(x: Column) -> Column:
        token = F.regexp_replace(x["match"], "=+$", "")
        code = (
            F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), F.when(token.rlike("[0-9]") & token.rlike("[A-Fa-f]"), 0))
            .when(token.rlike("^[A-Z2-7]+$") | token.rlike("^[a-z2-7]+$"), F.when(token.rlike("[2-7]") & token.rlike("[A-Za-z]"), 1))
            .when(token.rlike("^[A-Z0-9]+$") | token.rlike("^[a-z0-9]+$"), F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), 3))
            .when(token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]"), 2)
        )
        plain = F.when(code.isin(0, 3), F.lower(token)).when(code == 1, F.upper(token)).otherwise(F.translate(token, "-_", "+/"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), plain.alias("token"), F.when(code == 0, ALPHABETS[0]).when(code == 1, ALPHABETS[1]).when(code == 3, ALPHABETS[3]).otherwise(ALPHABETS[2]).alias("alphabet"), code.alias("code"))

    def values(x: Column) -> Column:
        chars = F.when(x["code"].isNotNull(), F.filter(F.split(x["token"], ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
        numbers = F.transform(chars, lambda c: F.call_function("instr", x["alphabet"], c) - 1)
        counts = F.transform(F.array_distinct(chars), lambda c: F.char_length(x["token"]) - F.char_length(F.replace(x["token"], c, F.lit(""))))
        kinds = F.transform(chars, lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["code"].alias("code"), F.char_length(x["alphabet"]).cast("double").alias("k"), F.char_length(x["token"]).cast("double").alias("n"), numbers.alias("v"), counts.alias("counts"), kinds.alias("kinds"))

    def total(array: Column, f=lambda v: v.cast("double")) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + f(v))

    def changes(array: Column) -> Column:
        return total(F.zip_with(F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0))), array, lambda a, b: F.coalesce((a != b).cast("double"), F.lit(0.0))))

    def measured(x: Column) -> Column:
        high = F.transform(x["v"], lambda v: (v >= x["k"] / 2).cast("int"))
        pairs = F.zip_with(F.slice(x["v"], F.lit(2), F.greatest(F.size(x["v"]) - 1, F.lit(0))), x["v"], lambda a, b: F.coalesce(a.cast("double") * b, F.lit(0.0)))
        return F.struct(  # sums only: a mean within a lambda would be made anew for each symbol
            x["start"].alias("start"), x["end"].alias("end"), x["code"].alias("code"), x["k"].alias("k"), x["n"].alias("n"),
            total(x["counts"], lambda c: c.cast("double") * c).alias("squares"), total(high).alias("high"), changes(high).alias("runs"), changes(x["kinds"]).alias("changes"),
            total(x["v"]).alias("sum"), total(x["v"], lambda v: v.cast("double") * v).alias("square_sum"), total(pairs).alias("pair_sum"),
            (F.coalesce(F.get(x["v"], F.lit(0)), F.lit(0)) + F.coalesce(F.get(x["v"], F.size(x["v"]) - 1), F.lit(0))).alias("ends"),
        )

    def judged(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        both = 2 * x["high"] * (n - x["high"])
        runs = (x["runs"] + 1 - (both / n + 1)) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        mean = x["sum"] / n
        spread, products = x["square_sum"] - n * mean * mean, x["pair_sum"] - mean * (2 * x["sum"] - x["ends"]) + (n - 1) * mean * mean
        serial = F.when(spread > 1e-6, products / spread * F.sqrt(n)).otherwise(F.lit(99.0))
        random = F.pow(F.greatest(chi, F.lit(0.0)), 2) + F.pow(runs, 2) + F.pow(serial, 2) <= PASS
        pairs = (x["squares"] - n) / 2
        expected = F.when(x["code"] == 0, 2 * EQUAL).otherwise(EQUAL) * n * (n - 1) / 2
        rate = F.when(x["code"] == 2, CHANGES).otherwise(ONE_CASE)
        z = ((expected - pairs - 0.5) / F.sqrt(expected) + (x["changes"] - 0.5 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))) / F.sqrt(F.lit(2.0))
        p = F.when(F.coalesce(random, F.lit(False)) & x["code"].isNotNull() & (z > 0), 0.5 * F.exp(-0.717 * z - 0.416 * z * z)).otherwise(F.lit(1.0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), p.alias("p"))

    out = F.transform(F.transform(F.transform(F.transform(clear, read), values), measured), judged)
    return F.when(F.size(clear) > 0, out).otherwise(F.array().cast("array<struct<start:int,end:int,n:double,p:double>>"))


def _discovered(tests: Column) -> Column:
    """The tests that a Benjamini-Hochberg procedure, weighted by length, lets pass."""
    mean = F.aggregate(tests, F.lit(0.0), lambda acc, x: acc + x["n"]) / F.size(tests)
    ranked = F.sort_array(F.transform(tests, lambda x: F.struct((x["p"] * mean / x["n"]).alias("q"), x["start"].alias("start"), x["end"].alias("end"))))
    last = F.array_max(F.transform(ranked, lambda x, i: F.when(x["q"] <= FALSE * (i + 1) / F.size(tests), i + 1).otherwise(0)))
    none = F.array().cast("array<struct<q:double,start:int,end:int>>")
    return F.when((F.size(tests) > 0) & (last > 0), F.slice(ranked, F.lit(1), last)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """docs with base_spans and all_spans: arrays of structs start, order, end, kind, sorted; other columns stay.

    Positions are code points with the end exclusive. Null and empty texts have
    no spans; texts of any length are scanned whole; repeated rows are scanned
    one by one. The two new columns take the place of any of their names in docs
    (as do _assign, _access, _hex, _candidate and _tests, which go again). An
    empty table gives no rows.
    """
    text = text_of()
    wide = docs.withColumns({"_assign": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), "_access": F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), "_hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), "_candidate": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))})
    groups = F.when(F.size("_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    long = F.zip_with(_placed(text, ASSIGN, F.col("_assign")), groups, lambda x, g: F.struct(x.alias("x"), F.char_length(g).alias("n")))
    assign = F.transform(F.filter(long, lambda y: y["n"] >= 8), lambda y: _span(y["x"], "assign"))
    access = F.transform(_placed(text, ACCESS, F.col("_access")), lambda x: _span(x, "access"))
    hexes = F.transform(_placed(text, HEX, F.col("_hex")), lambda x: _span(x, "hex"))
    wide = wide.withColumn("base_spans", F.sort_array(F.concat(assign, access, hexes)))
    wide = wide.withColumn("_tests", _tested(_placed(text, CANDIDATE, F.col("_candidate")), F.col("base_spans")))
    more = F.transform(_discovered(F.col("_tests")), lambda x: _span(x, "random"))
    return wide.withColumn("all_spans", F.sort_array(F.concat("base_spans", more))).drop("_assign", "_access", "_hex", "_candidate", "_tests")


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_told("base_spans"), 256).alias("base_sha256"), _told("all_spans").alias("spans"), F.size(F.filter("all_spans", lambda s: s["kind"] == "random")).cast("long").alias("n_random"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by mark, overlapping spans by one; n_chars, if there, follows the text.

    Rows without a span stay as they are, null texts too.
    """
    acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], gap).alias("parts"))

    cut = F.aggregate("all_spans", acc, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["at"] + 1, F.char_length("text"))))
    scanned = scan(docs.select(F.struct("*").alias("_row"), "text"))
    return rewritten(docs, scanned.withColumn("_text", F.when(F.size("all_spans") > 0, cut)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
