"""Secret scans: three fixed patterns, and runs of characters that look random.

The fixed patterns give the base spans. The method adds spans of kind
``random``: runs of 20 or more encoding characters, except those that lie whole
in a base span. A run's encoding is inferred from its characters, and two
batteries of tests are made in it, each of a chi-squared test of the alphabet, a
runs test and a lag-1 serial correlation:

* against uniform draws from the alphabet; a run that one of them rejects is not random;
* against ordinary names and numbers, which prefer some characters, change
  seldom between digits, capitals and small letters, and put like beside like.
  Their p-values are combined by Fisher's method; a run of digits alone, or of
  letters of one case, has no changes that could tell, so two p-values are combined.

Over the whole corpus the combined p-values of each encoding and length class
then pass the Benjamini-Hochberg step-up rule on a fixed grid of p, rounded up,
so that only counts by grid cell are shuffled and a short run needs no less
evidence than its own class allows.

Positions count code points, ends are exclusive. Defined cases: a null or empty
text has no spans; repeated rows are scanned each by itself; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.llm.common import let, match_spans

# The base patterns. Runs of a class are maximal, so that a least
# length inside the pattern finds what a length test after it would keep.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + SMALL[:6], "base32": LARGE + "234567", "base36": DIGITS + SMALL,
    "base64": LARGE + SMALL + DIGITS + "+/", "digits": DIGITS, "letters": SMALL, "cases": LARGE + SMALL,
}
#: What ordinary runs are taken for: how much likelier than in uniform draws two
#: characters agree, how often neighbours change class, and their serial correlation.
ORDINARY_EXCESS, ORDINARY_CHANGES, ORDINARY_SERIAL = 0.7, 0.2, 0.4
#: A run is not random where a test of uniform draws has a p-value below this, for each of the three.
REJECTED = 0.001
#: The share of ordinary runs among those found, in each class.
FALSE_SHARE = 0.01
#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)
#: Grid cells per power of ten of p, and their number.
CELLS_PER_TEN, CELLS = 20, 600


def _assignments(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return match_spans(text, ASSIGN, lambda s: let(values, lambda v: F.filter(
        s, lambda _, i: F.char_length(F.get(v, i)) >= ASSIGN_LEAST)))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of the base spans; ``text`` has no nulls."""
    return {"assign": _assignments(text), "access": match_spans(text, ACCESS), "hex": match_spans(text, HEX)}


def _candidates(text: Column, base: list[Column]) -> Column:
    def left(s: Column) -> Column:
        inside = F.lit(False)
        for b in base:
            inside = inside | F.exists(b, lambda x: (x.start <= s.start) & (s.end <= x.end))
        return ~inside

    return match_spans(text, CANDIDATE, lambda spans: F.filter(spans, left))


def _phi(z: Column) -> Column:
    """The normal distribution function by the rational approximation with five coefficients, within 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z > 0, 1 - upper).otherwise(upper)


def _both_tails(z: Column) -> Column:
    return 2 * _phi(-F.abs(z))


def _verdict(v: Column, s: Column, encoding: Column) -> Column:
    """``v``: places in the alphabet; ``s``: their number n, the alphabet's size k, changes of class."""
    n, k, zero = s.n, s.k, F.lit(0.0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct(v), lambda x: F.pow(
        F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0))))
    following = F.slice(v, 2, F.size(v))
    centre, spread = (k - 1) / 2, (k * k - 1) / 12
    turns = total(F.transform(following, lambda x, i: ((x >= k / 2) != (F.get(v, i) >= k / 2)).cast("double")))
    serial = total(F.transform(following, lambda x, i: (x - centre) * (F.get(v, i) - centre))) / (spread * (n - 1))

    def combined(c: Column) -> Column:
        uniform = F.least(
            _both_tails((c.chi - (k - 1)) / F.sqrt(2 * (k - 1))),
            _both_tails((c.turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)),
            _both_tails(c.serial * F.sqrt(n - 1)),
        )
        lean = n * ORDINARY_EXCESS
        by_chi = _phi((c.chi - (k - 1) - lean) / F.sqrt(2 * (k - 1) + 4 * lean))
        by_changes = _phi(-(s.changes - (n - 1) * ORDINARY_CHANGES)
                          / F.sqrt((n - 1) * ORDINARY_CHANGES * (1 - ORDINARY_CHANGES)))
        by_serial = _phi((F.atanh(F.least(F.abs(c.serial), F.lit(0.99))) - F.atanh(F.lit(ORDINARY_SERIAL)))
                         * F.sqrt(n - 3))
        one_kind = encoding.isin("digits", "letters")
        by_changes = F.when(one_kind, 1.0).otherwise(by_changes)
        half = F.lit(0.0)
        for p in (by_chi, by_changes, by_serial):
            half = half - F.log(F.greatest(p, F.lit(1e-30)))
        # Fisher's statistic has six degrees of freedom, or four; this is the log of its upper tail.
        tail = -half + F.log(1 + half + F.when(one_kind, 0.0).otherwise(half * half / 2))
        cell = F.least(F.floor(-tail / F.log(F.lit(10.0)) * CELLS_PER_TEN), F.lit(CELLS - 1)).cast("int")
        length = F.lit(LENGTHS[0])
        for least in LENGTHS[1:]:
            length = F.when(n >= least, least).otherwise(length)
        return F.struct(F.concat_ws(":", encoding, length.cast("string")).alias("class"),
                        F.greatest(cell, F.lit(0)).alias("cell"), (uniform < REJECTED).alias("rejected"))

    return let(F.struct((squares * k / n - n).alias("chi"), turns.alias("turns"), serial.alias("serial")), combined)


def battery(token: Column) -> Column:
    """A struct with a run's class (encoding and length), its grid cell, and whether uniform draws are rejected."""
    letter_by_letter = "(?<=.)(?=.)"

    def tested(body: Column, encoding: Column) -> Column:
        letters = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[encoding]
        folded = F.when(encoding.isin("hex", "base36", "letters"), F.lower(body)).otherwise(body)
        values = let(letters, lambda a: F.transform(
            F.split(folded, letter_by_letter), lambda c: (F.instr(a, c) - 1).cast("double")))
        kinds = body
        for pattern, kind in (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A")):
            kinds = F.regexp_replace(kinds, pattern, kind)
        changes = let(F.split(kinds, letter_by_letter), lambda x: F.size(F.filter(
            F.slice(F.transform(x, lambda c, i: c != F.get(x, i - 1)), 2, F.size(x)), lambda c: c)))
        return let(values, lambda v: let(
            F.struct(F.size(v).cast("double").alias("n"), F.char_length(letters).cast("double").alias("k"),
                     changes.cast("double").alias("changes")),
            lambda s: _verdict(v, s, encoding)))

    # The padding is no part of the alphabet; the two base64 alphabets become one.
    stripped = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    return let(stripped, lambda body: let(
        F.when(body.rlike("^[0-9]+$"), "digits").when(body.rlike("^([a-z]+|[A-Z]+)$"), "letters")
        .when(body.rlike("^[A-Za-z]+$"), "cases").when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64"),
        lambda encoding: tested(body, encoding)))


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans and tested candidates."""
    text = F.coalesce("text", F.lit(""))
    based = docs.withColumns({f"_{kind}": spans for kind, spans in base_spans(text).items()})
    runs = based.withColumn("_runs", _candidates(text, [F.col(f"_{kind}") for kind in KINDS[:3]]))
    return runs.withColumn("_random", F.transform("_runs", lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"), x.match.alias("match"), battery(x.match).alias("test"))))


def discovery_cells(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row: a map from class to the least grid cell that the step-up rule accepts.

    Over all candidates of the corpus; there are at most 35 classes of ``CELLS`` cells.
    """
    tests = _scanned(docs.select("text")).select(F.explode("_random.test").alias("t")).select("t.*")
    counts = tests.groupBy("class", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("rejected")).cast("long")).alias("passed"))
    whole = Window.partitionBy("class")
    reached = counts.select(
        "class", "cell", F.sum("n").over(whole).alias("m"),
        F.sum("passed").over(whole.orderBy(F.desc("cell"))).alias("k"),
    ).where(F.pow(F.lit(10.0), -F.col("cell") / CELLS_PER_TEN) * F.col("m") <= false_share * F.col("k"))
    least = reached.groupBy("class").agg(F.min("cell").alias("least"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("cells"))


def secret_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with ``secret_spans``: structs of kind, start and end by start, then kind as in ``KINDS``."""
    cells = discovery_cells(docs, false_share).scalar()
    scanned = _scanned(docs).withColumn("_cells", cells)
    found = F.filter("_random", lambda x: ~x.test.rejected & F.coalesce(
        x.test.cell >= F.element_at("_cells", x.test["class"]), F.lit(False)))

    def ranked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x.start.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x.end.alias("end")))

    arrays = [ranked(F.col(f"_{kind}"), i) for i, kind in enumerate(KINDS[:3])] + [ranked(found, 3)]
    spans = F.transform(F.sort_array(F.concat(*arrays)), lambda x: F.struct(x.kind, x.start, x.end))
    return scanned.withColumn("secret_spans", spans).drop(*[f"_{kind}" for kind in KINDS], "_runs", "_cells")


def joined(spans: Column) -> Column:
    """Spans as text, kind:start:end with commas between."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(docs: DataFrame, false_share: float = FALSE_SHARE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of the text, or group of overlapping spans, replaced by ``mark``.

    A null text stays null; a column n_chars, if there is one, is set to the new length.
    """
    def replaced(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        # ``at``: the end of what is copied or marked so far
        step = lambda done, x: F.struct(
            F.greatest(done.at, x.end).alias("at"),
            F.when(x.start < done.at, done.out).otherwise(F.concat(
                done.out, F.substring(text, done.at + 1, x.start - done.at), F.lit(mark))).alias("out"))
        return F.aggregate(spans, start, step, lambda done: F.concat(
            done.out, F.substring(text, done.at + 1, F.char_length(text))))

    marked = secret_spans(docs, false_share)
    text = F.when(F.size("secret_spans") > 0, replaced(F.col("text"), F.col("secret_spans"))).otherwise(F.col("text"))
    out = marked.withColumn("text", text).drop("secret_spans")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
