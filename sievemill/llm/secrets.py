"""Secret scans in built-in functions only: fixed patterns, and a battery of randomness tests on unnamed strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch

# The base patterns and the least lengths of what they find.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]
#: Runs of characters of common encodings, of 20 or more with a digit; letters and digits alone, which + / _ - part.
LONG = 20
RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{LONG},}}"
PART = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{{{LONG},}}"
# The alphabets of the encodings, in the order of their tests, and what a string of each must look like.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": (_DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    "HEX": (_DIGITS + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    "base32": (_UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    "base32 in lower case": (_LOWER + "234567", r"^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+$"),
    "base36": (_DIGITS + _LOWER, r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$"),
    "BASE36": (_DIGITS + _UPPER, r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$"),
    "alnum": (_UPPER + _LOWER + _DIGITS, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$"),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$"),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$"),
    "any": (_UPPER + _LOWER + _DIGITS + "+/-_", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]+$"),
}
#: What counts as ordinary: symbols whose probabilities have at least this sum of squares (letters of names in mixed
#: case: 0.046, of lower-case text: 0.065), with 16 symbols, where digits prevail, that of eleven; and neighbours that
#: change between small letters, capitals and digits at most this often (a capital before a small letter is no change).
CONCENTRATION, CONCENTRATION_16, CHANGES = 0.046, 0.09, 0.2
CHANGE = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
#: Level at which runs or serial correlation show that symbols aren't independent.
DEPENDENT = 0.01
#: Bins of -log10 p, in hundredths up to 20, in which the false-discovery step counts the hypotheses.
BINS = 2000


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, also where fn uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, tok, part), code points, end exclusive.

    Starts are the lengths of what a split at the same pattern leaves between the matches, summed up.
    """
    none = F.array().cast("array<struct<start:int,end:int,tok:string,part:string>>")

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["tok"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["tok"].alias("tok"), x["part"].alias("part")))).alias("out"))

    def placed(tok):
        part = tok if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(tok)).alias("gap"), tok.alias("tok"), part.alias("part"))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _tail(z: str) -> str:
    """P(Z > z) of a standard normal variable, by the rational form of Abramowitz and Stegun 26.2.17."""
    poly = "t * (0.319381530D + t * (-0.356563782D + t * (1.781477937D + t * (-1.821255978D + t * 1.330274429D))))"
    upper = f"exp(-z * z / 2) / {math.sqrt(2 * math.pi)}D * " + _let("t", "1 / (1 + 0.2316419D * abs(z))", poly)
    return _let("z", z, _let("u", upper, "CASE WHEN z >= 0 THEN u ELSE 1 - u END"))


def battery(tok: str) -> str:
    """SQL for the p of "these symbols are ordinary text"; null where the string has the form of no encoding.

    The alphabet is that of the first encoding whose form the string has. Two statistics tell random symbols from text,
    and the mean of their normal forms (Stouffer) gives p. First, text deviates from an even use of the alphabet by an
    effect w * w of k * `CONCENTRATION` - 1 or more (k symbols): then Pearson's statistic of the n symbols is noncentral
    chi-squared with n * w * w, of which the lower tail counts (Patnaik's central form, Wilson and Hilferty's cube root).
    Second, the runs of letters and digits: text changes between them at most with the rate `CHANGES`. So p is small
    only for strings that are too even and too mixed for text, and long enough to tell. Where the runs above and below
    the middle of the alphabet or the serial correlation of lag one, two-sided and at `DEPENDENT` together, show that
    symbols depend on each other (a counter, a repeated group), p is 1.
    """
    alphabet = "CASE " + " ".join(f"WHEN {tok} RLIKE '{form}' THEN '{letters}'" for letters, form in ALPHABETS.values()) + " END"
    symbols = f"transform(filter(split({tok}, ''), c -> c <> ''), c -> instr(a, c) - 1)"
    high, pairs = "aggregate(x, 0D, (s, v) -> s + CASE WHEN v >= k / 2 THEN 1 ELSE 0 END)", "zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (l, r) -> struct(l, r))"
    squares = "aggregate(transform(sequence(0, length(a) - 1), s -> size(filter(x, v -> v = s))), 0D, (s, c) -> s + c * c)"
    chi = f"greatest({squares} * k / n - n, 0D)"
    effect = f"n * (k * CASE WHEN k <= 16 THEN {CONCENTRATION_16}D ELSE {CONCENTRATION}D END - 1)"
    even = _let("m", "k - 1 + e", _let("f", "m * m / (k - 1 + 2 * e)", f"(1 - 2 / (9 * f) - pow({chi} / m, 1D / 3)) / sqrt(2 / (9 * f))"))
    runs = "aggregate(q, 1D, (s, p) -> s + CASE WHEN (p.l >= k / 2) <> (p.r >= k / 2) THEN 1 ELSE 0 END)"
    z_runs = _let("h", high, _let("e", "2 * h * (n - h) / n + 1", f"CASE WHEN h = 0 OR h = n THEN 9D ELSE greatest(0D, (abs({runs} - e) - 0.5D) / sqrt(greatest((e - 1) * (e - 2) / (n - 1), 1e-9D))) END"))
    z_serial = "abs(aggregate(q, 0D, (s, p) -> s + (p.l - (k - 1) / 2) * (p.r - (k - 1) / 2)) / ((k * k - 1) / 12) / sqrt(n - 1))"
    apart = f"least(4 * {_tail(z_runs)}, 4 * {_tail(z_serial)})"
    mixed = f"(regexp_count({tok}, '{CHANGE}') - 0.5D - (n - 1) * {CHANGES}D) / sqrt((n - 1) * {CHANGES * (1 - CHANGES)}D)"
    both = f"({_let('e', f'greatest(0D, {effect})', even)} + {mixed}) / {math.sqrt(2)}D"
    p = f"CASE WHEN {apart} < {DEPENDENT}D THEN 1D ELSE least(1D, {_tail(both)}) END"
    body = _let("x", symbols, _let("k", "CAST(length(a) AS double)", _let("n", "CAST(size(x) AS double)", _let("q", pairs, p))))
    return _let("a", alphabet, f"CASE WHEN a IS NULL THEN NULL ELSE {body} END")


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 100)).cast("int")


def _left(m: Column, base: Column) -> Column:
    """What base spans leave of a run, as an array: the run itself, or the parts before and behind them."""
    over = F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    lo, hi = F.array_min(F.transform(over, lambda b: b["start"])), F.array_max(F.transform(over, lambda b: b["end"]))

    def part(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"), F.substring(m["tok"], a - m["start"] + 1, F.greatest(b - a, F.lit(0))).alias("tok"))

    parts = F.filter(F.array(part(m["start"], lo), part(hi, m["end"])), lambda x: (x["end"] - x["start"] >= LONG) & x["tok"].rlike("[0-9]"))
    return F.when(F.size(over) == 0, F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["tok"].alias("tok")))).otherwise(parts)


def scan(docs: DataFrame, *, text: str = "text", level: float = 0.05, name: str = "secrets") -> DataFrame:
    """Adds `name`, an array of structs (start, kind, end) of all spans by start; kind is a place in `KINDS`.

    The base kinds are the leftmost non-overlapping matches of the fixed patterns, less those that are too short. The
    method adds `random`: runs of 20 or more symbols of an encoding (`ALPHABETS`), whole and parted at + / _ -, as far as
    base spans leave them, that the battery finds too even for text. The hypotheses "this string is ordinary" of all
    documents are tested together: their p-values, divided by weights in proportion to a string's length (long strings
    carry more evidence), go through the step-up procedure of Benjamini and Hochberg, so of the strings that are
    reported at most a share of `level` is expected to be ordinary. A span inside another `random` one is left out.

    Each text is matched once: spans and p-values are written to the shared folder with the rows, and the step needs
    only counts in `BINS` bins, which are aggregated before anything leaves a task. Nothing else is shuffled.

    Null text: empty, no spans. All other columns stay, whatever their names, except those called `name`, which are
    replaced. Repeated rows are each scanned, and each counts as a hypothesis. An empty table gives no rows. Only
    built-in functions run.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kind = {k: F.lit(i) for i, k in enumerate(KINDS)}
    as_span = lambda found, k: F.transform(found, lambda m: F.struct(m["start"].alias("start"), kind[k].alias("kind"), m["end"].alias("end")))
    assign = as_span(F.filter(matches(body, ASSIGN, 2), lambda m: F.length(m["part"]) >= LEAST["assign"]), "assign")
    access = as_span(matches(body, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"), "access")
    hexes = as_span(matches(body, rf"[0-9a-f]{{{LEAST['hex']},}}"), "hex")
    base = F.array_sort(F.concat(assign, access, hexes))
    # what the parts are cut from holds no other run, so a text without RUN has no PART
    runs = F.when(body.rlike(RUN), F.concat(matches(body, RUN), matches(body, PART))).otherwise(F.array().cast("array<struct<start:int,end:int,tok:string,part:string>>"))
    outside = lambda base: F.array_distinct(F.flatten(F.transform(runs, lambda m: _left(m, base))))
    tested = f"filter(transform(__s.runs, m -> named_struct('start', m.start, 'kind', {KINDS.index('random')}, 'end', m.end, 'p', {battery('m.tok')})), m -> m.p IS NOT NULL)"
    found = docs.withColumn("__s", let(base, lambda b: F.struct(b.alias("base"), outside(b).alias("runs"))))
    found = found.withColumn("__s", F.struct("__s.base", F.expr(tested).alias("runs")))
    # by place, so that no name clashes in the files
    found = Scratch(docs.sparkSession, "secrets").keep(found.toDF(*[f"c{i}" for i in range(len(docs.columns))], "s"), "found")
    tests = found.select(F.explode("s.runs").alias("m")).select((F.col("m.end") - F.col("m.start")).alias("n"), "m.p")
    # counts by length and bin: lengths above 512 weigh as 512, so there are at most 512 * BINS cells
    cells = tests.select(F.least("n", F.lit(512)).alias("n"), _bin(F.col("p")).alias("b")).groupBy("n", "b").agg(F.count("*").alias("c"))
    cut, mean = threshold([tuple(r) for r in cells.collect()], level)
    weight = lambda m: F.least(m["end"] - m["start"], F.lit(512)) / F.lit(mean)
    kept = lambda runs: F.filter(runs, lambda m: _bin(m["p"]) / 100 + F.log10(weight(m)) >= cut)
    inside = lambda m, o: (o["start"] <= m["start"]) & (m["end"] <= o["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])
    most = lambda runs: let(kept(runs), lambda k: F.filter(k, lambda m: ~F.exists(k, lambda o: inside(m, o))))
    plain = lambda runs: F.transform(most(runs), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    spans = let(F.col("s"), lambda s: F.array_sort(F.concat(s["base"], plain(s["runs"]))))
    cols = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c != name]
    return found.select(*[F.col(i).alias(c) for i, c in cols], spans.alias(name))


def threshold(cells: list[tuple[int, int, int]], level: float) -> tuple[float, float]:
    """From counts (length, bin, count): the least weighted -log10 p that is reported, and the mean length.

    A bin stands for its largest p, so the procedure errs towards reporting less.
    """
    m = sum(c for _, _, c in cells)
    if not m:
        return math.inf, 1.0
    mean = sum(n * c for n, _, c in cells) / m
    rank, cut = 0, math.inf
    for x, c in sorted(((b / 100 + math.log10(n / mean), c) for n, b, c in cells), reverse=True):
        rank += c
        if 10**-x <= level * rank / m:
            cut = x - 1e-9  # what Spark adds up may differ in the last digit
    return cut, mean


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text: str = "text", level: float = 0.05, mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """Replaces every span in the text by `mark`; overlapping spans are one. Null texts stay null; the columns stay.

    A column `length`, if there is one, is counted again where a text changes. For other cases see `scan`.
    """
    body = F.col(f"`{text}`").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        # a span that begins inside the one before has been marked with it
        out = F.when(s["end"] <= acc["at"], acc["out"]).when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("__secrets", start, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.greatest(F.length(body) - a["at"], F.lit(0)))))
    hit = F.size("__secrets") > 0
    out = scan(docs, text=text, level=level, name="__secrets").withColumn(text, F.when(hit, done).otherwise(body))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(hit, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.drop("__secrets")
