"""Secret scans: three fixed kinds by pattern, and random-looking strings by a battery of randomness tests.

The main path uses DataFrame functions only. A candidate is a run of at least 20 characters of the base64 alphabets.
Its encoding is inferred (decimal, hexadecimal, letters of one case with digits, base64) and three tests ask whether it
is a random string over that alphabet: chi-squared of the letters' uniformity, runs of the alphabet's two halves, and
correlation of successive letters. A candidate that none rejects is random-looking. Short text can look random too, so
the chance is computed, by length, that text with the corpus's own letter frequencies gets so small a chi-squared; the
Benjamini-Hochberg rule over all candidates of the corpus then bounds the share of text among what is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_written, table, written

# Patterns of the base kinds and the least characters of a match (of its value for assign).
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]"
HEX = r"[0-9a-f]"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

DIGITS = "0123456789"
#: Candidates: runs of these characters, at least so many.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings from the smallest: the alphabet, and how each character is told apart (case folded or not).
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", DIGITS + LOWER), ("upper", DIGITS + UPPER), ("letters", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/_-"),
)
#: A test rejects randomness below this chance; text among the reported is held below this share.
REJECT, FALSE_SHARE = 0.001, 0.01
#: Chances of text are counted in bins of -log10, a bound on what the rule reads: STEP bins for a power of ten.
STEP, BINS = 10, 600

SPAN = "struct<start:long,end:long,kind:int>"
WORD_SPAN = "struct<start:long,end:long,kind:int,word:string>"


#: Long arrays are folded in chunks of so many elements, so that the work stays in proportion to the array. Characters of a
#: long string that are looked at in one array.
CHUNK, CHARACTERS = 64, 4096


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, op, zero: int) -> Column:
    """For each of the longs, the fold by op, which is associative, of those before it."""
    begun = F.lit(zero).cast("long")
    steps = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))

    def folded(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, begun, op))
        bases = F.aggregate(totals, F.array(begun), lambda acc, t: F.concat(acc, F.array(op(F.element_at(acc, -1), t))))
        inside = lambda c, b: F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i), b, op))
        return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), inside))

    cut = lambda v: F.when(F.size(v) > 0, _let(F.transform(steps(F.size(v)), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK))), folded)).otherwise(v)
    return _let(values, cut)


def _spans(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Spans of successive matches in code points, each with its word: the group of that number."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    words = found if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match"), words.alias("word")), lambda z: z["match"].isNotNull())
    sizes = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).cast("long").alias("gap"), F.length(z["match"]).cast("long").alias("size"), z["word"].alias("word")))

    def placed(zs: Column) -> Column:
        def span(z: Column, at: Column) -> Column:
            return F.struct((at + z["gap"]).alias("start"), (at + z["gap"] + z["size"]).alias("end"), F.lit(kind).alias("kind"), z["word"].alias("word"))

        return F.zip_with(zs, before(F.transform(zs, lambda z: z["gap"] + z["size"]), lambda a, v: a + v, 0), span)

    return _let(sizes, placed)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(a["kind"] - b["kind"])


def base_spans(text: Column) -> Column:
    """All spans of the base kinds, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    low = F.lower(text)
    named = F.contains(low, F.lit(ASSIGN_WORDS[0]))
    for w in ASSIGN_WORDS[1:]:
        named = named | F.contains(low, F.lit(w))
    assign = F.when(named, _bare(F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["word"]) >= MIN_ASSIGN))).otherwise(none)
    # A run of these characters is matched whole, so that asking for its least length finds the same matches.
    access = F.when(F.contains(text, F.lit("AKIA")), _bare(_spans(text, f"{ACCESS}{{{MIN_ACCESS - 4},}}", 1))).otherwise(none)
    hexes = F.when(text.rlike(f"{HEX}{{{MIN_HEX}}}"), _bare(_spans(text, f"{HEX}{{{MIN_HEX},}}", 2))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes), _by_start)


def candidate_spans(text: Column) -> Column:
    """Spans of candidates with their strings."""
    return F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3)).otherwise(F.array().cast(f"array<{WORD_SPAN}>"))


def outside(candidates: Column, base: Column) -> Column:
    """Candidates that lie in no base span; both are in order of start, and one pass over both decides."""
    marked = F.concat(F.transform(base, lambda b: F.struct(b["start"], b["end"], F.lit(-1).alias("kind"), F.lit("").alias("word"))), candidates)

    def alone(xs: Column) -> Column:
        reach = before(F.transform(xs, lambda s: F.when(s["kind"] < 0, s["end"]).otherwise(F.lit(-1).cast("long"))), lambda a, v: F.greatest(a, v), -1)
        judged = F.zip_with(xs, reach, lambda s, r: F.struct(s.alias("s"), ((s["kind"] >= 0) & (s["end"] > r)).alias("alone")))
        return F.transform(F.filter(judged, lambda j: j["alone"]), lambda j: j["s"])

    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), _let(F.array_sort(marked, _by_start), alone)).otherwise(candidates)


def _normal_tail(z: Column) -> Column:
    """Chance that a standard normal value is above z (Abramowitz and Stegun 26.2.17; far out its leading term)."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(word: Column) -> Column:
    """Number of the smallest alphabet that holds the word."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(word.rlike(f"^[{ENCODINGS[k][1]}]+$"), F.lit(k)).otherwise(out)
    return out


def _pick(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), encoding + 1)


def battery(word: Column, repeat: list[float]) -> Column:
    """struct(random: no test rejects, bin: -log10 of the chance under text, in bins) of a candidate.

    repeat: for each encoding, the chance that two letters of text are equal. Time is in proportion to the word, and what is
    held beside it is an array of CHARACTERS letters.
    """
    letters = F.array(*[F.lit(c) for c in UPPER + LOWER + DIGITS + "+/_-"])
    halves = ["".join("01"[i >= len(a) // 2] for i in range(len(a))) for _, a in ENCODINGS]

    def translated(w: Column, encoding: Column) -> Column:
        out = F.translate(w, ENCODINGS[-1][1], halves[-1])
        for k in range(len(ENCODINGS) - 1):
            out = F.when(encoding == k, F.translate(w, ENCODINGS[k][1], halves[k])).otherwise(out)
        return out

    def counted(w: Column, n: Column, order: Column) -> Column:
        """From the occurrences of each letter, by the length that is lost without it: their squares, and sums of the letters'
        places in the alphabet and of their squares."""

        def add(acc: Column, letter: Column) -> Column:
            both = F.struct((n - F.length(F.replace(w, letter, F.lit("")))).alias("count"), F.instr(order, letter).cast("double").alias("place"))
            more = lambda b: F.struct((acc["even"] + b["count"] * b["count"]).alias("even"), (acc["sum"] + b["count"] * b["place"]).alias("sum"), (acc["squares"] + b["count"] * b["place"] * b["place"]).alias("squares"))
            return _let(both, more)

        return F.aggregate(letters, F.struct(*[F.lit(0.0).alias(c) for c in ("even", "sum", "squares")]), add)

    def neighbours(w: Column, order: Column) -> Column:
        """The sum of products of successive places, with the first and the last place."""

        def one(acc: Column, p: Column) -> Column:
            return F.when(p == 0, acc).otherwise(F.struct((acc["products"] + acc["last"] * p).alias("products"), F.when(acc["first"] == 0, p).otherwise(acc["first"]).alias("first"), p.alias("last")))

        places = lambda chunk: F.transform(F.split(chunk, ""), lambda c: F.when(c == "", F.lit(0.0)).otherwise(F.instr(order, c).cast("double")))
        begun = F.struct(*[F.lit(0.0).alias(c) for c in ("products", "first", "last")])
        return F.aggregate(F.regexp_extract_all(w, F.lit(f".{{1,{CHARACTERS}}}"), F.lit(0)), begun, lambda acc, chunk: F.aggregate(places(chunk), acc, one))

    def read(c: Column) -> Column:
        """The statistic of uniformity, the letters' halves and the sums."""
        w, n, k, size, order = c["word"], c["n"], c["encoding"], c["size"], c["order"]
        found = lambda x: F.struct(n.alias("n"), k.alias("k"), size.alias("size"), (x["even"] * size / n - n).alias("chi2"), translated(w, k).alias("halves"), x.alias("x"), neighbours(w, order).alias("y"))
        return _let(counted(w, n, order), found)

    def judged(r: Column) -> Column:
        n, size, chi2, x, y = r["n"], r["size"], r["chi2"], r["x"], r["y"]
        # Wilson and Hilferty's cube root makes chi-squared nearly normal.
        z_chi2 = (F.cbrt(chi2 / (size - 1)) - (1 - 2 / (9 * (size - 1)))) / F.sqrt(2 / (9 * (size - 1)))
        ones = F.length(F.replace(r["halves"], F.lit("0"), F.lit(""))).cast("double")
        lost = lambda t: (n - F.length(F.replace(r["halves"], F.lit(t), F.lit("")))) / 2
        both = 2 * ones * (n - ones)
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (lost("01") + lost("10") + 1 - (both / n + 1)) / F.sqrt(spread)).otherwise(F.lit(99.0))
        # Moments about the mean from the plain sums.
        mean = x["sum"] / n
        variance = x["squares"] - n * mean * mean
        serial = y["products"] - mean * (2 * x["sum"] - y["first"] - y["last"]) + (n - 1) * mean * mean
        z_serial = F.when(variance > 0, (serial / variance + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        random = F.least(_normal_tail(z_chi2), 2 * _normal_tail(F.abs(z_runs)), 2 * _normal_tail(F.abs(z_serial))) * 3 >= REJECT
        # Under text chi2 is about noncentral: its mean and variance follow from the length and from equal letters.
        beyond = F.greatest(_pick(r["k"], repeat) * size - 1, F.lit(0.0)) * (n - 1)
        under = (chi2 - (size - 1 + beyond)) / F.sqrt(2 * (size - 1) + 4 * beyond)
        chance = F.greatest(_normal_tail(-under), F.lit(10.0 ** (-BINS / STEP)))
        return F.struct(random.alias("random"), F.floor(-F.log10(chance) * STEP).cast("int").alias("bin"))

    def begun(k: Column) -> Column:
        return F.struct(word.alias("word"), F.length(word).cast("double").alias("n"), k.alias("encoding"), _pick(k, [float(len(a)) for _, a in ENCODINGS]).alias("size"), _pick(k, [a for _, a in ENCODINGS]).alias("order"))

    return _let(_let(_let(_encoding(word), begun), read), judged)


def text_repeat(words: DataFrame) -> list[float]:
    """By encoding, the chance that two letters of text are equal, from the letters of all candidates that hold no digit
    (a row for each letter reaches the driver). Alphabets without letters take that of their digits as even."""
    letters = words.filter(~F.col("word").rlike("[0-9]")).select(F.explode(F.split("word", "")).alias("c")).filter(F.col("c") != "").groupBy("c").agg(F.count("*").alias("n"))
    count = {r["c"]: r["n"] for r in letters.collect()}
    fold = [str.lower, str.upper]
    out = []
    for name, alphabet in ENCODINGS:
        folded: dict[str, int] = {}
        for c, n in count.items():
            options = [c] if {"a", "A"} <= set(alphabet) else [f(c) for f in fold]
            for o in options:
                if o in alphabet:
                    folded[o] = folded.get(o, 0) + n
                    break
        total = sum(folded.values())
        out.append(max(sum(v * v for v in folded.values()) / total**2 if total else 0.0, 1.0 / len(alphabet), {"decimal": 0.2, "hex": 0.2, "HEX": 0.2}.get(name, 0.06)))
    return out


def false_discovery_bin(words: DataFrame, repeat: list[float]) -> int:
    """The least bin that the Benjamini-Hochberg rule admits, or one beyond the last. At most BINS + 1 rows reach the driver."""
    result = words.select(battery(F.col("word"), repeat).alias("b"))
    counts = result.groupBy("b.bin").agg(F.count("*").alias("n"), F.count_if("b.random").alias("random")).collect()
    every, found, least = sum(r["n"] for r in counts), 0, BINS + 1
    for r in sorted(counts, key=lambda r: -r["bin"]):
        found += r["random"]
        if found and 10.0 ** (-r["bin"] / STEP) * every <= FALSE_SHARE * found:
            least = r["bin"]
    return least


def scan_secrets(docs: DataFrame) -> DataFrame:
    """row_ (a struct of the columns of docs), base and spans: arrays of (start, end, kind) in code points, end exclusive.

    base: spans of the fixed kinds assign, access and hex by start, then kind; spans: these and the random-looking
    candidates that lie in none of them. Null and empty texts have none; long texts are scanned whole, in time that is in
    proportion to them. Row by row: repeated rows give equal results, and an empty table gives no rows. Columns of docs
    that are called as results stay in row_. The corpus enters through two bounded tables, letter counts and bins of
    chances; the candidates' strings are written once for both.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("text").filter(F.col("text").rlike(CANDIDATE)).select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("word"))
    words = written(words, "candidates")
    repeat = text_repeat(words)
    least = false_discovery_bin(words, repeat)
    drop_written(words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), text.alias("text_")).withColumn("base", base_spans(F.col("text_")))

    def reported(c: Column) -> Column:
        return _let(battery(c["word"], repeat), lambda b: b["random"] & (b["bin"] >= least))

    more = _bare(F.filter(outside(candidate_spans(F.col("text_")), F.col("base")), reported))
    return rows.withColumn("spans", F.array_sort(F.concat("base", more), _by_start))


MARK = "[secret]"


def redact(text: Column, spans: Column) -> Column:
    """text with a mark in place of each run of overlapping spans, which are in order of start.

    The text is cut into chunks of CHARACTERS code points, so that a piece is read from its chunk and not from the start.
    """

    reach = before(F.transform(spans, lambda s: s["end"]), lambda a, v: F.greatest(a, v), 0)
    cut = F.zip_with(spans, reach, lambda s, r: F.struct(r.alias("from"), s["start"].alias("to")))
    gaps = F.filter(cut, lambda g: g["to"] >= g["from"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first, final = F.floor(a / CHARACTERS).cast("int"), F.floor(b / CHARACTERS).cast("int")
        at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        begin = (a - first * CHARACTERS + 1).cast("int")
        inside = F.substr(at(first), begin, (b - a).cast("int"))
        across = F.concat(F.substr(at(first), begin, F.lit(CHARACTERS)), F.array_join(F.slice(chunks, first + 2, F.greatest(final - first - 1, F.lit(0))), ""), F.substr(at(final), F.lit(1), (b - final * CHARACTERS).cast("int")))
        return F.when(first == final, inside).otherwise(across)

    def rebuilt(chunks: Column) -> Column:
        ends = F.concat(gaps, F.array(F.struct(last.alias("from"), F.length(text).cast("long").alias("to"))))
        return F.array_join(F.transform(ends, lambda g: piece(chunks, g["from"], g["to"])), MARK)

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0)), rebuilt)).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every reported span of text replaced by a mark; null texts stay null, empty ones empty.

    Rows that repeat stay as often as they were; an empty table gives none; other columns, whatever they are called, are not
    touched.
    """
    found = scan_secrets(docs)
    return found.select(*[redact(F.col("row_.text"), F.col("spans")).alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns])


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("row_.doc_id", count(0), count(1), count(2), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
