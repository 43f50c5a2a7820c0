"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. The models are fitted on labelled samples (string, whether it is random) of bounded size and
enter the plan as one table of log-likelihood ratios by pair of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fresh, table, text_of

KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:int,rank:int,end:int,match:string>>"
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest length stands in the pattern: a shorter run has no longer match inside it.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What a model sees: every character of a candidate, and any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: Mean log-likelihood ratio per character pair, in nats, from which a candidate counts as random.
THRESHOLD = 0.35
#: Rulers and padding are no secrets: a candidate has at least this many different characters.
DISTINCT = 8
#: Inside a run, a stretch ends where its sum of ratios above the threshold has fallen by so many nats from its top.
DROP = 10.0
#: A stretch from so many characters on counts: chance makes the ends of a random string look ordinary.
SHORTEST, LEAST = 16, 20

#: Labelled sample of ordinary identifiers: these stems, alone and in pairs in the usual styles.
STEMS = (
    "the of and that for with this from which their about would there people because information between development "
    "company number system program question government national university international community important "
    "get set list user name file path data value index count total result response request server client config option "
    "handler manager service controller buffer string object array length size version default message error status "
    "die der und nicht werden einer eine haben sich auch einen wissenschaft gesellschaft entwicklung verwaltung sicherheit "
    "les des une dans pour avec sont cette gouvernement organisation question niveau pendant toujours maintenant "
    "los las para como pero sobre entre tambien nacional informacion gobierno desarrollo universidad empresa ciudad"
).split()


def samples(spark: SparkSession) -> DataFrame:
    """The default labelled samples: 6000 random strings by rule from a hash, and pairs of stems in seven styles (string, random)."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.base64(F.unhex(digest))
    random = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.substr(digest, F.lit(1), F.lit(40))).when(F.col("id") % 3 == 1, plain).otherwise(F.translate(plain, "+/=", "")).alias("string"), F.lit(True).alias("random")
    )
    stems, n = F.array(*[F.lit(s) for s in STEMS]), len(STEMS)
    pairs = spark.range(n * n).select(F.get(stems, F.floor(F.col("id") / n).cast("int")).alias("a"), F.get(stems, (F.col("id") % n).cast("int")).alias("b"))
    styles = F.array(F.concat("a", "b"), F.concat_ws("_", "a", "b"), F.concat_ws("-", "a", "b"), F.concat("a", F.initcap("b")), F.concat(F.upper("a"), F.lit("_"), F.upper("b")), F.concat("a", F.lit("/"), "b"), F.concat("a", F.lit("_2024")))
    return random.unionByName(pairs.select(F.explode(styles).alias("string"), F.lit(False).alias("random")))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place(character: Column) -> Column:
    """0-based place of a character in the alphabet; the last one for any other."""
    found = F.instr(F.lit(ALPHABET), character)
    return F.when(found == 0, SIDE - 1).otherwise(found - 1)


def fit(labelled: DataFrame, most: int = 200_000) -> list[float]:
    """Fit both models on at most ``most`` labelled rows (string, random); row-major log-likelihood ratios by pair.

    First-order chains with add-half smoothing. Of a larger sample those with the least hashes are taken, so that the fit
    is the same each time; the default one is below the bound. Null strings, and strings of one character, add nothing; an
    empty sample gives ratios of zero.
    """
    rows = labelled.filter(F.col("string").isNotNull() & F.col("random").isNotNull()).select("string", "random")
    if rows.count() > most:
        rows = rows.orderBy(F.xxhash64("string", "random")).limit(most)
    pair = F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.substr("string", i, F.lit(2)))
    counted = rows.filter(F.length("string") > 1).select("random", F.explode(pair).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {True: [[0.5] * SIDE for _ in range(SIDE)], False: [[0.5] * SIDE for _ in range(SIDE)]}
    at = {c: i for i, c in enumerate(ALPHABET)}
    for r in counted:
        counts[r["random"]][at.get(r["pair"][0], SIDE - 1)][at.get(r["pair"][1], SIDE - 1)] += r["count"]
    table_ = []
    for a in range(SIDE):
        high, low = sum(counts[True][a]), sum(counts[False][a])
        table_ += [round(math.log(counts[True][a][b] / high * low / counts[False][a][b]), 6) for b in range(SIDE)]
    return table_


def ratios_of(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratios of a token's pairs of characters, in order."""
    grid = F.array(*[F.lit(x) for x in ratios])
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), place)
    paired = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a * SIDE + b)
    return F.transform(let(places, paired), lambda i: F.get(grid, i))


def mean(values: Column) -> Column:
    """Mean log-likelihood ratio; positive: rather random."""
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(values), F.lit(1))


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters."""
    return let(ratios_of(token, ratios), mean)


def stretches(values: Column, threshold: float) -> Column:
    """Array of (first, end), 0-based characters, of the stretches of a run whose mean exceeds ``threshold``.

    One pass over the run's ratios less the threshold: a stretch goes from where the sum was last zero to the sum's top, and
    is closed where the sum is no longer positive or has fallen by :data:`DROP`. Stretches of :data:`SHORTEST` characters or
    more are widened to :data:`LEAST`, to the side that scores higher, and judged by their own mean.
    """
    empty = F.array().cast("array<struct<first:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), empty.alias("found"))

    def closed(s):
        return F.when(s["last"] - s["first"] + 1 >= SHORTEST, F.concat(s["found"], F.array(F.struct(s["first"].alias("first"), (s["last"] + 1).alias("end"))))).otherwise(s["found"])

    def added(s, x):
        total = s["sum"] + x - F.lit(threshold)
        return F.struct((s["at"] + 1).alias("at"), s["first"].alias("first"), F.when(total > s["top"], s["at"] + 1).otherwise(s["last"]).alias("last"), total.alias("sum"), F.greatest(total, s["top"]).alias("top"), s["found"].alias("found"))

    def settled(s):
        fresh = F.struct(s["at"].alias("at"), s["at"].alias("first"), s["at"].alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), closed(s).alias("found"))
        return F.when((s["sum"] <= 0) | (s["top"] - s["sum"] > DROP), fresh).otherwise(s)

    step = lambda s, x: let(added(s, x), settled)
    n = F.size(values) + 1

    def widened(w):
        short = F.greatest(LEAST - (w["end"] - w["first"]), F.lit(0))
        begin, end = F.greatest(w["first"] - short, F.lit(0)), F.least(w["end"] + short, n)
        left = F.struct(begin.alias("first"), F.greatest(w["end"], begin + LEAST).alias("end"))
        right = F.struct(F.least(w["first"], end - LEAST).alias("first"), end.alias("end"))
        judged = F.transform(F.array(left, right), lambda v: F.struct(mean(F.slice(values, v["first"] + 1, v["end"] - v["first"] - 1)).alias("mean"), v["first"].alias("first"), v["end"].alias("end")))
        return F.array_max(judged)

    wide = F.filter(F.transform(F.aggregate(values, start, step, closed), widened), lambda w: w["mean"] > threshold)
    return F.transform(wide, lambda w: F.struct(w["first"].alias("first"), w["end"].alias("end")))


def random_in(run: Column, ratios: list[float], threshold: float) -> Column:
    """What is random in a span of a run of token characters, as array of spans: the run if it is as a whole, or its stretches."""
    varied = lambda m: F.size(F.array_distinct(F.split(m, ""))) >= DISTINCT

    def judged(values):
        part = lambda w: F.struct((run["start"] + w["first"]).alias("start"), run["rank"].alias("rank"), (run["start"] + w["end"]).alias("end"), F.substr(run["match"], w["first"] + 1, w["end"] - w["first"]).alias("match"))
        return F.when(mean(values) > threshold, F.array(run)).otherwise(F.filter(F.transform(stretches(values, threshold), part), lambda s: varied(s["match"])))

    found = let(ratios_of(run["match"], ratios), judged)
    return F.when(varied(run["match"]), found).otherwise(F.array().cast(SPANS))


#: Elements that one fold gathers: what it has gathered is copied at each step, so long arrays are folded in parts.
PART = 128


def _folded(values: Column, join) -> Column:
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    step = lambda s, x: F.struct(join(s["sum"], x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
    return F.aggregate(values, start, step, lambda s: s["all"])


def running(values: Column, join=lambda x, y: x + y, depth: int = 2) -> Column:
    """For each of an array of integers what ``join`` (a sum or a maximum, from 0) makes of those before it.

    In time linear in the array: parts are folded by themselves, and what the parts before them make is added.
    """
    if not depth:
        return _folded(values, join)

    def by_part(v):
        at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / PART).cast("int"), F.lit(0)))
        parts = F.transform(at, lambda i: F.slice(v, i * PART + 1, F.lit(PART)))
        whole = lambda p: F.aggregate(p, F.lit(0), join)

        def placed(p):
            before = running(F.transform(p, whole), join, depth - 1)
            return F.flatten(F.zip_with(p, before, lambda part, b: F.transform(_folded(part, join), lambda x: join(x, b))))

        return let(parts, placed)

    return let(values, by_part)


def find(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, rank, end, match), in code points.

    The matches and the gaps between them come from two passes of the same pattern; running sums give the places.
    """
    empty = F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))), lambda h, g: F.struct(F.length(g).alias("gap"), h.alias("match")))

    def span(x, before):
        begin = before + x["gap"]
        return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (begin + F.length(x["match"])).alias("end"), x["match"].alias("match"))

    def place_all(found):
        before = running(F.transform(found, lambda x: x["gap"] + F.length(x["match"])))
        return F.zip_with(found, before, span)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(both, place_all)).otherwise(empty)


#: Code points of the stretches that a text is cut into, so that reaching a place costs no walk from its beginning.
STRETCH = 1024


def between(chunks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` of a text that is cut into ``chunks``; empty if there are none."""
    a, b = F.floor(begin / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
    own = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    apart = F.concat(F.substr(own(a), begin % STRETCH + 1), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substr(own(b), F.lit(1), end % STRETCH))
    return F.when(end <= begin, "").when(a == b, F.substr(own(a), begin % STRETCH + 1, end - begin)).otherwise(apart)


def replaced(text: Column, spans: str, body) -> Column:
    """``text`` with each of ``spans``, sorted by start, replaced by ``body(span, end of those before)``; each place is cut once."""

    def by_chunks(chunks):
        def cut(before):
            pieces = F.zip_with(F.col(spans), before, lambda s, b: F.concat(between(chunks, b, s["start"]), body(s, b)))
            tail = between(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
            return F.concat(F.array_join(pieces, ""), tail)

        return let(running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), cut)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), F.lit(0)), by_chunks)).otherwise(text)


def blanked(text: Column, spans: str) -> Column:
    """``text`` with a blank for each character that ``spans`` cover, so that all places stay."""
    return replaced(text, spans, lambda s, before: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0))))


def scan(docs: DataFrame, ratios: list[float] | None = None, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, match) by start, then rank (:data:`KINDS`).

    ``base_spans`` are the matches of the fixed patterns; ``spans`` adds what the models call random in runs of 20 or more
    token characters that base spans leave: the run if its mean exceeds ``threshold``, else those of its stretches whose
    mean does, so that a path or name around a secret does not hide it. Both have 8 different characters or more. One
    narrow projection, in time linear in a text's length and matches; null text counts as empty, repeated rows are scanned
    each, an empty table gives no rows; columns of these two ``names`` are replaced, others stay.
    """
    base_name, all_name = names
    if ratios is None:
        ratios = fit(samples(docs.sparkSession))
    t = text_of(text)
    value = lambda m: F.regexp_extract(m, "^" + ASSIGN, 1)
    assign = F.filter(find(t, ASSIGN, "assign"), lambda s: F.length(value(s["match"])) >= 8)
    base = F.array_sort(F.concat(assign, find(t, ACCESS, "access"), find(t, HEX, "hex")))
    first = docs.withColumn(base_name, base)
    runs = let(blanked(t, base_name), lambda x: find(x, CANDIDATE, "markov"))
    likely = F.flatten(F.transform(runs, lambda r: random_in(r, ratios, threshold)))
    return first.withColumn(all_name, F.array_sort(F.concat(base_name, likely)))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each stretch of text that spans cover replaced by ``mark``; overlapping spans are one stretch.

    Null texts stay null, repeated rows are redacted each, an empty table gives no rows; all other columns stay, whatever
    their names.
    """
    base_name, all_name = fresh(docs.columns, "base_spans", "all_spans")
    found = scan(docs, names=(base_name, all_name), **options)
    changed = replaced(F.col("text"), all_name, lambda s, before: F.when(s["start"] >= before, mark).otherwise(""))
    return found.withColumn("text", changed).drop(base_name, all_name)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` following the text; other columns stay."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])
