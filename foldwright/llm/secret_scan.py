"""Secret scan: fixed patterns and a randomness test battery, in DataFrame functions only.

Base spans come from three patterns (assignments to secret-like names, access keys,
long hexadecimal runs).  Further spans, of kind ``random``, are tokens that look drawn
at random.  A token is 20 or more characters of the usual alphabets; ``=`` only pads its
end, so a value glued to its name (NAME=VALUE) is a token of its own.  It gets an
encoding inferred from its characters, and where ``_``, ``-``, ``/`` or ``+`` join names
or paths to it, so does every part between them of 16 or more; a part inside a token
that is reported whole is left out.  The symbols of each then take three tests against uniform draws
from that alphabet: chi-squared uniformity, number of runs about the alphabet's middle,
and lag-one serial correlation.  A token that fails one of them is not random.  For
the others the same statistics are held against ordinary text, whose symbols are
uneven and change half of the alphabet less often, and combined by Fisher's rule to a
p-value; longer tokens tell the two apart better.  The p-values are then controlled
for false discoveries by Benjamini and Hochberg within each stratum of encoding and
length (powers of two), over the whole table.

P-values are rounded up to quarter powers of ten, so each stratum's step-up needs only
counts by bin: at most strata x bins rows reach the driver, whatever the input.

Work grows in proportion to a text's length, however many matches it has and however
long they are: matches become rows, a window's running sum gives their positions, every
statistic is one pass over a token, and running bounds tell overlaps.  Equal texts are
scanned as one, told apart by two 64-bit hashes.  Only texts with a match are shuffled, over
``SALTS`` tasks a text where many rows share it.

Positions count code points, ends are exclusive.  Null and empty texts have no spans.
Rows are handled one by one, so repeated rows, null ids and very long texts are no matter.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The leftmost longest run is the same whether its length is asked for here or afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts of a token between separators; as long as a tested token's symbols must be.
PART = r"[A-Za-z0-9]{16,}"
MIN_ASSIGNED = 8

#: Encoding: pattern, alphabet in order, unevenness of ordinary text in it (k * sum p^2 - 1).
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 0.9),
    "HEX": (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 0.9),
    "base32": (r"^(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.2),
    "BASE36": (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.4),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    "base64": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.0),
}
#: How often neighbouring symbols of ordinary text lie in different halves of the alphabet.
TEXT_SWITCH = 0.3
#: A uniform draw fails one of the three tests about once in 700.
Z_LIMIT = 3.5
FALSE_DISCOVERY = 0.05
BINS_PER_DECADE, MOST_BIN = 4, 60

#: Tasks over which the rows of one text are spread, and characters that masking cuts a text into.
SALTS, BLOCK = 16, 4096
_HIT = "array<struct<kind:int,skip:int,n:int,told:int,group:string>>"


def _hits(text: Column, pattern: str, kind: int, need: Column, told: Column | None = None, keep: bool = False) -> Column:
    """A pattern's matches: the characters before each, since the last one, its own, and, if asked, the text of it.

    ``told`` is the list of another group's texts, of which the lengths are kept.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    skips = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    both = F.arrays_zip(found.alias("m"), (told if told is not None else found).alias("g"))

    def hit(x, skip):
        return F.struct(F.lit(kind).alias("kind"), skip.alias("skip"), F.length(x["m"]).alias("n"), F.length(x["g"]).alias("told"), (x["m"] if keep else F.lit("")).alias("group"))

    # the pieces between matches are one more than the matches
    hits = F.filter(F.zip_with(both, skips, hit), lambda h: h["n"].isNotNull())
    return F.when(need & text.rlike(pattern), hits).otherwise(F.array()).cast(_HIT)


def _needs(text: Column) -> dict[str, Column]:
    """What a match needs, by cheaper means first."""
    return {"assign": text.rlike("[:=]"), "access": F.contains(text, F.lit("AKIA")), "any": F.lit(True)}


def _has_match(text: Column) -> Column:
    needs = _needs(text)  # long hexadecimal runs are tokens too
    return text.rlike(TOKEN) | (needs["access"] & text.rlike(ACCESS)) | (needs["assign"] & text.rlike(ASSIGN))


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the hashes of ``text`` as k1 and k2."""
    return df.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _placed(hits: DataFrame, by: list[str]) -> DataFrame:
    """Start and end of every hit, from the running sum of what comes before it."""
    upto = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("end", F.sum(F.col("skip") + F.col("n")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("n"))


def _matches(docs: DataFrame) -> DataFrame:
    """k1, k2, copies, start, kind, end and group of every match of every different text."""
    text = F.col("text")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(_has_match(text))
    needs = _needs(text)
    assigned = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    hits = F.concat(
        _hits(text, ASSIGN, 0, needs["assign"], assigned), _hits(text, ACCESS, 1, needs["access"]),
        _hits(text, HEX, 2, needs["any"]), _hits(text, TOKEN, 3, needs["any"], keep=True),
    )
    rows = _keyed(texts).select("k1", "k2", F.posexplode(hits).alias("pos", "hit")).select("k1", "k2", "pos", "hit.*")
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    placed = _placed(rows, ["k1", "k2", "kind"]).where((F.col("kind") != 0) | (F.col("told") >= MIN_ASSIGNED))
    return placed.select("k1", "k2", "copies", "start", "kind", "end", "group")


def _tail(z: Column) -> Column:
    """P(N > z) by the rational approximation of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-30))


def _first_of(choices) -> Column:
    return reduce(lambda acc, c: acc.when(c[0], c[1]), choices[1:], F.when(choices[0][0], choices[0][1]))


def _parts(tokens: DataFrame) -> DataFrame:
    """Tokens and, where separators join them, their parts: k1, k2, copies, start, end and the symbols."""
    group = F.col("group")
    whole = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("skip"), F.lit(0).alias("n"), F.lit(0).alias("told"), group.alias("group"))
    every = F.concat(F.array(whole).cast(_HIT), _hits(group, PART, 3, group.rlike("[+/_-]"), keep=True))
    rows = tokens.select("k1", "k2", "copies", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.posexplode(every).alias("pos", "hit")).select("k1", "k2", "copies", "t_start", "t_end", "pos", "hit.*")
    placed = _placed(rows, ["k1", "k2", "t_start"])
    is_whole = F.col("kind") == -1
    start = F.col("t_start") + F.when(is_whole, 0).otherwise(F.col("start"))
    end = F.when(is_whole, F.col("t_end")).otherwise(F.col("t_start") + F.col("end"))
    core = F.translate(F.regexp_replace("group", "=+$", ""), "-_", "+/")
    return placed.select("k1", "k2", "copies", start.alias("start"), end.alias("end"), core.alias("core"))


def _battery(tokens: DataFrame) -> DataFrame:
    """Stratum and bin of every token with an encoding; bin 0 is not random."""
    of = lambda values: _first_of([(F.col("enc") == e, F.lit(v)) for e, v in values.items()])
    core = F.col("core")
    df = tokens.where(F.length("core") >= 16).withColumn("enc", _first_of([(core.rlike(p), F.lit(e)) for e, (p, _, _) in ENCODINGS.items()])).where(F.col("enc").isNotNull())
    df = df.withColumns({"alphabet": of({e: a for e, (_, a, _) in ENCODINGS.items()}), "uneven": of({e: u for e, (_, _, u) in ENCODINGS.items()}), "n": F.length("core").cast("double")})
    df = df.withColumn("k", F.length("alphabet").cast("double"))
    alphabet, half = F.col("alphabet"), F.col("k") / 2

    def step(acc, ch):
        v = (F.instr(alphabet, ch) - 1).cast("double")
        last = acc["last"]
        return F.struct(
            F.when(last < 0, v).otherwise(acc["first"]).alias("first"), v.alias("last"),
            (acc["sum"] + v).alias("sum"), (acc["squares"] + v * v).alias("squares"),
            (acc["lagged"] + F.when(last < 0, 0.0).otherwise(last * v)).alias("lagged"),
            (acc["low"] + F.when(v < half, 1.0).otherwise(0.0)).alias("low"),
            (acc["switches"] + F.when((last >= 0) & ((last < half) != (v < half)), 1.0).otherwise(0.0)).alias("switches"),
        )

    zero = F.struct(*[F.lit(x).alias(c) for c, x in (("first", -1.0), ("last", -1.0), ("sum", 0.0), ("squares", 0.0), ("lagged", 0.0), ("low", 0.0), ("switches", 0.0))])
    held = lambda ch: (F.length(core) - F.length(F.replace(core, ch, F.lit("")))).cast("double")
    df = df.withColumns({
        "s": F.aggregate(F.split("core", ""), zero, step),
        "even": F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda acc, ch: acc + held(ch) * held(ch)),
    }).select("k1", "k2", "copies", "start", "end", "enc", "uneven", "n", "k", "even", "s.*")
    k, n, low, switches = (F.col(c) for c in ("k", "n", "low", "switches"))
    df = df.withColumns({"chi": k / n * F.col("even") - n, "mean": F.col("sum") / n})
    chi, mean = F.col("chi"), F.col("mean")
    df = df.withColumns({
        "spread": F.col("squares") - n * mean * mean,
        "lagged": F.col("lagged") - mean * (2 * F.col("sum") - F.col("first") - F.col("last")) + (n - 1) * mean * mean,
        "both": 2 * low * (n - low),
        "fisher": -F.log(_tail((k - 1 + (n - 1) * F.col("uneven") - chi) / F.sqrt(2 * (k - 1) + 4 * n * F.col("uneven") * (1 + F.col("uneven")))))
        - F.log(_tail((switches - (n - 1) * TEXT_SWITCH) / F.sqrt((n - 1) * TEXT_SWITCH * (1 - TEXT_SWITCH)))),
    })
    both, fisher = F.col("both"), F.col("fisher")
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    z_runs = F.when(both > n, (switches - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
    z_lag = F.when(F.col("spread") > 0, (F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    log10p = (F.log1p(fisher) - fisher) / F.lit(2.302585092994046)
    bin_ = F.greatest(F.least(F.floor(-log10p * BINS_PER_DECADE), F.lit(MOST_BIN)), F.lit(0)).cast("int")
    random = (F.abs(z_chi) <= Z_LIMIT) & (F.abs(z_runs) <= Z_LIMIT) & (F.abs(z_lag) <= Z_LIMIT)
    stratum = F.concat_ws(":", "enc", F.floor(F.log2(n)).cast("string"))
    return df.select("k1", "k2", "copies", "start", "end", stratum.alias("stratum"), F.when(random, bin_).otherwise(0).alias("bin"))


def thresholds(tested: DataFrame) -> dict[str, int]:
    """Stratum -> least bin that Benjamini and Hochberg's step-up accepts, over the tokens of all documents."""
    counts = tested.groupBy("stratum", "bin").agg(F.sum("copies").alias("n")).collect()
    by: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counts:
        by[r["stratum"]][r["bin"]] = r["n"]
    out = {}
    for stratum, bins in by.items():
        total = sum(bins.values())
        passing = [b for b in bins if b > 0 and 10 ** (-b / BINS_PER_DECADE) * total <= FALSE_DISCOVERY * sum(n for c, n in bins.items() if c >= b)]
        if passing:
            out[stratum] = min(passing)
    return out


def find(docs: DataFrame) -> DataFrame:
    """A row for each different text with secrets: k1, k2, spans, gaps and last.

    ``spans`` are sorted (start, kind, end), kind an index of KINDS; ``gaps`` the stretches (to, from) of clean
    text before secrets, and ``last`` the end of the last secret.
    """
    matches = materialize(_matches(docs), "secret-matches")
    tested = materialize(_battery(_parts(matches.where("kind = 3"))), "secret-tests")
    base = matches.where("kind < 3").select("k1", "k2", "start", "kind", "end")
    limits = thresholds(tested)
    if limits:
        least = _first_of([(F.col("stratum") == k, F.lit(v)) for k, v in sorted(limits.items())])
        passed = tested.where(F.col("bin") >= least).select("k1", "k2", "start", F.lit(3).alias("kind"), "end")
        one = Window.partitionBy("k1", "k2")
        is_base = F.col("kind") < 3
        # a base span that began before ends behind the start, or the next one begins before the end
        before = F.max(F.when(is_base, F.col("end"))).over(one.orderBy("start", "kind", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0))
        behind = F.min(F.when(is_base, F.col("start"))).over(one.orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0))
        every = base.unionByName(passed).withColumns({"before": before, "behind": behind})
        free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("end")))
        every = every.where(is_base | free)
        # of a token and its own parts, the widest that passes
        wider = F.max(F.when(~is_base, F.col("end"))).over(one.orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
        every = every.withColumn("wider", wider).where(is_base | F.col("wider").isNull() | (F.col("wider") < F.col("end"))).select("k1", "k2", "start", "kind", "end")
    else:
        every = base
    reach = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("reach", F.coalesce(reach, F.lit(0)))
    gap = F.when(F.col("start") >= F.col("reach"), F.struct(F.col("start").alias("to"), F.col("reach").alias("from")))
    return every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"), F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("end").alias("last"))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``__found``: spans, gaps and last as in :func:`find`, null for a row without a match."""
    found = find(docs).select("k1", "k2", F.struct("spans", "gaps", "last").alias("__found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text.alias("text"))
    hit = _has_match(F.col("text"))
    some = _keyed(rows.where(hit)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    some = some.join(found, ["k1", "k2", "salt"], "left").select("row.*", "__found")
    return some.unionByName(rows.where(~hit).select("row.*", F.lit(None).cast(some.schema["__found"].dataType).alias("__found")))


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row."""
    df = scan(docs.select("doc_id", "text")).select("doc_id", F.coalesce("__found.spans", F.array()).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return df.select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), count(3).alias("n_random"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; texts without secrets, and nulls, stay as they are."""
    blocks = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    df = scan(docs).withColumn("__blocks", F.when(F.col("__found").isNotNull(), blocks))

    def cut(a, b):
        """Characters a to b, from the blocks that hold them."""
        first = F.floor(a / BLOCK).cast("int")
        held = F.slice("__blocks", first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
        return F.when(b > a, F.substr(F.array_join(held, ""), a % BLOCK + 1, b - a)).otherwise(F.lit(""))

    kept = F.transform("__found.gaps", lambda g: F.concat(cut(g["from"], g["to"]), F.lit(mask)))
    clean = F.concat(F.array_join(kept, ""), cut(F.col("__found.last"), F.length("text")))
    return df.select(*[F.when(F.col("__found").isNotNull(), clean).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
