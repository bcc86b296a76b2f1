"""Secret scans: patterns, and a battery of randomness tests. DataFrame functions only.

Base spans come from three patterns. The battery looks at every other run of token characters of at
least MIN_LENGTH that has a letter ("=" counts only as padding, so the value of key=value is a run of its own). Its encoding is inferred (hex, base 32, base 36,
base 64) and with it the alphabet; three tests ask whether the run looks like uniform draws from
that alphabet: chi-squared of the symbol counts, Wald-Wolfowitz runs above and below the middle of
the alphabet, and lag-1 serial correlation. Each gives a two-sided normal p-value (chi-squared by
Wilson-Hilferty); the smallest, times three, is the run's. Benjamini-Hochberg then declares runs
non-random at level FDR within each class of lengths, so that short runs, on which the tests have
little power, do not share the threshold of long ones. p-values are counted in bins of their
logarithm for this, BINS to a power of ten: an aggregate of bounded size in which small p-values
keep their rank, each taken as its bin's largest (at most 2.4 % more). What is not declared non-random is a secret span of kind `random`.

The text is read twice: for the runs, which are few and are checkpointed with a key of their row, and for the base spans of the result.

Defined results: null or empty texts have no spans; repeated rows give repeated results; rows with null or shared ids
have the spans of their own text; a run that
overlaps a base span is left to it; empty tables give no rows; extra columns are ignored unless named in `keep`, where names of results are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs; runs below the length would be dropped anyway, so the pattern asks for it.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: "=" is padding at the end of a run only; elsewhere it parts a key from its value.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
MIN_LENGTH, FDR, BINS = 24, 0.01, 100
SPAN = "array<struct<start:int,stop:int,text:string>>"
#: Values that one step of a sum over an array takes together; 128 * 128 make a long text's spans cheap.
BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it, also in lambdas of its own."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(values: Column, of) -> Column:
    """of(block) for consecutive blocks of BLOCK values: what grows an array step by step copies a block at most."""
    return let(values, lambda v: F.transform(F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda b: of(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))))


def spans(text: Column, pattern: str, keep) -> Column:
    """start, stop (code points, end exclusive) and text of the leftmost non-overlapping matches for which keep(match) holds.

    Positions are sums of the lengths before: summed within blocks, then over blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {SPAN})")
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"), F.length(m).alias("n")))
    parts = F.filter(parts, lambda p: p["m"].isNotNull())

    def add(s: Column, p: Column) -> Column:
        a = s["at"] + p["g"]
        one = F.struct(a.alias("start"), (a + p["n"]).alias("stop"), p["m"].alias("text"))
        return F.struct((a + p["n"]).alias("at"), F.when(keep(p["m"]), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    def placed(of: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(of, first, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(of, before, lambda b, o: F.transform(b["out"], lambda t: F.struct((t["start"] + o).alias("start"), (t["stop"] + o).alias("stop"), t["text"].alias("text")))))

    each = blocks(parts, lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), add))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(each, placed)).otherwise(none)


def two_sided(z: Column) -> Column:
    """p of |z| under a normal law: Borjesson and Sundberg's form of its tail, good to 0.3 % of p; never 0."""
    x = F.least(F.abs(z), F.lit(30.0))
    return F.least(F.lit(1.0), F.exp(-x * x / 2) * 0.7978845608 / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))


def battery(token: Column) -> dict[str, Column]:
    """kind (inferred encoding, null if none) and p of one token."""
    kind = (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), F.lit(16))
        .when(token.rlike("^[A-Z2-7]+=*$"), F.lit(32))
        .when(token.rlike("^[a-z0-9]+$") | token.rlike("^[A-Z0-9]+$"), F.lit(36))
        .when(token.rlike("^[A-Za-z0-9+/_-]+=*$"), F.lit(64))
    )
    order = F.when(kind == 16, "0123456789abcdef").when(kind == 32, "abcdefghijklmnopqrstuvwxyz234567").when(kind == 36, "0123456789abcdefghijklmnopqrstuvwxyz").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    plain = F.when(kind == 64, plain).otherwise(F.lower(plain))
    return {"kind": kind, "codes": F.transform(F.split(plain, ""), lambda c: F.call_function("position", c, order) - 1)}


def _scored(tokens: DataFrame) -> DataFrame:
    """tokens (token) with p, as columns in steps so that each is computed once."""
    parts = battery(F.col("token"))
    df = tokens.withColumn("kind", parts["kind"]).where("kind is not null").withColumn("codes", parts["codes"])
    k, n = F.col("kind").cast("double"), F.size("codes").cast("double")
    sums = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c)
    df = df.withColumn("n", n).withColumn("mean", sums / n)
    squares = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("codes", lambda x: x == c)).cast("double"), 2))
    high = F.transform("codes", lambda c: F.when(c * 2 >= F.col("kind"), 1).otherwise(0))
    turns = F.zip_with(F.slice(high, F.lit(1), F.size("codes") - 1), F.slice(high, F.lit(2), F.size("codes") - 1), lambda a, b: F.abs(a - b))
    lag = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    df = df.withColumn("chi", squares * k / F.col("n") - F.col("n")).withColumn("runs", F.aggregate(turns, F.lit(1.0), lambda s, x: s + x)).withColumn("up", F.aggregate(high, F.lit(0.0), lambda s, x: s + x))
    df = df.withColumn("lag", F.aggregate(lag, F.lit(0.0), lambda s, x: s + x)).withColumn("var", F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.pow(c - F.col("mean"), F.lit(2.0))))
    v = k - 1
    z_chi = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / v, F.lit(1 / 3)) - (1 - 2 / (9 * v))) / F.sqrt(2 / (9 * v))
    down = F.col("n") - F.col("up")
    mu = 2 * F.col("up") * down / F.col("n") + 1
    spread = F.greatest((mu - 1) * (mu - 2) / F.greatest(F.col("n") - 1, F.lit(1.0)), F.lit(1e-3))
    z_runs = (F.col("runs") - mu) / F.sqrt(spread)
    z_lag = F.when(F.col("var") > 0, F.col("lag") / F.col("var") * F.sqrt("n")).otherwise(F.lit(30.0))
    return df.withColumn("p", F.least(F.lit(1.0), 3 * F.least(two_sided(F.greatest(z_chi, F.lit(0.0))), two_sided(z_runs), two_sided(z_lag))))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, keep, and arrays assign, access, hex, random of spans (start, stop, text)."""
    if clash := {"assign", "access", "hex", "random"} & {id_col, *keep}:
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ids may be null or shared: rows of one key have one id and text, and so the same spans
    row = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text).cast("binary"))
    kinds = [
        spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        spans(text, ACCESS, lambda m: F.length(m) >= 20).alias("access"),
        spans(text, HEX, lambda m: F.length(m) >= 24).alias("hex"),
    ]
    base = documents.select(id_col, *keep, row.alias("__row"), *kinds)
    runs = spans(text, TOKEN, lambda m: (F.length(m) >= MIN_LENGTH) & m.rlike("[A-Za-z]"))
    found = documents.where(text.rlike(TOKEN)).select(row.alias("row"), *kinds, runs.alias("tokens"))
    # a run is free if no base span of its row reaches into it: of those that begin before its end, the one that ends last
    each = F.concat(F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t.alias("t"))), F.transform(F.concat("assign", "access", "hex"), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.lit(None).alias("t"))))
    w = Window.partitionBy("row").orderBy("start", F.col("t").isNotNull())
    base_stop, base_start = F.when(F.col("t").isNull(), F.col("stop")), F.when(F.col("t").isNull(), F.col("start"))
    placed = found.where(F.size("tokens") > 0).select("row", F.explode(F.array_distinct(each)).alias("x")).distinct().select("row", "x.*")
    placed = placed.withColumn("before", F.max(base_stop).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.min(base_start).over(w.rowsBetween(0, Window.unboundedFollowing)))
    tokens = checkpointed(placed.where("t is not null and (before is null or before <= start) and (after is null or after >= stop)").select("row", "t"))
    distinct = tokens.select(F.col("t.text").alias("token")).distinct()
    scored = _scored(distinct).select("token", "p", F.least(F.floor(F.log2("n")), F.lit(12)).alias("size"), F.floor(F.log10("p") * -BINS).alias("bin"))
    # Benjamini-Hochberg from counts: p is over 1e-198, so at most 13 * 198 * BINS rows whatever the input
    counts = scored.groupBy("size", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("size")
    ranked = counts.withColumn("m", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(F.desc("bin"))))
    cut = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= F.col("upto") * FDR / F.col("m")).groupBy("size").agg(F.min("bin").alias("cut"))
    random = scored.join(F.broadcast(cut), "size", "left").where("cut is null or bin < cut").select("token")
    rows = tokens.join(random, F.col("t.text") == F.col("token")).groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_set("t")).alias("random"))
    return base.join(rows, "__row", "left").drop("__row").withColumn("random", F.coalesce("random", F.expr(f"cast(array() as {SPAN})")))


def _tagged(kind: str, i: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    ordered = F.array_sort(F.concat(*[_tagged(k, i) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(["assign", "access", "hex"]).cast("binary"), 256).alias("base_sha256"),
        _listed(["assign", "access", "hex", "random"]).alias("spans"),
    )


def redacted(text: Column, kinds: list[str], mark: str = "[SECRET]") -> Column:
    """text with every span of the columns `kinds` replaced; overlapping spans become one mark. A text with spans is taken apart into its characters once; its pieces are joined at the end."""
    ordered = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for k in kinds]))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(s: Column, x: Column) -> Column:
        """What remains of a span behind those before it; nothing is left of one that begins within them."""
        apart = F.struct(s["at"].alias("start"), x["start"].alias("stop"))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(apart))).otherwise(s["out"]).alias("out"))

    def joined(of: Column) -> Column:
        """of: the blocks of spans. Each block goes on where the furthest of those before it ends."""
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(of, first, lambda s, b: F.struct(F.greatest(s["at"], F.array_max(F.transform(b, lambda x: x["stop"]))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
        kept = lambda r: F.flatten(F.zip_with(of, r["out"], lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])))
        whole = lambda chars, r: F.concat(F.array_join(F.transform(kept(r), lambda g: F.concat(F.array_join(F.slice(chars, g["start"] + 1, g["stop"] - g["start"]), ""), F.lit(mark))), ""), F.array_join(F.slice(chars, r["at"] + 1, F.size(chars)), ""))
        return let(F.split(text, ""), lambda chars: let(starts, lambda r: whole(chars, r)))

    return F.when(F.size(ordered) > 0, let(blocks(ordered, lambda b: b), joined)).otherwise(text)
