"""Operator 7, quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import read_table, stage

#: A document of fewer words fails, and so does one with more than REPEATS hundredths of its words in repeated windows.
LEAST_WORDS = 50
REPEATS = 50
#: Groups of fewer documents take the estimate of their language.
LEAST_GROUP = 200
#: Languages of fewer documents, ten for each dimension, take the estimate over all documents.
LEAST_LANGUAGE = 50
#: Share of a group that the covariance determinant is minimised over.
COVER = 0.75
STEPS = 4
#: Fixed values of the chi-square law with 5 degrees of freedom: quantiles, and factors that make truncated covariances
#: consistent at the normal law, p / P(chi2 with 7 <= quantile of p with 5).
CHI2_975 = 12.8325
CONSISTENT_75 = 1.4119
CONSISTENT_975 = 1.0553
#: Squared distance beyond which a document is rejected; at the normal law fewer than two in 100 million lie beyond.
CUTOFF = 45.0
#: Bins a unit of a statistic, and bins a unit of the logarithm of a distance, in the histograms that give quantiles.
BINS = 64
#: Variance below which a statistic is not told apart, added to the diagonal. The shares of repeated lines and words get a
#: wide one: repetition by itself is left to the base rule and to deduplication.
FLOORS = (0.01, 0.0025, 0.09, 2.25, 2.25)
#: Parts up to which their models, of 21 numbers each, are broadcast; with more, rows are joined with them by part.
BROADCAST_PARTS = 20_000
DIMS = range(5)
PAIRS = [(i, j) for i in DIMS for j in DIMS if j <= i]

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def words_column(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included.

    Each window becomes one number, its hash above and its position below (as many bits as positions need). Sorted, equal
    windows are neighbours, whose words are compared; the positions of those that agree are sorted again and their cover is
    added up. Linear but for sorting.
    """
    n = F.size(words)

    def cover(bits: Column) -> Column:
        def hashed(i: Column) -> Column:
            h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        def twice(s: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, bits)
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            word = lambda x, d: F.get(words, x.bitwiseAND(low).cast("int") + d)
            same = lambda x, y: F.when(high(x) == high(y), (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))).otherwise(False)
            # Neighbours but one count too, so that another window of the same hash between two equal ones hides nothing.
            at = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 2)) | same(x, F.get(s, k - 2)))
            return F.sort_array(F.transform(at, lambda x: x.bitwiseAND(low)))

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), hashed))
        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("e"))
        step = lambda a, p: F.struct((a["c"] + p + 3 - F.greatest(a["e"], p)).alias("c"), (p + 3).alias("e"))
        return F.aggregate(let(windows, twice), start, step, lambda a: a["c"])

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(n.cast("long"))), cover))


def statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row."""
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("lang", "source")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *group, text.alias("text"))
    lines = let(F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
    )
    symbols = F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long")
    found = base.select("doc_id", "lang", "source", let(words_column(F.col("text")), words).alias("w"), symbols.alias("n_symbols"), lines.alias("l"))
    return found.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", F.col("l.n").cast("long").alias("n_lines"), (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"), "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: sizes and shares on logarithmic scales."""
    share = lambda part, whole: F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    mean = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    return [x.alias(f"x{i}") for i, x in enumerate([F.log1p("n_words"), mean, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")])]


def _quantile(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin by which the given share of each key's rows is reached. Histograms are exact counts and of bounded size."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"))
    step = lambda a, x: F.when(a["c"] >= F.ceil(F.col("n") * share), a).otherwise(F.struct((a["c"] + x["n"]).alias("c"), x["bin"].alias("b")))
    return listed.select(*keys, F.aggregate("h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("b")), step, lambda a: a["b"]).alias("bin"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    z: list[Column] = []
    for i in DIMS:
        r = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * F.col(f"z{j}")
        z.append(r / F.col(f"l{i}{i}"))
    return z


def _few(staged: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (else the staged table), of one row a part: broadcast if the staged table is counted to have few parts."""
    rows = staged if rows is None else rows
    return F.broadcast(rows) if staged.count() <= BROADCAST_PARTS else rows


def with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with d2; null where the staged model has no estimate."""
    out = rows.join(_few(model), "part", "left")
    for i, z in enumerate(_distance()):
        out = out.withColumn(f"z{i}", z)
    return out.select(*rows.columns, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS[1:]), F.col("z0") * F.col("z0")).alias("d2"))


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each part, from sums about a rough centre c0.. that rows carry."""
    moments = [F.avg(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"d{i}") for i in DIMS]
    moments += [F.avg((F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{j}") - F.col(f"c{j}"))).alias(f"q{i}{j}") for i, j in PAIRS]
    m = rows.groupBy("part").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in DIMS], *moments)
    m = m.select("part", *[(F.col(f"c{i}") + F.col(f"d{i}")).alias(f"m{i}") for i in DIMS], *[((F.col(f"q{i}{j}") - F.col(f"d{i}") * F.col(f"d{j}")) * factor + (FLOORS[i] if i == j else 0.0)).alias(f"v{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        v = F.col(f"v{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l{j}{j}"))
    return m.select("part", *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i, j in PAIRS])


def fit(stats: DataFrame, name: str = "quality") -> DataFrame:
    """The model: part, mean and Cholesky factor, one row for each part (language and source, language, or all) of enough documents.

    Rows have part and x0..x4. Start: binned medians and median absolute deviations. Then concentration steps: the share
    COVER of each part that lies nearest gives the next mean and covariance. Last, a reweighted estimate from the documents
    within the 97.5 % ellipsoid. Only histograms and sums are shuffled; nothing goes to the driver.
    """
    long = lambda df, cols: df.select("part", F.posexplode(F.array(*cols)).alias("i", "x"))
    wide = lambda df, p: df.groupBy("part").agg(*[F.max(F.when(F.col("i") == i, (F.col("bin") + 0.5) / BINS)).alias(f"{p}{i}") for i in DIMS])
    binned = lambda x: F.floor(x * BINS).alias("bin")
    centre = stage(wide(_quantile(long(stats, [f"x{i}" for i in DIMS]).select("part", "i", binned(F.col("x"))), ["part", "i"], 0.5), "c"), f"{name}-centre")
    rows = stats.select("part", *[f"x{i}" for i in DIMS]).join(_few(centre), "part")
    off = long(rows, [F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in DIMS]).select("part", "i", binned(F.col("x")))
    spread = wide(_quantile(off, ["part", "i"], 0.5), "s")
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i]) for i in DIMS]
    start = [F.col(f"c{i}").alias(f"m{i}") for i in DIMS] + [(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]
    model = stage(centre.join(spread, "part").select("part", *start), f"{name}-start")
    bin_of = F.floor(F.log(F.col("d2") + 1e-9) * BINS)
    for _ in range(STEPS):
        near = with_distance(rows, model).withColumn("bin", bin_of)
        most = _quantile(near.select("part", "bin"), ["part"], COVER).withColumnRenamed("bin", "most")
        model = stage(_estimate(near.join(_few(model, most), "part").filter("bin <= most"), CONSISTENT_75), f"{name}-step")
    return stage(_estimate(with_distance(rows, model).filter(F.col("d2") <= CHI2_975), CONSISTENT_975), f"{name}-model")


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", cutoff: float = CUTOFF, least_group: int = LEAST_GROUP, least_language: int = LEAST_LANGUAGE) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept.

    kept is false if the base rules fail, else unless the squared distance d2 from the robust centre of the document's
    language and source exceeds the cutoff. Estimates use the documents that pass the base rules; groups too small for one
    take that of their language, and languages too small for one that of all documents. Only if all that pass are fewer
    than least_language, d2 is null and the base rules decide alone. A null or empty text has no words and fails; null
    languages and sources form groups of their own; repeated rows are each judged; very long texts are judged whole, by
    hashes of at least 44 bits inside one text of up to a million words; other columns are not looked at; an empty table
    gives an empty one.
    """
    stats = statistics(docs, text_col, id_col)
    stats = stage(stats.select("*", base_failed().alias("base_failed"), *vector()), "quality-stats")
    fine = stats.filter("NOT base_failed")
    part = F.to_json(F.array("lang", "source"))
    whole = F.to_json(F.array("lang"))
    everything = F.lit("[]")
    sizes = fine.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_group).select("lang", "source", F.lit(True).alias("own"))
    spoken = fine.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = spoken.filter(F.col("n") >= least_language).select("lang", F.lit(True).alias("spoken"))
    parts = stats.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    parts = parts.withColumn("part", F.when(F.col("own"), part).when(F.col("spoken"), whole).otherwise(everything)).drop("own", "spoken")
    x = [f"x{i}" for i in DIMS]
    by_part = fine.join(sizes, ["lang", "source"]).select(part.alias("part"), *x)
    by_part = by_part.unionByName(fine.join(langs, "lang").select(whole.alias("part"), *x))
    total = spoken.agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    # The estimate over all is made only where a language needs it.
    if total["n"] is not None and total["least"] < least_language <= total["n"]:
        by_part = by_part.unionByName(fine.select(everything.alias("part"), *x))
    scored = with_distance(parts, fit(by_part))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).drop("d2")
