"""Operator 2, PII: base patterns, and information-theoretic sanitisation of terms that reveal them; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnstone.llm.common import read_table, stage
from tarnstone.llm.quality_rules import let
from tarnstone.llm.repeats import NO_ID

KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: Numbers of the kinds that patterns find; the first four are the base.
PROTECTED = (0, 1, 2, 3, 5)
#: The base patterns. A match is tried only where a run of its leading class begins or the last match ended, and repeats
#: are possessive: the same leftmost matches, in linear time on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Letters and digits mixed over 32 characters or more: no word of a language, but a key that names one thing alone.
    "secret": r"(?<![A-Za-z0-9_-])(?=[_-]*+[A-Za-z][A-Za-z_-]*+[0-9]|[_-]*+[0-9][0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{32,}+",
}
#: A text without these cannot match.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Code points on either side of a base span that tell one context of it from another; terms are taken from whole texts.
CONTEXT = 80
#: Letters, marks and digits: short names and codes are terms too.
LETTER = r"[\p{L}\p{M}\p{N}]"
TERM = LETTER + "+"
#: Distinct texts, and distinct contexts, in which an entity, and a term with it, must have been seen.
SUPPORT = 3
#: A term reveals an entity if their pointwise mutual information reaches this share of the entity's information content.
DISCLOSURE = 0.9
#: From this share on a term is removed, below it generalised.
REMOVAL = 0.999


def _valid(kind: str, m: Column) -> Column:
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        def luhn(d: Column) -> Column:
            digit = lambda i: F.ascii(F.substring(d, -i, 1)) - 48
            double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
            return F.length(d).between(16, 19) & (total % 10 == 0)
        # Few matches are long enough, so the sum is worked out for those alone.
        return F.when(F.length(m) < 16, F.lit(False)).otherwise(F.when(F.length(digits(m)).between(16, 19), let(digits(m), luhn)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def _tokens() -> Column:
    return F.regexp_extract_all("text", F.lit(TERM), F.lit(0))


def base_matches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, kind, start, end, value, before, after of the base spans. docs: doc_id, tkey, text, none null.

    Positions come from the lengths of the pieces between a kind's matches, added up over the document; before and after
    are the neighbouring pieces' nearest CONTEXT code points.
    """
    each = []
    for no in PROTECTED:
        kind = KINDS[no]
        pattern = PATTERNS[kind]
        some = docs.filter(F.col("text").contains(HINTS[kind])) if kind in HINTS else docs
        some = some.filter(F.col("text").rlike(pattern))
        zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("g"))
        both = let(zipped, lambda z: F.transform(z, lambda x, i: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT + 1)).alias("before"), F.left(F.coalesce(F.get(z, i + 1)["g"], F.lit("")), F.lit(CONTEXT + 1)).alias("after"))))
        one = some.select("doc_id", "tkey", F.lit(no).alias("kind"), F.posexplode(both).alias("i", "x")).select("doc_id", "tkey", "kind", "i", "x.*").filter("m IS NOT NULL")
        each.append(one)
    found = each[0]
    for one in each[1:]:
        found = found.unionByName(one)
    # Repeated rows of one id and text give the same matches, which count once.
    found = found.repartition("doc_id", "tkey").dropDuplicates(["doc_id", "tkey", "kind", "i"])
    so_far = Window.partitionBy("doc_id", "tkey", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(so_far).cast("int"))
    keep = F.lit(False)
    for no in PROTECTED:
        keep = F.when(F.col("kind") == no, _valid(KINDS[no], F.col("m"))).otherwise(keep)
    return found.filter(keep).select("doc_id", "tkey", "kind", (F.col("end") - F.length("m")).alias("start"), "end", F.col("m").alias("value"), "before", "after")


def _held(base: DataFrame) -> DataFrame:
    """tkey, unit, entity, context of the texts with base spans. Texts of the same entities in the same contexts are one unit."""
    entity = F.concat(F.col("kind").cast("string"), F.lit(":"), F.lower(F.when(F.col("kind").isin(0, 5), F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))))
    held = base.select("tkey", entity.alias("entity"), F.xxhash64("before", "after").alias("context")).distinct()
    unit = held.groupBy("tkey").agg(F.xxhash64(F.array_sort(F.collect_set(F.struct("entity", "context")))).alias("unit"))
    return stage(held.join(unit, "tkey"), "pii-entities")


def revealing(docs: DataFrame, held: DataFrame, support: int, disclosure: float) -> DataFrame:
    """entity, term, share: terms whose mutual information with an entity reaches the share of its information content.

    A term and an entity meet where one text has both. Everything is counted in units: a text without entities, or the
    texts that have the same entities in the same contexts, so that copies of a passage prove nothing and hide nothing.
    A corpus without repeated entities reveals nothing.
    """
    units = held.select("tkey", "unit").distinct()
    n = float(max(docs.select("tkey").distinct().count() - units.count() + units.select("unit").distinct().count(), 1))
    entity = held.groupBy("entity").agg(F.countDistinct("unit").alias("n_e"), F.countDistinct("context").alias("n_c"))
    entity = stage(entity.filter((F.col("n_e") >= support) & (F.col("n_c") >= support)).drop("n_c"), "pii-counts")
    # n_et <= n_e, so a term of more units than this cannot reach the share with an entity of n_e: no pair is lost.
    most = lambda n_e: F.pow(F.lit(n), F.lit(1 - disclosure)) * F.pow(n_e, F.lit(disclosure)) * (1 + 1e-9)
    texts = docs.select("tkey", "text").dropDuplicates(["tkey"]).join(units, "tkey", "left")
    words = texts.select("unit", F.explode(F.array_distinct(F.transform(_tokens(), F.lower))).alias("term"))
    words = stage(words.groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n")), "pii-terms")
    df = words.groupBy("term").agg(F.sum(F.when(F.col("unit").isNull(), F.col("n")).otherwise(1)).alias("n_t"))
    df = df.filter(F.col("n_t").between(F.lit(support), most(F.lit(entity.agg(F.max("n_e")).first()[0] or 0))))
    live = held.join(entity, "entity").select("unit", "entity", "context", "n_e").distinct()
    pair = words.filter("unit IS NOT NULL").join(df, "term").join(live, "unit").filter(F.col("n_t") <= most(F.col("n_e")))
    pair = pair.groupBy("entity", "term", "n_e", "n_t").agg(F.countDistinct("unit").alias("n_et"), F.countDistinct("context").alias("n_c"))
    content = F.log2(F.lit(n) / F.col("n_e"))
    mutual = F.log2(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.col("n_t")))
    share = F.when(content > 0, mutual / content).otherwise(F.lit(0.0))
    pair = pair.filter((F.col("n_et") >= support) & (F.col("n_c") >= support)).select("entity", "term", share.alias("share"))
    return pair.filter(F.col("share") >= disclosure)


def term_spans(docs: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """tkey, terms: every occurrence of a term that reveals an entity of the same text, as (kind, start, end, share)."""
    marks = held.select("tkey", "entity").distinct().join(found, "entity").groupBy("tkey", "term").agg(F.max("share").alias("share"))
    marks = stage(marks, "pii-marks")
    names = marks.groupBy("tkey").agg(F.collect_list("term").alias("names"))
    some = docs.select("tkey", "text").join(names, "tkey").dropDuplicates(["tkey"])
    forms = F.array_distinct(F.filter(_tokens(), lambda t: F.array_contains(F.col("names"), F.lower(t))))
    some = some.select("tkey", "text", forms.alias("forms")).filter(F.size("forms") > 0)
    pattern = F.concat(F.lit(f"(?<!{LETTER})(?:"), F.array_join("forms", "|"), F.lit(f")(?!{LETTER})"))
    some = some.select("tkey", "text", pattern.alias("pattern"))
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("m"), F.transform(F.split("text", F.col("pattern"), -1), F.length).alias("gap"))
    at = some.select("tkey", F.posexplode(zipped).alias("i", "x")).select("tkey", "i", "x.*").filter("m IS NOT NULL")
    so_far = Window.partitionBy("tkey").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(so_far).cast("int")).withColumn("term", F.lower("m"))
    at = at.join(marks, ["tkey", "term"]).select("tkey", F.struct(F.lit(4).alias("kind"), (F.col("end") - F.length("m")).alias("start"), "end", "share").alias("s"))
    return at.groupBy("tkey").agg(F.collect_list("s").alias("terms"))


def find_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, tkey, spans: for each text with any, its sorted (kind, start, end, share). docs: doc_id, tkey, text."""
    base = stage(base_matches(docs), "pii-base")
    held = _held(base)
    terms = term_spans(docs, held, stage(revealing(docs, held, support, disclosure), "pii-pairs"))
    spans = base.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("kind", "start", "end", F.lit(1.0).alias("share"))).alias("base"))
    spans = spans.join(terms, "tkey", "left")
    # Base spans stand; a term inside one adds nothing.
    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    extra = F.coalesce(F.filter("terms", lambda t: ~inside(t)), F.array())
    return spans.select("doc_id", "tkey", F.sort_array(F.concat("base", extra)).alias("spans"))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, n_term, n_secret, n_private (all spans), base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind in the order of KINDS, then start, joined by commas.
    A null or empty text has none; repeated rows are each reported; other columns are not looked at; long runs of one
    character class take linear time; an empty table gives an empty one.
    """
    rows = _keyed(docs, text_col, id_col)
    found = rows.select("doc_id", "tkey").join(find_spans(rows, support, disclosure), ["doc_id", "tkey"], "left")
    found = found.withColumn("spans", F.coalesce("spans", F.array().cast(dict(found.dtypes)["spans"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")
    return found.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), *[count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)], F.size("spans").cast("long").alias("n_private"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """docs with each base span replaced by its kind in brackets, revealing terms generalised to [word], or removed from
    `removal` on. A null text stays null; the other columns are kept as they are."""
    rows = _keyed(docs, text_col, id_col)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["share"].alias("share"))))
    found = find_spans(rows, support, disclosure).select("doc_id", "tkey", ordered.alias("spans"))
    text, names = F.col("text"), F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]], F.lit("[word]"), F.lit("[secret]"))
    mark = lambda s: F.when((s["kind"] == 4) & (s["share"] >= removal), F.lit("")).otherwise(F.get(names, s["kind"]))
    step = lambda a, s: F.when(s["start"] < a["e"], F.struct(a["t"].alias("t"), F.greatest(a["e"], s["end"]).alias("e"))).otherwise(F.struct(F.concat(a["t"], F.substring(text, a["e"] + 1, s["start"] - a["e"]), mark(s)).alias("t"), s["end"].alias("e")))
    clean = F.aggregate("spans", F.struct(F.lit("").alias("t"), F.lit(0).alias("e")), step, lambda a: F.concat(a["t"], F.substring(text, a["e"] + 1, F.length(text))))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey")]
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), *key)
    out = packed.join(found, ["doc_id", "tkey"], "left").withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(clean))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
