"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Generators propose spans: four strict patterns (e-mail addresses, IP addresses, card
numbers, telephone numbers; matches that pass their check are base spans and always
stay) and looser ones (spelt-out e-mail signs, IPv6, telephone numbers without a plus,
card numbers with other separators).

Two views of a loose candidate are independent: whether its normalised form passes the
check of its kind (`fits`), and what the words before it speak of (`speaks`). Where both
say yes, it is added; where the words name something else, or no view says yes, it is not.
These and the base spans are the labels. All others, such as a number that fits without
a word before it, are open, and boosted trees decide: they learn from all labels but
those held out, by format and context, and each kind, pattern and label weighs alike; the checks are no features. An open candidate
that overlaps no base span is added if its score reaches its kind's threshold, halfway
between the score that `RECALL` of the held-out positives reach and that which as many
held-out negatives stay below. A kind's threshold is drawn to that of all kinds, and this
to 0.5, by PRIOR rows, so that few held-out rows move it little. Where only one label is
known, it holds for open candidates too; where none is, nothing is added.

All steps are DataFrame functions and Spark's own trees. A candidate's place comes from
the lengths of the matches and gaps before it, summed in a window over its text.

Null and empty texts have no spans. Rows that repeat doc_id and text are each returned.
Very long texts are searched whole. Of overlapping spans, base ones stay. An empty table
has no rows. Extra columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

KINDS = ("email", "ip", "card", "phone")
RECALL = 0.98
PRIOR = 20

#: Strict patterns. A run of characters is entered at its start only, so that scans stay linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_-])[0-9]{4}[./_\x20-][0-9]{4}[./_\x20-][0-9]{4}[./_\x20-][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9.+-])\+?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9.])",
}
WORDS = {"email": "mail|contact|write|reply", "ip": "ip|host|server|address|node", "card": "card|visa|credit|pay|account", "phone": "tel|phone|call|fax|mobil"}
#: Directly before a number, these say that it counts or names something else.
OTHER = r"\b(part|item|order|invoice|ref|reference|serial|version|article|isbn|date|time|page|model|sku)s?[^a-z0-9]*$"
FEATURES = ["kind", "chars", "digits", "letters", "seps", "parts", "longest", "dots", "plus", "brackets", "at", "before_space", "after_space", "cue", "before_digit", "after_digit", "upper"]


def _hint(kind: str, text: Column) -> Column:
    """Cheap test that most texts without a candidate fail."""
    return (text.contains("@") | text.rlike(r"[(\[]at[)\]]")) if kind == "email" else text.rlike("[0-9]")


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def fits(kind: str, match: Column) -> Column:
    """Whether a candidate of any pattern, in its normalised form, passes the check of its kind."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(match, r"\x20?(?:@|[(\[]at[)\]])\x20?", "@"), r"\x20?(?:\.|[(\[]dot[)\]])\x20?", ".")
        return plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]") & plain.rlike(r"\.[A-Za-z]{2,}$") & ~match.rlike(r"\x20@|@\x20")
    if kind == "ip":
        return F.when(match.contains(":"), match.rlike("[A-Fa-f]|[0-9]{3}")).otherwise(passes(kind, match))  # else a row of times
    return passes(kind, match)


def speaks(kind: str, before: Column) -> Column:
    """1 if the words before a candidate speak of its kind, -1 if the last one names something else, else 0."""
    words = F.lower(before)
    return F.when(words.rlike(OTHER), -1).when(words.rlike(WORDS[kind]), 1).otherwise(0)


def label(rows: DataFrame) -> DataFrame:
    """Adds `view`: 1 for base spans and where both views agree that it is one, 0 where none says so or the words speak against it, else null."""
    of_kind = lambda f: F.coalesce(*[F.when(F.col("kind") == k, f(k)) for k in KINDS])
    good, said = of_kind(lambda k: fits(k, F.col("match"))), of_kind(lambda k: speaks(k, F.col("before")))
    return rows.withColumn("view", F.when(F.col("base") | (good & (said == 1)), 1.0).when((said == -1) | (~good & (said == 0)), 0.0))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate of (doc_id, text): doc_id, sum, kind, base, match, start, end, before, after."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("sum"), text.alias("text"))
    found = found.where(_hint("email", F.col("text")) | _hint("ip", F.col("text")))
    sources = [(k, b, rx) for b, group in ((True, BASE), (False, LOOSE)) for k, rx in group.items()]
    none = F.array().cast("array<string>")
    cut = found.select(
        "doc_id",
        "sum",
        *[F.when(_hint(k, F.col("text")), F.split("text", rx, -1)).otherwise(none).alias(f"p{i}") for i, (k, _, rx) in enumerate(sources)],
        *[F.when(_hint(k, F.col("text")), F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(none).alias(f"m{i}") for i, (k, _, rx) in enumerate(sources)],
    )

    def rows(i: int, kind: str, base: bool) -> Column:
        p, m = F.col(f"p{i}"), F.col(f"m{i}")
        behind = F.when(F.size(p) > 1, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(none)
        return F.transform(
            F.filter(F.arrays_zip(m.alias("m"), p.alias("p"), behind.alias("q")), lambda z: z["m"].isNotNull()),
            lambda z, at: F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), at.alias("at"), z["m"].alias("match"), F.length(z["p"]).alias("gap"), F.right(z["p"], F.lit(24)).alias("before"), F.left(z["q"], F.lit(8)).alias("after")
            ),
        )

    every = F.flatten(F.array(*[rows(i, k, b) for i, (k, b, _) in enumerate(sources)]))
    one = cut.select("doc_id", "sum", F.explode(every).alias("c")).select("doc_id", "sum", "c.*")
    earlier = Window.partitionBy("doc_id", "sum", "kind", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(earlier)
    placed = one.dropDuplicates(["doc_id", "sum", "kind", "base", "at"]).withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    valid = F.coalesce(*[F.when(F.col("kind") == k, passes(k, F.col("match"))) for k in KINDS])
    return placed.withColumn("valid", F.col("base") & valid).select("doc_id", "sum", "kind", "base", "valid", "match", "start", "end", "before", "after")


def features(rows: DataFrame) -> DataFrame:
    m, b, a = F.col("match"), F.col("before"), F.col("after")
    only = lambda c, keep: F.length(F.regexp_replace(c, f"[^{keep}]", ""))
    runs = F.split(m, "[^0-9A-Za-z]+")
    number = {
        "kind": F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)]),
        "chars": F.length(m),
        "digits": only(m, "0-9"),
        "letters": only(m, "A-Za-z"),
        "seps": F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        "parts": F.size(runs),
        "longest": F.array_max(F.transform(runs, F.length)),
        "dots": only(m, "."),
        "plus": m.startswith("+").cast("int"),
        "brackets": only(m, "()"),
        "at": only(m, "@"),
        "before_space": b.rlike(r"(^|\s)$").cast("int"),
        "after_space": a.rlike(r"^(\s|$)").cast("int"),
        "cue": F.coalesce(*[F.when(F.col("kind") == k, F.lower(b).rlike(w)) for k, w in WORDS.items()]).cast("int"),
        "before_digit": b.rlike("[0-9][^0-9]?$").cast("int"),
        "after_digit": a.rlike("^[^0-9]?[0-9]").cast("int"),
        "upper": only(m, "A-Z"),
    }
    return rows.withColumns({f"f_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in number.items()})


def judged(rows: DataFrame) -> DataFrame:
    """Adds `added`: whether a loose candidate is selected, by both views or by the trees. `rows` has columns `view` and `overlaps`."""
    ready = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="vector").transform(features(rows))
    free = ~F.col("base") & ~F.col("overlaps")
    key = F.struct("doc_id", "sum", "kind", "start", "base")
    groups = rows.where("view is not null").groupBy("kind", "base", "view").count().collect()  # three a kind at most; each weighs alike, so that rare ones count
    total = sum(g["count"] for g in groups)
    weight = F.coalesce(*[F.when((F.col("kind") == g["kind"]) & (F.col("base") == g["base"]) & (F.col("view") == g["view"]), F.lit(total / len(groups) / g["count"])) for g in groups], F.lit(1.0))
    part = ready.where("view is not null").withColumn("held", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(3)) == 0)
    part = written(part.select("kind", "vector", "held", weight.alias("weight"), F.col("view").alias("label")), "pii-labels")
    taught = {r["label"] for r in part.where("not held").select("label").distinct().collect()}
    if len(taught) < 2:
        return rows.withColumn("added", free & F.coalesce("view", F.lit(max(taught, default=0.0))).eqNullSafe(1.0))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, seed=7, stepSize=0.3, weightCol="weight").fit(part.where("not held"))
    p = vector_to_array("probability")[1]
    seen = model.transform(part.where("held")).select("kind", "label", p.alias("p"))
    halfway = (F.coalesce(F.expr(f"percentile(p, {1 - RECALL}) FILTER (WHERE label = 1)"), F.lit(1.0)) + F.coalesce(F.expr(f"percentile(p, {RECALL}) FILTER (WHERE label = 0)"), F.lit(0.0))) / 2
    levels = {r["kind"]: (r["n"], r["t"]) for r in seen.rollup("kind").agg(F.count(F.lit(1)).alias("n"), halfway.alias("t")).collect()}
    drawn = lambda kind, to: (levels[kind][0] * levels[kind][1] + PRIOR * to) / (levels[kind][0] + PRIOR) if kind in levels else to
    least = {k: drawn(k, drawn(None, 0.5)) for k in KINDS}
    enough = F.coalesce(*[F.when(F.col("kind") == k, p >= F.lit(least[k])) for k in KINDS])
    return model.transform(ready).withColumn("added", free & F.coalesce(F.col("view") == 1, enough))


def _of(kind: int):
    return lambda s: s["k"] == kind


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    found = written(candidates(docs).where("valid or not base"), "pii-candidates")
    whole = Window.partitionBy("doc_id", "sum").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("doc_id", "sum").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    ties = Window.partitionBy("doc_id", "sum", "start")
    marked = found.select(
        "*",
        (F.coalesce(F.max(base_end).over(whole) > F.col("start"), F.lit(False)) | F.coalesce(F.min(base_start).over(later) < F.col("end"), F.lit(False)) | F.max("base").over(ties)).alias("overlaps"),
    )
    marked = written(label(marked), "pii-marked")
    added = judged(marked)
    chosen = added.where(F.col("base") | F.col("added"))
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    span = F.struct(order.alias("k"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"), "base", F.col("end").alias("e"))
    spans = chosen.groupBy(F.col("doc_id").alias("__doc"), F.col("sum").alias("__sum")).agg(F.sort_array(F.collect_set(span)).alias("__spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key")).join(spans, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__sum")), "left")
    every = F.coalesce("__spans", F.array().cast(spans.schema["__spans"].dataType))
    base = F.filter(every, lambda s: s["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["s"]), ",")
    return rows.select(
        "doc_id",
        *[F.size(F.filter(base, _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size(F.filter(every, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
