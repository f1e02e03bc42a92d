"""Payee -> category: ordered keyword rules (first match wins), classifier fallback, learning.

A short list of rules is a CASE chain in the plan. A longer one is an equi-join: every distinct payee
is cut into its substrings of the lengths that rules have, which are joined with the lower-cased
keywords; the match with the smallest (priority, keyword) wins and is joined back by payee.
Blank or missing payees get 'SIP' and never reach rules or classifier.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip
from ledgerlake.sources.rules import CATEGORY_STRIDE, LEARNED_SLOT

MISSING_PAYEE_CATEGORY = "SIP"


def _order_key() -> Column:
    return F.struct(F.col("priority"), F.col("keyword"))


def _inline_match(payee_lower: Column, rules: list[tuple[str, str]]) -> Column:
    out = None
    for cat, kw in rules:
        hit = payee_lower.contains(F.lit(kw.lower()))
        out = F.when(hit, F.lit(cat)) if out is None else out.when(hit, F.lit(cat))
    return out


#: A list of at most so many rules is written into the plan; a longer one is joined.
INLINE_RULES = 64
SALTS = 1024


def _first_match(payees: DataFrame, rules: DataFrame) -> DataFrame:
    """__payee, __cat: for every distinct payee (lower case) that a rule matches, the first rule's category."""
    words = rules.filter("keyword is not null").select(F.lower("keyword").alias("__part"), "category", "priority", "keyword")
    lengths = words.agg(F.collect_set(F.length("__part")).alias("n")).scalar()
    last = F.length("__payee") - F.col("__n") + 1
    places = F.when(F.col("__n") == 0, F.array(F.lit(1))).when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
    parts = (payees.distinct().withColumn("__n", F.explode(lengths)).withColumn("__i", F.explode(places))
             .select("__payee", F.substring("__payee", F.col("__i"), F.col("__n")).alias("__part")).distinct())
    return parts.join(words, "__part").groupBy("__payee").agg(F.min_by("category", _order_key()).alias("__cat"))


def rule_category(df: DataFrame, rules: DataFrame, payee_col: str = "paid_to", out_col: str = "category",
                  strategy: str = "auto") -> DataFrame:
    """Adds out_col: 'SIP' for a blank payee, else the first matching rule's category, else null.

    strategy 'inline' writes the rules as a CASE chain into the plan (one pass, no shuffle), 'join'
    meets distinct payees and rules in an equi-join and joins the result back once; 'auto' takes
    at most INLINE_RULES + 1 rules to the driver and inlines them if there are no more."""
    payee = F.lower(strip(F.col(payee_col)))
    blank = F.col("__payee").isNull() | (F.col("__payee") == "")
    out = lambda match: F.when(blank, F.lit(MISSING_PAYEE_CATEGORY)).otherwise(match)
    if strategy != "join":
        some = rules.filter("keyword is not null").select("category", "keyword", "priority")
        found = (some.limit(INLINE_RULES + 1) if strategy == "auto" else some).collect()
        if strategy == "inline" or len(found) <= INLINE_RULES:
            ordered = sorted(found, key=lambda r: (r.priority, r.keyword))
            match = _inline_match(F.col("__payee"), [(r.category, r.keyword) for r in ordered]) if ordered else F.lit(None).cast("string")
            return df.withColumn("__payee", payee).withColumn(out_col, out(match)).drop("__payee")
    # Read twice: for its distinct payees and for the join back. Blank payees get keys of their own,
    # spread over SALTS, so that they match nothing and don't meet in one task.
    keyed = df.withColumn("__payee", payee).persist(StorageLevel.MEMORY_AND_DISK)
    best = _first_match(keyed.filter(~blank).select("__payee"), rules)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]), F.lit(SALTS)).cast("string")
    left = keyed.withColumn("__key", F.when(blank, F.concat(F.lit("\x00"), salt)).otherwise(F.col("__payee")))
    joined = left.join(best.withColumnRenamed("__payee", "__key"), "__key", "left")
    return joined.withColumn(out_col, out(F.col("__cat"))).select(*[F.col(f"`{c}`") for c in df.columns if c != out_col], out_col)


# ---------------------------------------------------------------- classifier (fallback)
NO_EVIDENCE = "Others"


class PayeeClassifier:
    """Character-trigram naive Bayes trained on the rules' keywords (label = category).

    A stand-in for an external labeller, as joins and aggregates: score(label) is the log of the
    label's share of keywords plus, for each of the payee's trigrams that any keyword has, the log
    of its smoothed share of the label's trigrams. Scores are rounded to SCALE places, ties go to
    the first label in the alphabet. A payee without a known trigram is NO_EVIDENCE; so is every
    payee when there are no rules. Any object with fit(rules) -> self and predict(df, col, out)
    -> df[+out] can replace it.
    """

    SCALE = 9

    def __init__(self, smoothing: float = 1.0):
        self.smoothing = smoothing
        self.rules = None

    @staticmethod
    def trigrams(text: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))

    def fit(self, rules: DataFrame) -> "PayeeClassifier":
        self.rules = rules.filter("keyword is not null").select("category", "keyword")
        return self

    def predict(self, df: DataFrame, col: str, out_col: str = "predicted") -> DataFrame:
        if self.rules is None:
            raise RuntimeError("fit the classifier first")
        tri = self.rules.select("category", F.explode(self.trigrams(F.col("keyword"))).alias("t"))
        per = tri.groupBy("category", "t").agg(F.count("*").alias("n"))
        prior = self.rules.groupBy("category").agg(F.count("*").alias("words"))
        labels = prior.join(per.groupBy("category").agg(F.sum("n").alias("grams")), "category")
        known = per.select("t").distinct()
        vocabulary = known.agg(F.count("*")).scalar()
        keywords = self.rules.agg(F.count("*")).scalar()
        # One row per text and known trigram, then per label that has it; labels without it share a rest.
        texts = df.select(F.col(col).alias("x")).filter("x is not null").distinct()
        grams = texts.select("x", F.explode(self.trigrams(F.col("x"))).alias("t")).join(known, "t")
        grams = grams.groupBy("x", "t").agg(F.count("*").alias("k"))
        held = grams.groupBy("x").agg(F.sum("k").alias("all"))
        seen = grams.join(per, "t").groupBy("x", "category").agg(
            F.sum(F.col("k") * (F.log(F.col("n") + F.lit(self.smoothing)) - F.log(F.lit(self.smoothing)))).alias("gain"))
        rest = F.log(F.lit(self.smoothing)) - F.log(F.col("grams") + F.lit(self.smoothing) * vocabulary)
        score = F.log(F.col("words") / keywords) + F.coalesce("gain", F.lit(0.0)) + F.col("all") * rest
        # Every text meets every label: the labels are the categories of the rules, a short list.
        every = held.withColumn("one", F.lit(1)).join(labels.withColumn("one", F.lit(1)), "one").drop("one")
        scored = every.join(seen, ["x", "category"], "left").select("x", "category", F.round(score, self.SCALE).alias("s"))
        best = scored.groupBy("x").agg(F.min_by("category", F.struct((-F.col("s")).alias("s"), "category")).alias("__label"))
        best = best.withColumnRenamed("x", "__x")
        out = df.join(best, F.col(col) == F.col("__x"), "left").drop("__x")
        return out.withColumn(out_col, F.coalesce("__label", F.lit(NO_EVIDENCE))).drop("__label")


def learned_rules(unmatched_payees: DataFrame, rules: DataFrame, classifier: PayeeClassifier,
                  payee_col: str = "paid_to", batch_id: str | None = None) -> DataFrame:
    """One learned rule per distinct unmatched payee: keyword = lower(strip(payee)), category =
    classifier label, placed after the category's file keywords. Takes effect next batch."""
    distinct = (unmatched_payees.select(F.lower(strip(F.col(payee_col))).alias("keyword"))
                .where(F.col("keyword").isNotNull() & (F.col("keyword") != "")).distinct())
    labelled = classifier.predict(distinct, "keyword", "category")
    first_of = F.floor(F.col("priority") / CATEGORY_STRIDE) * CATEGORY_STRIDE
    slots = rules.groupBy("category").agg(F.min(first_of + LEARNED_SLOT).cast("bigint").alias("priority"))
    after = rules.agg(F.coalesce(F.max(first_of + CATEGORY_STRIDE), F.lit(0)).cast("bigint")).scalar()  # new labels go last
    return labelled.join(slots, "category", "left").select(
        "category", "keyword", F.coalesce("priority", after + LEARNED_SLOT).alias("priority"),
        F.lit("learned").alias("source"), F.lit(batch_id).cast("string").alias("batch_id"),
    )


def merge_rules(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """Union; a keyword keeps its earliest (priority, keyword) entry."""
    u = rules.unionByName(learned)
    best = u.groupBy("keyword").agg(F.min_by(F.struct("category", "priority", "source", "batch_id"),
                                             F.col("priority")).alias("r"))
    return best.select("r.category", "keyword", "r.priority", "r.source", "r.batch_id")


def categorise(df: DataFrame, rules: DataFrame, classifier: PayeeClassifier | None = None,
               payee_col: str = "paid_to", batch_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules first; payees no rule matches go (distinct) to the classifier; their labels are
    used now and returned as learned rules for the next batch."""
    ruled = rule_category(df, rules, payee_col)
    if classifier is None:
        return ruled, rules.limit(0)
    ruled = ruled.persist(StorageLevel.MEMORY_AND_DISK)  # read for what to learn and for the result
    unmatched = ruled.filter(F.col("category").isNull())
    learned = learned_rules(unmatched, rules, classifier, payee_col, batch_id)
    lk = learned.select(F.col("keyword").alias("__k"), F.col("category").alias("__c"))
    out = (ruled.withColumn("__k", F.lower(strip(F.col(payee_col))))
           .join(lk, "__k", "left")
           .withColumn("category", F.coalesce("category", "__c")).drop("__k", "__c"))
    return out, learned
