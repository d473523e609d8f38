"""Author resolution after matching: steps combined, persons told apart, parties of appointment, samples and their precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import is_blank, wilson
from quarry.operators.linkage import name_ladder, quality_of
from quarry.operators.windows import stratified_sample


def by_author_id(opinions: DataFrame, persons: DataFrame) -> DataFrame:
    """Step 1: the recorded author's gender; resolved if it is m or f."""
    known = persons.select(F.col("id").alias("author_id"), "gender", "name_last")
    out = opinions.select("opinion_id", "author_id").join(known, "author_id", "left")
    return out.withColumn("gender_resolved", F.coalesce(F.col("gender").isin("m", "f"), F.lit(False)))


def open_for_names(opinions: DataFrame) -> DataFrame:
    """Step 2 looks only where no author id is recorded, the opinion is surely not per curiam, and a name is given."""
    return opinions.where(F.col("author_id").isNull() & (F.col("per_curiam") == F.lit(False)) & (F.trim("author_str") != ""))


def combine(opinions: DataFrame, step1: DataFrame, step2: DataFrame) -> DataFrame:
    """opinions (opinion_id, author_id, author_str) with gender, source, quality tier and label: of step 1 (gender, gender_resolved)
    where it resolves, else of step 2 (gender, gender_source), else why there is none."""
    one = step1.select("opinion_id", F.col("gender").alias("_g1"), F.coalesce("gender_resolved", F.lit(False)).alias("_r1"))
    two = step2.select("opinion_id", F.col("gender").alias("_g2"), F.col("gender_source").alias("_s2"))
    out = opinions.join(one, "opinion_id", "left").join(two, "opinion_id", "left")
    first, second = F.coalesce("_r1", F.lit(False)), F.col("_g2").isNotNull()
    silent = F.col("author_id").isNull() & F.coalesce(F.trim("author_str") == "", F.lit(True))
    source = (
        F.when(first, "author_id").when(second, F.col("_s2")).when(F.col("author_id").isNotNull(), "author_id_not_resolved").when(~silent & F.col("_s2").isNotNull(), F.col("_s2"))
        .when(silent, "no_author_id_or_author_str").otherwise("unknown")
    )
    tier, label = quality_of(F.col("gender_source"))
    out = out.select(*opinions.columns, F.when(first, F.col("_g1")).otherwise(F.col("_g2")).alias("gender"), (first | second).alias("gender_resolved"), source.alias("gender_source"))
    return out.withColumns({"quality_tier": tier, "quality_label": label})


def person_registry(judge_id: Column, persons: DataFrame, bio: DataFrame, df: DataFrame) -> DataFrame:
    """df with `registry`: supplemental, person, service record, or unmapped."""
    number = F.when(~judge_id.startswith("sup_"), judge_id.try_cast("long"))
    out = df.withColumn("_id", number)
    out = out.join(persons.select(F.col("id").cast("long").alias("_id")).distinct().withColumn("_p", F.lit(True)), "_id", "left")
    out = out.join(bio.select(F.col("nid").cast("long").alias("_id")).distinct().withColumn("_b", F.lit(True)), "_id", "left")
    return out.withColumn("registry", F.when(judge_id.startswith("sup_"), "supplemental").when(F.col("_p"), "person").when(F.col("_b"), "service_record").otherwise("unmapped")).drop("_id", "_p", "_b")


def person_unique(df: DataFrame) -> DataFrame:
    """df (step, n_judges, judges) with whether exactly one person is meant, and who."""
    one = (F.col("step") == 1) | (F.col("n_judges") == 1)
    return df.withColumn("person_unique", F.coalesce(one, F.lit(False))).withColumn("judge_id", F.when(one, F.split_part(F.col("judges"), F.lit("|"), F.lit(1))))


def unique_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(F.count("*").alias("resolved"), F.count_if("person_unique").alias("person_unique"), F.countDistinct("judge_id").alias("distinct_judges"))


def appointing_party(cases: DataFrame, service: DataFrame) -> DataFrame:
    """Cases (case_id, person_key, court_id, filed) with the party of the service record (person_key, court_id, commission_date,
    termination_date, party) that fits best: court and period, then court, then any; of these the latest."""
    s = service.withColumnRenamed("court_id", "_court")
    here = F.col("_court") == F.col("court_id")
    during = (F.col("commission_date") <= F.col("filed")) & (F.col("termination_date").isNull() | (F.col("termination_date") >= F.col("filed")))
    rank = F.when(here & during, 1).when(here, 2).otherwise(3)
    days = F.coalesce(F.datediff(F.lit("2200-01-01"), "commission_date"), F.lit(1 << 30))
    best = cases.join(s, "person_key").groupBy("case_id").agg(F.min(F.struct(rank.alias("fit"), days.alias("d"), "party")).alias("b"))
    return cases.join(best, "case_id", "left").select(*cases.columns, F.col("b.party").alias("party"), F.col("b.fit").alias("fit"))


def validation_sample(df: DataFrame, key: str, step: str, sizes: dict[int, int], salt: str, texts: DataFrame | None = None, excerpt: int = 1500) -> DataFrame:
    """A fixed number of rows of each step by a salted hash, with the step's size, the start of the text where texts (key, text) are
    given, and empty columns for the verdict."""
    strata = df.groupBy(step).agg(F.count("*").alias("stratum_size"))
    drawn = stratified_sample(df, step, key, sizes, salt).join(strata, step)
    if texts is not None:
        drawn = drawn.join(texts.select(key, F.left("text", F.lit(excerpt)).alias("excerpt")), key, "left")
    return drawn.withColumn("verdict", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))


def sample_faults(sample: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """What is wrong with a judged sample: repeated keys, rows without a verdict, and unknown verdicts."""
    v = F.lower(F.trim(verdict))
    return sample.agg(
        (F.count("*") - F.countDistinct(key)).alias("n_repeated"), F.count_if(is_blank(F.col(verdict))).alias("n_unjudged"),
        F.count_if(~is_blank(F.col(verdict)) & ~v.isin("correct", "wrong", "unclear")).alias("n_unknown"),
    )


def precision(sample: DataFrame, step: str, verdict: str = "verdict") -> DataFrame:
    """For each step and pooled (null): judged, correct, precision and its Wilson interval."""
    judged = sample.where(F.col(verdict).isin("correct", "wrong"))
    ok = F.count_if(F.col(verdict) == "correct")
    rows = judged.groupBy(step).agg(F.count("*").alias("n"), ok.alias("k")).unionByName(judged.agg(F.count("*").alias("n"), ok.alias("k")).withColumn(step, F.lit(None).cast(sample.schema[step].dataType)))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select(step, "n", "k", (F.col("k") / F.nullif("n", F.lit(0))).alias("precision"), low.alias("low"), high.alias("high"))


def weighted_precision(per_step: DataFrame, strata: DataFrame, step: str) -> DataFrame:
    """Mean precision weighted by the strata's sizes (step, stratum_size)."""
    return per_step.where(F.col(step).isNotNull()).join(strata, step).agg((F.sum(F.col("precision") * F.col("stratum_size")) / F.sum("stratum_size")).alias("weighted"))


def unresolved_names(cases: DataFrame, pool: DataFrame, n: int = 50) -> DataFrame:
    """The names (court_id, author_norm) that met no judge, most frequent first (ties by name), and in how many opinions the last word
    alone would find judges of one gender: at the same court, or at any."""
    names = cases.where(~is_blank(F.col("author_norm"))).groupBy("court_id", "author_norm").agg(F.count("*").alias("k")).withColumn("_last", F.element_at(F.split("author_norm", " "), -1))
    near = pool.groupBy(F.col("name_norm").alias("_last"), F.col("court_id")).agg(F.countDistinct("gender").alias("here"))
    far = pool.groupBy(F.col("name_norm").alias("_last")).agg(F.countDistinct("gender").alias("anywhere"))
    found = names.join(near, ["_last", "court_id"], "left").join(far, "_last", "left")
    told = F.when(F.col("here") == 1, "same_court").when(F.col("here") > 1, "ambiguous").when(F.col("anywhere") == 1, "any_court").when(F.col("anywhere") > 1, "ambiguous").otherwise("none")
    kinds = ("same_court", "any_court", "ambiguous", "none")
    by_name = found.withColumn("suffix", told).groupBy("author_norm").agg(F.sum("k").alias("n_opinions"), *(F.sum(F.when(F.col("suffix") == s, F.col("k")).otherwise(0)).alias(f"n_{s}") for s in kinds))
    return by_name.orderBy(F.desc("n_opinions"), "author_norm").limit(n)


def ladder_and_combine(opinions: DataFrame, persons: DataFrame, pool: DataFrame) -> DataFrame:
    """Steps 1 and 2 of opinions (opinion_id, court_id, author_id, author_str, per_curiam) in one."""
    cases = open_for_names(opinions).select(F.col("opinion_id").alias("case_id"), "court_id", F.col("author_str").alias("author"))
    step2 = name_ladder(cases, pool).withColumnRenamed("case_id", "opinion_id")
    return combine(opinions.select("opinion_id", "author_id", "author_str"), by_author_id(opinions, persons), step2)
