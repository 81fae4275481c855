"""Secrets in documents, in DataFrame and ML operations only: candidates by form, false findings out by a random forest.

A candidate is a run of key-like characters, or any value that a telling name assigns. The forest sees its length, how its
characters change from kind to kind and from one to the next, how much of it words
of the corpus cover, whether it looks like a path, and the words beside it. It is
trained on labelled findings: such as a caller has, or those that fixed forms and
plain words settle without doubt."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.session import scratch_path

#: Labelled findings of the fit at most, by the order of a hash.
TRAIN_ROWS = 20_000
#: Words of the dictionary at most, the most frequent, of at least so many documents' uses.
WORDS, USES = 50_000, 50
#: A finding is kept from this probability on.
KEEP = 0.5

#: Characters of a candidate, and its length at least.
BODY, LENGTH = "[A-Za-z0-9+/_=.-]", 16
#: Characters at least of a value that a name assigns.
SHORT = 4
FEATURES = ("length", "digits", "uppers", "kinds", "changes", "repeats", "surprise", "covered", "slashes", "dots", "named", "assigned", "quoted", "plain_before", "plain_after")

# Words that name what follows them a secret.
NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|key)"
# A name that makes its value a candidate, as far as the sign of assignment; a value in quotes, or up to a sign that ends it.
_ASSIGNED = rf"{NAMES}[\w.-]*[\"'`]*[:=]"
_NAMED_BEFORE = rf"{NAMES}[\w.-]*[\"'`]*\s?[:=][\"'`]*$"
_VALUE = f"{{{SHORT},}}"
# Groups: name and value (in quotes or bare) of an assignment by such a name; any other name before a run of key characters, the run.
_CANDIDATE = (
    r"(?:(?=[\w.-]*?" + NAMES + r")([\w.-]+)[\"'`]*[:=](?:[\"'`]+([^\s\"'`]" + _VALUE + r")|([^\s\"'`,;&<>(){}\[\]]" + _VALUE + ")))"
    r"|(?:([\w.-]+)[\"'`]*[:=][\"'`]*)?([A-Za-z0-9+/_.-]" + f"{{{LENGTH},}})"
)
# Forms that are secrets by themselves.
FORMS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})$"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, place (word number), word, nth, name, secret, before, after: each candidate of each word.

    A word is what stands between white space. Its candidates are all its runs of LENGTH
    key characters or more, cut at signs of assignment, quotes, commas and &, and the values of any
    signs, SHORT characters or more, that one of NAMES assigns, in the word or just before it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # only texts with a long run or an assignment to such a name are cut into words
    some = rows.where(F.col("text").rlike(f"{BODY}{{{LENGTH},}}") | F.col("text").rlike(rf"{NAMES}[\w.-]*[\"'`]*\s*[:=]"))
    words = some.select("row", "doc_id", F.split("text", r"\s+").alias("w"))

    def beside(place: Column, k: int) -> Column:
        return F.when(place + k >= 0, F.coalesce(F.get("w", place + k), F.lit(""))).otherwise("")

    def assigned(place: Column) -> Column:
        return beside(place, -1).rlike("[:=][\"'`]*$") & F.concat_ws(" ", beside(place, -2), beside(place, -1)).rlike(_NAMED_BEFORE)

    holds = lambda i: F.get("w", i).rlike(f"{BODY}{{{LENGTH},}}") | F.get("w", i).rlike(_ASSIGNED) | assigned(i)
    found = words.select("row", "doc_id", "w", F.explode(F.filter(F.sequence(F.lit(0), F.size("w") - 1), holds)).alias("place"))
    place = F.col("place")
    around = found.select("row", "doc_id", "place", F.get("w", place).alias("word"), assigned(place).alias("led"), *(beside(place, k).alias(name) for k, name in ((-2, "before2"), (-1, "before"), (1, "after"))))
    lead = F.regexp_extract(F.concat_ws(" ", "before2", "before"), r"([\w.-]+)[\"'`]*\s?[:=][\"'`]*$", 1)
    read = F.when(F.col("led"), F.concat(lead, F.lit("="), F.col("word"))).otherwise(F.col("word"))
    parts = F.arrays_zip(*(F.regexp_extract_all(read, F.lit(_CANDIDATE), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3, 4, 5)))
    each = around.select("*", F.posexplode(parts).alias("nth", "p"))
    secret = F.regexp_replace(F.concat("p.g2", "p.g3", "p.g5"), r"[.=-]+$", "")
    cut = each.select("row", "doc_id", "place", "word", "nth", F.concat("p.g1", "p.g4").alias("name"), secret.alias("secret"), "before2", "before", "after", (F.col("p.g1") != "").alias("by_name"))
    return cut.where(F.length("secret") >= F.when(F.col("by_name"), SHORT).otherwise(LENGTH)).drop("by_name")


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n: the most frequent words of all texts, letters only and lowered; WORDS rows at most."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 30))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= USES).orderBy(F.desc("n"), "word").limit(WORDS)


def transitions(words: DataFrame) -> DataFrame:
    """pair and cost: how surprising a character is after another, in bits, in the dictionary's words."""
    spelled = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    pairs = spelled.groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("all"))
    cost = -F.log2(F.col("n") / F.col("all"))
    return pairs.join(firsts, F.substring("pair", 1, 1) == F.col("c")).select("pair", cost.alias("cost"))


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with their features. Equal candidates are measured once."""
    bits = transitions(words)
    secret = F.col("secret")
    distinct = found.select("secret").distinct()
    low = F.lower(secret)
    # the longest common words are not searched for: letter runs are looked up as they stand
    runs = distinct.select("secret", F.explode_outer(F.filter(F.split(low, r"[^\p{L}]+"), lambda x: F.length(x) >= 3)).alias("word"))
    known = runs.join(words.select("word", F.lit(True).alias("known")), "word", "left").groupBy("secret").agg(F.sum(F.when(F.col("known"), F.length("word")).otherwise(0)).alias("letters"))
    pairs = distinct.select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).alias("pair"))
    surprise = pairs.join(bits, "pair", "left").groupBy("secret").agg(F.avg(F.coalesce("cost", F.lit(12.0))).alias("surprise"))
    shapes = distinct.join(known, "secret").join(surprise, "secret").select(
        "secret", F.length(secret).cast("double").alias("length"), _share("[0-9]", secret).alias("digits"), _share("[A-Z]", secret).alias("uppers"),
        (secret.rlike("[0-9]").cast("int") + secret.rlike("[a-z]").cast("int") + secret.rlike("[A-Z]").cast("int") + secret.rlike("[^A-Za-z0-9]").cast("int")).cast("double").alias("kinds"),
        _share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]", secret).alias("changes"), _share(r"(.)(?=\1)", secret).alias("repeats"), "surprise",
        (F.col("letters") / F.length(secret)).alias("covered"), _share("/", secret).alias("slashes"), _share("[.]", secret).alias("dots"),
    )
    plain = r"^[\p{L}]+[.,;:!?]*$"
    # the words before are those of the first candidate; others have their own names
    near = F.when(F.col("nth") == 0, F.concat_ws(" ", "before2", "before", "name")).otherwise(F.col("name"))
    around = found.withColumns({
        "named": near.rlike(NAMES).cast("double"), "assigned": ((F.col("name") != "") | (F.col("nth") == 0) & F.col("before").rlike("^[:=]+$|[:=]$")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"), "plain_before": F.col("before").rlike(plain).cast("double"), "plain_after": F.col("after").rlike(plain).cast("double"),
    })
    return around.join(shapes, "secret")


def settled(found: DataFrame) -> DataFrame:
    """Findings with a label that needs no judgement: fixed forms and hexadecimal or mixed
    runs that a name assigns are secrets (1); letters only, or letters with one kind of
    sign between them and no digit, are none (0). All others are left out."""
    secret = F.col("secret")
    mixed = secret.rlike("[0-9]") & secret.rlike("[A-Za-z]")
    label = F.when(secret.rlike(FORMS) | ((F.col("named") == 1) & (F.col("assigned") == 1) & mixed), 1).when(secret.rlike(f"^{BODY}+$") & ~secret.rlike("[0-9]"), 0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Findings: doc_id, place (word number from 0), secret, probability and kept.

    `labelled` has findings' features and `label` (1: a secret), as features() gives
    them; without it those that settled() labels are taken. At most `train_rows` go
    into the fit, by the order of a hash; features count over all documents. With no
    labels of both kinds the probability is that of the fixed forms (1 or 0). A null
    or empty text has no candidates. Repeated rows keep their findings each, null
    ids too; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words_path, found_path = scratch_path(spark, "dictionary"), scratch_path(spark, "candidates")
    dictionary(docs, text_col).coalesce(1).write.parquet(words_path)
    features(candidates(docs, id_col, text_col), spark.read.parquet(words_path)).write.parquet(found_path)
    found = spark.read.parquet(found_path)
    sample = (settled(found) if labelled is None else labelled).select("secret", "label", *FEATURES)
    order = F.xxhash64("secret", *FEATURES)
    train = sample.dropDuplicates().orderBy(order).limit(train_rows)
    kinds = train.groupBy("label").count().collect()
    if len(kinds) < 2:
        judged = found.withColumn("probability", F.col("secret").rlike(FORMS).cast("double"))
    else:
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="__x")
        forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=30, maxDepth=8, seed=7, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
        model = forest.fit(vector.transform(train.withColumn("label", F.col("label").cast("double"))))
        judged = model.transform(vector.transform(found)).withColumn("probability", vector_to_array("__p")[1])
    return judged.select("doc_id", "place", "secret", "probability", (F.col("probability") >= KEEP).alias("kept"))
