"""Secret scans: candidates by pattern, and a random forest that removes false positives.

Everything runs as DataFrame functions and Spark's own random forest.

* A candidate is a run of 16 or more of `A-Za-z0-9+/_-`.
* Features: length, shares of digits, capitals, hexadecimal and different characters, changes between
  character kinds, the mean log probability of its letter transitions, the share of it covered by
  dictionary words, its path (depth, words for tests and examples, a hash bucket), and its neighbours
  (credential words, an assignment or a quote before it, a quote after it).
* The dictionary and the transition table come from the words of all documents: a word belongs to the
  dictionary if it stands at least `dictionary_count` times. The transition table has a row per pair of
  letters a-z, so its size is fixed.
* The forest is fitted on labelled findings, at most `max_findings` of them (those with the smallest
  hash); the bound is a parameter.

Labels may be given as `labels(candidate, label)`. Without them, findings label themselves where the case is
plain (`plain_label`); all others are for the forest to judge.

Defined cases: null texts have no candidates; null paths are empty; offsets are code points, ends
exclusive; repeated rows are scanned once each. If the labelled findings do not show both labels, scores
are null and nothing is a secret. Other columns play no part. U+0001 counts as a blank.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import saved

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
MARK = "\u0001"
#: Characters of context on each side.
AROUND = 48
MAX_FINDINGS = 20_000
DICTIONARY_COUNT = 20
CREDENTIAL = r"(?i)(api|access|auth|bearer|credential|key|pass|passwd|password|private|pwd|secret|token)"
TRIAL_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
FEATURES = [
    "length", "digits", "capitals", "hexes", "different", "changes", "transition", "covered",
    "depth", "trial", "bucket", "credential", "assigned", "quoted", "closed",
]


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = "source") -> DataFrame:
    """row, doc_id, path, nth, candidate, before, after, start, end."""
    marked = F.regexp_replace(F.replace(F.col(text), F.lit(MARK), F.lit(" ")), f"({CANDIDATE})", f"{MARK}$1{MARK}")
    pieces = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.split(marked, MARK).alias("pieces"),
    ).filter(F.size("pieces") > 1)
    piece = lambda k: F.get("pieces", k)
    found = pieces.select(
        "row",
        "doc_id",
        "path",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2)),
                lambda k: F.struct(
                    piece(k).alias("candidate"),
                    F.right(piece(k - 1), F.lit(AROUND)).alias("before"),
                    F.left(piece(k + 1), F.lit(AROUND)).alias("after"),
                    F.char_length(piece(k - 1)).cast("long").alias("gap"),
                ),
            )
        ).alias("nth", "c"),
    ).select("row", "doc_id", "path", "nth", "c.*")
    upto = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.char_length("candidate").cast("long")
    return (
        saved(found, "candidates")
        .withColumn("end", F.sum(F.col("gap") + length).over(upto))
        .withColumn("start", F.col("end") - length)
        .drop("gap")
    )


def dictionary(docs: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """word, n: lower-case words of a-z and other letters, by their number in all texts."""
    found = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).filter("length(word) >= 3")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def transitions(words: DataFrame) -> DataFrame:
    """pair, cost: log probability of each letter pair a-z given its first letter, with one added to each count."""
    letters = F.filter(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)).rlike("^[a-z]{2}$"))
    counted = (
        words.select("n", F.explode(F.transform(letters, lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )
    alphabet = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.char(c))
    every = words.sparkSession.range(1).select(F.explode(alphabet).alias("a")).select("a", F.explode(alphabet).alias("b"))
    full = every.select(F.concat("a", "b").alias("pair"), "a").join(counted, "pair", "left")
    n = F.coalesce("n", F.lit(0)) + 1
    return full.select("pair", F.log(n / F.sum(n).over(Window.partitionBy("a"))).alias("cost"))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.char_length(text)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with their features.

    Each different candidate is looked up in the dictionary and the transition table once.
    """
    distinct = found.select("candidate").distinct()
    lower = F.lower("candidate")
    runs = distinct.select("candidate", F.explode(F.split(lower, "[^a-z]+")).alias("word")).filter("length(word) >= 3")
    covered = (
        runs.join(words.select("word"), "word", "left_semi").groupBy("candidate").agg(F.sum(F.char_length("word")).alias("hit"))
    )
    places = F.sequence(F.lit(1), F.char_length("candidate") - 1)
    pairs = distinct.select("candidate", F.explode(F.transform(places, lambda i: F.substring(lower, i, F.lit(2)))).alias("pair"))
    costs = pairs.join(F.broadcast(transitions(words)), "pair").groupBy("candidate").agg(F.avg("cost").alias("transition"))
    text = F.col("candidate")
    kinds = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    facts = (
        distinct.join(covered, "candidate", "left")
        .join(costs, "candidate", "left")
        .select(
            "candidate",
            F.char_length(text).cast("double").alias("length"),
            _share(text, "[0-9]").alias("digits"),
            _share(text, "[A-Z]").alias("capitals"),
            _share(text, "[0-9a-fA-F]").alias("hexes"),
            (F.size(F.array_distinct(F.split(text, ""))) / F.char_length(text)).alias("different"),
            _share(text, kinds).alias("changes"),
            F.coalesce("transition", F.lit(-10.0)).alias("transition"),
            (F.coalesce("hit", F.lit(0)) / F.char_length(text)).alias("covered"),
        )
    )
    flag = lambda c: c.cast("double")
    return found.join(facts, "candidate").select(
        *found.columns,
        *FEATURES[:8],
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        flag(F.col("path").rlike(TRIAL_PATH)).alias("trial"),
        F.pmod(F.xxhash64("path"), F.lit(32)).cast("double").alias("bucket"),
        flag(F.col("before").rlike(CREDENTIAL + r"\W{0,6}$")).alias("credential"),
        flag(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike(r"[\"']$")).alias("quoted"),
        flag(F.col("after").rlike(r"^[\"']")).alias("closed"),
    )


def plain_label() -> Column:
    """1 and 0 where a described candidate is a plain case, else null.

    Plain secrets have the fixed format of an access key id, or are assigned to a credential word and hold
    digits and letters. Plain false positives are letters only or digits only, with no credential word before.
    """
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    issued = F.col("candidate").rlike("^AKIA[0-9A-Z]{16}$")
    return F.when(issued | ((F.col("credential") == 1) & (F.col("assigned") == 1) & mixed), 1.0).when(
        ~mixed & (F.col("credential") == 0), 0.0
    )


def forest(labelled: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 20, depth: int = 8, seed: int = 4):
    """A fitted forest, or None where the findings do not show both labels."""
    order = F.xxhash64("candidate", "before", "label")
    bounded = saved(labelled.orderBy(order, "candidate", "before").limit(max_findings).select("label", *FEATURES), "findings")
    if bounded.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(bounded)
    learner = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return learner.fit(rows)


def scan(
    docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str = "source",
    dictionary_count: int = DICTIONARY_COUNT, max_findings: int = MAX_FINDINGS,
) -> DataFrame:
    """One row per candidate: doc_id, start, end, candidate, its features, score and is_secret."""
    words = saved(dictionary(docs, text, dictionary_count), "dictionary")
    found = saved(described(candidates(docs, text, doc_id, path), words), "described")
    if labels is None:
        labelled = found.withColumn("label", plain_label()).filter("label IS NOT NULL")
    else:
        given = labels.select("candidate", F.col("label").cast("double").alias("label")).dropna().distinct()
        labelled = found.join(given, "candidate")
    model = forest(labelled.dropDuplicates(["candidate", "before", "label"]), max_findings)
    kept = ["doc_id", "start", "end", "candidate", "path", *FEATURES]
    if model is None:
        return found.select(*kept, F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_secret"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*kept, "score", (F.col("score") >= 0.5).alias("is_secret"))
