"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 and more key characters with a digit and a letter; an
``=`` ends a name, and belongs to a candidate only as padding at its end. A
forest judges them by length, character transitions, distinct characters, share of
hexadecimal digits, coverage by dictionary words, prefixes of issuers, the path
they stand in, whether something is assigned to them, and words in the ``CONTEXT``
code points in front, whatever else stands there; of words for and against a
secret the nearest counts. All is trained from a table of labelled findings
(before, value, after, is_secret): the trees, and the log odds of each step from
one character class to the next. The dictionary has the most frequent words of all
documents and the words of harmless labelled values. The trees are then written as
nested conditions, so documents are judged in their rows with built-in
expressions and without a shuffle.

``labelled_findings`` makes such a table by rule: random keys in assignments to
short and long names, and keys that stand alone but have an issuer's prefix or
mixed case, against digests, identifiers, paths, names and placeholders in their
usual places, with placeholders behind words for secrets too. A bare hexadecimal
run is taken for a digest. ``split_findings`` and ``measure`` give precision and
recall on findings that were not trained on.

Defined cases: a null or empty text has no candidates. Equal candidates at
several places are reported at each, in order. Repeated rows are each judged. A
text of any length is searched whole, in one task. An empty table gives no rows,
and without documents the dictionary has the words of findings only. Labelled rows
with a null are not learned from. Columns of the input that have the name of an
output column are replaced, all others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.exprs import let, packed, unpacked

CANDIDATE = "[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
CONTEXT = 40
TREES, DEPTH, SEED = 15, 5, 7
LEAST_SCORE = 0.5

#: Most words in the dictionary, by count over all documents, and the letters that such words have.
DICTIONARY_WORDS, WORD_LETTERS = 256, (4, 12)
#: Words before a secret, and before what only looks like one.
SECRET_WORDS = "token|secret|passw|api.?key|access.?key|auth|bearer|credential|private"
HARMLESS_WORDS = "commit|sha-?1|sha-?256|sha-?512|integrity|md5|checksum|digest|etag|revision|hash|uuid|blob"
#: How keys of known issuers begin.
ISSUERS = "^(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[srp]k-|[srp]k_(live|test)_|hf_|npm_|pypi-)"

FEATURES = ["length", "transitions", "steps", "distinct", "hex", "dictionary", "path", "secret_word", "harmless_word", "assigned", "issuer", "named"]


def classes_of(value: Column) -> Column:
    """A letter for the class of each character: digits, hexadecimal and other letters of either case, and the rest."""
    return F.regexp_replace(F.translate(value, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "f" * 6 + "z" * 20 + "F" * 6 + "Z" * 20), "[^0fzFZ]", "-")


@dataclass(frozen=True)
class Learned:
    """Dictionary words, and the log odds of each two neighbouring classes for a secret."""

    words: tuple[str, ...]
    steps: tuple[tuple[str, float], ...]


def _words(text: Column) -> Column:
    least, most = WORD_LETTERS
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w).between(least, most))


def learn(labelled: DataFrame, docs: DataFrame | None = None, n_words: int = DICTIONARY_WORDS) -> Learned:
    """Counts over all rows of both tables; at most ``n_words`` words of each, and 36 steps, go to the driver."""
    labelled = labelled.dropna(subset=["before", "value", "after", "is_secret"])

    def top(words: DataFrame, least: int) -> list[str]:
        counts = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(n_words).collect()]

    known = top(labelled.where("not is_secret").select(F.explode(_words(F.col("value"))).alias("w")), 3)
    if docs is not None:
        known += top(docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("w")), 10)
    kind = classes_of(F.col("value"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(kind, i, F.lit(2)))
    seen = labelled.where(F.length("value") > 1).select("is_secret", F.explode(pairs).alias("step")).groupBy("step").agg(F.count_if("is_secret").alias("yes"), F.count_if(~F.col("is_secret")).alias("no")).collect()
    yes, no = sum(r.yes for r in seen) + 36, sum(r.no for r in seen) + 36
    return Learned(tuple(sorted(set(known), key=lambda w: (-len(w), w))), tuple(sorted((r.step, math.log((r.yes + 1) / yes) - math.log((r.no + 1) / no)) for r in seen)))


def features(before: Column, value: Column, after: Column, learned: Learned) -> Column:
    n = F.length(value).cast("double")
    digit = F.translate(value, "0123456789", "0000000000")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(digit, "[a-z]+", "a"), "[A-Z]+", "A"), "0+", "0")
    low, near = F.lower(value), F.lower(before)
    covered = F.regexp_replace(low, "|".join(learned.words), "") if learned.words else low
    odds = F.create_map(*(F.lit(x) for step in learned.steps for x in step)) if learned.steps else F.create_map(F.lit(""), F.lit(0.0))
    steps = let(classes_of(value), lambda k: F.aggregate(F.sequence(F.lit(1), F.length(k) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(F.element_at(odds, F.substring(k, i, F.lit(2))), F.lit(0.0))))
    yes = lambda c: c.cast("double")
    return F.struct(
        F.least(n, F.lit(128.0)).alias("length"),
        (F.length(classes) / n).alias("transitions"),
        (steps / n).alias("steps"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0))).alias("distinct"),
        (F.length(F.regexp_replace(low, "[^0-9a-f]", "")) / n).alias("hex"),
        ((n - F.length(covered)) / n).alias("dictionary"),
        yes(F.contains(value, F.lit("/")) | near.rlike("[/.]$") | after.rlike("^[.][a-z]")).alias("path"),
        yes(near.rlike(f"(?s)({SECRET_WORDS})(?!.*({HARMLESS_WORDS}))")).alias("secret_word"),
        yes(near.rlike(f"(?s)({HARMLESS_WORDS})(?!.*({SECRET_WORDS}))")).alias("harmless_word"),
        yes(near.rlike("[=:]\\s*[\"']?$")).alias("assigned"),
        yes(value.rlike(ISSUERS)).alias("issuer"),
        yes(after.rlike("^[\"']?\\s*[=:]") | (value.rlike("^[A-Za-z_][A-Za-z0-9_-]*=$") & after.rlike("^[\"']") & ~near.rlike("[\"']$"))).alias("named"),
    )


def labelled_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """before, value, after, is_secret: generated findings, half of each label."""
    row = spark.range(0, n, 1, 1).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("g", F.base64(F.unhex(F.sha2(F.concat(F.lit("g"), F.col("id").cast("string")), 256))))
    at = F.floor(F.col("id") / 2)
    pick = lambda at, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (at % len(xs) + 1).cast("int"))
    h = lambda a, k: F.substring("h", a, k)
    g = lambda k: F.translate(F.substring("g", 1, k), "/+", "ab")
    uuid = F.concat_ws("-", h(1, 8), h(9, 4), h(13, 4), h(17, 12))
    issued = [F.concat(F.lit("sk-"), g(30)), F.concat(F.lit("AKIA"), F.upper(h(1, 16))), F.concat(F.lit("ghp_"), g(36)), F.concat(F.lit("xoxb-"), h(1, 12), F.lit("-"), g(24))]
    # The numbers of places and of keys have no common factor, so that all pairs occur.
    places = ['token = "', 'api_key: "', "password=", "secret: '", "Authorization: Bearer ", 'access_key = "', "auth_token=", 'aws_secret_access_key = "', "github_access_token: ", "AWS_SECRET_ACCESS_KEY=", '"client_secret": "']
    keyed = [h(1, 40), h(1, 32), g(40), F.upper(h(5, 40)), F.substring("g", 1, 40), F.col("g"), F.col("h"), uuid, *issued]
    alone = ["", "we use ", "see\n", "(", 'x = "', "it is ", "- "]
    bare = [*issued, g(40), g(32)]
    third = F.floor(at / 3)
    lone = at % 3 == 2
    plain = [
        ("commit ", h(1, 40)), ("sha256: ", F.col("h")), ("md5 checksum ", h(1, 32)), ("see https://example.com/", F.concat(F.lit("docs/page_"), h(1, 12))),
        ("file ", F.concat(F.lit("report_file_version_"), F.col("id").cast("string"))), ("the ", F.concat(F.lit("user_page_index_list_"), F.col("id").cast("string"))),
        ("id ", uuid), ('name = "', F.concat(F.lit("default_image_content_"), F.col("id").cast("string"))), ("class ", F.concat(F.lit("TestModuleConfigDocument"), F.col("id").cast("string"))),
        ("token = ", F.concat(F.lit("your_example_value_here_"), F.col("id").cast("string"))), ("the ", h(1, 40)), ("integrity sha512-", F.col("g")), ("see https://example.com/", g(22)),
        ("password=", F.concat(F.lit("change_your_password_here_"), F.col("id").cast("string"))), ('api_key: "', F.concat(F.lit("example_value_of_the_key_"), F.col("id").cast("string"))), ("auth token in ", F.concat(F.lit("home/user/config/file_"), F.col("id").cast("string"))),
    ]
    # Names that something is assigned to.
    names = [F.concat(F.lit(x), h(1, 1), F.lit(y)) for x, y in (("aws_s3_secret_access_key_", ""), ("service_auth_token_v", ""), ("BACKUP2_API_KEY_", "="))]
    secret = F.col("id") % 2 == 1
    name = ~secret & (at % 7 == 6)
    by = lambda a, b, c, d: F.when(secret & lone, a).when(secret, b).when(name, c).otherwise(d)
    return row.select(
        by(pick(third, *alone), pick(third, *places), pick(F.floor(at / 7), "export ", "\n", '{"', "set the token "), pick(at, *(b for b, _ in plain))).alias("before"),
        by(pick(third, *bare), pick(third, *keyed), pick(F.floor(at / 7), *names), pick(at, *(v for _, v in plain))).alias("value"),
        by(F.lit(" and "), F.lit('" '), F.when(pick(F.floor(at / 7), *names).endswith("="), '"x1').otherwise(' = "x1"'), F.lit('" ')).alias("after"),
        secret.alias("is_secret"),
    )


class Forest:
    """A trained forest as one expression over its own features."""

    def __init__(self, trees: list, learned: Learned):
        self.trees, self.learned = trees, learned

    def features(self, before: Column, value: Column, after: Column) -> Column:
        return features(before, value, after, self.learned)

    def score(self, x: Column) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + self._tree(t, x)
        return total / len(self.trees)

    def _tree(self, node, x: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(x[name] <= threshold, self._tree(left, x)).otherwise(self._tree(right, x))


def _read(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return float(stats[1] / max(sum(stats), 1e-9))
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _read(node.leftChild()), _read(node.rightChild())


def train(labelled: DataFrame, docs: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """From a table of before, value, after and is_secret; words of ``docs`` (text) go into the dictionary."""
    learned = learn(labelled, docs)
    known = labelled.dropna(subset=["before", "value", "after", "is_secret"])
    rows = known.select(features(F.col("before"), F.col("value"), F.col("after"), learned).alias("x"), F.col("is_secret").cast("double").alias("label")).select("x.*", "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    return Forest([_read(t._java_obj.rootNode()) for t in model.trees], learned)


def split_findings(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three quarters to learn from and a quarter that is held out, by crc32 of the value."""
    out = F.crc32("value") % 4 == 2
    return labelled.where(~out), labelled.where(out)


def measure(labelled: DataFrame, forest: Forest, least_score: float = LEAST_SCORE) -> tuple[float, float]:
    """Precision and recall on labelled findings."""
    found = labelled.select("is_secret", (forest.score(forest.features(F.col("before"), F.col("value"), F.col("after"))) >= least_score).alias("said"))
    r = found.agg(F.count_if(F.expr("said and is_secret")).alias("hit"), F.count_if("said").alias("said"), F.count_if("is_secret").alias("real")).first()
    return r.hit / max(r.said, 1), r.hit / max(r.real, 1)


def scan_secrets(docs: DataFrame, forest: Forest, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with n_candidates, and secrets: start (code points), value and score, in order."""
    text = F.coalesce("text", F.lit(""))
    found = packed(docs, text=text, match=F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    found = found.withColumn("parts", F.when(F.exists("match", lambda v: v.rlike("[0-9]")), F.split("text", CANDIDATE, -1)).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<struct<at:int,before:string,value:string,after:string>>")
    placed = F.aggregate(
        F.arrays_zip(F.col("parts").alias("part"), F.col("match").alias("value"), F.slice("parts", F.lit(2), F.size("parts")).alias("following")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")),
        lambda s, x: F.struct(
            (s.at + F.length(x.part) + F.coalesce(F.length(x.value), F.lit(0))).alias("at"),
            F.right(F.concat(s.tail, F.right(x.part, F.lit(CONTEXT)), F.right(F.coalesce(x.value, F.lit("")), F.lit(CONTEXT))), F.lit(CONTEXT)).alias("tail"),
            F.when(
                x.value.rlike("[0-9]") & x.value.rlike("[A-Za-z]"),
                F.concat(s.out, F.array(F.struct((s.at + F.length(x.part)).alias("at"), F.right(F.concat(s.tail, F.right(x.part, F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"), x.value.alias("value"), F.left(F.coalesce(x.following, F.lit("")), F.lit(8)).alias("after")))),
            ).otherwise(s.out).alias("out"),
        ),
        lambda s: s.out,
    )
    found = found.withColumn("found", F.when(F.size("parts") > 0, placed).otherwise(none))
    judged = F.transform("found", lambda c: let(forest.features(c.before, c.value, c.after), lambda x: F.struct(c.at.alias("start"), c.value.alias("value"), forest.score(x).alias("score"))))
    nothing = F.array().cast("array<struct<start:int,value:string,score:double>>")
    secrets = F.when(F.size("found") > 0, F.filter(judged, lambda s: s.score >= least_score)).otherwise(nothing)
    return unpacked(found, docs.columns, {"n_candidates": F.size("found").cast("long"), "secrets": secrets})
