"""Secret scan: a wide pattern proposes candidates, a random forest removes the false ones.

The forest sees the candidate's length and characters, the transitions between classes of characters, how much of it
dictionary words cover, the path it was found under, and the words next to it. The dictionary is counted from the corpus
itself (``dictionary``). The forest is trained from labelled findings: those of ``labelled_findings`` (generated, ``FINDINGS`` rows), or a caller's own.

DataFrame functions and Spark ML only. The forest is trained by Spark ML; its trees are then expressions that judge
the candidates of a row where the row lies, so that scanning and redacting need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, table_path
from .spans import spans

#: Labelled findings that the forest is trained on: the bound of the sample.
FINDINGS = 4000
TREES, DEPTH, SEED = 24, 8, 17
MASK = "[SECRET]"
#: What stands assigned to a telling name (a full stop or exclamation mark at its end doesn't belong to it), or runs of 12 or more word characters with a digit.
CANDIDATE = (
    r"(?<=(?i:pass|word|passwd|pwd|secret|token|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?:[A-Za-z0-9+/_@#$%^&*-]|[.!](?=\S)){8,}+={0,2}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
)
HINT = r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12}|(?i:pass|word|pwd|secret|token|key)[\"']?\s{0,3}[=:]"
#: Words that speak for a secret or against one, when they stand next to it.
FOR = "password|passwd|pwd|secret|token|api_key|apikey|access_key|auth|credential|private|bearer|key"
AGAINST = "commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|id|version|order|invoice|isbn|ref|see|file|path|class|call|example|sample|test|dummy|placeholder"
#: Words of the corpus in the dictionary: the most frequent ones of three letters or more.
DICTIONARY_WORDS = 2000
#: Words of placeholders and identifiers that the dictionary has in any case.
USUAL_WORDS = (
    "your here example sample test dummy change me placeholder secret password token api key user name admin login demo default value string "
    "main java python file data base class function method service factory provider manager handler config client server index table order number "
    "report image page view model module package library build version release source local remote public static final process thread time date xxx abc"
).split()
FEATURES = ("length", "digits", "uppers", "symbols", "distinct", "transitions", "vowels", "hex", "covered", "slashes", "prefix", "assigned", "quoted", "word_for", "word_against", "path_test")


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The words of ASCII letters that are most frequent in all of the texts, at most ``most``, and ``USUAL_WORDS``."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 15))
    best = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most)
    return sorted({r["word"] for r in best.collect()} | set(USUAL_WORDS))


def _features(value: Column, before: Column, after: Column, path: Column, words: list[str]) -> dict[str, Column]:
    """The forest's features, in the order of ``FEATURES``."""
    length = F.length(value).cast("double")
    part = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / length  # noqa: E731  what is left without it
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    near = F.lower(F.concat_ws(" ", F.substring(before, -30, 30), F.substring(after, 1, 15)))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {
        "length": F.least(length, F.lit(200.0)),
        "digits": 1 - part("[0-9]"),
        "uppers": 1 - part("[A-Z]"),
        "symbols": 1 - part("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "transitions": F.length(F.regexp_replace(classes, r"(.)\1*+", "x")) / length,
        "vowels": 1 - part("[aeiouAEIOU]"),
        "hex": flag(F.regexp_like(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))),
        "covered": F.aggregate(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lit(0), lambda n, w: n + F.when(F.lower(w).isin(words), F.length(w)).otherwise(0)) / length,
        "slashes": F.length(F.regexp_replace(value, "[^/]", "")).cast("double"),
        "prefix": flag(F.regexp_like(value, F.lit("^(?:AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|eyJ)"))),
        "assigned": flag(F.regexp_like(before, F.lit("[=:]\\s{0,3}[\"']?$"))),
        "quoted": flag(F.regexp_like(before, F.lit("[\"'`]$"))),
        "word_for": flag(F.regexp_like(near, F.lit(f"(?:^|[^a-z])(?:[a-z_]*_)?(?:{FOR})s?(?![a-z])"))),
        "word_against": flag(F.regexp_like(near, F.lit(f"(?:^|[^a-z])(?:{AGAINST})(?![a-z])"))),
        "path_test": flag(F.regexp_like(F.lower(path), F.lit("test|example|sample|fixture|mock|docs?/"))),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Generated findings (value, before, after, path, label, kind): eighteen kinds, half of them secrets. The same for every call."""
    made = spark.range(0, rows, 1, 1).select("id", F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 256).alias("hex"))
    made = made.withColumns({"mixed": F.regexp_replace(F.concat(F.base64(F.unhex("hex")), F.base64(F.unhex(F.sha2("hex", 256)))), "[+/=]", ""), "kind": (F.col("id") % 18).cast("int"), "n": F.floor(F.col("id") / 18)})
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (F.col("n") % len(options) + 1).cast("int"))
    cut = lambda column, a, b: F.col(column).substr(F.lit(1), F.lit(a) + (F.col("n") % (b - a + 1)).cast("int"))
    word = pick("theatre", "order", "Ofthen", "report", "erhent", "mit", "dans", "service")
    cases = [  # value, before, after, label
        (cut("hex", 40, 40), pick('token = "', 'auth_token: "', "secret="), pick('"', " and"), 1),
        (F.concat(F.lit("AKIA"), F.upper(cut("mixed", 16, 16))), pick("aws_access_key_id = ", "key ", 'id: "'), F.lit(""), 1),
        (F.concat(F.lit("ghp_"), cut("mixed", 36, 36)), pick("GITHUB_TOKEN=", "use ", "bearer "), F.lit(""), 1),
        (cut("mixed", 10, 20), pick("password: ", 'passwd = "', "pwd="), pick("", '"'), 1),
        (cut("hex", 32, 32), pick('api_key="', "access_key: ", "apikey = "), pick('"', ""), 1),
        (F.concat(F.lit("sk_live_"), cut("mixed", 24, 24)), pick("key: ", "with ", 'secret "'), F.lit(""), 1),
        (cut("mixed", 40, 64), pick('client_secret = "', "private key: ", "Authorization: Bearer "), F.lit('"'), 1),
        (F.upper(cut("hex", 32, 40)), pick('TOKEN = "', 'API_KEY="', "SECRET: "), pick('"', '"!!'), 1),
        (cut("hex", 40, 40), pick("commit ", "reverts commit ", "hash "), F.lit(" by"), 0),
        (cut("hex", 32, 64), pick("sha256:", "md5 checksum ", "digest = "), F.lit(""), 0),
        (F.concat_ws("-", F.substring("hex", 1, 8), F.substring("hex", 9, 4), F.substring("hex", 13, 4), F.substring("hex", 17, 4), F.substring("hex", 21, 12)), pick("uuid ", 'id = "', "request "), F.lit(""), 0),
        (F.concat(pick("your_api_key_here", "xxxxxxxxxxxx", "changeme12345", "example_token_123", "0000000000000000", "1234567890123456", "test_password_1"), (F.col("n") % 10).cast("string")), pick('password = "', "token: ", 'api_key="'), F.lit('"'), 0),
        (F.regexp_replace(F.concat(F.col("hex"), F.lit("123456789012")), "[a-f]", "").substr(F.lit(1), F.lit(12) + (F.col("n") % 8).cast("int")), F.concat(word, F.lit(" ")), F.concat(F.lit(" "), word), 0),
        (F.concat(pick("src/main/", "/usr/lib/", "docs/pages/"), word, F.lit("2/"), pick("index", "module", "table"), (F.col("n") % 7).cast("string")), pick("see ", "in file ", "path="), F.lit(""), 0),
        (F.concat(word, F.lit("_"), pick("handler", "value", "config"), F.lit("_v"), (F.col("n") % 12).cast("string"), word), pick("call ", "class ", "def "), pick("(", " "), 0),
        (F.when(F.col("n") % 2 == 0, cut("hex", 40, 40)).otherwise(F.concat(pick("Token", "Password", "Key"), F.lit("Provider2Factory"))), pick('token = "', 'key = "'), F.lit('"'), 0),
        (F.concat(cut("mixed", 5, 12), pick("!", "$", "@", "#", "%", "&", "*"), F.substring("hex", 1, 2), pick("x$", "!", ".Q", "^", "#7"), F.substring("hex", 9, 1)), pick("password=", 'pwd = "', "passwd: ", "secret: ", "login password="), pick("", '"', " and"), 1),
        (F.concat(word, pick("-", ".", "_", "@"), pick("value", "theatre", "example", "manual"), pick(".", "-", "_"), pick("com", "order", "report", "page")), pick("password: ", "key=", 'token: "', "secret = "), pick("", '"', " or"), 0),
    ]
    choose = lambda place: F.coalesce(*(F.when(F.col("kind") == k, F.lit(c[place]) if isinstance(c[place], int) else c[place]) for k, c in enumerate(cases)))
    test = pick("tests/fixtures/a.py", "docs/example.md", "test/mock.json")
    plain = pick("src7", "app/config.env", "web", "src12", "lib/main.py", "src0")
    path = F.when((F.col("kind") == 15) & (F.col("n") % 2 == 0), test).when(F.col("kind").between(8, 15) & (F.col("n") % 5 == 0), test).otherwise(plain)
    return made.select(choose(0).alias("value"), F.concat(word, F.lit(" "), choose(1)).alias("before"), choose(2).alias("after"), path.alias("path"), choose(3).cast("double").alias("label"), "kind").where("length(value) > 0")


@dataclass(frozen=True)
class SecretModel:
    words: list[str]
    forest: RandomForestClassificationModel
    trees: list[dict[int, tuple]]  # node -> (feature, threshold, left, right), or (share of secrets,)

    def probability(self, features: Column) -> Column:
        """The forest's, of an array of features."""

        def node(tree: dict[int, tuple], k: int) -> Column:
            if len(tree[k]) == 1:
                return F.lit(tree[k][0])
            feature, threshold, left, right = tree[k]
            return F.when(features[feature] <= threshold, node(tree, left)).otherwise(node(tree, right))

        return F.round(sum((node(t, 0) for t in self.trees), F.lit(0.0)) / len(self.trees), 6)


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _vector(value: Column, before: Column, after: Column, path: Column, words: list[str]) -> Column:
    found = _features(value, before, after, path, words)
    return F.array(*(found[k].cast("double") for k in FEATURES))


def train(findings: DataFrame, words: list[str] | None = None) -> SecretModel:
    """A forest from labelled findings (value, before, after, path, label), with the words of a dictionary.

    Findings without a value or label are left out, other nulls are empty. With no findings, or none of one of the two labels, every candidate
    gets the share of secrets among them (0 with none).
    """
    words, spark = sorted(set(words or USUAL_WORDS)), findings.sparkSession
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = findings.where("length(value) > 0 and label is not null").select(_vector(F.col("value"), text("before"), text("after"), text("path"), words).alias("x"), F.col("label").cast("double").alias("label"))
    rows = materialise(known.select(array_to_vector("x").alias("features"), "label").coalesce(1), "secret-findings")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        return SecretModel(words, None, [{0: (positive / n if n else 0.0,)}])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    path = table_path(spark, "secret-forest")
    forest.write().save(path)
    trees: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # at most TREES * 2 ** (DEPTH + 1)
        d = r["nodeData"]
        leaf = d["leftChild"] < 0
        trees.setdefault(r["treeID"], {})[d["id"]] = (d["impurityStats"][1] / sum(d["impurityStats"]),) if leaf else (d["split"]["featureIndex"], d["split"]["leftCategoriesOrThreshold"][0], d["leftChild"], d["rightChild"])
    return SecretModel(words, forest, list(trees.values()))


def _judged(text: Column, path: Column, model: SecretModel) -> Column:
    """array<struct<start,end,value,probability>> of a text's candidates."""

    def judge(s: Column) -> Column:
        vector = _vector(s["value"], s["before"], s["after"], path, model.words)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _bind(vector, model.probability).alias("probability"))

    return F.transform(spans(text, CANDIDATE, HINT), judge)


def judge(findings: DataFrame, model: SecretModel) -> DataFrame:
    """findings (value, before, after, path) with the forest's probability."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return findings.withColumn("probability", _bind(_vector(F.col("value"), text("before"), text("after"), text("path"), model.words), model.probability))


def scan(docs: DataFrame, model: SecretModel, path: str = "source") -> DataFrame:
    """doc_id, start, end, value, probability and is_secret of every candidate in every whole text.

    A null text has none; a null path says nothing. Repeated rows have their candidates each. Extra columns are ignored; an empty
    table gives an empty one.
    """
    found = docs.select("doc_id", F.explode(_judged(F.coalesce("text", F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")), model)).alias("s"))
    return found.select("doc_id", "s.*", (F.col("s.probability") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel, path: str = "source") -> DataFrame:
    """docs with every secret in ``text`` replaced by ``MASK``; all rows stay, in all their columns. Each row is judged by itself."""
    text = F.col("text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)).alias("out"))
    secrets = F.filter(_judged(F.coalesce(text, F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")), model), lambda s: s["probability"] >= 0.5)
    masked = _bind(secrets, lambda found: F.when(F.size(found) > 0, F.aggregate(found, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text))
    return docs.withColumn("text", masked)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(labelled_findings(spark), dictionary(docs)))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")
