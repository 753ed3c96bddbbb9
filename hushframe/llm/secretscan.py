"""Secret scans whose false positives a random forest removes, with DataFrame functions only.

Candidates are long words of key-like characters, whatever is assigned to a word that names a
secret (up to the closing quote, if it has an opening one; a passphrase to the end of its line), and
passwords within addresses. Features are length, kinds of characters and how often
they change, how likely the candidate's transitions from character to character are in the corpus'
own words, how much of it words of the corpus cover, whether it looks like a path or a plain
number, and the words before it. The forest is Spark's own, trained on labelled findings: keys,
passwords and phrases of many shapes in assignments; ordinary words of the corpus, assigned ones
too, numbers, paths and digests.

Nothing is sampled: words and transitions are counted over all texts, copies as often as they
stand there, and all distinct long words of the corpus are ordinary findings. Features lie on a
grid, so that findings alike are one weighted row and the rows of the training, however large the
corpus, are bounded; each tree is grown on all of them, and its thresholds come from all of them.
Weights are whole numbers over a power of two, whose sums are exact, so that the forest does not
depend on how rows are dealt.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle

MIN_CHARS, MAX_CHARS = 12, 400
#: Words that name a secret when they stand before it.
KEYWORDS = "token|secret|passphrase|password|passwd|pass|pwd|apikey|api_key|api-key|access_key|accesskey|auth|bearer|credential|private_key|client_secret"
#: Published prefixes of service keys.
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29\.|eyJ|npm_|pypi-|SG\.)"
LABELLED = 6000  # labelled findings, of all kinds of shapes together
#: Of the corpus: its most frequent words, which cover candidates, and what all of its long words weigh together, at most, against the labelled findings.
DICTIONARY, CORPUS_WEIGHT = 2000, 2000
TREES, DEPTH, THRESHOLD, SEED = 32, 8, 0.5, 11
#: Features are multiples of one part in so many. Bins of a feature, at least; rows of the training in a task.
GRID, BINS, TASK_ROWS = 64, 32, 20_000
#: From a name to where its value begins.
_TO_VALUE = r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}"
ASSIGNED = rf"(?i:{KEYWORDS}){_TO_VALUE}[\"']?"
#: A password in an address: after the scheme and a name, before the host.
USERINFO = r"://[^\s/:@]{1,64}:"
#: Values: quoted ones up to their quote, passphrases up to the end of the line, others up to a blank or quote without the punctuation at their end; passwords in addresses; long words.
CANDIDATE = (
    "(?:" + "|".join(rf"(?<=(?i:{KEYWORDS}){_TO_VALUE}{q})[^{q}]+(?={q})" for q in ("\"", "'")) + rf"|(?<=(?i:passphrase){_TO_VALUE})[^\s\"'][^\"']*[^\s\"',;<>.]|(?<=(?i:{KEYWORDS}){_TO_VALUE})[^\s\"']*[^\s\"',;<>.]"
    rf"|(?<={USERINFO})[^\s/@]+(?=@)|[A-Za-z0-9_\-+/.~]{{{MIN_CHARS},}}={{0,2}})"
)
NAMES = ("length", "digits", "uppers", "others", "changes", "flow", "covered", "distinct", "hex", "number", "path", "dots", "prefix", "keyword", "userinfo", "blanks", "assigned", "quoted")
#: Characters whose transitions are told apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_./"


def hinted(text: Column) -> Column:
    """A condition that any text with a candidate meets: a long word with a digit or two capitals apart, or an assignment to one of the words."""
    inner = r"[A-Za-z0-9_\-+/.~]"
    long_word = rf"(?<!{inner})(?={inner}{{{MIN_CHARS}}})(?:[A-Za-z_\-+/.~]*+[0-9]|{inner}*[a-z][A-Z]{inner}*[a-z][A-Z])"
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return text.rlike(long_word) | (assigned & text.rlike(rf"(?i:{KEYWORDS})[\"']?[ \t]{{0,3}}[=:]|{USERINFO}"))


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc, at, nth, before, after, candidate)``: assigned values, and words of key-like characters with a digit or with capitals in their midst; and the 40 characters before.

    Only lines with a candidate are cut; a line's parts are the pieces between its candidates.
    """
    lines = docs.where(hinted(F.col(text))).select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    lines = lines.where(hinted(F.col("line")))
    cut = lines.select("doc", "at", F.split("line", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("line", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    rows = cut.select("doc", "at", "gaps", "found", F.posexplode("found").alias("nth", "candidate"))
    before = F.concat(F.coalesce(F.get("found", F.col("nth") - 1), F.lit("")), F.get("gaps", F.col("nth")))
    after = F.left(F.get("gaps", F.col("nth") + 1), F.lit(1))
    rows = rows.select("doc", "at", "nth", F.right(before, F.lit(40)).alias("before"), after.alias("after"), "candidate")
    return rows.where(F.col("candidate").rlike("[0-9]|[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]") | F.col("before").rlike(f"(?:{ASSIGNED}|{USERINFO})$"))


class Language:
    """What the corpus' own words are like: log-odds of the transitions between their characters, and the most frequent of them, counted over all texts."""

    def __init__(self, docs: DataFrame, text: str):
        words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.char_length("word") >= 3)
        counts = settle(words.groupBy("word").agg(F.count("*").alias("n")))
        plain = counts.where(F.char_length("word").between(4, 20) & F.col("word").rlike("^[a-z]+$"))
        # Words too rare for the dictionary are left out first, by a count per power of two, or each task would send as many as it holds.
        least, more = 0, 0
        for r in plain.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("words")).orderBy(F.desc("bits")).collect():
            least, more = (1 << r["bits"] - 1, more + r["words"]) if more < DICTIONARY else (least, more)
        frequent = plain.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(DICTIONARY)
        self.words = sorted(r["word"] for r in frequent.select("word").collect())
        pairs = counts.select("n", F.explode(_pairs(F.col("word"))).alias("pair"))
        codes = pairs.groupBy(_code(F.col("pair.a")).alias("a"), _code(F.col("pair.b")).alias("b")).agg(F.sum("n").alias("n"))
        kinds = len(ALPHABET) + 1
        seen = [[1.0] * kinds for _ in range(kinds)]
        for r in codes.collect():  # as many rows as pairs of kinds, at most
            seen[r["a"]][r["b"]] += r["n"]
        self.flow = [math.log(n / sum(row)) for row in seen for n in row]

    def transitions(self, column: str) -> Column:
        """Mean log-odds of the column's transitions."""
        pairs, kinds = _pairs(F.lower(F.col(column))), len(ALPHABET) + 1
        table = constants([repr(x) for x in self.flow]).cast("array<double>")
        at = lambda pair: F.get(table, _code(pair["a"]) * kinds + _code(pair["b"]))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + at(pair)) / F.greatest(F.size(pairs), F.lit(1))

    def covered(self, column: str) -> Column:
        """Characters of the column in words of the dictionary."""
        parts = F.split(F.lower(F.regexp_replace(column, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
        known = F.filter(parts, lambda p: (p != "") & F.contains(F.lit(f" {' '.join(self.words)} "), F.concat(F.lit(" "), p, F.lit(" "))))
        return F.aggregate(known, F.lit(0), lambda acc, p: acc + F.char_length(p))


def constants(values: list[str]) -> Column:
    """An array of fixed strings without blanks, as one constant: thousands of literals would burden every rule of the planner."""
    return F.split(F.lit(" ".join(values)), " ")


def _pairs(word: Column) -> Column:
    """Each character of the word but the last, with the next one, in time that grows with its length."""
    characters = F.split(word, "")
    n = F.size(characters) - 1
    return F.arrays_zip(F.slice(characters, F.lit(1), n).alias("a"), F.slice(characters, F.lit(2), n).alias("b"))


def _code(character: Column) -> Column:
    """Number of a character, 0 for those outside the alphabet."""
    return F.coalesce(F.instr(F.lit(ALPHABET), character), F.lit(0))


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(pattern)).cast("double")


def featured(rows: DataFrame, language: Language) -> DataFrame:
    """Adds the columns NAMES, on the grid; from ``before, after, candidate``."""
    n = F.char_length("candidate").cast("double")
    # Kinds of characters: small, capital, digit, other.
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]", "\x01"), "[A-Z]", "\x02"), "[0-9]", "\x03"), "_-+/=.~", "\x04" * 7)
    kinds = F.regexp_replace(kinds, "[^\x01-\x04]", "\x04")
    rows = rows.withColumn("kinds", kinds)
    changes = F.lit(0.0)
    for k in "\x01\x02\x03\x04":
        changes = changes + _count("kinds", f"{k}(?!{k}|$)")
    values = {
        "length": F.least(n, F.lit(float(MAX_CHARS))),
        "digits": _count("candidate", "[0-9]") / n,
        "uppers": _count("candidate", "[A-Z]") / n,
        "others": _count("candidate", "[^A-Za-z0-9]") / n,
        "changes": changes / n,
        "flow": language.transitions("candidate"),
        "covered": language.covered("candidate") / n,
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / n,
        "hex": F.col("candidate").rlike("^[0-9a-fA-F]+$").cast("double"),
        "number": F.col("candidate").rlike(r"^[0-9.\-+/]+$").cast("double"),
        "path": _count("candidate", "/"),
        "dots": _count("candidate", r"\."),
        "prefix": F.col("candidate").rlike(PREFIXES).cast("double"),
        "keyword": F.lower("before").rlike(rf"(?:{KEYWORDS})[^a-z]{{0,6}}$").cast("double"),
        "userinfo": F.col("before").rlike(f"{USERINFO}$").cast("double"),
        "blanks": _count("candidate", r"\s"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double"),
    }
    return rows.withColumns({name: F.floor(value * GRID + 0.5) / GRID for name, value in values.items()})


def assembled(rows: DataFrame) -> DataFrame:
    """Adds ``features``, the vector of the columns NAMES."""
    return VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows)


def labelled_findings(spark: SparkSession, docs: DataFrame, text: str, language: Language) -> DataFrame:
    """``(own, label, before, after, candidate)``: generated findings of known shapes, phrases of the corpus' words among them, and all distinct long words of the corpus as false ones (``own``)."""
    seed = spark.range(LABELLED, numPartitions=4).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("x"), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))).alias("b"))
    words = language.words or ["word"]
    nth = lambda k: F.get(constants(words), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))).cast("int"))
    sign = F.substr(F.lit("!#$%&*?@"), (F.col("id") % 8 + 1).cast("int"), F.lit(1))
    upper, b62 = F.upper("x"), F.regexp_replace("b", "[+/=]", "7")
    word = F.element_at(F.array(*[F.lit(w) for w in ("token", "secret", "password", "api_key", "auth", "client_secret", "DB_PASS", "pwd")]), (F.shiftright("id", 5) % 8 + 1).cast("int"))
    joint = F.element_at(F.array(*[F.lit(w) for w in (' = "', '="', ": ", " = ", "=", ' = "')]), (F.shiftright("id", 3) % 6 + 1).cast("int"))
    plain = F.element_at(F.array(*[F.lit(w) for w in ("the ", "of this ", "und ", "le ", "ref: ", "commit ", "", "see ")]), (F.shiftright("id", 2) % 8 + 1).cast("int"))
    quote = F.when(F.endswith(joint, F.lit('"')), F.lit('"')).otherwise(F.lit(" "))
    number = F.translate("x", "abcdef", "012345")
    shapes = [  # label, before, after, candidate
        (1.0, F.concat(word, joint), quote, F.left("x", F.lit(40))),
        (1.0, F.upper(F.concat(word, joint)), quote, F.left(upper, F.lit(40))),
        (1.0, F.concat(word, joint), quote, F.left(b62, 20 + (F.col("id") % 44).cast("int"))),
        (1.0, F.concat(word, joint), quote, F.concat(F.left("b", F.lit(43)), F.lit("="))),
        (1.0, F.concat(word, joint), quote, F.concat(F.left("b", F.lit(4)), sign, F.substring("b", 5, 3))),
        (1.0, F.concat(word, joint), quote, F.concat(F.left(b62, F.lit(3)), nth(1), F.substring("x", 1, 2))),
        (1.0, F.concat(word, joint), quote, F.concat_ws("-", nth(1), nth(2), nth(3), nth(4))),
        (1.0, F.concat(word, joint), quote, F.left(F.translate("b", "0123456789+/=", "qwertzuiopasd"), F.lit(20))),
        (1.0, F.concat(word, joint), quote, F.concat(F.left(F.lower(b62), F.lit(2)), F.left(number, 1 + (F.col("id") % 3).cast("int")), F.lit("7"))),
        (1.0, F.concat(word, F.lit('="')), F.lit('"'), F.concat(F.left("b", F.lit(2)), F.lit(","), F.substring("b", 3, 2), F.lit(";<"), F.substring("b", 5, 3), F.lit(">"), sign)),
        (1.0, F.concat(word, joint), quote, F.concat(nth(1), F.left(number, F.lit(1)), nth(2), F.substring(number, 2, 1))),
        (1.0, F.concat(F.lit("passphrase"), joint), quote, F.concat_ws(" ", nth(1), nth(2), nth(3), nth(4))),
        (1.0, F.concat(plain, F.lit("https://"), nth(3), F.lit(":")), F.lit("@"), F.concat(F.left(b62, F.lit(4)), nth(1), F.left(number, F.lit(1)))),
        (0.0, F.concat(F.lit("passphrase: ")), F.lit(""), F.concat_ws(" ", nth(1), nth(2))),
        (0.0, plain, F.lit(" "), F.concat(F.upper(nth(1)), F.lit("-"), F.left(number, F.lit(3)), F.lit("-"), F.substring(number, 4, 1), F.lit("-"), F.substring(number, 5, 2), F.lit("-"), F.substring(number, 7, 6), F.lit("-"), F.substring(number, 13, 1))),
        (0.0, F.concat(word, F.lit(": ")), F.lit(" "), nth(5)),
        (0.0, F.concat(word, F.lit(": ")), F.lit(""), F.concat(nth(6), F.lit("."))),
        (0.0, F.concat(word, joint), quote, F.concat_ws("_", nth(7), nth(8))),
        (0.0, plain, F.lit(" "), F.concat_ws("-", nth(1), nth(2), nth(3), F.left(number, F.lit(2)))),
        (0.0, plain, F.lit(" "), F.concat(nth(1), F.initcap(nth(2)), F.initcap(nth(3)), F.initcap(nth(4)))),
        (1.0, plain, F.lit(" "), F.concat(F.lit("AKIA"), F.left(upper, F.lit(16)))),
        (1.0, plain, F.lit(" "), F.concat(F.lit("ghp_"), F.left(b62, F.lit(36)))),
        (1.0, plain, F.lit(" "), F.concat(F.lit("sk_live_"), F.left(b62, F.lit(24)))),
        (1.0, plain, F.lit(" "), F.concat(F.lit("eyJ"), F.left(b62, F.lit(30)), F.lit("."), F.right(b62, F.lit(40)))),
        (0.0, plain, F.lit(" "), F.left(number, 12 + (F.col("id") % 8).cast("int"))),
        (0.0, plain, F.lit(" "), F.concat(F.left(number, F.lit(3)), F.lit("."), F.substring(number, 4, 3), F.lit("."), F.substring(number, 7, 3), F.lit("."), F.substring(number, 10, 2))),
        (0.0, plain, F.lit(" "), F.concat(F.left("x", F.lit(8)), F.lit("-"), F.substring("x", 9, 4), F.lit("-4"), F.substring("x", 13, 3), F.lit("-a"), F.substring("x", 16, 3), F.lit("-"), F.substring("x", 20, 12))),
        (0.0, plain, F.lit(" "), F.left("x", 40 + 24 * (F.col("id") % 2).cast("int"))),
        (0.0, plain, F.lit(" "), F.concat(F.lit("/usr/lib/python3/"), F.left("x", F.lit(6)), F.lit("/index.html"))),
        (0.0, plain, F.lit("@"), F.concat(F.lit("user.name."), F.left(number, F.lit(2)))),
        (0.0, plain, F.lit(" "), F.concat(F.lit("mail"), F.left(number, F.lit(1)), F.lit(".example.com"))),
        (0.0, plain, F.lit(" "), F.concat(F.lit("2024-"), F.substring(number, 3, 2), F.lit("-"), F.substring(number, 5, 2), F.lit("T10.00.00"))),
    ]
    each = F.array(*[F.struct(F.lit(y).alias("label"), b.alias("before"), a.alias("after"), c.alias("candidate")) for y, b, a, c in shapes])
    # Written by themselves: with the features, the code of so many shapes is more than Spark compiles.
    made = settle(seed.select(F.get(each, (F.col("id") % len(shapes)).cast("int")).alias("f")).select(F.lit(False).alias("own"), "f.*"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![^\s])[^\W\d_]{12,}(?![^\s])"), F.lit(0))).alias("candidate")).where(~F.col("candidate").rlike("[^A-Za-z]"))
    words = words.where(F.char_length("candidate") <= MAX_CHARS).distinct()
    return made.union(words.select(F.lit(True).alias("own"), F.lit(0.0).alias("label"), F.lit("the ").alias("before"), F.lit(" ").alias("after"), "candidate"))


def training_rows(findings: DataFrame, language: Language) -> DataFrame:
    """``(label, features, weight)`` of labelled findings, those alike together.

    Words of the corpus, if more than CORPUS_WEIGHT, weigh the power of two at which all of them
    together do not weigh more; every other finding weighs 1.
    """
    rows = settle(featured(findings, language).groupBy("own", "label", *NAMES).agg(F.count("*").alias("n")))
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("own"), F.col("n"))), F.lit(0))).first()
    each = 0.5 ** (max(-(-words // CORPUS_WEIGHT), 1) - 1).bit_length()
    weight = F.col("n") * F.when(F.col("own"), each).otherwise(1.0)
    return assembled(rows.coalesce(1 + n // TASK_ROWS)).select("label", "features", weight.alias("weight"))


def fitted(rows: DataFrame) -> RandomForestClassificationModel:
    """The forest grown on all ``rows(label, features, weight)``."""
    # Spark takes thresholds from a sample of as many rows as the square of its bins: these are enough for all.
    bins = max(BINS, math.isqrt(rows.count()) + 1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", weightCol="weight", maxBins=bins, bootstrap=False)
    return forest.fit(rows)


def secret_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc, at, nth, candidate, before, probability, secret``."""
    language = Language(docs, text)
    model = fitted(training_rows(labelled_findings(docs.sparkSession, docs, text, language), language))
    # Candidates are few; written once, as the forest's outputs each read the features again.
    found = settle(assembled(featured(candidates(docs, doc_id, text), language)).select("doc", "at", "nth", "candidate", "before", "features"))
    scored = model.transform(found)
    probability = F.get(vector_to_array("probability"), 1)
    return scored.select("doc", "at", "nth", "candidate", "before", probability.alias("probability"), (probability >= threshold).alias("secret"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document id: ``doc_id, n_candidates, n_secrets, secrets_sha256``.

    The last is over the sorted distinct secrets of the document, comma-joined, so that values
    do not leave the operator. Null and empty texts have no candidates; rows that repeat an id
    are one document; an empty table gives none.
    """
    found = secret_findings(docs, doc_id, text, threshold)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set(F.when(F.col("secret"), F.col("candidate")))), ","), 256)
    by = found.groupBy("doc").agg(F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"), digest.alias("digest"))
    ids = docs.select(doc_id).distinct()
    joined = ids.join(by.hint("merge"), ids[doc_id].eqNullSafe(by["doc"]), "left")
    return joined.select(doc_id, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("secrets_sha256"))
