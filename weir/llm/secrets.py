"""Secret scan: a random forest weeds out false findings. Native: DataFrame functions and Spark ML.

Candidates are all runs of ten or more key-like characters inside the words of a text, whatever they
are made of, and all values assigned to a keyword (``password=``, ``token: ``), whatever their length.
The forest sees the length and make-up of a candidate, the likelihood of its character
transitions, how much of it dictionary words cover, the path or address it stands in and the
words around it. It is trained on labelled findings; without any given, on candidates that a few
strict formats label. Only the labelled rows of the training are a sample: the character table and the
dictionary count all words of all texts, and every candidate of every whole text is scored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import fraction, words, written

CHARS = r"[A-Za-z0-9+/_.@-]"
CANDIDATE = CHARS + r"{10,}={0,2}"
#: A word that holds a run: ten such characters in a row.
HOLDER = rf"{CHARS}{{10}}"
#: What word and run must hold besides: nothing. The share of digits is a feature of the forest.
DIGITS = r""
KEYWORD = r"(?i)(pass|pwd|secret|token|key|auth|bearer|credential)"
#: A keyword as a name, ahead of its assignment.
NAME = KEYWORD + r"[\w.-]*[\"'`\])]*"
#: The value assigned inside a word; in the query of an address it ends at the next parameter.
ASSIGNED = NAME + r"(?:=>|:=|[=:]+)[\"'`(\[{]*([^\s\"'`]+)"
PARAMETER = r"[?&;][\w.-]*" + NAME + r"=([^\s\"'`&#]+)"
#: An address with user info, or with a long or named value in its query: it may carry a key.
CARRIER = rf"://[^/?#\s]+@|[?&;][^=&\s]*=[^&#\s]{{10,}}|{PARAMETER}"
#: The value of an assignment that ended with the word before, without quotes around it.
VALUE = r"^[\"'`(\[{<]*([^\s\"'`]+)"
#: Marks that close a sentence or a list, not a value.
CLOSING = r"[,;.)\]}>]+$"
CONFIG_PATH = r"(?i)(\.env|\.cfg|\.conf|\.ini|\.ya?ml|\.json|\.py|\.js|config|secret)"
CODES = "abcdefghijklmnopqrstuvwxyz0"
FEATURES = ["length", "digits", "upper", "lower", "changes", "transitions", "dictionary", "keyword", "assigned", "quoted",
            "path_chars", "address", "word_before", "word_after", "config_path"]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, text_hash, path, position (word, from 0), piece, value, lead, and the words around it.

    The runs of a word are its pieces from 0 in order; a value assigned to a keyword that is no run
    of the word by itself comes after them. NULL and empty texts have none. Equal rows have equal
    candidates, once each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), words(F.col(text)).alias("w"))
    q = lambda pattern: "r'" + pattern.replace("'", "\\x27") + "'"
    # Texts without any keyword, the usual case, are looked through for runs only.
    named = F.exists("w", lambda x: x.rlike(KEYWORD))
    ahead = (f"(get(w, i - 2) rlike {q(NAME + '(?:=>|:=|[=:]+)$')} or (get(w, i - 2) rlike '^(=>|:=|[=:]+)$' and get(w, i - 3) rlike {q(NAME + '$')}))")
    found = rows.withColumn("named", named).withColumn("hits", F.expr(
        f"filter(sequence(1, size(w)), i -> i <= size(w) and (get(w, i - 1) rlike '{HOLDER}' or (named and (get(w, i - 1) rlike {q(ASSIGNED)} or {ahead}))))"))
    context = F.expr("transform(hits, i -> struct(i - 1 as position, get(w, i - 1) as word, coalesce(get(w, i - 2), '') as before,"
                     f" coalesce(get(w, i - 3), '') as before2, coalesce(get(w, i), '') as after, named and coalesce({ahead}, false) as ahead))")
    one = found.select("doc_id", "text_hash", "path", F.explode(context).alias("c")).select("doc_id", "text_hash", "path", "c.*")
    runs = F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1)
    inside = F.when(F.col("word").rlike(PARAMETER), F.regexp_extract_all("word", F.lit(PARAMETER), 2)).when(
        F.col("word").rlike(ASSIGNED), F.regexp_extract_all("word", F.lit(ASSIGNED), 2)).when(
        F.col("ahead"), F.regexp_extract_all("word", F.lit(VALUE), 1)).otherwise(F.array().cast("array<string>"))
    given = F.array_distinct(F.filter(F.transform(inside, lambda x: F.regexp_replace(x, CLOSING, "")), lambda x: x != ""))
    values = one.withColumn("runs", runs).withColumn("runs", F.concat("runs", F.array_except(given, "runs"))).select(
        "doc_id", "text_hash", "path", "position", "word", "before", "before2", "after", F.posexplode("runs").alias("piece", "value"))
    return values.withColumn("lead", F.expr("substring_index(word, value, 1)"))


def language_tables(docs: DataFrame, text: str = "text", share: float = 0.0005) -> tuple[list[float], list[str]]:
    """Character transition log-probabilities (28 x 28, flat) and the dictionary, from all words of all texts.

    The dictionary holds the words of four or more letters a-z that make up ``share`` of all such words: at most 1 / ``share``.
    """
    counts = written(docs.select(F.explode(words(F.col(text))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).where(F.length("w") > 1), "words")
    coded = F.translate(F.regexp_replace("w", "[^a-z0-9]", "~"), "123456789", "000000000")
    chars = counts.select("n", F.split(coded, "").alias("c"))
    pairs = chars.select("n", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("x"), F.expr("slice(c, 2, size(c) - 1)").alias("y"))).alias("p"))
    table = [[1.0] * 28 for _ in range(28)]
    place = {c: i for i, c in enumerate(CODES + "~")}
    for r in pairs.groupBy("p.x", "p.y").agg(F.sum("n").alias("n")).collect():  # at most 28 x 28 rows
        table[place[r.x]][place[r.y]] += r.n
    flat = [round(math.log(v / sum(row)), 6) for row in table for v in row]
    known = counts.where(F.col("w").rlike("^[a-z]{4,}$"))
    total = known.agg(F.sum("n")).first()[0] or 0
    return flat, sorted(r.w for r in known.where(F.col("n") >= share * total).select("w").collect())


def with_features(found: DataFrame, transitions: list[float], dictionary: list[str]) -> DataFrame:
    """``found`` with the columns of ``FEATURES``."""
    v = F.col("value")
    n = F.length(v)
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "."), "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    out = found.withColumn("__c", F.regexp_replace(F.regexp_replace(F.lower(v), "[0-9]", "0"), "[^a-z0]", "~")).withColumn("__t", F.array(*[F.lit(x) for x in transitions]))
    code = "coalesce(nullif(instr('" + CODES + "', substr(__c, {}, 1)), 0), 28)"
    likely = F.expr(f"aggregate(sequence(1, length(__c) - 1), 0D, (s, i) -> s + get(__t, ({code.format('i')} - 1) * 28 + {code.format('i + 1')} - 1)) / (length(__c) - 1)")
    starts: dict[str, list[str]] = {}  # by their first letter, the longest first: few words are tried at a place
    for w in sorted(dictionary, key=lambda w: (-len(w), w)):
        starts.setdefault(w[0], []).append(w[1:])
    entries = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(starts.items()))
    known = (n - F.length(F.regexp_replace(F.lower(v), entries, ""))) / n if dictionary else F.lit(0.0)
    flag: dict[str, Column] = {
        "keyword": F.concat_ws(" ", "before2", "before", "lead").rlike(KEYWORD),
        "assigned": F.col("lead").rlike("[=:]\\W*$") | ((F.col("lead").rlike("^\\W*$")) & F.col("before").rlike("[=:]$")),
        "quoted": F.col("lead").rlike("[\"'`]$"),
        "address": F.col("word").rlike("://|@"),
        "word_before": F.col("before").rlike(r"^\p{L}+[,.]?$"),
        "word_after": F.col("after").rlike(r"^\p{L}+[,.]?$"),
        "config_path": F.col("path").rlike(CONFIG_PATH),
    }
    values = {"length": n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "changes": changes / n, "transitions": likely,
              "dictionary": known, "path_chars": share("[/.@]"), **flag}
    return out.withColumns({k: values[k].cast("double") for k in FEATURES}).drop("__c", "__t")


def strict_labels(found: DataFrame) -> DataFrame:
    """Candidates whose format leaves no doubt, with ``is_secret``: access ids and assigned long keys
    against addresses, plain numbers, file names and words that no keyword stands by. The others are left
    out, as is all that stands in an address that may carry a key and has no certain format."""
    v, near = F.col("value"), F.concat_ws(" ", "before2", "before", "lead")
    secret = v.rlike("^AKIA[0-9A-Z]{16}$") | v.rlike("^gh[pousr]_[A-Za-z0-9]{30,}$") | (near.rlike(KEYWORD + r"[\w-]*\W*$") & v.rlike("^[A-Fa-f0-9]{16,}$"))
    plain = F.col("word").rlike(r"://|@|^\W*www\.") | v.rlike("^[0-9+./_-]+$") | v.rlike(r"\.[a-z]{2,5}$")
    plain = plain | (v.rlike("^[A-Za-z]?[a-z]+([-/._@+][A-Za-z]?[a-z]+)*[-/._@+]*$") & ~near.rlike(KEYWORD))
    plain = plain & ~F.col("word").rlike(CARRIER)
    return found.withColumn("is_secret", F.when(secret & ~plain, 1.0).when(plain & ~secret, 0.0)).where("is_secret is not null")


def sampled(labelled: DataFrame, max_rows: int = 4000) -> DataFrame:
    """Of each label at most ``max_rows`` rows, by a pseudo-random number of their value."""
    parts = [labelled.where(F.col("is_secret") == x).orderBy(fraction("value"), "doc_id", "position", "piece").limit(max_rows) for x in (0.0, 1.0)]
    return parts[0].unionByName(parts[1])


def fit(labelled: DataFrame, trees: int = 20, depth: int = 6):
    """Random forest on ``labelled`` (FEATURES, is_secret). None where either label is missing."""
    rows = written(labelled.select(*FEATURES, "is_secret").coalesce(1), "findings")
    if rows.select("is_secret").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="is_secret", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None,
         threshold: float = 0.5) -> DataFrame:
    """One row per candidate: the columns of ``candidates`` with score and is_secret.

    ``labelled`` are findings with the columns of ``candidates`` and ``is_secret`` (0 or 1); where
    None, ``strict_labels`` of the scanned documents serve. With findings of one label only there
    is nothing to learn: every candidate then scores what ``strict_labels`` says, else 0.
    Extra columns of ``docs`` are not read.
    """
    found = written(candidates(docs, doc_id, text, path), "candidates")
    table, dictionary = language_tables(docs, text)
    rows = with_features(found, table, dictionary)
    # Labels need no features: these are computed for the rows that the forest learns from, and once for all to be scored.
    known = written(sampled(labelled if labelled is not None else strict_labels(found)), "labelled")
    model = fit(with_features(known, table, dictionary))
    if model is None:
        v = strict_labels(found).where("is_secret = 1").select("value").distinct().withColumn("score", F.lit(1.0))
        scored = found.join(v, "value", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_hash", "path", "position", "piece", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def _without(mark: Column):
    def replaced(t: Column, s: Column) -> Column:
        bare = F.regexp_replace(s, "([^A-Za-z0-9])", "\\\\$1")
        edges = F.concat(F.when(s.rlike("^[A-Za-z0-9]"), F.lit("(?<![A-Za-z0-9])")).otherwise(""), bare,
                         F.when(s.rlike("[A-Za-z0-9]$"), F.lit("(?![A-Za-z0-9])")).otherwise(""))
        return F.when(F.length(s) < 10, F.regexp_replace(t, edges, mark)).otherwise(F.replace(t, s, mark))

    return replaced


def redact(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``found`` replaced by ``mark``; same columns, same rows.

    A secret of fewer than ten characters is replaced where it stands by itself, not inside longer words.
    """
    per_doc = found.where("is_secret").groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.collect_set("value").alias("__s"))
    per_doc = per_doc.withColumn("__s", F.expr("transform(sort_array(transform(__s, x -> struct(length(x) as n, x as x)), false), y -> y.x)"))
    joined = docs.join(per_doc, F.col(doc_id).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__h")), "left")
    clean = F.when(F.col("__s").isNull(), F.col(text)).otherwise(F.aggregate("__s", F.col(text), _without(F.lit(mark))))
    return joined.withColumn(text, clean).select(*docs.columns)
