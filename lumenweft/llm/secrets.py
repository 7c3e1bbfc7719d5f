"""Secret scans: pattern candidates, and a random forest that takes out false positives.

Candidates, their neighbouring words and all features are column expressions; the forest is grown on the driver from a
bounded table of labelled findings and runs as nested CASE expressions. No Python runs on the executors.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm.native import let

# What a candidate looks like. A private key from its first line to its last (or, where another first line or
# the last line of something else comes before that, or none, with the lines of characters that follow: so no sign is looked
# at again for another first line); whatever is assigned to a naming word (8 characters or more, of any kind but blanks
# and quotes); a key by its known head; 16 characters or more with a digit. A name and its value are apart: '=' only ends a
# candidate.
_KEY = r"A-Za-z0-9+/=\s:,\\"
_BLOCK = rf"-----BEGIN [A-Z ]{{0,24}}PRIVATE KEY-----(?:[{_KEY}]*+(?:-(?!----(?:BEGIN|END) )[{_KEY}]*+)*+-----END [A-Z ]{{0,24}}PRIVATE KEY-----|(?:\s{{1,4}}[A-Za-z0-9+/=]{{16,}}){{0,200}})"
_IN = r"A-Za-z0-9+/_\-"
# What stands right before is looked at in steps, the cheapest first.
_NAMED = r"(?<=[=: \t\"'])(?<=[=:][ \t]{0,2}[\"']?)(?<=(?i:token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|credential)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?)(?![=:])[^\s\"'`,;<>]{8,}"
CANDIDATE = rf"{_BLOCK}|{_NAMED}|(?<![{_IN}])(?:(?:AKIA|ghp_|eyJ)[{_IN}]{{13,}}|(?=[A-Za-z+/_\-]*+[0-9])[{_IN}]{{16,}})={{0,2}}"

# Neighbouring words that speak for and against a secret, paths of examples, placeholders.
FOR = r"(?i)(token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private)[^\n]{0,16}$"
AGAINST = r"(?i)(sha-?\d*|md5|commit|checksum|hash|uuid|guid|etag|digest|integrity|revision|session|isbn|url|https?)[^\n]{0,16}$"
# Right after a finding: what ends a value, and what says that it is none.
ENDED = r"^([\"';,)]|\s*$|\s*\n)"
AFTERWARDS = r"(?i)^[^\n]{0,12}\b(example|sample|placeholder|checksum|digest|commit|revision|dummy|fake|page|chapter)\b"
EXAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/)"
PLACEHOLDER = r"(?i)(example|xxxx|your|change.?me|placeholder|dummy|00000|12345|abcdef)"
# Frequent words and endings of the languages at hand, and words that names in programs are made of.
DICTIONARY = (
    "the and ing tion ment able ness with from this that which there have not are was for ence ance ious ally er en der die das und ein sch keit ung lich che les des que eau eux ier oi ou la le de el "
    "los las cion ado mente ar re in on st an or es over under between about after before other some time year people world work home water light house stone river winter summer "
    "user name data file index page list value test config server client message error request response service account manager default version update string number array object class "
    "method table column image style button header footer content search filter result public static final return import export module package build release example sample internal external"
).split()

FEATURES = ("length", "digits", "capitals", "transitions", "variety", "hex", "dictionary", "letter_run", "word_for", "word_against", "assigned", "ended", "word_after", "example_path", "placeholder", "groups")

#: Neighbouring characters that are looked at, bound on labelled findings, and the forest.
LEFT, RIGHT = 60, 30
TRAIN_ROWS, TREES, DEPTH, LEAF = 4000, 15, 5, 8
THRESHOLD = 0.5


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """FEATURES of a candidate with what stands before and after it and the path of its text."""
    c, n = candidate, F.length(candidate).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    runs = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "transitions": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "dictionary": 1.0 - F.length(F.regexp_replace(c, "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")) / n,
        "letter_run": F.coalesce(F.array_max(runs), F.lit(0)) / n,
        "word_for": flag(before.rlike(FOR)),
        "word_against": flag(before.rlike(AGAINST)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "ended": flag(F.coalesce(after, F.lit("")).rlike(ENDED)),
        "word_after": flag(after.rlike(AFTERWARDS)),
        "example_path": flag(path.rlike(EXAMPLE_PATH)),
        "placeholder": flag(c.rlike(PLACEHOLDER)),
        "groups": F.regexp_count(c, F.lit("[-_/=+]")).cast("double"),
    }


def with_features(df: DataFrame) -> DataFrame:
    """Adds FEATURES to a table with candidate, before, after and path."""
    return df.withColumns(features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")))


def labelled_findings(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, 1 if a secret): findings as reviewers label them, generated by rule."""
    rng = random.Random(seed)
    hexes, letters, more = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: "".join(rng.choice(DICTIONARY) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 6))) + " "
    keyed = lambda: rng.choice(["token", "api_key", "secret", "password", "auth_token", "ACCESS_KEY", "client_secret", "Bearer", "credential"])
    benign = lambda: rng.choice(["sha256", "md5", "commit", "checksum", "hash", "uuid", "etag", "integrity", "revision", "session"])
    joined = lambda: rng.choice([" = \"", "=", ": ", ": '", " "])
    closing = lambda: rng.choice(['" ' + prose(), '"', "\n" + prose(), "'\n", " " + prose(), ""])
    denied = lambda: rng.choice([" is an example ", " (sample) ", " checksum ", " # placeholder ", " is the commit ", ", a dummy "]) + prose()
    key = [
        lambda: pick(hexes, rng.choice([32, 40, 64])),
        lambda: pick(letters, rng.randint(20, 44)),
        lambda: pick(more, rng.choice([40, 44, 64])),
        lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16),
        lambda: "ghp_" + pick(letters, 36),
        lambda: "eyJ" + pick(letters, rng.randint(30, 80)),
        lambda: pick(hexes, 40).upper(),
    ]
    plain = [
        lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)),
        lambda: word() + word() + word() + word() + word() + str(rng.randint(0, 9999)),
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))) + "-" + str(rng.randint(1, 2030)),
        lambda: "/".join([word() for _ in range(rng.randint(3, 6))] + [str(rng.randint(1, 99))]),
        lambda: rng.choice(string.digits) * rng.randint(16, 40),
        lambda: pick(string.digits, rng.randint(16, 24)),
        lambda: rng.choice("=-_") * 10 + pick(string.digits, 2) + rng.choice("=-_") * 10,
        lambda: "your_" + word() + "_key_here_" + pick(string.digits, 3),
        lambda: "EXAMPLE" + pick(letters, 20),
        lambda: "_".join(word() for _ in range(4)) + str(rng.randint(1, 9)),
    ]
    out = []
    for _ in range(rows):
        path = rng.choice(["src0", "src7", "app/config.py", "web/settings", "notes.txt", "tests/test_auth.py", "docs/example.md"])
        kind = rng.random()
        test = path.startswith(("tests", "docs"))
        if kind < 0.4:
            out.append((rng.choice(key)(), prose() + keyed() + joined(), closing(), path, int(not test or rng.random() < 0.3)))
        elif kind < 0.5:  # keys without a word that names them
            out.append((rng.choice(key[1:6])(), prose() + rng.choice(["", "= \"", ": "]), closing(), path, int(not test)))
        elif kind < 0.55:
            out.append((rng.choice(key[:3])(), prose() + rng.choice(["", benign() + joined()]), denied(), path, 0))
        elif kind < 0.65:
            out.append((rng.choice(key[:3])(), prose() + benign() + joined(), closing(), path, 0))
        elif kind < 0.75:
            out.append((rng.choice(plain[7:9])(), prose() + keyed() + joined(), " " + prose(), path, 0))
        else:
            out.append((rng.choice(plain)(), prose() + rng.choice(["", "", benign() + joined()]), rng.choice([" " + prose(), closing()]), path, 0))
    return out


Tree = float | tuple[int, float, "Tree", "Tree"]


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> Tree:
    """A CART tree on a random third or so of the features at each split (Gini gain)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * leaf or p in (0.0, 1.0):
        return p
    best: tuple[float, int, float] | None = None
    for f in rng.choice(x.shape[1], max(2, round(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.arange(leaf, len(y) - leaf + 1)
        k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
        if len(k):
            left, right = t[k - 1], t[-1] - t[k - 1]
            impurity = left * (1 - left / k) + right * (1 - right / (len(y) - k))
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0]:
                best = (float(impurity[i]), int(f), float((v[k[i] - 1] + v[k[i]]) / 2))
    if best is None:
        return p
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[side], y[side], rng, depth - 1, leaf), grow_tree(x[~side], y[~side], rng, depth - 1, leaf)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 3) -> list[Tree]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow_tree(x[rows], y[rows], rng, depth, leaf))
    return out


def _tree_column(tree: Tree, feature: Callable[[str], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    which, cut, low, high = tree
    return F.when(feature(FEATURES[which]) <= cut, _tree_column(low, feature)).otherwise(_tree_column(high, feature))


def forest_column(forest: list[Tree], feature: Callable[[str], Column] = F.col) -> Column:
    """The mean vote of the trees over the features."""
    return reduce(lambda a, b: a + b, [_tree_column(t, feature) for t in forest]) / float(len(forest))


_forests: dict[int, list[Tree]] = {}


def trained_forest(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list[Tree]:
    """A forest on labelled findings (TRAIN_ROWS at most); grown once a process for the built-in ones."""
    if findings is None and 0 in _forests:
        return _forests[0]
    rows = (labelled_findings() if findings is None else findings)[:TRAIN_ROWS]
    table = with_features(spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int"))
    seen = table.select(*FEATURES, "label").coalesce(1).collect()
    data = np.array([list(r) for r in seen], float)
    forest = grow_forest(data[:, :-1], data[:, -1])
    if findings is None:
        _forests[0] = forest
    return forest


def found_in(text: Column) -> Column:
    """The candidates of a text, in order."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def neighbourhoods(parts: Column, found: Column) -> Column:
    """(candidate, before, after) of each candidate, given what the text has between them.

    What stands before a candidate ends its part of the text, what stands after it begins the next part.
    """
    last = lambda p: F.when(F.length(p) > LEFT, F.substring(p, -LEFT, LEFT)).otherwise(p)
    return F.transform(found, lambda c, i: F.struct(c.alias("candidate"), last(F.get(parts, i)).alias("before"), F.substring(F.get(parts, i + 1), 1, RIGHT).alias("after")))


def around(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text's parts between candidates and the candidates; null if there are none. The text is split only then."""
    return let(found_in(text), lambda found: F.when(F.size(found) > 0, let(F.split(text, CANDIDATE), lambda parts: body(parts, found))))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, ordinal, candidate, before, after): every candidate of every text with its neighbourhood."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    listed = let(text, lambda t: around(t, neighbourhoods))
    df = docs.select("doc_id", (F.col(path).cast("string") if path in docs.columns else F.lit("")).alias("path"), F.posexplode(listed).alias("ordinal", "found"))
    return df.select("doc_id", "path", "ordinal", "found.candidate", "found.before", "found.after")


def secret_scan(docs: DataFrame, path: str = "source", threshold: float = THRESHOLD, findings: list | None = None) -> DataFrame:
    """A row for each candidate: doc_id, ordinal, kind, candidate, score, secret.

    ``docs`` has doc_id, text and, as path, ``path`` (empty if there is no such column). Null and empty texts have no
    candidates; repeated rows and repeated candidates are all listed, ``ordinal`` being the place among a row's
    candidates. A private key's head is always a secret. Other columns, clashing names among them, are ignored; an empty table
    gives no rows. Texts are searched whole, in time that grows with their length.
    """
    found = with_features(candidates(docs, path))
    head = F.col("candidate").startswith("-----BEGIN ")
    kind = F.when(head, "private_key").when(F.col("hex") == 1.0, "hex").when(F.col("candidate").rlike("^(AKIA|ghp_|eyJ)"), "known_prefix").otherwise("token")
    scored = found.withColumn("score", F.when(head, 1.0).otherwise(forest_column(trained_forest(docs.sparkSession, findings))))
    return scored.select("doc_id", "ordinal", kind.alias("kind"), "candidate", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, path: str = "source", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``mark`` in the place of each secret; n_chars, if there, follows. No row is dropped or moved.

    The forest votes within the row, and only in texts with a candidate. Only the place of the candidate changes: the same
    characters inside another word stay. A private key goes from its first line to its last. Null, empty and clean texts,
    other columns, repeated rows and an empty table stay as they are.
    """
    forest = trained_forest(docs.sparkSession)
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")

    def secret(x: Column) -> Column:
        named = features(x.candidate, x.before, x.after, place)
        vote = let(F.struct(*(v.alias(k) for k, v in named.items())), lambda f: forest_column(forest, lambda name: f[name]))
        return x.candidate.startswith("-----BEGIN ") | (vote >= threshold)

    def cleaned(parts: Column, found: Column) -> Column:
        instead = F.transform(neighbourhoods(parts, found), lambda x: F.when(secret(x), F.lit(mark)).otherwise(x.candidate))
        return F.array_join(F.flatten(F.zip_with(parts, instead, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")

    text = F.col("text").cast("string")
    out = docs.withColumn("text", F.when(text.isNotNull(), let(text, lambda t: F.coalesce(around(t, cleaned), t))))
    if "n_chars" in docs.columns:
        kept = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), kept).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    """Every candidate of every document with its digest, score and verdict; see ``secret_scan``."""
    found = secret_scan(docs)
    return found.select("doc_id", "ordinal", "kind", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score", "secret")
