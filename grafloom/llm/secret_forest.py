"""Secret scan with a random forest that removes false positives, in DataFrame functions only.

One regular expression marks candidates: known key shapes, private-key blocks, quoted values of telling names
and long runs that hold a digit. A text with candidates is split at the marks, so each candidate has its place
and the words around it. Features are columns: length, character transitions, classes of characters, repeated
characters, coverage by dictionary words, the path, and the neighbouring words. The dictionary is the words of
the corpus that stand in the most documents, counted over all of them, and a short list. The forest is grown on
a table of labelled findings, a bounded number of each label (by default a seeded table made here; ``tests/llm``
measures precision and recall on findings made otherwise); their features are computed by the same columns. Its
trees become CASE expressions, so scanning needs no Python on executors.

Defined cases: null or empty text has no candidates; candidates never overlap; 0x01 in a text counts as a
space; offsets count characters from 0 and the end is exclusive; rows with null or repeated ids are
scanned row by row; extra columns are kept by ``redact`` and ignored by ``scan``; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spare

# Shapes of candidates, dictionary words, telling words.
SHAPES = {
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "host_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}+",
    "service_key": r"\b(?:sk|rk|pk)[-_](?:[a-z0-9]{2,10}[-_]){0,3}[A-Za-z0-9][A-Za-z0-9_-]{18,}+",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}+",
    "map_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+",
    # To its END line; without one, header lines and the long lines that follow, with the short one after them.
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\r?\n(?:[A-Za-z-]++:[^\r\n]*+|(?=\r?\n)))*+(?:\r?\n[A-Za-z0-9+/]{40,}+={0,2})++(?:\r?\n[A-Za-z0-9+/]++={0,2}(?=[\r\n]|$))?+)?+",
    "quoted_value": r"""(?<=["'])(?<=(?i:passwo?r?d|pwd|secret|token|api[_-]?key|credentials?)["']?\s{0,2}(?:=|:|=>)\s{0,2}["'])[^\s"'<>{}]{8,}+""",
    "long_run": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
DICTIONARY = "access account address admin alpha amber and api app base beta build cache case check class client code commit common config content data date debug default delta demo device document email error event example field file final first for from function green group hash header home host image index info input item key label language large last level line link list local log long main master message method mode model module name network new node not note number object open option order output page parent part password path person phone place plain point port private process product project public query random record red release report request result role root rule sample secret section select server service session set simple size source start state status string style system table target team temp test text the this time title token total tree type update user value version view web with word work world yes zone".split()
TELLING = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|client.?id)"
HARMLESS = r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|order|invoice|phone|isbn|example|placeholder|fingerprint|version|integrity)"
ASSIGNED = r"""(?:[=:]|=>|is)\s*["'`]?$"""
HARMLESS_PATH = r"(?i)(?:test|example|sample|mock|fixture|docs?/|vendor|node_modules|\.lock|\.md$)"

CONTEXT = 48
_MARK = "\u0001"
_ANY = "|".join(SHAPES.values())
_SHAPED = "^(?:" + "|".join(v for k, v in SHAPES.items() if k not in ("long_run", "quoted_value")) + ")"
FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "dictionary", "hexadecimal", "telling", "harmless", "assigned", "path", "shaped", "dashes"]
#: Words of the corpus that count as a dictionary: those of the most documents.
DICTIONARY_WORDS = 2_000


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The words of 4 to 12 Latin letters that stand in the most documents: the dictionary of this corpus."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return sorted(r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(most).collect())


def _candidate_features(text: Column, left: Column, right: Column, path: Column, words: list[str]) -> list[Column]:
    """Numbers from 0 to 1 (length: characters), in the order of FEATURES."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    kinds = F.translate(text, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26)
    same = F.length(F.regexp_replace(kinds, r"(.)\1++", "$1")).cast("double")
    runs = F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    number = lambda c: c.cast("double")
    return [
        number(F.length(text)),
        (same - 1) / n,
        F.length(F.regexp_replace(text, "[^0-9]", "")) / n,
        F.length(F.regexp_replace(text, "[^A-Z]", "")) / n,
        F.size(F.array_distinct(F.split(text, ""))) / n,
        F.aggregate(F.filter(runs, lambda x: x.isin(words)), F.lit(0), lambda a, x: a + F.length(x)) / n,
        number(text.rlike("^[0-9a-fA-F]+$")),
        number(left.rlike(TELLING)),
        number(left.rlike(HARMLESS) | right.rlike(HARMLESS)),
        number(left.rlike(ASSIGNED)),
        number(F.coalesce(path, F.lit("")).rlike(HARMLESS_PATH)),
        number(text.rlike(_SHAPED)),
        F.length(F.regexp_replace(text, "[^/_-]", "")) / n,
    ]


def labelled_findings(seed: int = 23, rows: int = 4_000, words: list[str] = DICTIONARY) -> list[tuple[str, str, str, str, int]]:
    """(candidate, left, right, path, is a secret): shapes of both kinds in contexts that mostly tell them apart,
    with nouns from ``words``. A stand-in for findings that people have labelled, which ``train`` takes as a table."""
    rng = random.Random(seed)
    pick = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    hexa, upper, alnum, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noun = lambda: rng.choice(words)
    secrets = [
        lambda: "AKIA" + pick(upper, 16), lambda: "ghp_" + pick(alnum, 36), lambda: rng.choice(["sk-", "sk_live_", "rk_live_"]) + pick(alnum, rng.randint(24, 48)),
        lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum, 40),
        lambda: (lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----" + rng.choice(["", f"\n{pick(b64, 64)}\n{pick(b64, 30)}==\n-----END {kind}PRIVATE KEY-----"]))(rng.choice(["", "RSA ", "EC ", "OPENSSH "])),
        lambda: "sk-" + rng.choice(["proj", "svc", "live"]) + "-" + "-".join(pick(alnum, rng.randint(8, 24)) for _ in range(rng.randint(1, 3))),
    ]
    loose = [lambda: pick(alnum + "!#%&*+.,;@", rng.randint(10, 24)), lambda: pick(hexa, rng.choice([32, 40, 40, 40, 48, 64])), lambda: pick(alnum, rng.randint(20, 48)), lambda: pick(b64, rng.choice([40, 44, 64])) + rng.choice(["", "=", "=="])]
    tells = ["token", "api_key", "apikey", "secret", "client_secret", "password", "auth_token", "access_key", "Authorization: Bearer", "private_token", "credential"]
    links = [' = "', "=", ': "', ": ", " = '", '="', "='", ' => "']
    dull = ["sha256", "commit", "checksum", "md5", "revision", "etag", "digest", "integrity", "fingerprint", "uuid", "hash", "Invoice number", "order"]
    harmless = [
        lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), lambda: pick(alnum, rng.randint(20, 44)),
        lambda: "_".join(noun() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)), lambda: "/".join(noun() for _ in range(rng.randint(3, 7))) + f"/{rng.randint(1, 2000)}",
        lambda: pick("0123456789", rng.randint(16, 24)), lambda: f"20{pick('0123456789', 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}-" + "-".join(noun() for _ in range(3)),
        lambda: rng.choice("x0a1") * rng.randint(18, 40) + "0", lambda: "your-" + noun() + "-" + noun() + "-here-" + str(rng.randint(0, 9)),
        lambda: "AKIA" + "IOSFODNN7EXAMPLE",
    ]
    plain = lambda: " ".join(noun() for _ in range(rng.randint(3, 6)))
    out = []
    for _ in range(rows):
        kind = rng.random()
        path = rng.choice(["src/app/" + noun() + ".py", "config/" + noun() + ".yml", "src" + str(rng.randint(0, 19)), "web", ""])
        end = rng.choice(['" ', "' ", " ", "\n", ".", '"\n']) + plain()
        if kind < 0.25:
            out.append((rng.choice(secrets)(), f"{plain()} {rng.choice([*tells, noun()])}{rng.choice(links + [' '])}", end, path, 1))
        elif kind < 0.5:
            out.append((rng.choice(loose)(), f"{plain()} {rng.choice(tells)}{rng.choice(links)}", end, path, 1))
        elif kind < 0.6:
            out.append((rng.choice(harmless[:5])(), f"{plain()} {rng.choice(tells)}{rng.choice(links)}", end, rng.choice(["tests/", "docs/", "examples/"]) + noun() + ".md", 0))
        elif kind < 0.8:
            out.append((rng.choice(harmless)(), f"{plain()} {rng.choice(dull)}{rng.choice([' ', ': ', '=', '-', ':'])}", end, path, 0))
        else:
            out.append((rng.choice(harmless[3:])(), plain() + rng.choice([" ", ": ", "\n", " ("]), end, path, 0))
    return out


@dataclass
class Forest:
    """trees: nested (feature, limit, at most, above) or the share of secrets in a leaf."""

    trees: list
    words: list[str]

    def score(self, row: Callable[[str], Column]) -> Column:
        """The share of the trees' votes, from a row of features by name."""

        def grow(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(row(FEATURES[t[0]]) <= t[1], grow(t[2])).otherwise(grow(t[3]))

        return F.round(sum((grow(t) for t in self.trees[1:]), grow(self.trees[0])) / len(self.trees), 6)


def grow_forest(x: np.ndarray, y: np.ndarray, words: list[str], trees: int = 9, depth: int = 5, least: int = 12, seed: int = 3) -> Forest:
    """Gini trees on bootstrap samples with a random half of the features at each split."""
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray, level: int):
        p = float(y[rows].mean())
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return round(p, 4)
        best = (0.0, None, None)
        for f in rng.choice(x.shape[1], max(1, math.ceil(x.shape[1] / 2)), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order) + 1)
            cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (n[::-1][1:] >= least))
            if len(cut):
                a, b = ones[cut] / n[cut], (ones[-1] - ones[cut]) / (len(order) - n[cut])
                gain = p * (1 - p) - (n[cut] * a * (1 - a) + (len(order) - n[cut]) * b * (1 - b)) / len(order)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), int(f), float(round((v[cut[k]] + v[cut[k] + 1]) / 2, 6)))
        if best[1] is None:
            return round(p, 4)
        down = x[rows, best[1]] <= best[2]
        return (best[1], best[2], split(rows[down], level + 1), split(rows[~down], level + 1))

    return Forest([split(np.sort(rng.integers(0, len(y), len(y))), 0) for _ in range(trees)], words)


FINDINGS = "text string, lhs string, rhs string, path string, label int"


def train(spark: SparkSession, findings: DataFrame | None = None, words: list[str] | None = None, rows: int = 4_000) -> Forest:
    """Grows the forest on labelled findings (the columns of FINDINGS), about ``rows`` of each label, chosen by hash;
    their features come from the columns that scan uses. Without a table, on ``labelled_findings``."""
    words = sorted({*DICTIONARY, *(words or [])})
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(rows=rows, words=words), FINDINGS).coalesce(1)
    else:
        sizes = {r["label"]: r["count"] for r in findings.filter("label in (0, 1)").groupBy("label").count().collect()}
        draw = F.pmod(F.xxhash64("text", "lhs", "rhs"), F.lit(1 << 30)) / float(1 << 30)
        findings = findings.filter(draw < F.when(F.col("label") == 1, rows / max(1, sizes.get(1, 0))).otherwise(rows / max(1, sizes.get(0, 0))))
    cols = _candidate_features(F.col("text"), F.coalesce("lhs", F.lit("")), F.coalesce("rhs", F.lit("")), F.col("path"), words)
    table = findings.filter("text is not null and label in (0, 1)").select(*(c.alias(n) for c, n in zip(cols, FEATURES, strict=True)), "label")
    rows_in = np.array(sorted([float(v) for v in r] for r in table.collect())).reshape(-1, len(FEATURES) + 1)
    return grow_forest(rows_in[:, :-1], rows_in[:, -1], words) if len(rows_in) else Forest([0.0], words)


def _cut(text: Column) -> Column:
    """Context, candidate, context, ... in turn; null for a text without a candidate."""
    clean = F.translate(text.cast("string"), _MARK, " ")
    return F.when(text.cast("string").rlike(_ANY), F.split(F.regexp_replace(clean, f"({_ANY})", f"{_MARK}$1{_MARK}"), _MARK))


def _judged(cut: Column, path: Column, forest: Forest) -> Column:
    """An array with (at, text, score) of each candidate. The context runs across the candidate before."""

    def features(i: Column) -> Column:
        left = F.right(F.concat(F.coalesce(F.try_element_at(cut, F.greatest(i - 2, F.lit(1))), F.lit("")), F.element_at(cut, i - 1)), F.lit(CONTEXT))
        right = F.left(F.element_at(cut, i + 1), F.lit(CONTEXT))
        text = F.element_at(cut, i)
        cols = _candidate_features(text, F.when(i > 2, left).otherwise(F.right(F.element_at(cut, F.lit(1)), F.lit(CONTEXT))), right, path, forest.words)
        return F.struct(i.alias("at"), text.alias("text"), *(c.alias(n) for c, n in zip(cols, FEATURES, strict=True)))

    each = F.transform(F.sequence(F.lit(2), F.size(cut) - 1, F.lit(2)), features)
    return F.transform(each, lambda c: F.struct(c["at"].alias("at"), c["text"].alias("text"), forest.score(lambda name: c[name]).alias("score")))


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, kind, start, stop, digest, score, is_secret), a row for each candidate."""
    forest = forest or train(docs.sparkSession, words=corpus_words(docs, text_col))
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), _cut(F.col(text_col)).alias("cut")).filter("cut is not null")
    each = rows.select("id", F.transform("cut", lambda x: F.length(x).cast("long")).alias("len"), F.explode(_judged(F.col("cut"), F.col("path"), forest)).alias("c"))
    start = F.aggregate(F.slice("len", F.lit(1), F.col("c.at") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    kind = F.lit("long_run")
    for name, shape in reversed(SHAPES.items()):
        if name == "quoted_value":  # known by what stands before it
            kind = F.when(~F.col("c.text").rlike("^(?:" + SHAPES["long_run"] + ")$"), name).otherwise(kind)
        elif name != "long_run":
            kind = F.when(F.col("c.text").rlike(f"^(?:{shape})"), name).otherwise(kind)
    found = each.select("id", kind.alias("kind"), start.alias("start"), "c.*")
    return found.select(F.col("id").alias(id_col), "kind", "start", (F.col("start") + F.length("text")).alias("stop"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, text_col: str = "text", path_col: str | None = "source", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; other rows and columns stay as they are."""
    forest = forest or train(docs.sparkSession, words=corpus_words(docs, text_col))
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    cut, bad = spare(docs, "cut"), spare(docs, "bad")
    rows = docs.withColumn(cut, _cut(F.col(text_col)))
    secret = F.transform(F.filter(_judged(F.col(cut), path, forest), lambda c: c["score"] >= threshold), lambda c: c["at"])
    rows = rows.withColumn(bad, F.when(F.col(cut).isNotNull(), secret))
    masked = F.array_join(F.transform(cut, lambda x, i: F.when(F.array_contains(bad, i + 1), F.lit(mask)).otherwise(x)), "")
    return rows.withColumn(text_col, F.when(F.size(bad) > 0, masked).otherwise(F.col(text_col))).drop(cut, bad)
