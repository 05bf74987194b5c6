"""Secret scans: a random forest removes false positives from candidates, with DataFrame functions only.

A candidate is a run of 16 or more characters of identifiers and encodings; a word may have several. The forest sees its length, how
likely its character transitions are among the corpus' words, how much of it a dictionary covers, where it stands and its
neighbouring words. It is grown level by level from sums over (tree, node, feature, bin) of a bounded sample of labelled
findings, and applied as an expression. What decides a label (names, assignments, published shapes) is no feature. Found
values are never written: tables between the steps hold their features and digests.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drawn, written

RUN = "[A-Za-z0-9+/_-]{16,}"
#: What ends a field of a word, as in JSON and queries; no run has one.
FIELDS = r"[,;&?|(){}\[\]<>]"
#: Words that name secrets.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key")
#: Published shapes of issued keys.
SHAPES = (r"^AKIA[A-Z0-9]{16}$", r"^ASIA[A-Z0-9]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abpr]-[A-Za-z0-9-]{10,}$", r"^sk_live_[A-Za-z0-9]{20,}$", r"^AIza[A-Za-z0-9_-]{35}$")
#: Forest: trees, levels, bins a feature; the share of features tried at a node.
TREES, LEVELS, BINS, TRIED = 12, 5, 16, 0.4
#: Bound of the sample: labelled findings of each class.
FINDINGS = 2000
#: The dictionary: words of 3 to 12 letters in at least this share of all documents, the most common ones first up to a number.
DICTIONARY_SHARE, DICTIONARY_WORDS = 0.002, 2000
#: What transitions are between; others count as the last.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SECRET = 0.5


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate of whole texts: doc_id, path, position (word), run_index (in the word), run, before (what stands before it), quoted, next.

    Before the first run of a word stand the two earlier words and the word up to the run; before a later one, its own field of
    the word (FIELDS end one) up to the run, so that a name in one-line JSON belongs to its own value only.
    """
    words = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), words.alias("w")).filter(F.exists("w", lambda x: x.rlike(RUN)))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(RUN))
    rows = rows.select("doc_id", "path", "w", F.explode(at).alias("position"))
    near = lambda k: F.coalesce(F.get("w", F.col("position") + k), F.lit(""))
    rows = rows.select("doc_id", "path", "position", near(0).alias("word"), F.concat_ws(" ", near(-2), near(-1)).alias("earlier"), near(1).alias("next"))
    first = F.concat(F.lower("earlier"), F.lit(" "), F.lower(F.expr("substring_index(word, run, 1)")))
    rows = rows.withColumn("run", F.regexp_extract("word", f"({RUN})", 1)).withColumn("first", first).withColumn("quoted", F.col("word").rlike("[\"'`]"))
    runs = F.flatten(F.transform(F.split("word", FIELDS), _runs))
    rows = rows.select("doc_id", "path", "position", "first", "quoted", "next", F.posexplode(runs).alias("run_index", "found"))
    before = F.when(F.col("run_index") == 0, F.col("first")).otherwise(F.lower("found.front"))
    return rows.select("doc_id", "path", "position", "run_index", "found.run", before.alias("before"), "quoted", "next")


def _runs(field: Column) -> Column:
    """(run, front) of each run of a field; front is the field up to the run."""
    runs, gaps = F.regexp_extract_all(field, F.lit(f"({RUN})")), F.split(field, RUN)
    pieces = lambda i: F.zip_with(F.slice(runs, 1, i), F.slice(gaps, 2, i), lambda r, g: F.concat(r, g))
    return F.transform(runs, lambda r, i: F.struct(r.alias("run"), F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces(i), "")).alias("front")))


def dictionary(docs: DataFrame) -> dict[str, int]:
    """The corpus' common words and their numbers of documents, counted over all documents; bounded by a share of them."""
    total = docs.count()
    word = F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-zà-öø-ÿ]+")))
    count = docs.select(word.alias("x")).filter(F.length("x").between(3, 12)).groupBy("x").agg(F.count("*").alias("c"))
    common = count.filter(F.col("c") >= max(2, DICTIONARY_SHARE * total)).orderBy(F.desc("c"), "x").limit(DICTIONARY_WORDS)
    return {r["x"]: r["c"] for r in common.collect()}


def _pattern(words: list[str]) -> str:
    """A regular expression of these words, longer ones first, with their common beginnings once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        parts = [c + of(node[c]) for c in sorted(node) if c]
        return "" if not parts else f"(?:{'|'.join(parts)})" + "?" * ("" in node)

    return of(tree)


def transitions(known: dict[str, int]) -> list[float]:
    """log2 of the smoothed probability of each character after each, among the words of the dictionary; by 27 * first + second."""
    k = len(LETTERS) + 1
    counts = [[0.5] * k for _ in range(k)]
    place = {c: i for i, c in enumerate(LETTERS)}
    for w, n in known.items():
        for a, b in zip(w[:-1], w[1:], strict=True):
            counts[place.get(a, k - 1)][place.get(b, k - 1)] += n
    return [math.log2(x / sum(row)) for row in counts for x in row]


def features(known: dict[str, int]) -> dict[str, Column]:
    run, n = F.col("run"), F.length("run").cast("double")
    share = lambda cls: F.regexp_count(run, F.lit(cls)) / n
    pattern = _pattern(list(known))
    covered = lambda c: 1 - F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1)) if known else F.lit(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    table, k = F.array(*[F.lit(x) for x in transitions(known)]), len(LETTERS) + 1
    places = F.transform(F.filter(F.split(F.lower(run), ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(LETTERS)), F.lit(0)), F.lit(k)) - 1)
    steps = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.size(places)), lambda a, b: F.get(table, a * k + b))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "symbols": share("[+/_-]"),
        "transitions": F.aggregate(steps, F.lit(0.0), lambda total, x: total + x) / n,
        "consonants": share("(?i)[bcdfghjklmnpqrstvwxz]{4,}"),
        "vowels": share("(?i)[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(run, ""))) / n,
        "hex": flag(run.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "covered": covered(F.lower(run)),
        "path_tests": flag(F.lower("path").rlike("test|example|sample|doc|fixture|mock")),
        "early": 1.0 / (1.0 + F.col("position")),
        "before_covered": covered(F.regexp_extract("before", r"([^ ]*)$", 1)),
        "next_covered": covered(F.lower("next")),
    }


def labels() -> Column:
    """1 for published shapes and for values that a name of secrets is assigned, 0 for what is neither named, assigned nor quoted; else null."""
    named, assigned = F.col("before").rlike("|".join(NAMES)), F.col("before").rlike("[=:]\\s*[\"']?$")
    shaped = F.col("run").rlike("|".join(SHAPES))
    return F.when(shaped | (named & assigned), 1).when(~named & ~assigned & ~F.coalesce(F.col("quoted"), F.lit(False)), 0)


class Forest:
    """Trees as {(tree, node): (feature, threshold)} and {(tree, node): value}."""

    def __init__(self, names: list[str], splits: dict, values: dict, prior: float):
        self.names, self.splits, self.values, self.prior = names, splits, values, prior

    def score(self) -> Column:
        """Mean of the trees' shares of secrets, of columns named like the features."""

        def node(t: int, i: int, above: float) -> Column:
            value = self.values.get((t, i), above)
            if (t, i) not in self.splits:
                return F.lit(float(value))
            feature, edge = self.splits[t, i]
            return F.when(F.col(self.names[feature]) <= edge, node(t, 2 * i + 1, value)).otherwise(node(t, 2 * i + 2, value))

        return sum((node(t, 0, self.prior) for t in range(TREES)), F.lit(0.0)) / TREES


def train(labelled: DataFrame, names: list[str], per_class: int = FINDINGS) -> Forest:
    """A forest from a bounded sample of labelled findings: columns doc_id, position, run_index, y and the features.

    The sample: of each class, about ``per_class`` findings by a threshold of md5(doc_id, position, run_index; a word's first run without the
    index), so that no task sorts or gathers a class; all findings of a class that has no more. Bootstrap weights and the
    features tried at a node come from hashes, so training again gives the same forest. Without findings every score is 0, of one
    class its label.
    """
    key = F.concat_ws(":", "doc_id", "position", F.when(F.col("run_index") > 0, F.col("run_index")))
    n = {r["y"]: r["c"] for r in labelled.groupBy("y").agg(F.count("*").alias("c")).collect()}  # two classes
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, per_class / c))) for y, c in sorted(n.items())], F.lit(0.0))
    sample = labelled.withColumn("k", F.md5(key.cast("binary"))).filter(drawn(key) <= share)
    sample = written(sample.select("k", "y", *names), "findings")
    grid = [i / BINS for i in range(1, BINS)]
    row = sample.agg(F.avg("y").alias("prior"), *[F.percentile(n, F.array(*[F.lit(g) for g in grid])).alias(n) for n in names]).first()
    prior = float(row["prior"] or 0.0)
    edges = [sorted(set(row[n] or [])) for n in names]
    bins = F.array(*[sum((F.when(F.col(n) > e, 1).otherwise(0) for e in edges[i]), F.lit(0)) for i, n in enumerate(names)])
    draw = F.conv(F.substring(F.md5(F.concat("k", F.col("tree").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") / 65536
    weight = F.when(draw < 0.368, 0).when(draw < 0.736, 1).when(draw < 0.92, 2).otherwise(3)  # Poisson(1)
    rows = sample.select("k", "y", bins.alias("bins"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).withColumn("w", weight).filter("w > 0")
    rows = written(rows.select("tree", "w", "y", "bins", F.lit(0).alias("node")), "trees")
    splits, values = {}, {}
    for level in range(LEVELS):
        wide = rows.select("tree", "node", "w", "y", F.posexplode("bins").alias("feature", "bin"))
        sums = wide.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")).collect()  # bounded by trees, nodes, features and bins
        new = _best_splits(sums, edges, level == LEVELS - 1, values)
        if not new:
            break
        splits |= {k: (f, edges[f][b]) for k, (f, b) in new.items()}
        table = rows.sparkSession.createDataFrame([(t, n, f, b) for (t, n), (f, b) in new.items()], "s_tree int, s_node int, s_feature int, s_bin int")
        split = rows.join(F.broadcast(table), (F.col("tree") == F.col("s_tree")) & (F.col("node") == F.col("s_node")))  # a row a node at most
        child = 2 * F.col("node") + 1 + (F.get("bins", F.col("s_feature")) > F.col("s_bin")).cast("int")
        rows = written(split.select("tree", "w", "y", "bins", child.alias("node")), "trees")
    return Forest(names, splits, values, prior)


def _tried(tree: int, node: int, feature: int) -> bool:
    """Whether a feature is drawn for a node, by a hash of the three."""
    return int.from_bytes(hashlib.md5(f"{tree}:{node}:{feature}".encode()).digest()[:4], "big") < TRIED * 2**32


def _best_splits(sums: list, edges: list, last: bool, values: dict) -> dict:
    nodes: dict = {}
    for r in sums:
        nodes.setdefault((r["tree"], r["node"]), {}).setdefault(r["feature"], {})[r["bin"]] = (r["w"], r["s"])
    out = {}
    gini = lambda w, s: 2 * s * (w - s) / w if w else 0.0
    for (t, i), by in sorted(nodes.items()):
        w, s = (sum(x[j] for x in by[0].values()) for j in (0, 1))
        values[t, i] = s / w
        if last or w < 8 or s in (0, w):
            continue
        best = (1e-9, None)
        for f, hist in sorted(by.items()):
            if not edges[f] or not _tried(t, i, f):
                continue
            lw = ls = 0
            for b in range(len(edges[f])):
                x = hist.get(b, (0, 0))
                lw, ls = lw + x[0], ls + x[1]
                gain = gini(w, s) - gini(lw, ls) - gini(w - lw, s - ls)
                if 0 < lw < w and gain > best[0]:
                    best = (gain, (f, b))
        if best[1]:
            out[t, i] = best[1]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, position, run_index, length, score, is_secret, run_sha256: a row for each candidate of docs (doc_id, text, source).

    The value itself is neither returned nor written. Null and empty texts have no candidates; very long texts and words are
    scanned whole; repeated rows are scanned each; findings that tie in the sample's hash are all in or out; a null doc_id is
    kept; further columns, of whatever name, play no part; no documents, no rows. Labels come from context and published
    shapes (labels), the forest judges all by the rest.
    """
    columns = features(dictionary(docs))
    found = candidates(docs).select("doc_id", "position", "run_index", F.length("run").alias("n"), F.sha2("run", 256).alias("run_sha256"), labels().alias("y"), *[c.alias(n) for n, c in columns.items()])
    found = written(found, "candidates")
    score = train(found.filter("y is not null"), list(columns)).score()
    return found.select("doc_id", F.col("position").cast("long").alias("position"), "run_index", F.col("n").alias("length"), score.alias("score"), (score >= SECRET).alias("is_secret"), "run_sha256")
