"""Operators 3 and 9: a quality classifier of boosted trees, and quality rules with an isolation forest.

The classifier fits on a bounded sample of labelled rows of the learning fold (parameter max_rows, the
rows of least id hash); only its statistics, never its texts, come to the driver. The forest and its
threshold are aggregates over all clean labelled rows of that fold. Scoring covers all rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, held_out, table, text_of, words, written

#: Fixed values of the rules: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeat_words(w: list[str], size: int = 5) -> int:
    """How many words lie in a window of `size` words that the text has twice or more."""
    windows = list(zip(*(w[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, x in enumerate(windows):
        if counts[x] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and repeated words of a text."""
    w = words(text)
    return len(w), sum(map(len, w)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat_words(w)


FEATURES = (
    "characters", "words", "word length", "longest word", "distinct words", "top word", "symbols", "pipes",
    "exclamations", "digits", "full stops", "commas", "upper-case words", "same word again", "lines", "repeated lines",
    "words a line", "beyond ASCII", "repeated words",
)


def features(text: str) -> list[float]:
    """The statistics of a text that the classifier sees; shares are of words or characters."""
    w = words(text)
    n, chars = max(1, len(w)), max(1, len(text))
    lines = text.count("\n") + 1
    return [
        np.log1p(len(text)), np.log1p(len(w)), sum(map(len, w)) / n, max(map(len, w), default=0), len(set(w)) / n,
        max(Counter(w).values(), default=0) / n, sum(map(text.count, SYMBOLS)) / chars, text.count("|") / chars,
        text.count("!") / chars, sum(map(text.count, "0123456789")) / chars, text.count(".") / n, text.count(",") / n,
        sum(map(str.isupper, w)) / n, sum(map(str.__eq__, w, w[1:])) / n, lines / n, duplicate_lines(text) / lines,
        len(w) / lines, (len(text.encode()) - len(text)) / chars, repeat_words(w) / n,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


class Trees:
    """Boosted trees as complete binary trees in arrays: the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """The probability of label 1 for each row: all trees step down together, a block of rows at a time."""
        count = self.feature.shape[0]
        if not count:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree, depth, out = np.arange(count)[None, :], int(np.log2(self.leaf.shape[1])), np.empty(len(x))
        for i in range(0, len(x), block):
            rows = x[i : i + block]
            at, row = np.zeros((len(rows), count), np.int64), np.arange(len(rows))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (rows[row, self.feature[tree, at]] > self.cut[tree, at])
            out[i : i + block] = self.base + self.leaf[tree, at - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, count: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting on the logistic loss. Without rows of both labels, the share of 1 (0.5 without rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    inner, width = 2**depth - 1, x.shape[1]
    feature, cut, leaf = np.zeros((count, inner), int), np.full((count, inner), np.inf), np.zeros((count, 2**depth))
    raw = np.full(len(y), base)
    for t in range(count):
        p = 1 / (1 + np.exp(-raw))
        g, h, at = y - p, p * (1 - p), np.zeros(len(y), int)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-6)
            split = np.full((nodes, 2), -1)
            for f in range(width):
                slot = local * bins + coded[:, f]
                G, H, N = (np.bincount(slot, v, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                left, right = (G**2 / (H + ridge)), ((G[:, -1:] - G) ** 2 / (H[:, -1:] - H + ridge))
                gain = left + right - G[:, -1:] ** 2 / (H[:, -1:] + ridge)
                gain[(N < least) | (N[:, -1:] - N < least)] = -1
                k = gain.argmax(axis=1)
                better = gain[np.arange(nodes), k] > best
                best[better], split[better, 0], split[better, 1] = gain[np.arange(nodes), k][better], f, k[better]
            for node in range(nodes):
                f, k = split[node]
                if f >= 0 and k < len(cuts[f]):
                    feature[t, first + node], cut[t, first + node] = f, cuts[f][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        local = at - inner
        leaf[t] = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        raw += leaf[t, local]
    return Trees(base, feature, cut, leaf)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of the rows of at most max_rows labelled ids of the learning fold, those of least id hash.

    Rows without id or label don't count; of several labels of one id the lower one holds.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")


def sample_matrix(sample: DataFrame, make, width: int, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of a sample, on the driver; max_rows bounds them where ids are repeated."""

    def rows(batches):
        for batch in batches:
            x = make(batch["text"])
            yield pd.DataFrame({"x": list(x), "label": batch["label"]})

    made = written(sample.mapInPandas(rows, "x array<double>, label int"), "sample")
    got = made.limit(max_rows).toPandas()
    drop_written(made)
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, width)
    y = got["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((y, *x.T))  # the same model whatever the order of the rows
    return x[order], y[order]


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    return fit_trees(*sample_matrix(labelled(docs, labels, max_rows), matrix, len(FEATURES), max_rows))


def quality_score(model: Trees, text: Column) -> Column:
    """The score of a text between 0 and 1, by the trees' arrays (a few hundred KB, sent with the task)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    A null text is scored as an empty one; a null id is not held out. Equal texts have equal
    scores. Without labels of both kinds every score is the smoothed share of label 1.
    Other columns are not read.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(fit_classifier(docs, labels, max_rows), text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text the classifier doesn't reject; nulls, empty texts and repeated rows as in classify()."""
    return docs.where(quality_score(fit_classifier(docs, labels), text_of()) >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- quality rules -----------------------------------------------------------------------------


#: How many shares the forest sees.
WIDTH = 4


def rule_matrix(counts: np.ndarray) -> np.ndarray:
    """What the forest sees: shares that don't depend on a text's length."""
    n = np.maximum(1, counts[:, 0])
    return np.stack([counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / n], axis=1)


def counts_of(texts) -> np.ndarray:
    return np.array([rule_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)


def base_failed(counts: np.ndarray, least_words: int = 10, repeat_percent: int = 20) -> np.ndarray:
    return (counts[:, 0] < least_words) | (100 * counts[:, 4] > repeat_percent * counts[:, 0])


def usual_depth(n) -> np.ndarray:
    """The mean path length of a failed search in a binary tree of n rows, by which paths are scaled."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees in arrays as complete binary trees; a text is odd if random splits isolate it early."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, path: np.ndarray, scale: float, threshold: float = np.inf):
        self.feature, self.cut, self.path, self.scale, self.threshold = feature, cut, path, scale, threshold

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Between 0 and 1, higher for odder rows."""
        out, count = np.zeros(len(x)), self.feature.shape[0]
        if not count:
            return out
        tree = np.arange(count)[None, :]
        for i in range(0, len(x), block):
            out[i : i + block] = 2 ** (-self.path[tree, self.nodes(x[i : i + block])].mean(axis=1) / self.scale)
        return out

    def nodes(self, rows: np.ndarray) -> np.ndarray:
        """The node of each tree where a row ends, (row, tree)."""
        count = self.feature.shape[0]
        tree, last = np.arange(count)[None, :], self.path.shape[1] - 1
        at, row = np.zeros((len(rows), count), np.int64), np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(last + 2)) - 1):
            f = self.feature[tree, at]
            if (f < 0).all():
                break
            at = np.where(f < 0, at, 2 * at + 1 + (rows[row, np.maximum(f, 0)] > self.cut[tree, at]))
        return at


def fit_forest(x: np.ndarray, margin: np.ndarray | float = 0.0, count: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """Random splits of random subsets, as deep as the logarithm of the subset's size.

    margin: how far beyond a node's own range its cut may lie, by column. It lets rows that are
    odd in a column which is constant among x be cut off from all of them.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    if rows < 2:
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 1.0)
    depth = int(np.ceil(np.log2(rows)))
    size = 2 ** (depth + 1) - 1
    feature, cut, path = np.full((count, size), -1), np.zeros((count, size)), np.zeros((count, size))
    for t in range(count):
        todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)])]
        while todo:
            node, level, part = todo.pop()
            path[t, node] = level + usual_depth(len(part))
            if level == depth or len(part) < 2:
                continue
            low, high = part.min(axis=0) - margin, part.max(axis=0) + margin
            able = np.flatnonzero(high > low)
            if not len(able):
                continue
            f = rng.choice(able)
            feature[t, node], cut[t, node] = f, rng.uniform(low[f], high[f])
            right = part[:, f] > cut[t, node]
            todo += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return Forest(feature, cut, path, float(usual_depth(rows)))


#: The five counts of a text, by column.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(text: Column) -> Column:
    """The counts of a text, as a struct."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(COUNTS, counts_of(texts).T)))

    return counts(text)


def node_ranges(rows: DataFrame, forest: Forest) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each node that rows (x) come to: how many do, and their least and greatest values.

    A node's number is that of its tree times the nodes of a tree, and its own. Each task gives a row for each node.
    """
    count, size = forest.feature.shape

    def run(batches):
        n, low, high = np.zeros(count * size, np.int64), np.full((count * size, WIDTH), np.inf), np.full((count * size, WIDTH), -np.inf)
        for batch in batches:
            for i in range(0, len(batch), 4096):
                x = np.array(batch["x"].iloc[i : i + 4096].tolist(), dtype=np.float64).reshape(-1, WIDTH)
                at = (forest.nodes(x) + size * np.arange(count)[None, :]).ravel()
                n += np.bincount(at, minlength=count * size)
                for f in range(WIDTH):
                    v = np.repeat(x[:, f], count)
                    np.minimum.at(low[:, f], at, v)
                    np.maximum.at(high[:, f], at, v)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"node": held, "n": n[held], **{f"low{f}": low[held, f] for f in range(WIDTH)}, **{f"high{f}": high[held, f] for f in range(WIDTH)}})

    ends = [f"{end}{f}" for end in ("low", "high") for f in range(WIDTH)]
    each = rows.mapInPandas(run, "node long, n long, " + ", ".join(f"{c} double" for c in ends))
    most = each.groupBy("node").agg(F.sum("n").alias("n"), *((F.min if c.startswith("low") else F.max)(c).alias(c) for c in ends))
    return {r["node"]: (r["n"], np.array(r[2 : 2 + WIDTH]), np.array(r[2 + WIDTH :])) for r in most.collect()}


def grow_forest(rows: DataFrame, margin: np.ndarray, count: int = 100, depth: int = 8, seed: int = 7) -> Forest:
    """An isolation forest of all rows (x): each level is an aggregate over them, and only ranges of nodes (count times 2**depth at most) come to the driver.

    margin: as in fit_forest(). Trees differ by their random cuts, not by their rows. A leaf's path
    counts all rows that come to it.
    """
    rng, size = np.random.default_rng(seed), 2 ** (depth + 1) - 1
    forest = Forest(np.full((count, size), -1), np.zeros((count, size)), np.zeros((count, size)), 1.0)
    for level in range(depth + 1):
        for node, (n, low, high) in sorted(node_ranges(rows, forest).items()):
            t, at = divmod(node, size)
            if at < 2**level - 1:  # an end of an earlier level
                continue
            if level == 0:
                forest.scale = float(max(usual_depth(n), 1.0))
            forest.path[t, at] = level + usual_depth(n)
            able = np.flatnonzero(high + margin > low - margin)
            if level == depth or n < 2 or not len(able):
                continue
            f = rng.choice(able)
            forest.feature[t, at], forest.cut[t, at] = f, rng.uniform(low[f] - margin[f], high[f] + margin[f])
            forest.path[t, 2 * at + 1 : 2 * at + 3] = level + 1  # where no row comes to
        if (forest.feature[:, 2**level - 1 : 2 ** (level + 1) - 1] < 0).all():
            break
    return forest


def nth_largest(values: DataFrame, column: str, n: int, few: int = 4096) -> float:
    """The n-th largest value (1: the largest), by counts within ranges that get narrower: `few` of them come to the driver at once."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        part = F.least(F.floor((F.col(column) - low) / (high - low) * few), F.lit(few - 1))
        held = values.where(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(held.collect(), key=lambda r: -r["part"]):
            low, high = r["low"], r["high"]
            if n <= r["n"]:
                break
            n -= r["n"]
    return float(low)


def fit_counts(counts: DataFrame, labels: DataFrame, clean_loss: float = 0.002) -> Forest:
    """The forest of all clean labelled rows that pass the base rules, of the learning fold, and the threshold that spares them.

    counts: doc_id and COUNTS. Rows without id or label don't count; of several labels of one id the lower one holds.
    The threshold is the lowest score that no more than clean_loss of the clean rows exceed.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )

    @F.pandas_udf("failed boolean, x array<double>")
    def seen(*columns: pd.Series) -> pd.DataFrame:
        c = np.stack([x.to_numpy() for x in columns], axis=1)
        return pd.DataFrame({"failed": base_failed(c), "x": list(rule_matrix(c))})

    rows = written(counts.join(known, "doc_id").select("label", seen(*COUNTS).alias("v")).select("label", "v.*").where("not failed").drop("failed"), "learned")
    spread = rows.agg(*(F.stddev_pop(F.col("x")[f]) for f in range(WIDTH))).first()
    margin = np.array([float(f"{v or 0.0:.9g}") for v in spread])  # the same whatever the order of the sums
    clean = rows.where("label = 1").select("x")
    forest, total = grow_forest(clean, margin), clean.count()
    if total:
        score = F.pandas_udf(lambda x: pd.Series(forest.score(np.array(x.tolist(), dtype=np.float64).reshape(-1, WIDTH))), "double")
        scores = written(clean.select(score("x").alias("score")), "scores")
        forest.threshold = nth_largest(scores, "score", total - min(total - 1, int(np.ceil(total * (1 - clean_loss)))))
        drop_written(scores)
    drop_written(rows)
    return forest


def counts_table(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row of docs, made once: what the forest learns from and what is judged are small rows without texts."""
    return written(docs.select("doc_id", counted(text_of()).alias("v")).select("doc_id", "v.*"), "counts")


def fit_rules(docs: DataFrame, labels: DataFrame) -> Forest:
    """fit_counts() of the texts of docs."""
    counts = counts_table(docs)
    forest = fit_counts(counts, labels)
    drop_written(counts)
    return forest


def rule_verdict(forest: Forest, counts: list[Column]) -> Column:
    """Whether the counts of a text fail the base rules, and whether it is kept."""

    @F.pandas_udf("base_failed boolean, kept boolean")
    def verdict(*columns: pd.Series) -> pd.DataFrame:
        c = np.stack([x.to_numpy() for x in columns], axis=1)
        failed = base_failed(c)
        return pd.DataFrame({"base_failed": failed, "kept": ~failed & (forest.score(rule_matrix(c)) <= forest.threshold)})

    return verdict(*counts)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for each row of docs.

    A null or empty text has no words, so it fails the base rules. Equal texts have equal rows.
    Without rows of label 1 that pass the base rules the forest rejects nothing. An empty table
    gives no rows. Other columns are not read.
    """
    counts = counts_table(docs)
    verdict = rule_verdict(fit_counts(counts, labels), [F.col(c) for c in COUNTS])
    return counts.select("doc_id", *COUNTS, verdict.alias("v")).select("doc_id", *COUNTS, "v.*")


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; nulls, empty texts and repeated rows as in apply_rules()."""
    counts = counted(text_of())
    return docs.where(rule_verdict(fit_rules(docs, labels), [counts[c] for c in COUNTS])["kept"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apply_rules() of all documents."""
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality, "op9_quality_rules": op9_quality_rules}
