"""Quality classifier by co-training of two views.

The content view sees what a text says: hashed words and word shapes. The page view sees what the
page is like: language, source, length, lines, and shares of kinds of characters, as binned values.
Each view is a logistic model, fitted to a bounded sample of the labelled training rows (LABELLED) and,
in each round, also to the rows of a bounded pool of unlabelled documents (POOL) that the OTHER view
labels with confidence. Samples are chosen by a hash of the row and put in its order, and fitted in
one place, so models and scores depend neither on the order of the rows nor on their partitions.
Each view's scores are calibrated on all labelled documents held out from training, the two calibrated
views are combined, and every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

#: Hashed content features, rounds, and the calibrated
#: probability from which a view's label is passed to the other.
CONTENT, ROUNDS, CONFIDENT = 1 << 14, 2, 0.97
#: Labelled rows that are fitted at most, and unlabelled ones that can get a label (both but for chance).
LABELLED, POOL = 16_384, 16_384
#: The last of the content features are for patterns of the whole text; words have the others.
PATTERNS = 1 << 10
#: Bins of each page value, a held-out fold in so many, and bins of a calibration curve.
LEVELS, FOLDS, CURVE = 16, 5, 40
#: Documents below this probability of good quality are rejected.
KEEP = 0.5
_VIEWS = ("content", "page")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[^\W_]+")


def content_features(text: str) -> np.ndarray:
    """Distinct hashed features: words (letters and digits, lower case), shapes of tokens that are
    not plain words, repetitions, and for shapes and repetitions also how large their share is."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return np.array([_pattern("empty")], np.uint16)
    counts = Counter(tokens)
    words, names, shapes = set(), set(), Counter()
    for t, n in counts.items():
        core = _CORE.findall(t)
        for w in core:
            words.add(zlib.crc32(w.encode()) % (CONTENT - PATTERNS))
        rest = _CORE.sub("a", t)
        if rest not in ("a", "a.", "a,"):
            shapes[rest] += n
    total = len(tokens)
    for s, n in shapes.items():
        names.add("s" + s)
        names.add(f"s{s}{_level(n / total)}")
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    names.add(f"r{_level(same / total)}")
    names.add(f"d{_level(len(counts) / total)}")
    names.add(f"p{_level(sum(shapes.values()) / total)}")
    return np.array([*words, *{_pattern(x) for x in names}], np.uint16)


def _pattern(name: str) -> int:
    return CONTENT - PATTERNS + zlib.crc32(name.encode()) % PATTERNS


def _level(share: float) -> int:
    """0 for none, then one level for each doubling from 1/128 on."""
    return 0 if share <= 0 else int(np.clip(np.log2(share) + 8, 1, 8))


def page_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Feature number of each page value: LEVELS numbers for each value."""
    n = max(1, len(text))
    lines = text.count("\n") + 1
    letters = sum(map(len, _CORE.findall(text)))
    blanks = text.count(" ") + lines - 1
    marks = n - letters - blanks
    words = max(1, blanks + 1)
    full = sum(text.count(c) for c in ".,;:!?'\"-")
    values = [
        zlib.crc32((lang or "").encode()) % LEVELS,
        zlib.crc32((source or "").encode()) % LEVELS,
        int(np.log2(n)),
        int(np.log2(lines)),
        int(np.log2(n / lines)),
        16 * letters // n,
        _level(marks / n),
        _level((marks - min(marks, full)) / n),
        _level(full / n),
        min(LEVELS - 1, n // words),
        _level(text.count("|") / words),
        _level(len(set(text.split())) / words),
    ]
    return np.array([i * LEVELS + min(LEVELS - 1, v) for i, v in enumerate(values)], np.uint16)


PAGE_VALUES = 12
_SIZES = {"content": CONTENT, "page": PAGE_VALUES * LEVELS}


@dataclass
class View:
    """A logistic model of one view (the last weight is the constant), and the curve that makes its scores probabilities."""

    weights: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.empty(0))
    curve: np.ndarray = field(default_factory=lambda: np.empty(0))

    def score(self, lists: pa.ListArray) -> np.ndarray:
        flat, bounds = _flat(lists)
        return _sums(self.weights, flat, bounds)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.edges, self.curve) if len(self.edges) else np.full(len(score), 0.5)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy().astype(np.int64), bounds


def _values(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A pattern counts in full; the other features of a row are scaled by the root of their number."""
    n = np.diff(bounds)
    return np.where(flat < CONTENT - PATTERNS, np.repeat(1 / np.sqrt(np.maximum(1, n)), n), 1.0)


def _sums(weights: np.ndarray, flat: np.ndarray, bounds: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[flat] * (_values(flat, bounds) if values is None else values))])
    return sums[bounds[1:]] - sums[bounds[:-1]] + weights[-1]


def fit(start: np.ndarray, lists: pa.ListArray, label: np.ndarray) -> np.ndarray:
    """Weights after AdaGrad in batches of MINI rows, in the given order, from the start weights on: EPOCHS
    passes over the rows, or, if they are few, as many as make STEPS steps."""
    w, squares = start.copy(), np.full(len(start), 1e-6)
    flat, bounds = _flat(lists)
    per_epoch = max(1, -(-len(label) // MINI))
    for _ in range(max(EPOCHS, -(-STEPS // per_epoch))):
        for at in range(0, len(label), MINI):
            local = bounds[at : at + MINI + 1]
            mine, local = flat[local[0] : local[-1]], local - local[0]
            x = _values(mine, local)
            p = 1 / (1 + np.exp(-np.clip(_sums(w, mine, local, x), -30, 30)))
            error = p - label[at : at + MINI]
            g = np.bincount(mine, weights=np.repeat(error, np.diff(local)) * x, minlength=len(w)) / len(error)
            g[-1] += error.mean()
            g += RIDGE * w
            squares += g * g
            w -= RATE * g / np.sqrt(squares)
    return w


#: Rows of a step, least passes, least steps, step length and ridge of the logistic fit.
MINI, EPOCHS, STEPS, RATE, RIDGE = 64, 4, 250, 0.3, 1e-6


def features(docs: DataFrame) -> DataFrame:
    """doc_id and both views' features of each row; null text is empty; a missing lang or source is null."""
    have = set(docs.columns)
    column = lambda c: (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), column("lang"), column("source"))

    def run(batches):
        kind = pa.list_(pa.int16())
        for batch in batches:
            doc, text, lang, source = (c.to_pylist() for c in batch.columns)
            one = [content_features(t) .astype(np.int16) for t in text]
            two = [page_features(t, a, b).astype(np.int16) for t, a, b in zip(text, lang, source)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(one, kind), pa.array(two, kind)], ["doc_id", "content", "page"])

    return map_arrow(rows, run, "doc_id long, content array<short>, page array<short>")


_STATS = "view string, label int, feature int, n long"


def _columns(batch):
    return {n: batch.column(i) for i, n in enumerate(batch.schema.names)}


def gathered(rows: DataFrame, n: int, bound: int) -> pa.Table:
    """About ``bound`` of n rows at most, chosen and ordered by a hash of what they hold."""
    number = F.xxhash64("doc_id", "content", "page")
    share = rows if n <= bound else rows.filter(F.pmod(F.xxhash64(F.lit(11), number), F.lit(1 << 30)) < (bound << 30) // n)
    table = share.select(number.alias("number"), "doc_id", "content", "page", "label").toArrow().combine_chunks()
    return table.sort_by([("number", "ascending"), ("doc_id", "ascending")]).combine_chunks()


def fit_round(labelled: pa.Table, pool: pa.Table, views: dict[str, View], confident: float | None) -> dict[str, View]:
    """Both views fitted on, from their weights: to the labelled rows, and from the second round on to every
    row of the pool that the other view is confident of."""
    out = {}
    for v, other in (_VIEWS, _VIEWS[::-1]):
        lists, target = [_list(labelled[v])], [labelled["label"].to_numpy().astype(np.float64)]
        if confident is not None and pool.num_rows:
            p = views[other].probability(views[other].score(_list(pool[other])))
            told = np.maximum(p, 1 - p) >= confident
            lists.append(_list(pool[v]).filter(pa.array(told)))
            target.append((p[told] >= 0.5).astype(np.float64))
        out[v] = View(fit(views[v].weights, pa.concat_arrays(lists), np.concatenate(target)))
    return out


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def calibrate(labelled: DataFrame, views: dict[str, View], edges: dict[str, np.ndarray], share: float) -> None:
    """Gives each view a rising curve from score to probability, from held-out counts in CURVE bins;
    a bin without counts has the share of good labels."""

    def run(batches):
        seen = {v: np.zeros((2, CURVE), np.int64) for v in _VIEWS}
        for batch in batches:
            c = _columns(batch)
            label = c["label"].to_numpy(zero_copy_only=False).astype(np.float64)
            out = c["fold"].to_numpy() == 0
            for v in _VIEWS:
                at = np.clip(np.searchsorted(edges[v], views[v].score(c[v])), 0, CURVE - 1)
                for k in (0, 1):
                    seen[v][k] += np.bincount(at[out & (label == k)], minlength=CURVE)
        for v in _VIEWS:
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array([v] * CURVE), pa.array(np.full(CURVE, k, np.int32)), pa.array(np.arange(CURVE, dtype=np.int32)), pa.array(seen[v][k])], ["view", "label", "feature", "n"])

    table = {v: np.zeros((2, CURVE)) for v in _VIEWS}
    for r in map_arrow(labelled, run, _STATS).groupBy("view", "label", "feature").agg(F.sum("n").alias("n")).collect():  # 4 * CURVE rows
        table[r.view][r.label, r.feature] = r.n
    for v in _VIEWS:
        bad, good = table[v]
        views[v].edges, views[v].curve = edges[v], rising((good + 0.04 * share) / (good + bad + 0.04), good + bad + 0.04)


def rising(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The closest non-decreasing curve, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for value, weight in zip(y, w):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, wb, nb = pools.pop()
            a, wa, na = pools.pop()
            pools.append([(a * wa + b * wb) / (wa + wb), wa + wb, na + nb])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def score_edges(labelled: DataFrame, views: dict[str, View]) -> dict[str, np.ndarray]:
    """Bin bounds of each view's scores: even steps over the range of labelled scores."""

    def run(batches):
        low, high = dict.fromkeys(_VIEWS, np.inf), dict.fromkeys(_VIEWS, -np.inf)
        for batch in batches:
            c = _columns(batch)
            for v in _VIEWS:
                s = views[v].score(c[v])
                low[v], high[v] = min(low[v], s.min(initial=np.inf)), max(high[v], s.max(initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(_VIEWS), pa.array([low[v] for v in _VIEWS]), pa.array([high[v] for v in _VIEWS])], ["view", "low", "high"])

    rows = map_arrow(labelled, run, "view string, low double, high double").groupBy("view").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return {r.view: np.linspace(r.low, r.high, CURVE) for r in rows}


def train(all_features: DataFrame, labels: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confident: float = CONFIDENT) -> tuple[dict[str, View] | None, float]:
    """Both views after co-training (None if labels are not of two classes), and the share of good labels."""
    # ties: a document with several labels counts once, as good if any label says so
    one = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    examples = scratch.write(all_features.join(one, "doc_id", "left").withColumn("fold", F.coalesce(fold, F.lit(1))), "examples")
    n, good = examples.agg(F.count("label"), F.sum("label")).first()
    share = good / n if n else 0.5
    if not n or good in (0, n):
        return None, share
    labelled = examples.filter("label is not null")
    counts = examples.groupBy((F.col("label").isNotNull() & (F.col("fold") > 0)).alias("trains"), F.col("label").isNull().alias("open")).count().collect()
    n_of = {(r.trains, r.open): r["count"] for r in counts}
    shown = gathered(labelled.filter("fold > 0"), n_of.get((True, False), 0), LABELLED)
    pool = gathered(examples.filter("label is null"), n_of.get((False, True), 0), POOL)
    views = fit_round(shown, pool, {v: View(np.zeros(_SIZES[v] + 1)) for v in _VIEWS}, None)
    calibrate(labelled, views, score_edges(labelled, views), share)
    for _ in range(rounds):
        views = fit_round(shown, pool, views, confident)
        calibrate(labelled, views, score_edges(labelled, views), share)
    return views, share


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, keep: float = KEEP, name: str = "quality") -> DataFrame:
    """doc_id, content_score, page_score, quality_score, keep for each row of docs (doc_id, text, and
    lang and source if there). The quality score combines the odds of both calibrated views.

    Null or empty text is scored like any other, very long texts whole; rows that repeat an id, or have
    none, are scored each on their own; a document with several labels counts once, as good if any
    says so; an empty table gives no rows; other columns are ignored; without labels of both classes
    every score is the share of good labels, and every document is kept.
    """
    scratch = Scratch(docs.sparkSession, name)
    made = scratch.write(features(docs), "features")
    views, share = train(made, labels, scratch, rounds, confident)
    if views is None:
        same = F.lit(share)
        return made.select("doc_id", same.alias("content_score"), same.alias("page_score"), same.alias("quality_score"), F.lit(True).alias("keep"))

    def run(batches):
        for batch in batches:
            c = _columns(batch)
            p = {v: np.clip(views[v].probability(views[v].score(c[v])), 1e-4, 1 - 1e-4) for v in _VIEWS}
            odds = sum(np.log(p[v] / (1 - p[v])) for v in _VIEWS)
            both = 1 / (1 + np.exp(-(odds - np.log(share / (1 - share)))))
            yield pa.RecordBatch.from_arrays([c["doc_id"], *[pa.array(np.round(x, 6)) for x in (p["content"], p["page"], both)]], ["doc_id", "content_score", "page_score", "quality_score"])

    return map_arrow(made, run, "doc_id long, content_score double, page_score double, quality_score double").withColumn("keep", F.col("quality_score") >= keep)


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    return classify(read("documents", "doc_id", "text", "lang", "source"), read("labels", "doc_id", "quality"))
