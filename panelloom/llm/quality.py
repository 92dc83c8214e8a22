"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path are like.

1. Two logistic models (bad quality, toxic) over character shares, word statistics and the presence of telling words are
   fitted to a sample of labelled documents, at most ``SAMPLE`` of them: those with the least hashes of their ids.  The
   telling words are those whose presence in the sample tells most (signed likelihood ratio).  The evidence of a
   document is the log odds that it is neither.
2. The expected number of good documents is summed over all documents by host and by path within the host.  Hosts shrink
   toward the global share, paths toward their host; how strongly follows from how much they differ beyond chance
   (method of moments).  A document is left out of its own site's sums.
3. The odds of a document under the global share are carried over to the share of its path; it is kept if it is then
   more likely good than not.

``documents`` has no url: by default ``source`` stands for the host and ``lang`` for the path (arguments of ``classify``).

Null text is empty.  Null hosts and paths are sites of their own.  Without labels of both kinds a model knows nothing and
says so (the share of its label, or never); an empty table gives no rows.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, least_hashed
from .tokens import bytes_of, slices, words_of

#: Most labelled documents that the models are fitted to, and most telling words of each model.
SAMPLE, TELLING = 20_000, 100
#: A telling word occurs in so many documents of the sample at least.
LEAST_DOCS = 4
#: Sites are broadcast up to so many, which is counted; more are joined by shuffling.
FEW_SITES = 100_000
#: Columns that describe the characters and words of a text.
SHAPE = 14

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(texts, words: dict[str, int]) -> np.ndarray:
    """One row per text: SHAPE numbers, then 0 or 1 for each telling word (lower case, marks at its ends cut off)."""
    import pyarrow as pa
    import pyarrow.compute as pc


    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data, ends = bytes_of(texts)
    data = np.frombuffer(data, np.uint8)

    def share(kinds: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kinds[data])])
        return (upto[ends] - upto[ends - sizes]) / np.maximum(1, sizes)

    code = np.arange(256)
    upper, lower, digit = ((code >= lo) & (code <= hi) for lo, hi in ((65, 90), (97, 122), (48, 57)))
    mark = (code > 32) & (code < 127) & ~upper & ~lower & ~digit
    plain = np.isin(code, [ord(c) for c in ".,'-"])
    kinds = [upper, lower, digit, mark & ~plain, plain, code == 10, code == 32, code == 33, code == 124]
    columns = [share(k.astype(np.int64)) for k in kinds]
    codes, names, counts = words_of(pc.utf8_lower(texts), lower=False)
    owner = np.repeat(np.arange(n), counts)
    pairs = np.unique(owner * np.int64(max(1, len(names))) + codes) if len(codes) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // max(1, len(names)), minlength=n)
    columns += [np.log1p(sizes), np.log1p(counts), distinct / np.maximum(1, counts), sizes / np.maximum(1, counts) / 10]
    columns.append((counts < 20).astype(float))
    out = np.zeros((n, SHAPE + len(words)))
    out[:, :SHAPE] = np.stack(columns, axis=1)
    if words and len(names):
        cut = [x.strip(MARKS) for x in names]
        place = np.array([words.get(x, -1) for x in cut], np.int64)
        doc, word = pairs // len(names), place[pairs % len(names)]
        out[doc[word >= 0], SHAPE + word[word >= 0]] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method; the constant isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    if not 0 < y.sum() < len(y):
        weights[-1] = np.inf if len(y) and y.all() else -np.inf
        return weights
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = np.diag(shrink)
        for k in range(0, len(x), 4096):  # no weighted copy of the whole
            part = x[k : k + 4096]
            hessian += (part * (p * (1 - p))[k : k + 4096, None]).T @ part
        step = np.linalg.solve(hessian, x.T @ (p - y) + shrink * weights)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_models(x: np.ndarray, labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Mean and scale of the columns (0 and 1 for telling words), and a model's weights for each label."""
    size = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(size), np.ones(size))
    mean[SHAPE:], scale[SHAPE:] = 0, 1
    scale[scale == 0] = 1
    x -= mean
    x /= scale
    return mean, scale, [fit_logistic(x, y) for y in labels]


class Model:
    """Both logistic models; ``good_odds`` is the log odds that a text is neither bad nor toxic."""

    def __init__(self, words: dict[str, int], mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.words, self.mean, self.scale, self.weights = words, mean, scale, weights

    def good_odds(self, texts) -> np.ndarray:
        x = (features(texts, self.words) - self.mean) / self.scale
        fine = np.ones(len(x))
        for w in self.weights:
            if np.isinf(w[-1]):
                continue  # says nothing
            fine *= 1 / (1 + np.exp(np.clip(x @ w[:-1] + w[-1], -25, 25)))
        return np.log(fine / np.maximum(1 - fine, 1e-12))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to the labelled documents with the least hashes of their ids.  Labels with a null are left out."""
    import pyarrow as pa


    work = Workspace(docs.sparkSession, "quality-model")
    chosen = labels.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "quality", "toxic"))).dropna()
    chosen = least_hashed(chosen, ["doc_id", "quality", "toxic"], sample, Workspace(docs.sparkSession, "quality-labels"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.join(F.broadcast(chosen), "doc_id").select(  # bounded by ``sample``
        F.coalesce("text", F.lit("")).alias("text"), (1 - F.col("quality")).alias("bad"), "toxic", "doc_id"
    )
    held = work.settle(held, "labelled")
    if held.count() > sample:  # ids that repeat
        held = least_hashed(held, ["doc_id", "text"], sample, work)
    words = {w: i for i, w in enumerate(telling_words(held))}

    def rows(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = features(batch.column(0).slice(a, b - a), words)
                columns = [batch.column(k).slice(a, b - a) for k in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["bad", "toxic", "x"])

    size = SHAPE + len(words)

    def fit(batches):
        xs, labels = [np.zeros((0, size))], [[], []]
        for batch in batches:
            xs.append(batch.column(2).flatten().to_numpy().reshape(-1, size))
            for k, held in enumerate(labels):
                held.append(batch.column(k).to_numpy().astype(float))
        mean, scale, weights = fit_models(np.concatenate(xs), [np.concatenate([np.zeros(0), *y]) for y in labels])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (mean, scale, *weights)], names=["mean", "scale", "bad", "toxic"])

    # one task holds the numbers of at most ``sample`` documents; the driver gets the weights
    numbers = work.settle(held.select("text", "bad", "toxic").mapInArrow(rows, "bad long, toxic long, x array<double>"), "numbers")
    fitted = numbers.coalesce(1).mapInArrow(fit, "mean array<double>, scale array<double>, bad array<double>, toxic array<double>")
    found = fitted.first()
    if found is None:  # a table without rows has no tasks
        return Model(words, *fit_models(np.zeros((0, size)), [np.zeros(0)] * 2))
    mean, scale, *weights = (np.array(x) for x in found)
    return Model(words, mean, scale, weights)


def telling_words(held: DataFrame) -> list[str]:
    """Words whose presence in a document tells most about each label, by signed likelihood ratio."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc


        for batch in batches:
            for a, b in slices(batch.column(0)):
                codes, names, counts = words_of(pc.utf8_lower(batch.column(0).slice(a, b - a)), lower=False)
                cut: dict[str, int] = {}
                place = np.array([cut.setdefault(x.strip(MARKS), len(cut)) for x in names], np.int64)
                pairs = np.unique(np.repeat(np.arange(b - a), counts) * np.int64(max(1, len(cut))) + (place[codes] if len(codes) else 0))
                doc, word = pairs // max(1, len(cut)), pairs % max(1, len(cut))
                sums = [np.bincount(word, minlength=len(cut))]
                for k in (1, 2):
                    label = batch.column(k).slice(a, b - a).to_numpy()
                    sums.append(np.bincount(word, weights=label[doc], minlength=len(cut)))
                columns = [pa.array(list(cut), pa.string()), *(pa.array(v.astype(np.int64)) for v in sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "bad", "toxic"])

    total = held.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("toxic")).first()
    counts = held.select("text", "bad", "toxic").mapInArrow(count, "word string, n long, bad long, toxic long")
    counts = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic"))).where(f"n >= {LEAST_DOCS} and word <> ''")
    out: list[str] = []
    for label, hits in (("bad", total[1]), ("toxic", total[2])):
        if not total[0] or not 0 < hits < total[0]:
            continue
        share = hits / total[0]
        rate = F.greatest(F.least(F.col(label) / F.col("n"), F.lit(1 - 1e-9)), F.lit(1e-9))
        ratio = F.col(label) * F.log(rate / share) + (F.col("n") - F.col(label)) * F.log((1 - rate) / (1 - share))
        best = counts.withColumn("ratio", F.signum(rate - share) * ratio).where("ratio > 3.84")
        out += [r[0] for r in best.orderBy(F.desc("ratio"), "word").limit(TELLING).select("word").collect()]
    return list(dict.fromkeys(out))


def _with_odds(rows: DataFrame, model: Model) -> DataFrame:
    """All columns but ``_pl_text``, and its ``_pl_odds``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("_pl_text")
            for a, b in slices(batch.column(at)):
                some = batch.slice(a, b - a)
                odds = pa.array(model.good_odds(some.column(at)), pa.float64())
                columns = [c for k, c in enumerate(some.columns) if k != at]
                names = [c for k, c in enumerate(batch.schema.names) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, odds], names=[*names, "_pl_odds"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([f for f in rows.schema.fields if f.name != "_pl_text"] + [StructField("_pl_odds", DoubleType())])
    return rows.mapInArrow(run, schema)


def _strength(groups: DataFrame, total: str, n: str, center) -> float:
    """How many documents the prior of these groups is worth: from their spread around ``center`` beyond chance."""
    mean = F.col(total) / F.col(n)
    chance = F.sum(center * (1 - center))
    row = groups.agg(
        F.sum(F.col(n) * (mean - center) ** 2).alias("spread"), chance.alias("chance"), F.sum(n).alias("n"),
        F.sum(F.col(n) ** 2 / F.lit(1.0)).alias("n2"), F.count(F.lit(1)).alias("groups"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["chance"]:
        return 1e6
    inner = row["chance"] / row["groups"]
    between = (row["spread"] - row["chance"]) / max(row["n"] - row["n2"] / row["n"], 1)
    return float(np.clip(inner / between - 1 if between > 0 else 1e6, 2, 1e6))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, carry: list[str] | None = None
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all), and _pl_p (own evidence), _pl_host, _pl_path (shares), _pl_good (combined),
    _pl_kept.  Names that begin with ``_pl_`` are reserved.  Texts are scored once: what is carried is written with its odds."""
    carry = docs.columns if carry is None else carry
    if taken := [c for c in docs.columns if c.startswith("_pl_")]:
        raise ValueError(f"reserved column names: {taken}")
    work = Workspace(docs.sparkSession, "quality")
    model = train(docs, labels, sample)
    own = 1 / (1 + F.exp(-F.col("_pl_odds")))
    # keys that are never null, and differ for null and empty
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(k) for c, k in ((host, "_pl_h"), (path, "_pl_p"))]
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), *keys, F.col("text").cast("string").alias("_pl_text"))
    rows = work.settle(_with_odds(rows, model), "scored")
    paths = rows.groupBy("_pl_h", "_pl_p").agg(F.sum(own).alias("_pl_ps"), F.count(F.lit(1)).alias("_pl_pn"))
    paths = work.settle(paths, "paths")
    hosts = paths.groupBy("_pl_h").agg(F.sum("_pl_ps").alias("_pl_hs"), F.sum("_pl_pn").alias("_pl_hn"))
    total, n = paths.agg(F.coalesce(F.sum("_pl_ps"), F.lit(0.0)), F.coalesce(F.sum("_pl_pn"), F.lit(0))).first()
    share = min(max(total / n if n else 0.5, 1e-6), 1 - 1e-6)
    by_host = _strength(hosts, "_pl_hs", "_pl_hn", F.lit(share))
    of_host = (F.lit(by_host * share) + F.col("_pl_hs")) / (by_host + F.col("_pl_hn"))
    sites = paths.join(hosts, "_pl_h")
    by_path = _strength(sites.withColumn("_pl_c", of_host), "_pl_ps", "_pl_pn", F.col("_pl_c"))
    if paths.count() <= FEW_SITES:
        sites = F.broadcast(sites)

    rows = rows.join(sites, ["_pl_h", "_pl_p"])
    host_share = (F.lit(by_host * share) + F.col("_pl_hs") - own) / (by_host + F.col("_pl_hn") - 1)
    rows = rows.withColumn("_pl_host", host_share)
    path_share = (by_path * F.col("_pl_host") + F.col("_pl_ps") - own) / (by_path + F.col("_pl_pn") - 1)
    path_share = F.greatest(F.least(path_share, F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumn("_pl_path", path_share)
    carried = F.col("_pl_odds") + F.log(F.col("_pl_path") / (1 - F.col("_pl_path"))) - float(np.log(share / (1 - share)))
    good = 1 / (1 + F.exp(-carried))
    rows = rows.withColumn("_pl_good", good).withColumn("_pl_own", own)
    return rows.select(*(F.col(f"`{c}`") for c in carry), F.col("_pl_own").alias("_pl_p"), "_pl_host", "_pl_path", "_pl_good", (F.col("_pl_good") >= 0.5).alias("_pl_kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return classify(docs, labels).where("_pl_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
