"""Quality classification from weak labels.

1. Heuristic labellers vote on every document: fire (reject) or not. Some look at the form of the
   text, two at words and word beginnings that labelled documents show to be bad (toxic, or of low
   quality). These two hold halves of what was mined, dealt by the beginning, so neither implies the
   other. No word is given by hand, whatever the language.
2. Expectation-maximisation over the counts of vote patterns of all documents estimates how often
   each labeller fires on good documents and on those bad by form or by words, and their shares. There
   are at most 2 ** labellers patterns, so the corpus comes down to a bounded table.
3. The posterior of its pattern is a document's soft label. A hashed linear scorer (logistic
   regression on the presence of hashed words, word beginnings and votes) is fitted to soft labels of
   a bounded sample and scores every document. Documents with a score of one half or more are rejected.

Texts are read by Python once: the first pass writes each document's votes and hashed features, and
scores are sums over those. Bounds: `SAMPLE` documents to fit the scorer (by one task, not the driver)
and `LABELLED` labelled ones to mine words, on average and both by hash, so that a larger table gives
a like sample. Everything else covers all documents and whole texts. What is mined is bounded by its
support: a word is held by one in `MINED_RATE` of the bad documents sampled.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store

SAMPLE, LABELLED = 8000, 20_000
BUCKETS = 1 << 18
#: A mined word or beginning is held by so many documents labelled bad in one way at least, by one in `MINED_RATE`, and they are this share of
#: its documents. By chance alone a word of nine documents has that share with a probability of about 1e-8.
MINED_FROM, MINED_RATE, MINED_SHARE = 9, 1000, 0.97
#: Hashed features that the scorer weighs are held by so many sampled documents at least.
SEEN = 40
#: Lengths of the word beginnings that are mined beside whole words.
BEGINNINGS = (4, 5)
#: Words that a task counts before it passes them on.
COUNTED = 300_000
WORD = re.compile(r"\w+")
SYMBOLS = "#$%&*+=~^@\\"
LABELLERS = ("symbols", "bars", "letters", "capitals", "exclamation", "top_word", "repeats", "mined_one", "mined_other")
#: Labellers that tell bad documents by their form, and by their words.
KINDS = (range(7), range(7, 9))


def feature(name: str) -> int:
    return crc32(name.encode()) % BUCKETS


class Features:
    """Hashed ids of a word: itself and its beginning; kept in a bounded cache."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, words: set[str]) -> set[int]:
        known, out = self.known, set()
        if len(known) > 400_000:
            known.clear()
        for w in words:
            pair = known.get(w)
            if pair is None:
                pair = known[w] = (feature(w[:64]), feature("^" + w[:5]))
            out.update(pair)
        return out


def votes(text: str | None, words: list[str], distinct: set[str], mined: tuple[frozenset, frozenset]) -> int:
    """One bit for each labeller that fires. Empty texts fire none.

    mined: words, and beginnings with a "^" before them, for each of the two labellers.
    """
    n = len(text or "")
    if not n:
        return 0
    raw = text.split()
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, raw))
    top = Counter(raw).most_common(1)[0][1] if raw else 0
    begun = {"^" + w[:k] for w in distinct for k in BEGINNINGS}
    fired = (
        sum(map(text.count, SYMBOLS)) > 0.04 * n,
        text.count("|") > 0.02 * n,
        len(raw) >= 5 and letters < 0.7 * (n - text.count(" ") - text.count("\n")),
        len(raw) >= 10 and upper > 0.4 * len(raw),
        text.count("!!") > 0.02 * n,
        len(raw) >= 30 and top > 0.25 * len(raw),
        len(raw) >= 30 and sum(map(str.__eq__, raw, raw[1:])) > 0.2 * len(raw),
        *(not own.isdisjoint(distinct) or not own.isdisjoint(begun) for own in mined),
    )
    return sum(1 << k for k, f in enumerate(fired) if f)


def expectation_maximisation(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200, kinds: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(shares, rates) of a model of independent labellers: good documents first, then each kind of bad ones.

    kinds: the labellers that a kind of bad documents is known by, one for all if none are given. A
    document is bad in one way or another, so labellers of one kind say nothing of another's.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    fired = (patterns[:, None] >> np.arange(labellers)) & 1
    kinds = kinds or (range(labellers),)
    start = np.full((1 + len(kinds), labellers), 0.01)
    start[0] = 0.002
    for k, own in enumerate(kinds, 1):
        start[k, list(own)] = 0.3
    # A little prior mass keeps rates away from 0 and 1; more of it says that labellers seldom fire on good documents.
    prior = np.ones((1 + len(kinds), 1))
    prior[0] += weight.sum() / 10
    rates, shares = start, np.array([1 - 0.1, *[0.1 / len(kinds)] * len(kinds)])
    for _ in range(rounds):
        w = weight[:, None] * _posterior(fired, shares, rates)
        new = (w.T @ fired + prior * start) / (w.sum(axis=0)[:, None] + prior)
        shares_new = (w.sum(axis=0) + 0.1) / (weight.sum() + 0.1 * len(shares))
        done = max(abs(new - rates).max(), abs(shares_new - shares).max()) < 1e-9
        rates, shares = new, shares_new
        if done:
            break
    return shares, rates


def _posterior(fired: np.ndarray, shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The probability of each class for each pattern."""
    likely = fired @ np.log(rates).T + (1 - fired) @ np.log1p(-rates).T + np.log(shares)
    p = np.exp(likely - likely.max(axis=1, keepdims=True)) if len(fired) else likely
    return p / p.sum(axis=1, keepdims=True)


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """The probability of bad for every vote pattern."""
    shares, rates = expectation_maximisation(counts, kinds=KINDS)
    patterns = np.array(sorted(counts), dtype=np.int64)
    fired = (patterns[:, None] >> np.arange(len(LABELLERS))) & 1
    return dict(zip(patterns.tolist(), (1 - _posterior(fired, shares, rates)[:, 0]).tolist()))


def fit(rows: list[np.ndarray], soft: np.ndarray, rounds: int = 200, decay: float = 2.0, pace: float = 0.06) -> np.ndarray:
    """Weights of the hashed features, the votes and the intercept, in this order, by Adam on the logistic loss.

    Weights decay by the round, but for those of votes, so that words count only for what votes do not explain.
    """
    weights = np.zeros(BUCKETS + len(LABELLERS) + 1)
    if not len(rows):
        return weights
    flat = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=len(weights) - 1) >= min(SEEN, max(2, len(rows) // 20))
    used, place = np.flatnonzero(seen), np.cumsum(seen) - 1
    keep = seen[flat]
    flat, doc = place[flat[keep]], doc[keep]
    shrink = np.where(used >= BUCKETS, 1.0, 1 - pace * decay)
    w, b = np.zeros(len(used)), float(np.log((soft.mean() + 1e-6) / (1 - soft.mean() + 1e-6)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[flat], len(rows)) + b, -30, 30)))
        miss = (p - soft) / len(rows)
        g = np.append(np.bincount(flat, miss[doc], len(used)), miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w * shrink - step[:-1], b - step[-1]
    weights[used], weights[-1] = w, b
    return weights


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _sampled(h: Column, n: int, most: int) -> Column:
    """Whether a row of hash h is among about `most` of n."""
    return F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(n, 1)))


def _least_shingle(w: Column) -> Column:
    """The least hash of the three-word shingles of an array of words, or of all of them if they are fewer."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.array_min(every)


def mine(docs: DataFrame, labels: DataFrame) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that mark labelled documents as bad, for each of two labellers.

    docs: doc_id, text. labels: doc_id, quality, toxic. A document is toxic, or of low quality, if any
    of its labels says so; a word has to mark one of the two. About `LABELLED` labelled documents are read.
    """
    toxic, low = F.coalesce("toxic", F.lit(0)).cast("int") == 1, F.coalesce("quality", F.lit(1)).cast("int") == 0
    known = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy("doc_id").agg(F.max(toxic.cast("int")).alias("toxic"), F.max(low.cast("int")).alias("low"))
    own = _sampled(F.xxhash64("doc_id"), known.count(), LABELLED)
    rows = docs.select("doc_id", "text").where(own & F.col("text").isNotNull()).join(known.where(own), "doc_id")
    # Copies and near copies that share their least shingle are one document: else their own words would seem to have support.
    rows = rows.select("text", "toxic", "low", F.explode_outer(F.array(F.split(F.lower("text"), r"\s+"))).alias("w"))
    rows = rows.groupBy(_least_shingle(F.col("w")).alias("shingle")).agg(F.max(F.struct("toxic", "low", "text")).alias("x")).select("x.*")

    rows = store.written(rows, "mined-rows", "mined")

    def counter(wanted: frozenset | None):
        def run(batches):
            import pyarrow as pa

            n = Counter()

            def counted():
                return pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in n], pa.string()), pa.array([t for _, t, _ in n], pa.int32()), pa.array([q for _, _, q in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "toxic", "low", "n"])

            for batch in batches:
                for text, t, q in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held = {w[:64] for w in _words(text)}
                    held |= {"^" + w[:k] for w in held for k in BEGINNINGS}
                    n.update((w, t, q) for w in (held if wanted is None else held & wanted))
                    n["", t, q] += 1  # counts documents
                    if len(n) > COUNTED:
                        yield counted()
                        n.clear()
            if n:
                yield counted()

        return run

    def counted(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
        made = rows.mapInArrow(counter(wanted), "word string, toxic int, low int, n long")
        return made.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("toxic", "low")])

    # Bad documents first: only what has support there is counted among all.
    bad = store.written(counted(rows.where("toxic + low > 0"), None).where(f"greatest(toxic, low) >= {MINED_FROM}"), "mined-words", "mined")
    total = bad.where("word = ''").first()
    least = {c: max(MINED_FROM, (total[c] if total else 0) / MINED_RATE) for c in ("toxic", "low")}
    some = frozenset(r["word"] for r in bad.where((F.col("word") != "") & ((F.col("toxic") >= least["toxic"]) | (F.col("low") >= least["low"]))).select("word").toLocalIterator())
    marks = [(F.col(c) >= least[c]) & (F.col(c) >= MINED_SHARE * F.col("n")) for c in ("toxic", "low")]
    found = [r["word"] for r in counted(rows, some).where((F.col("word") != "") & (marks[0] | marks[1])).select("word").toLocalIterator()] if some else []
    store.clear(docs.sparkSession, "mined")
    # What begins alike goes to one side, so that no word fires both labellers.
    begun = lambda w: w.lstrip("^")[: min(BEGINNINGS)]
    side = {b: k % 2 for k, b in enumerate(sorted(set(map(begun, found))))}
    return tuple(frozenset(w for w in found if side[begun(w)] == k) for k in (0, 1))


def _cast(mined: tuple[frozenset, frozenset], place: int):
    """Adds votes and hashed features (sorted, as differences) to rows."""

    def run(batches):
        import pyarrow as pa

        features = Features()
        for batch in batches:
            fired, held = [], []
            for text in batch.column(place).to_pylist():
                words = _words(text)
                distinct = set(words)
                fired.append(votes(text, words, distinct, mined))
                ids = np.fromiter(features.of(distinct), dtype=np.int32)
                ids.sort()
                held.append(np.diff(ids, prepend=np.int32(0)))
            ends = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
            flat = pa.array(np.concatenate([*held, np.empty(0, np.int32)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fired, pa.int32()), pa.ListArray.from_arrays(ends, flat)], [*batch.schema.names, "__votes", "__features"])

    return run


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a column of differences end to end, and the rows' edges."""
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    run = np.cumsum(column.flatten().to_numpy(), dtype=np.int64)
    before = np.concatenate([[0], run])[edges[:-1]]
    return run - np.repeat(before, np.diff(edges)), edges


#: The features of each vote pattern: they come after the hashed ones.
OWN = [np.array([BUCKETS + k for k in range(len(LABELLERS)) if v >> k & 1], dtype=np.int64) for v in range(1 << len(LABELLERS))]


class Model:
    """What is fitted: mined words, the posterior of each vote pattern, and the scorer's weights.

    `rows` are the documents with `__votes` and `__features`, written once.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: list[str], scope: str) -> None:
        spark = docs.sparkSession
        store.bounded_batches(spark)
        self.mined = mine(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
        # Columns go by place, so that their names can't clash.
        rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
        kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
        cast = rows.mapInArrow(_cast(self.mined, docs.columns.index(text_col)), f"{kinds}, __votes int, __features array<int>")
        kept = [F.col(f"c{docs.columns.index(c)}") for c in keep]
        row = F.xxhash64(f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}").alias("__row")
        self.rows = store.written(cast.select(*kept, row, "__votes", "__features"), "votes", scope, compression="zstd")
        counts = {r["__votes"]: r["n"] for r in self.rows.groupBy("__votes").agg(F.count("*").alias("n")).collect()}
        soft = self.soft = posteriors(counts)

        def fitted(batches):
            import pyarrow as pa

            held, aims = [], []
            for batch in batches:
                flat, edges = _ids(batch.column(1))
                for v, a, b in zip(batch.column(0).to_pylist(), edges, edges[1:]):
                    held.append(np.unique(np.concatenate([flat[a:b], OWN[v]])).astype(np.int32))
                    aims.append(soft[v])
            yield pa.RecordBatch.from_arrays([pa.array([fit(held, np.array(aims)).astype("<f4").tobytes()])], ["weights"])

        some = self.rows.where(_sampled(F.col("__row"), sum(counts.values()), SAMPLE)).select("__votes", "__features", "__row").limit(2 * SAMPLE)
        # One task fits: its input is bounded, and in a fixed order.
        one = some.repartition(1).sortWithinPartitions("__row").select("__votes", "__features").mapInArrow(fitted, "weights binary")
        got = one.first()
        self.weights = np.frombuffer(got["weights"], dtype="<f4") if got else np.zeros(BUCKETS + len(LABELLERS) + 1, dtype="<f4")

    def scores(self, fired, features) -> np.ndarray:
        """Scores of rows given by their columns of votes and features."""
        ids, edges = _ids(features)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        own = np.array([self.weights[x].sum(dtype=np.float64) for x in OWN])
        z = sums[edges[1:]] - sums[edges[:-1]] + own[fired.to_numpy()] + float(self.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __getstate__(self) -> dict:
        return {"soft": self.soft, "weights": self.weights}


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """id, votes (bits), posterior, score and rejected of every row.

    labels: doc_id, quality, toxic (either may be null); a document with several labels is bad if one
    says so. Null and empty texts get no votes and are kept (score: the scorer's intercept). Very long
    texts are read whole, a row at a time. Repeated ids are scored row by row. Other columns of docs
    are left behind, so their names can't clash. Empty tables give no rows; without labels nothing is
    mined and the form of texts decides.
    """
    model = Model(docs, labels, id_col, text_col, [id_col], scope)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = model.scores(batch.column(1), batch.column(2))
            posterior = [model.soft[v] for v in batch.column(1).to_pylist()]
            made = [batch.column(0), batch.column(1), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, ["id", "votes", "posterior", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = model.rows.select(f"c{docs.columns.index(id_col)}", "__votes", "__features")
    return out.mapInArrow(run, f"id {kind}, votes int, posterior double, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """The rows that `classify` does not reject, with all their columns, without a join."""
    model = Model(docs, labels, id_col, text_col, docs.columns, scope)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = model.scores(batch.column(len(names)), batch.column(len(names) + 1)) < 0.5
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(good, pa.bool_()))

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return model.rows.select(*names, "__votes", "__features").mapInArrow(run, kinds).toDF(*docs.columns)
