"""Subject areas of documents: a lexicon grown over the corpus, and a classifier chain decoded by beam search.

1. Seeds: terms that stand out in the labelled examples of one area, against the base rate in the texts' languages.
2. Lexicon, over all documents: a term belongs to the areas whose terms share its sentences, if these are few; so words
   that the examples lack are found, and words of code, which go with every area, are not.
3. Cues, over all documents: terms of sentences that name an area which the rest of the text never takes up.
4. Chain: one logistic model per area on term and structure features and on the areas decided before it, calibrated on
   examples that neither its lexicon nor its models have seen; a beam search finds the likeliest combination.

Texts are tokenised once; the three passes over them work on arrays of term codes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.terms import sentences
from ashlar.llm.tokens import HEADING, Words, as_batch, sums, tokenised
from ashlar.runtime import materialize

#: Labelled rows that are fitted on: all up to this many, else those with the least hashed ids.
MOST_EXAMPLES = 20_000
#: Every fifth example is held out for the calibration.
HELD_OUT = 5
#: Terms of the lexicon, and cues, that are sent to every task: the most frequent ones. The others, if there are more,
#: are joined to the documents that have them.
SENT_TERMS = 50_000
#: A term enters from so many sentences shared with area terms, and this divergence from the base rate (in nats).
LEAST_SEEN, LEAST_DIVERGENCE = 5, 0.9
#: A term is a cue if at this rate its sentences name an area that the text has nowhere else; a mention passes by if
#: this share of the terms around it are cues.
CUE_RATE, CUE_SHARE, AROUND = 0.5, 0.45, 4
BEAM = 8
#: Each area is one model of the chain; more are an error.
MOST_AREAS = 1000
#: Texts that are worked on together, and their bytes of terms (a longer one is worked on alone).
TOGETHER, TOGETHER_BYTES = 2_000, 8 << 20


@dataclass
class Lexicon:
    """Shares of the areas by term, and the terms that mark a passing mention."""

    areas: list[str]
    shares: dict[str, np.ndarray]
    cues: set[str] = field(default_factory=set)

    def with_rest(self, rest: dict[str, np.ndarray | None]) -> Lexicon:
        """With further terms (None for cues), those of one batch."""
        if not rest:
            return self
        more = {t: s for t, s in rest.items() if s is not None}
        return Lexicon(self.areas, self.shares | more, self.cues | {t for t, s in rest.items() if s is None and t not in more})


class Mentions:
    """The area terms of a batch: ``at`` (places among its words) and ``weights`` (by area)."""

    def __init__(self, words: Words, lexicon: Lexicon):
        known = [(i, lexicon.shares[t]) for i, t in enumerate(words.terms) if t in lexicon.shares]
        self.known = np.zeros(words.size, bool)
        self.known[[i for i, _ in known]] = True
        k = len(lexicon.areas)
        q = np.zeros((words.size, k))
        if known:
            q[[i for i, _ in known]] = [s for _, s in known]
        self.at = np.flatnonzero(self.known[words.code]) if words.size else np.zeros(0, np.int64)
        key, self.kind, n = np.unique(words.doc[self.at] * max(words.size, 1) + words.code[self.at], return_inverse=True, return_counts=True)
        doc, q = key // max(words.size, 1), q[key % max(words.size, 1)] if words.size else np.zeros((0, k))
        r, n = q, n[:, None]
        for _ in range(6):  # each term goes by the other terms of the text, not by its own repetitions
            told = n * r
            r = q * (sums(told, doc, words.docs)[doc] - told + 0.05)
            r = r / r.sum(1, keepdims=True)
        self.weights = r[self.kind]


def passing(words: Words, mentions: Mentions, lexicon: Lexicon) -> np.ndarray:
    """For each mention, whether it is made in passing."""
    cue = np.array([t in lexicon.cues for t in words.terms], bool)[words.code] if words.size else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(cue)])
    at, sent = mentions.at, words.sent[mentions.at]
    low, high = np.maximum(words.begins[sent], at - AROUND), np.minimum(words.ends[sent], at + AROUND + 1)
    cues, around = before[high] - before[low] - cue[at], high - low - 1
    return (around > 0) & (cues > 0) & (cues >= CUE_SHARE * around)


def seeds(texts: list[str], labels: np.ndarray, langs: list[str]) -> dict[str, np.ndarray]:
    """Terms by area shares, from examples alone."""
    seen, by_area = Counter(), defaultdict(lambda: np.zeros(labels.shape[1]))
    in_lang: dict[str, Counter] = defaultdict(Counter)
    total, area_of = Counter(langs), defaultdict(lambda: np.zeros(labels.shape[1]))
    for text, y, lang in zip(texts, labels, langs):
        area_of[lang] += y
        for t in {t for s in sentences(HEADING.sub("", text)) for t in s}:
            seen[t] += 1
            by_area[t] += y
            in_lang[t][lang] += 1
    out = {}
    for t, n in seen.items():
        if n < 2:
            continue
        base = sum(area_of[lang] * k / total[lang] for lang, k in in_lang[t].items()) / n
        share = (by_area[t] + base) / (n + 1)
        first, second = np.argsort(-share)[:2] if len(share) > 1 else (0, 0)
        z = (by_area[t][first] - n * base[first]) / np.sqrt(n * base[first] * (1 - base[first]) + 1e-9)
        if (share[first] >= 0.7 and z >= 2.5) or (share[first] + share[second] >= 0.85 and z >= 5 and n >= 10):
            rest = np.maximum(share - base, 0) + 1e-3
            out[t] = rest / rest.sum()
    return out


Counted = tuple[np.ndarray, np.ndarray]


def company(words: Words, lexicon: Lexicon) -> Counted:
    """For each term (its code, and sums over sentences), the areas of the other mentions in its sentences."""
    m = Mentions(words, lexicon)
    n = len(words.begins)
    sent = words.sent[m.at]
    whole = sums(m.weights, sent, n)
    with_mention = np.zeros(n, bool)
    with_mention[sent] = True
    size = max(words.size, 1)
    pair = words.pairs()
    pair = pair[with_mention[pair // size]]
    own = sums(m.weights, np.searchsorted(pair, sent * size + words.code[m.at]), len(pair))
    others = whole[pair // size] - own
    total = others.sum(1)
    kept = total > 0.3
    terms, at = np.unique(pair[kept] % size, return_inverse=True)
    return terms, sums(others[kept] / total[kept, None], at, len(terms))


def isolated(words: Words, lexicon: Lexicon) -> Counted:
    """For each term that is no area term, the sentences with a mention, and those whose area the text has nowhere else."""
    m = Mentions(words, lexicon)
    n = len(words.begins)
    sent = words.sent[m.at]
    by = sums(m.weights, sent, n)
    with_mention = np.zeros(n, bool)
    with_mention[sent] = True
    rest = sums(m.weights, words.doc[m.at], words.docs)[words.doc_of] - by
    with_mention &= rest.sum(1) >= 2
    alone = ((rest < 0.25) * by).sum(1) / np.maximum(by.sum(1), 1e-300)
    size = max(words.size, 1)
    pair = words.pairs()
    pair = pair[with_mention[pair // size]]
    pair = pair[~m.known[pair % size]] if words.size else pair
    terms, at = np.unique(pair % size, return_inverse=True)
    return terms, sums(np.column_stack([np.ones(len(pair)), alone[pair // size]]), at, len(terms))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES, "right"))
            to = min(max(to, at + 1), at + TOGETHER)
            yield b.slice(at, to - at)
            at = to


def _rest(piece: pa.RecordBatch, which: int) -> dict[str, np.ndarray | None]:
    """The further terms that a batch's documents were joined with, for the lexicon of this number."""
    if "rest" not in piece.schema.names:
        return {}
    found = {}
    for some in piece.column("rest").to_pylist():
        for r in some or ():
            if r["which"] == which:
                found.setdefault(r["term"], np.array(r["shares"]) if r["shares"] is not None else None)
    return found


def _counts(tokens: DataFrame, count: Callable[[Words, Lexicon], Counted], lexicons: list[Lexicon], width: int) -> DataFrame:
    """term and the sums c0, c1, ... of what ``count`` gives by term, ``width`` for each of the lexicons."""
    sent = tokens.sparkSession.sparkContext.broadcast(lexicons)
    names = [f"c{i}" for i in range(width * len(lexicons))]

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words = Words(piece.column("body"))
            table, seen = np.zeros((words.size, len(names))), np.zeros(words.size, bool)
            for j, lexicon in enumerate(sent.value):
                terms, values = count(words, lexicon.with_rest(_rest(piece, j)))
                table[terms, j * width : (j + 1) * width] = values
                seen[terms] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([words.terms[i] for i in at], pa.string()), *[pa.array(table[at, i]) for i in range(len(names))]], ["term", *names])

    rows = tokens.mapInArrow(over, "term string, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def _with_rest(tokens: DataFrame, rest: list[DataFrame]) -> DataFrame:
    """``tokens`` with the column rest: those terms of tables too large to be sent (term, which, shares) that a document has.

    The join is shuffled by term; the frequent terms were sent, so none of these is hot.
    """
    if not rest:
        return tokens
    table = rest[0]
    for r in rest[1:]:
        table = table.unionByName(r)
    words = tokens.select("row", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "body", "heading"), " "))).alias("term"))
    found = words.join(table, "term").groupBy("row").agg(F.collect_list(F.struct("term", "which", "shares")).alias("rest"))
    return materialize(tokens.join(found, "row", "left"), "tokens")


def _split(kept: DataFrame, most: int, examples: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows that are sent, the ``most`` most frequent ones by n and those of the examples' terms, and the others if
    there are any."""
    if kept.count() <= most:
        return kept, None
    frequent = kept.orderBy(F.desc("n"), "term").limit(most)
    sent = materialize(frequent.union(kept.join(F.broadcast(examples), "term", "left_semi")).distinct(), "sent-terms")
    return sent, kept.join(sent.select("term"), "term", "left_anti")


def grow(tokens: DataFrame, areas: list[str], starts: list[dict[str, np.ndarray]], texts: list[str], most: int = SENT_TERMS) -> tuple[list[Lexicon], DataFrame]:
    """The lexicons over all documents, one from each set of seeds, and the tokens with what these lack as ``rest``. They
    lack no term of ``texts``, the examples."""
    k = len(areas)
    own = as_batch(texts)
    own = {t for c in ("body", "heading") for t in Words(own.column(c)).terms}
    own = tokens.sparkSession.createDataFrame([(t,) for t in sorted(own)], "term string")
    counts = materialize(_counts(tokens, company, [Lexicon(areas, s) for s in starts], k), "company")
    lexicons, rest = [], []
    for j, start in enumerate(starts):
        names = [f"c{i}" for i in range(j * k, (j + 1) * k)]
        base = np.array([x or 0.0 for x in counts.agg(*[F.sum(n) for n in names]).first()]) + 1e-9
        base /= base.sum()
        n = sum((F.col(c) for c in names), F.lit(0.0))
        share = [(F.col(c) + float(b)) / (n + 1) for c, b in zip(names, base)]
        divergence = sum((p * F.log(p / float(b)) for p, b in zip(share, base)), F.lit(0.0))
        kept = counts.withColumn("n", n).filter((n >= LEAST_SEEN) & (divergence >= LEAST_DIVERGENCE)).select("term", "n", F.array(*share).alias("shares"))
        sent, others = _split(kept, most, own)
        shares = {r["term"]: np.array(r["shares"]) for r in sent.select("term", "shares").toLocalIterator()}
        if others is not None:
            rest.append(others.select("term", F.lit(j).alias("which"), "shares"))
        lexicons.append(Lexicon(areas, {t: shares.get(t, v) for t, v in start.items()} | shares))
    tokens = _with_rest(tokens, rest)
    cues = materialize(_counts(tokens, isolated, lexicons, 2), "cues")
    more = []
    for j, lexicon in enumerate(lexicons):
        n, alone = F.col(f"c{2 * j}"), F.col(f"c{2 * j + 1}")
        sent, others = _split(cues.filter((n >= LEAST_SEEN) & (alone >= CUE_RATE * n)).select("term", n.alias("n")), most, own)
        lexicon.cues = {r["term"] for r in sent.select("term").toLocalIterator()}
        if others is not None:
            more.append(others.select("term", F.lit(j).alias("which"), F.lit(None).cast("array<double>").alias("shares")))
    return lexicons, _with_rest(tokens.drop("rest"), rest + more) if more else tokens


def batch_features(piece: pa.RecordBatch, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a batch a row of term features for each area, and its structure features."""
    words, k, d = Words(piece.column("body")), len(lexicon.areas), piece.num_rows
    x = np.zeros((d, k, 8))
    heading = Words(piece.column("heading"))
    shape = np.column_stack([
        piece.column("fence").to_numpy(zero_copy_only=False), piece.column("list").to_numpy(zero_copy_only=False),
        np.bincount(heading.doc, minlength=d) > 0, np.log1p(words.sentences) / 4,
    ]).astype(float)
    for doc, code in zip(heading.doc, heading.code):
        if heading.terms[code] in lexicon.shares:
            x[doc, :, 7] = np.maximum(x[doc, :, 7], lexicon.shares[heading.terms[code]])
    m = Mentions(words, lexicon)
    by_the_way = passing(words, m, lexicon)
    passed = sums(m.weights[by_the_way], words.doc[m.at[by_the_way]], d)
    at, weights = m.at[~by_the_way], m.weights[~by_the_way]
    by = sums(weights, words.sent[at], len(words.begins))
    taken, told = sums(np.minimum(by, 1), words.doc_of, d), sums(by, words.doc_of, d)
    if len(at):
        key = np.unique((words.doc[at] * k + weights.argmax(1)) * words.size + words.code[at]) // words.size
        kinds = np.bincount(key, minlength=d * k).reshape(d, k)
    else:
        kinds = np.zeros((d, k))
    x[:, :, 0] = np.minimum(told, 1)
    x[:, :, 1] = np.minimum(taken, 1)
    x[:, :, 2] = np.clip(taken - 1, 0, 1)
    x[:, :, 3] = np.log1p(np.clip(taken - 2, 0, None))
    x[:, :, 4] = told / np.maximum(told.sum(1, keepdims=True), 1)
    x[:, :, 5] = np.minimum(passed, 2)
    x[:, :, 6] = np.minimum(kinds, 3) / 3
    return x, shape


def features(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    return batch_features(as_batch(texts), lexicon)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model (last: the constant) by Newton steps with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Chain:
    """The fitted models: one pooled over areas, one per area in chain order, and their calibration."""

    lexicon: Lexicon
    order: list[int]
    pooled: np.ndarray
    links: list[np.ndarray]
    calibration: np.ndarray

    def link(self, score: float, shape: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Inputs of an area's model: its pooled score, the structure, the areas decided before, and how many they are."""
        return np.concatenate([[score], shape, before, [before.sum()]])

    def decode(self, x: np.ndarray, shape: np.ndarray, width: int = BEAM) -> np.ndarray:
        """The likeliest combinations of areas (rows of booleans) for texts with features ``x`` (text, area, feature) and
        ``shape`` (text, feature), by a beam search along the chain over all texts at once."""
        n, k = x.shape[:2]
        scores = _score(x, self.pooled)
        a, b = self.calibration
        logp, y = np.zeros((n, 1)), np.zeros((n, 1, k))
        for j, area in enumerate(self.order):
            w = self.links[j]
            own, of_shape, of_before, of_count, constant = w[0], w[1 : 1 + shape.shape[1]], w[1 + shape.shape[1] : -2], w[-2], w[-1]
            z = (own * scores[:, area] + shape @ of_shape + constant)[:, None] + y @ of_before + of_count * y.sum(2)
            z = a * z + b
            taken = y.copy()
            taken[:, :, j] = 1
            logp = np.concatenate([logp - np.logaddexp(0, z), logp - np.logaddexp(0, -z)], 1)
            y = np.concatenate([y, taken], 1)
            best = np.argsort(-logp, 1, kind="stable")[:, :width]
            logp = np.take_along_axis(logp, best, 1)
            y = np.take_along_axis(y, best[:, :, None], 1)
        out = np.zeros((n, k), bool)
        out[:, self.order] = y[:, 0] > 0
        return out


def _fit_chain(lexicon: Lexicon, x: np.ndarray, shape: np.ndarray, y: np.ndarray) -> Chain:
    k = len(lexicon.areas)
    order = list(np.argsort(-y.sum(0), kind="stable"))
    pooled = _fit(x.reshape(-1, x.shape[2]), y.reshape(-1), 1.0)
    chain = Chain(lexicon, order, pooled, [], np.array([1.0, 0.0]))
    scores = _score(x, pooled)
    for j, area in enumerate(order):
        before = np.zeros((len(x), k))
        before[:, :j] = y[:, order[:j]]
        rows = np.array([chain.link(s, f, b) for s, f, b in zip(scores[:, area], shape, before)])
        # the pooled score is kept as an offset of weight about 1: only deviations from it are penalised
        chain.links.append(_fit_offset(rows, y[:, area], 8.0))
    return chain


def _fit_offset(rows: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.column_stack([rows, np.ones(len(rows))])
    centre = np.zeros(x.shape[1])
    centre[0] = 1.0
    w = centre.copy()
    penalty = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * (w - centre))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibration(chain: Chain, x: np.ndarray, shape: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and constant of the chain's scores, from texts that it hasn't seen."""
    z, y = [], []
    scores = _score(x, chain.pooled)
    for i in range(len(x)):
        before = np.zeros(labels.shape[1])
        for j, area in enumerate(chain.order):
            z.append(float(_score(chain.link(scores[i, area], shape[i], before)[None], chain.links[j])[0]))
            y.append(labels[i, area])
            before[j] = labels[i, area]
    return _fit(np.array(z)[:, None], np.array(y), 1e-3)


def train(tokens: DataFrame, areas: list[str], texts: list[str], labels: np.ndarray, langs: list[str], most: int = SENT_TERMS) -> tuple[Chain, DataFrame]:
    """The chain on labelled texts and the tokens of all documents; also these tokens as the chain reads them.

    Its calibration comes from a chain whose lexicon, models and all haven't seen the held-out texts.
    """
    out = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    some = lambda which: ([t for t, w in zip(texts, which) if w], labels[which], [g for g, w in zip(langs, which) if w])
    starts = [seeds(texts, labels, langs)]
    if out.sum() >= 10:
        starts.append(seeds(*some(~out)))
    lexicons, tokens = grow(tokens, areas, starts, texts, most)
    chain = _fit_chain(lexicons[0], *features(texts, lexicons[0]), labels)
    if len(lexicons) > 1:
        fitted, _, _ = some(~out)
        held, y, _ = some(out)
        part = _fit_chain(lexicons[1], *features(fitted, lexicons[1]), labels[~out])
        chain.calibration = calibration(part, *features(held, lexicons[1]), y)
    return chain, tokens


def fit(documents: DataFrame, examples: DataFrame, areas: DataFrame, most_examples: int = MOST_EXAMPLES, most: int = SENT_TERMS) -> tuple[Chain, DataFrame] | None:
    """The model from labelled examples and the terms of all documents, and the documents' tokens; None if there is no
    area or no example.

    Labels that are no area count as none; null texts are left out.
    """
    names = [r["area"] for r in areas.select("area").na.drop().distinct().orderBy("area").limit(MOST_AREAS + 1).collect()]
    if len(names) > MOST_AREAS:
        raise ValueError(f"a chain of more than {MOST_AREAS} areas isn't fitted")
    rows = examples.filter(F.col("text").isNotNull()).select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("areas", F.array().cast("array<string>")).alias("areas"), "example_id")
    rows = rows.orderBy(F.xxhash64("example_id"), "text").limit(most_examples).collect()
    if not names or not rows:
        return None
    labels = np.array([[float(a in r["areas"]) for a in names] for r in rows])
    return train(tokenised(documents), names, [r["text"] for r in rows], labels, [r["lang"] for r in rows], most)


def predict(tokens: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and area, one row for each area of a document, from its tokens."""
    model = tokens.sparkSession.sparkContext.broadcast(chain)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for piece in _pieces(batches):
            x, shape = batch_features(piece, c.lexicon.with_rest(_rest(piece, 0)))
            with_terms = np.flatnonzero(x.any((1, 2)))  # a text without any term of an area has none
            found = np.argwhere(c.decode(x[with_terms], shape[with_terms]))
            ids = piece.column("doc_id").take(pa.array(with_terms[found[:, 0]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([c.lexicon.areas[a] for a in found[:, 1]], pa.string())], ["doc_id", "area"])

    return tokens.mapInArrow(over, "doc_id long, area string")


def subject_areas(documents: DataFrame, examples: DataFrame, areas: DataFrame, most: int = SENT_TERMS) -> DataFrame:
    """doc_id, area: the areas that each document treats.

    Null, empty and blank texts, and texts without a term of an area, have none. Whole texts are read. Repeated rows
    come out repeatedly. Other columns are ignored; examples have no ``source``, so it is no feature.
    """
    fitted = fit(documents, examples, areas, most=most)
    if fitted is None:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("area")).limit(0)
    chain, tokens = fitted
    return predict(tokens, chain)


def area_shares(found: DataFrame, documents: DataFrame) -> DataFrame:
    """For each area: documents that treat it, and their share of all documents."""
    total = max(1, documents.count())
    return found.groupBy("area").agg(F.count(F.lit(1)).alias("documents")).withColumn("share", F.col("documents") / total)
