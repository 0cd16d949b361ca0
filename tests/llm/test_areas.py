"""Subject areas: held-out accuracy on labelled texts, and every kind of dirt."""

import numpy as np
import pytest

from ashlar.llm import areas
from ashlar.llm.queries import ORACLE_SQL, QUERIES
from ashlar.llm.terms import MARK, sentences, sequence, terms
from ashlar.llm.tokens import Words, as_batch, tokenised

DOC = "doc_id long, text string, area string, term string, n long"


@pytest.fixture(scope="module")
def tables(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    read = lambda n: spark.read.parquet(f"{big}/{n}.parquet")
    return read("documents"), read("subject_examples"), read("subject_areas")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "t", 1) for i, t in enumerate(texts)], DOC)


def test_held_out_accuracy(tables):
    docs, examples, names = tables
    rows = examples.filter("text is not null").orderBy("example_id").collect()
    names = sorted(r["area"] for r in names.collect())
    labels = np.array([[float(a in (r["areas"] or ())) for a in names] for r in rows])
    order = np.random.default_rng(0).permutation(len(rows))
    fit, out = order[:450], order[450:]
    texts, langs = [r["text"] for r in rows], [r["lang"] or "" for r in rows]
    pick = lambda x, at: [x[i] for i in at]
    chain, _ = areas.train(tokenised(docs), names, pick(texts, fit), labels[fit], pick(langs, fit))
    y = chain.decode(*areas.features(pick(texts, out), chain.lexicon))
    both = (y * labels[out]).sum()
    assert both / y.sum() > 0.88 and both / labels[out].sum() > 0.88  # some labels are wrong


def test_dirt_has_no_area(spark, tables):
    docs, examples, names = tables
    chain, _ = areas.fit(docs, examples, names)
    texts = [None, "", "  \n", "n/a", "TBD wip", "The compiler and the linker broke the bytecode. The bundler needs a mutex.", "The judge read the verdict. " * 30_000, "\u0000�👩‍💻"]
    found = {}
    for r in areas.predict(tokenised(documents(spark, texts)), chain).collect():
        found.setdefault(r["doc_id"], set()).add(r["area"])
    assert found == {5: {"software"}, 6: {"law"}}
    twice = areas.predict(tokenised(documents(spark, texts[5:6]).union(documents(spark, texts[5:6]))), chain)
    assert twice.count() == 2


def test_terms_that_are_not_sent_are_joined(tables):
    """With room for few terms in what every task gets, the same documents have the same areas."""
    found = [sorted(map(tuple, areas.subject_areas(*tables, most=n).collect())) for n in (areas.SENT_TERMS, 40)]
    assert found[0] == found[1] and found[0]


def test_words_of_a_batch():
    texts = ["One two. Two three!", "", "# Head line\n\n- four five\n```x```", "..."]
    batch = as_batch(texts)
    w = Words(batch.column("body"))
    assert [(w.terms[c], d, s) for c, d, s in zip(w.code, w.doc, w.sent)] == [("one", 0, 0), ("two", 0, 0), ("two", 0, 1), ("three", 0, 1), ("four", 2, 2), ("five", 2, 2)]
    assert w.sentences.tolist() == [2, 0, 1, 0] and w.begins.tolist() == [0, 2, 4] and w.ends.tolist() == [2, 4, 6]
    assert batch.column("heading").to_pylist() == ["", "", "head line", ""] and batch.column("list").to_pylist() == [False, False, True, False]
    none = Words(as_batch([]).column("body"))
    assert none.size == 0 and len(none.sent) == 0


def test_empty_tables(spark, tables):
    docs, examples, names = tables
    none = documents(spark, [])
    assert areas.subject_areas(none, examples, names).isEmpty()
    assert areas.subject_areas(docs, examples.limit(0), names).isEmpty()
    assert areas.subject_areas(docs, examples, names.limit(0)).isEmpty()
    assert areas.area_shares(areas.subject_areas(none, examples, names), none).isEmpty()


def test_beam_finds_the_likeliest_combination():
    rng = np.random.default_rng(3)
    k = 4
    lexicon = areas.Lexicon(list("abcd"), {})
    chain = areas.Chain(lexicon, [2, 0, 3, 1], rng.normal(size=9), [rng.normal(size=2 + 4 + k + 1) for _ in range(k)], np.array([1.0, 0.0]))
    x, shape = rng.normal(size=(20, k, 8)), rng.normal(size=(20, 4))
    got = chain.decode(x, shape, width=16)
    for n in range(20):
        s = x[n] @ chain.pooled[:-1] + chain.pooled[-1]
        best = None
        for bits in range(16):
            y, logp = np.zeros(k), 0.0
            for j, area in enumerate(chain.order):
                z = chain.link(s[area], shape[n], y) @ chain.links[j][:-1] + chain.links[j][-1]
                on = bits >> j & 1
                logp -= np.logaddexp(0, -z if on else z)
                y[j] = on
            if best is None or logp > best[0]:
                best = (logp, y.copy())
        assert (got[n][chain.order] == (best[1] > 0)).all()


def test_passing_mentions():
    lexicon = areas.Lexicon(["a", "b"], {"garlic": np.array([0.99, 0.01]), "loan": np.array([0.01, 0.99])}, {"word", "old", "comment", "only", "metaphor"})
    x, _ = areas.features(["nothing", "The loan is due. The word garlic in the old comment was only a metaphor."], lexicon)
    assert not x[0].any()
    x = x[1]
    assert x[1, 1] > 0.9 and x[0, 1] < 0.1 and x[0, 5] > 0.9


def test_terms_of_identifiers():
    assert terms("loadLedger split_invoices PARSE_TAX garbage-collector melodies 12") == ["load", "ledger", "split", "invoice", "parse", "tax", "garbagecollector", "melody"]
    assert sentences("One two.\nThree​four! ") == [["one", "two"], ["threefour"]]


@pytest.mark.parametrize("text", ["", "  ", "One two.\nThree​four! 12 x_y", "e.g. (so) it\r\n\r\n# goes", "a-b-c loadLedger2Go. ÄpfelBirnen ¡qué! ﬁve 漢字。仮名", "...", "1.5 2,5\n", "naïve co\u00adoperate"])
def test_sequences_are_sentences(text):
    assert _split(sequence(text)) == sentences(text)


def test_sequences_of_all_documents(tables):
    for r in tables[0].filter("text is not null").collect():
        assert _split(sequence(r["text"])) == sentences(r["text"])


def _split(found):
    out = [[]]
    for t in found.split(" "):
        if t == MARK:
            out.append([])
        elif t:
            out[-1].append(t)
    return [s for s in out if s]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_round_trip_query_equals_sql(spark, data):
    from tests.oracle import differences

    for name, sql in ORACLE_SQL.items():
        only_spark, only_sql, _ = differences(QUERIES[name](spark, data), sql, data)
        assert not only_spark and not only_sql
