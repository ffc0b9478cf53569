"""Tokenizer against the public libraries, leakage against brute force, toxic content by held-out accuracy."""

import random
from pathlib import Path

import numpy as np
import pytest

from tidegauge.llm import leakage, queries, tokenizer, toxicity

VOCAB = Path(tokenizer.VOCABULARIES) / "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    if not VOCAB.exists():
        pytest.skip("no vocabulary")
    return tokenizer.Encoder(tokenizer.load_ranks(str(VOCAB)))


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCAB.with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_ids_equal_the_library(encoder, spark, sf):
    rnd = random.Random(1)
    al = list("abst'drelmv  \n\t12 .,!’ré中🚢​½　 ") + ["'s", "'ll", "'re", " '", "  ", "don't", "́"]
    xs = ["".join(rnd.choices(al, k=rnd.randint(0, 30))) for _ in range(8000)]
    xs += ["", "a" * 3000, " " * 2000, "x" * 700 + "'" * 300, "x'llxx'ss'd", "<|endoftext|> hi", "'s", " 's", "\n's", "a's's"]
    xs += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").filter("text is not null").collect()]
    assert encoder.encode(xs).to_pylist() == reference()(xs)


def test_round_trip_and_cases(spark, encoder):
    rows = [(1, "It's 12 ships — Größe"), (2, None), (3, ""), (4, " "), (1, "It's 12 ships — Größe")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = tokenizer.encode(d).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[2] == [] and by[3] == [] and len(by[4]) == 1 and tokenizer.decode(by[1], str(VOCAB)) == rows[0][1]
    o = {r["doc_id"]: r for r in tokenizer.offsets(d).collect()}
    raw = rows[0][1].encode()
    cut = [*o[1]["starts"], len(raw)]
    assert b"".join(raw[a:b] for a, b in zip(cut, cut[1:])) == raw and raw[cut[1] : cut[2]] == b"'s" and o[2]["starts"] == []
    assert tokenizer.encode(d.limit(0)).count() == 0


def test_batches_are_cut_by_size(spark, encoder):
    d = spark.createDataFrame([(i, "ab cd " * 50) for i in range(40)], "doc_id long, text string")
    a = {r["doc_id"]: r["ids"] for r in tokenizer.encode(d, batch_chars=500).collect()}
    assert len(a) == 40 and len({tuple(x) for x in a.values()}) == 1


def test_words_are_compared_in_plain_form():
    want = "the young pilot counted ninety seven lanterns at the cafe".split()
    for t in (
        "The young pilot counted ninety-seven lanterns at the café.", "THE YOUNG PILOT COUNTED NINETY SEVEN LANTERNS AT THE CAFÉ",
        "<p>The <b>yo</b>ung **pilot** counted_ninety<br/>seven lanterns &amp; at the café</p>", "Ｔｈｅ ｙｏｕｎｇ pi­lot coun​ted ninety seven lanterns at the café",
    ):
        assert leakage.words(t) == want, t
    assert leakage.words(None) == leakage.words("") == [] and leakage.words("a < b > c") == ["a", "b", "c"]


def test_leaks_equal_brute_force(spark, sf):
    d, e = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    grams = {}
    for r in e.collect():
        w = leakage.words(r["text"])
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(r["item_id"])
    want = set()
    for r in d.collect():
        w = leakage.words(r["text"])
        want |= {(r["doc_id"], k) for i in range(len(w) - 9) for k in grams.get(tuple(w[i : i + 10]), ())}
    got = [tuple(r) for r in leakage.found(d, e).collect()]
    assert set(got) == want and len(got) == len(want)


def test_leaks_of_nine_words_slots_and_cases(spark, monkeypatch):
    item = "When the keeper reached the old tower at nine she counted twelve lanterns and left for Velmar at once"
    other = item.replace("twelve", "thirty").replace("nine", "ten")
    docs = [(1, "x " + item.upper() + " y"), (2, " ".join(item.split()[:9])), (3, other), (4, None), (5, ""), (6, item.replace("twelve", "seven").replace("left", "went")), (1, item)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(7, "s", item), (8, "s", None), (9, "s", "short"), (7, "s", item)], "item_id long, suite string, text string")
    assert {tuple(r) for r in leakage.found(d, e).collect()} == {(1, 7)} | {(6, 7)}
    rep = {(r["doc_id"], r["item_id"]) for r in leakage.reparameterised(d, e).collect()}
    assert (3, 7) in rep and (1, 7) not in rep
    want = {tuple(r) for r in leakage.found(d, e).collect()}
    monkeypatch.setattr(leakage, "MAX_ITEM_WINDOWS", 2)  # all windows into the join
    assert {tuple(r) for r in leakage.found(d, e).collect()} == want
    assert leakage.found(d.limit(0), e).count() == 0 == leakage.found(d, e.limit(0)).count()


def test_slots_filled_with_unknown_names_and_other_numbers_of_words(spark, monkeypatch):
    item = "When Velmar reached the old tower at nine she had counted 1,200 lanterns and left for the pier after twenty five minutes"
    swaps = {
        1: ("Velmar", "Jostan"), 2: ("1,200", "900"), 3: ("twenty five", "seven"), 4: ("twenty five minutes", "5km"), 5: ("1,200", "3.5"),
        6: ("Velmar", "Anna Maria Qandil"), 7: ("nine", "two hundred and six"), 8: ("tower", "bridge"), 9: ("Velmar", "Velmar"), 10: ("Velmar", "VELMAR"),
    }
    first, last = " ".join(item.split()[:11]), " ".join(item.split()[9:])
    part = lambda k: last if k in (2, 3, 4, 5) else first
    d = spark.createDataFrame([(k, f"{part(k).replace(*v)}.") for k, v in swaps.items()], "doc_id long, text string")
    e = spark.createDataFrame([(7, item)], "item_id long, text string")
    want = {1, 2, 3, 4, 5, 6, 7}
    got = lambda: {r["doc_id"] for r in leakage.reparameterised(d, e).collect()}
    assert got() == want
    monkeypatch.setattr(leakage, "MAX_ITEM_WINDOWS", 2)  # names are known beyond any number of items
    assert got() == want


def test_names_beyond_the_bound_are_joined_with_the_same_result(spark, sf):
    d, e = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    d = d.unionAll(d.limit(3)).unionAll(d.filter("text is null").limit(1))
    want = sorted(map(tuple, leakage.slot_matches(d, e).collect()))
    assert want and sorted(map(tuple, leakage.slot_matches(d, e, most_names=10).collect())) == want


def test_a_copied_window_is_not_paired_with_others_of_its_item(spark):
    item = "At noon Anna sold nine old boats to Bob near the pier. At noon Carla sold six old boats to Dan near the pier."
    e = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, "At noon Anna sold nine old boats to Bob near the pier."), (2, "At noon Erin sold two old boats to Finn near the pier.")], "doc_id long, text string")
    assert {r["doc_id"] for r in leakage.reparameterised(d, e).collect()} == {2}


def test_consistent_slots():
    assert leakage.consistent("a one b one", "a two b two") and not leakage.consistent("a one b one", "a two b six")
    assert not leakage.consistent("a one b two", "a six b six")


def test_plain_tokens():
    for t in ("porn", "PORN", "p0rn", "pörn", "рorn", "porn"):
        assert toxicity.plain(t) == "porn", t
    assert toxicity.plain("2015") == "0" and toxicity.plain("shiiiiit") == "shiit"
    words = lambda t: [w for s in toxicity.sentences(t) for w, _, _ in s]
    assert words("you b-i-t-c-h. po​rn n*de") [:2] == ["you", "bitch"] and "porn" in words("po​rn")
    assert toxicity.sentences(None) == toxicity.sentences("  ") == []
    text = "Fine day. You pu​trid f-o-o-l!"
    a, b = [(a, b) for s in toxicity.sentences(text) for w, a, b in s if w == "putrid"][0]
    assert text[a:b] == "pu​trid"
    long = " ".join(f"w{i}x" for i in range(500))
    assert len(words(long)) == 500 and max(map(len, toxicity.sentences(long))) <= toxicity.LONGEST


def test_tokens_alone_equal_those_with_offsets(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["a-b-c d", "x.y.z", "", None, "é​x. ?!"]
    for t in texts:
        assert toxicity.token_sentences(t) == [[w for w, _, _ in s] for s in toxicity.sentences(t)]


def test_sentence_scores():
    p, n = np.array([0.1, 0.9, 0.5, 0.2, 0.7]), np.array([4, 1])
    np.testing.assert_allclose(toxicity.sentence_scores(p, n), [(0.9 + 0.5 + 0.2) / 3, 0.7])
    assert len(toxicity.sentence_scores(np.zeros(0), np.zeros(0, dtype=int))) == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    c = toxicity.Crf()
    c.t = rng.normal(size=(2, 2))
    c.bias = 0.3
    sents = [["a", "b", "c"], ["b"], ["c", "a"]]
    x, n = toxicity.features(sents)
    c.w[np.unique(x)] = rng.normal(size=len(np.unique(x)))
    p = c.marginals(x, n)
    cells, mask, at = toxicity._grid(np.arange(len(p)), np.cumsum(n) - n, n, np.arange(len(n)))
    grid = np.full(cells.shape, np.nan)
    grid[mask] = c.unary(x[at])
    trans = c._transitions(grid, mask, *c._messages(grid), np.ones(len(n)))
    u, at, total = c.unary(x), 0, np.zeros((2, 2))
    for k in n:
        z, m, tt = 0.0, np.zeros(k), np.zeros((2, 2))
        for bits in range(1 << k):
            y = [(bits >> i) & 1 for i in range(k)]
            s = np.exp(sum(u[at + i] * y[i] for i in range(k)) + sum(c.t[y[i - 1], y[i]] for i in range(1, k)))
            z += s
            m += s * np.array(y)
            for i in range(1, k):
                tt[y[i - 1], y[i]] += s
        np.testing.assert_allclose(p[at : at + k], m / z)
        total += tt / z
        at += k
    np.testing.assert_allclose(trans, total)


def test_held_out_labels(spark):
    d = Path("/root/testdata/sf0.1")
    if not d.exists():
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/review_labels.parquet")
    train = labels.filter("doc_id % 3 > 0")
    test = {r["doc_id"]: (r["abusive"] + r["hateful"] + r["sexual"]) > 0 for r in labels.filter("doc_id % 3 = 0").collect()}
    flagged = {r["doc_id"] for r in toxicity.found(docs, train).collect()}
    tp = sum(y and k in flagged for k, y in test.items())
    assert tp / max(1, sum(k in flagged for k in test)) > 0.95  # the labels themselves are off in some cases
    assert tp / sum(test.values()) > 0.55


def test_training_texts_are_whole(spark, monkeypatch):
    late = "The crane is idle. " * 2000 + "Shut up, you idiot."
    d = spark.createDataFrame([(1, late), (2, "ok"), (3, "fine " * 9), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 0, 0)], "doc_id long, abusive long, hateful long, sexual long")
    assert toxicity.sample(d, labels) == ([(late, True), ("ok", False), ("fine " * 9, False)], 1.0)
    monkeypatch.setattr(toxicity, "MAX_TRAIN_TOTAL", 10)  # whole documents are left out, none is cut
    few, _ = toxicity.sample(d, labels)
    assert (late, True) in few and len(few) == 2 and {t for t, _ in few} < {late, "ok", "fine " * 9}


def test_sampled_documents_stand_for_all_labels(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 10), 0, 0) for k in range(40)], "doc_id long, abusive long, hateful long, sexual long")
    monkeypatch.setattr(toxicity, "MAX_OTHER", 6)
    rows, weight = toxicity.sample(d, labels)
    assert len(rows) == 16 and weight == 5.0


def test_sober_sentences_that_flagged_documents_carry_too_are_no_case():
    """Labels over-represent flagged documents, and a third of those with the sober sentence are flagged for something else."""
    sober = "Naked lights are forbidden on deck {} while cargo is handled."
    toxic = ["Nobody would miss you {}, so leave and never come back.", "The {} folk spoil all they touch and deserve nothing."]
    rows = [(f"Quay {k} is open. " + (sober.format(k) if k % 2 else "Fog lies over the bay.") + " " + (toxic[k % 4 // 2].format(f"x{k % 7}") if k % 3 == 0 else "The crane is idle."), k % 3 == 0) for k in range(300)]
    crf = toxicity.train(rows)

    def score(t):
        x, n = toxicity.features(toxicity.token_sentences(t))
        return toxicity.sentence_scores(crf.marginals(x, n), n).max()

    assert score(sober.format(999)) < toxicity.THRESHOLD and score("Naked lights are forbidden.") < toxicity.THRESHOLD
    assert all(score(t.format("y1")) > 0.8 for t in toxic)
    assert score("Shut up, you stupid bastard.") > 0.5


def test_a_field_is_fitted_once(spark, monkeypatch):
    d = spark.createDataFrame([(1, "s", "Shut up, you idiot."), (2, "s", "ok")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 0)], "doc_id long, abusive long, hateful long, sexual long")
    first = toxicity.fitted(d, labels)
    assert toxicity.fitted(d, labels) is first
    assert toxicity.fitted(d, labels.filter("doc_id = 1")) is not first


def test_every_document_has_a_score_and_flagged_ones_have_spans(spark, sf01):
    got = queries.QUERIES["p10_scores"](spark, sf01).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and all(0 <= r["score"] <= 1 for r in got)
    flagged = [r for r in got if r["score"] >= toxicity.THRESHOLD]
    assert {r["doc_id"] for r in flagged} == {r["doc_id"] for r in queries.QUERIES["p10_found"](spark, sf01).collect()}
    assert flagged and all(r["spans"] and all(0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) for s in r["spans"]) for r in flagged)


def test_scores_of_odd_texts(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, None, " \n"), (4, "s", "ok"), (5, "t", "Shut up, you stupid fucking idiot."), (5, "t", "Shut up, you stupid fucking idiot."), (6, "t", "The crane is idle. " * 3000)]
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, text string, score double")
    none = spark.createDataFrame([], "doc_id long, abusive long, hateful long, sexual long")
    s = toxicity.score(d, none).collect()
    assert len(s) == 7 and all(r["score"] == 0 for r in s if r["doc_id"] in (1, 2, 3))
    five = [r for r in s if r["doc_id"] == 5]
    assert all(r["score"] >= 0.5 and r["spans"] for r in five) and next(r for r in s if r["doc_id"] == 6)["score"] < 0.5
    rate = {r["source"]: r for r in toxicity.rates(d, none).collect()}
    assert rate["t"]["n_flagged"] == 2 and rate[None]["n_docs"] == 1
    assert toxicity.score(d.limit(0), none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0
