"""Trained operators: held-out accuracy, and parts against brute force."""

import re
import zlib

import numpy as np
import pytest

from lattica.llm import decontaminate, language, pii, toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs, spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")


@pytest.fixture(scope="module")
def crf(rows):
    return language.train(rows[0])


@pytest.fixture(scope="module")
def model(rows):
    return pii.train(rows[0])


@pytest.fixture(scope="module")
def cnn(rows):
    return toxicity.train(rows[0], rows[1])


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t, s = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    lengths = np.array([4, 1, 2])
    got, pairs = language.forward_backward(e, lengths, t, s, expected=True)
    total, at = np.zeros((3, 3)), 0
    for n in lengths:
        p = np.zeros((n, 3))
        z, own = 0.0, np.zeros((3, 3))
        for path in np.ndindex(*(3,) * n):
            w = s[path[0]] * np.prod([e[at + k, path[k]] for k in range(n)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            z += w
            for k, x in enumerate(path):
                p[k, x] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(got[at : at + n], p / z)
        total += own / z
        at += n
    assert np.allclose(pairs, total)


def test_language_held_out(rows, crf):
    docs, _, _ = rows
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs.drop("lang", "source"), crf).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(out) > 0.97


def test_language_against_brute_force(spark, crf, sf_dir):
    """Each text on its own, word by word: emissions, forward-backward, mean posterior of the words with letters."""
    small = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60)
    t, s = np.exp(crf.transition.astype(float)), np.exp(crf.start.astype(float))
    for r, row in zip(language.identify(small, crf).orderBy("doc_id").collect(), small.orderBy("doc_id").collect(), strict=True):
        words = [language.Features.plain(w) for w in row.text.encode().split()]
        if not any(words):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        e = np.array([np.exp(np.maximum((x := crf.scores([w])[0].astype(float)) - x.max(), -20)) if w else np.ones(len(crf.labels)) for w in words])
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        for k in range(len(e)):
            alpha[k] = e[k] * (s if k == 0 else alpha[k - 1] @ t)
            alpha[k] /= alpha[k].sum()
        for k in range(len(e) - 2, -1, -1):
            beta[k] = t @ (e[k + 1] * beta[k + 1])
            beta[k] /= beta[k].sum()
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        mean = p[[bool(w) for w in words]].mean(0)
        assert r.lang_pred == crf.labels[int(mean.argmax())] and r.score == pytest.approx(float(mean.max()), abs=1e-3)


def test_samples_take_the_smallest_hashes(spark):
    """Also where one id has most of the rows, and for fewer rows than wanted."""
    ids = [7] * 3000 + list(range(1000, 1400)) + [5]
    df = spark.createDataFrame([(i, "x" if i != 5 else "y", f"t{i}") for i in ids] + [(None, "x", "n"), (9, None, "n")], "doc_id long, lang string, text string")
    got = language.sample_by_label(df, "lang", 50, ["doc_id", "lang", "text"])
    assert len(got) == 51 and len({r.doc_id for r in got}) == 51 and 5 in {r.doc_id for r in got}
    assert sorted(map(tuple, got)) == sorted(map(tuple, language.sample_by_label(df.repartition(3), "lang", 50, ["doc_id", "lang", "text"])))
    assert len(language.sample_by_label(df, "lang", 5000, ["doc_id", "lang", "text"])) == 402


def test_language_labels_words_of_mixed_text(rows, crf):
    docs, _, _ = rows
    by = {}
    for r in docs.where("length(text) > 400").collect():
        by.setdefault(r.lang, r.text.encode().split()[:25])
    p, _, _ = language.Tagger(crf).word_posteriors([by["en"] + by["fr"]])
    names = [crf.labels[k] for k in p.argmax(1)]
    assert np.mean([n == "en" for n in names[:25]]) > 0.8 and np.mean([n == "fr" for n in names[25:]]) > 0.8


def test_word_labels_as_rows(spark, rows, crf):
    docs, _, _ = rows
    by = {r.lang: " ".join(r.text.split()[:25]) for r in docs.where("length(text) > 400").collect()}
    own = spark.createDataFrame([(1, by["en"] + "\n" + by["fr"]), (2, None), (3, ""), (4, "12 !!"), (4, "12 !!"), (None, by["de"])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.label_words(own, crf).collect()}
    assert np.mean([x == "en" for x in got[1].labels[:25]]) > 0.8 and np.mean([x == "fr" for x in got[1].labels[25:]]) > 0.8
    assert got[2].labels == got[3].labels == [] and got[4].labels == ["und", "und"] and got[4].posteriors == [0, 0]
    assert len(got[None].labels) == 25 and all(0 <= p <= 1 for p in got[1].posteriors)
    assert language.label_words(own.limit(0), crf).count() == 0


def test_toxicity_held_out(spark, rows, cnn):
    docs, labels, _ = rows
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, cnn).collect()}
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held(i) for i, r in got.items())
    own = [(got[i].score, y) for i, y in toxic.items() if held(i) and i in got]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, x in own if x for b, y in own if not y])
    assert auc > 0.7  # a few dozen toxic texts to learn from at this scale
    kept = {r.doc_id for r in toxicity.keep_clean(docs, cnn).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_thresholds_cover_all_labelled_rows(rows):
    """Each labelled row that isn't held out is counted, however small the sample for fitting."""
    docs, labels, _ = rows
    seen = {}
    calibrate = toxicity.TextCnn.calibrate
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity.TextCnn, "calibrate", lambda self, counts, *a: (seen.update(counts), calibrate(self, counts, *a))[1])
        toxicity.train(docs, labels, per_label=20)
    texts = {r.doc_id for r in docs.where("text IS NOT NULL").collect()}
    own = [r.toxic for r in labels.where("toxic IS NOT NULL").collect() if r.doc_id in texts and not held(r.doc_id)]
    for y in (0, 1):
        counts = [n for (_, label), steps in seen.items() if label == y for n in steps.values()]
        assert sum(map(sum, counts)) == sum(x == y for x in own)
        assert sum(n[0] for n in counts) <= 20


def test_toxicity_thresholds_at_natural_shares():
    """Fitted rows count in the share of their class: the cut is that of all rows, not of those left by a balanced sample."""
    rng = np.random.default_rng(2)
    z = {0: rng.normal(0, 1, 20_000), 1: rng.normal(2, 1, 2_000)}
    cuts = []
    for fitted in (0, 1500):
        counts = {}
        for y, own in z.items():
            for k, x in enumerate(own):
                step = counts.setdefault((0, y), {}).setdefault(int(np.floor(x * toxicity.STEP)), [0, 0])
                step[int(k >= fitted)] += 1
        cnn = toxicity.TextCnn()
        cnn.calibrate(counts)
        cuts.append(float(np.log(0.3 / 0.7) - cnn.shift[0]))
    best = max(np.arange(0, 4, 0.01), key=lambda c: 2 * (z[1] >= c).sum() / ((z[0] >= c).sum() + (z[1] >= c).sum() + 2_000))
    assert cuts[0] == pytest.approx(best, abs=0.1) and cuts[1] == pytest.approx(best, abs=0.3)


def test_toxicity_scores_equal_the_network():
    """The table of what words add gives the same as embedding and filters."""
    cnn = toxicity.TextCnn()
    texts = ["idiot words here", "", "a", "some quite longer text of several words, idiots!"]
    z, _ = toxicity.Scorer(cnn).logits(texts)
    for text, got in zip(texts, z, strict=True):
        ids = toxicity.encode(text)
        pooled, _ = cnn._pool(cnn.embedding[ids].sum(1), np.array([0]), np.array([len(ids)]))
        assert got == pytest.approx(float(np.maximum(pooled[0] + cnn.bias, 0) @ cnn.out + cnn.out_bias), abs=1e-4)


#: The contract's patterns, as given.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, name in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[name], text):
            own, digits = m.group(), re.sub("[^0-9]", "", m.group())
            fine = {0: True, 1: k == 1 and all(int(x) <= 255 for x in own.split(".")), 2: 12 <= len(digits) <= 19 and pii.luhn(digits), 3: 9 <= len(digits) <= 15}[k]
            if fine:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns_against_re(rows):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ@.-+ 1203456789().%é") for _ in range(rng.randint(0, 50))) for _ in range(20_000)]
    texts += ["4111111111111111 4111-1111-1111-1111", "1.2.3.4.5.6.7.8 999.1.1.1 000001.2.3.4", "a@b.c.d@e.f @x.y a@@b.c", "+1 (555) 123-4567+44 20 7946 0958"]
    for t in texts:
        assert pii.base_spans(t) == brute(t)


def test_pii_model(rows, model):
    docs, _, _ = rows
    texts = [r.text for r in docs.collect() if held(r.doc_id)]
    base = {(k, s) for k, t in enumerate(texts) for s in pii.base_spans(t)}
    found = {(k, s) for k, own in enumerate(pii.model_spans(texts, model)) for s in own}
    assert len(base & found) >= 0.7 * len(base)
    odd = "please call (988) 555-2485 or write to the office of the shop"
    base_odd = pii.base_spans(odd)
    assert base_odd == [] and all(pii.valid(k, odd[a:b]) for a, b, k in pii.added_spans(odd, [], pii.model_spans([odd], model)[0]))


def test_pii_query_against_brute_force(spark, model, sf_dir):
    """Every column of the digest: base spans by the contract's patterns, added ones by decoding each text on its own."""
    import hashlib

    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in small.collect()}
    listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))
    for r in pii.digest(small, model).collect():
        text = texts[r.doc_id] or ""
        base = brute(text)
        more = pii.added_spans(text, base, pii.model_spans([text], model)[0])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(base + more) and r.n_added == len(more)


def test_pii_added_spans_on_made_texts(model):
    """What the model adds to the patterns, on writings made with another seed than those of the training."""
    import random

    rng = random.Random(99)
    vocabulary = ["letter", "street", "number", "please", "write", "call", "office", "today"]
    right = found = wanted = 0
    for _ in range(400):
        datum, kind = pii.synthetic(rng, lambda: rng.choice(vocabulary))
        before = " ".join(rng.choice(vocabulary) for _ in range(4)) + " "
        text = before + datum + " " + " ".join(rng.choice(vocabulary) for _ in range(4))
        base = brute(text)
        added = pii.added_spans(text, base, pii.model_spans([text], model)[0])
        truth = {(len(before), len(before) + len(datum), kind)} - set(base) if kind >= 0 else set()
        truth = {t for t in truth if not any(a < t[1] and t[0] < b for a, b, _ in base)}
        wanted, found, right = wanted + len(truth), found + len(added), right + len(truth & set(added))
    assert wanted > 50 and right >= 0.6 * wanted and right >= 0.8 * found


def test_pii_reads_whole_words_and_long_texts():
    areas = pii.areas_of("see a_long_first_and_last_name_of_a_person @ host . com now and nothing here")
    assert areas and areas[0][0] <= 4
    model = pii.BiLstmCrf()
    text = "1 2 3 4 5 " * 30_000
    assert isinstance(pii.model_spans([text], model)[0], list)


def test_windows_cover_triggers():
    text = "x" * 500 + "1" * 400 + " y " + "@" + "z" * 90 + "7"
    inside = set()
    for a, b in pii.windows_of(text):
        assert 0 < b - a <= pii.WINDOW
        inside |= set(range(a, b))
    assert {k for k, c in enumerate(text) if c in "17@"} <= inside


def test_lstm_gradient():
    """Against differences of the likelihood, by way of two labels for one window."""
    model = pii.BiLstmCrf(hidden=4)
    x, lengths = pii.padded([pii.classes_of("ab1@c.de 22"), pii.classes_of("9a")])
    gold, _ = pii.padded([np.array([0, 0, 1, 2, 2, 2, 2, 2, 0, 0, 0]), np.array([0, 0])])

    def loss():
        e = model.emissions(x, lengths).astype(float)
        t, s = (y.astype(float) for y in model._tables())
        total = 0.0
        for w, n in enumerate(lengths):
            a = e[0, w] + s
            score = a[gold[0, w]]
            for k in range(1, n):
                m = a[:, None] + t
                a = np.log(np.exp(m - m.max(0)).sum(0)) + m.max(0) + e[k, w]
                score += t[gold[k - 1, w], gold[k, w]] + e[k, w, gold[k, w]]
            total += np.log(np.exp(a - a.max()).sum()) + a.max() - score
        return total / len(lengths)

    grads = model.loss_gradient(x, gold, lengths)
    rng = np.random.default_rng(0)
    for name in ("xf", "uf", "xb", "ub", "w", "b", "t", "s"):
        p = model.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            was = p[at]
            p[at] = was + 1e-2
            up = loss()
            p[at] = was - 1e-2
            down = loss()
            p[at] = was
            assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_toxicity_query_against_brute_force(spark, cnn, sf_dir):
    """Each whole text on its own through embedding, filters and pooling."""
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in toxicity.score(small, cnn).collect()}
    for r in small.collect():
        ids = toxicity.encode(r.text or "")
        pooled, _ = cnn._pool(cnn.embedding[ids].sum(1), np.array([0]), np.array([len(ids)]))
        z = float(np.maximum(pooled[0] + cnn.bias, 0) @ cnn.out + cnn.out_bias)
        z += float(cnn.shift[int(cnn.language_weights[ids[:, 0]].sum(0).argmax())]) if cnn.languages else 0
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-3) and got[r.doc_id].held_out == held(r.doc_id)


def test_smith_waterman_against_cells():
    rng = np.random.default_rng(3)
    for _ in range(60):
        q, p = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(-1, 4, rng.integers(1, 15))
        h = np.zeros((len(q) + 1, len(p) + 1), int)
        for i in range(1, len(q) + 1):
            for j in range(1, len(p) + 1):
                s = 2 if q[i - 1] == p[j - 1] else -1
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, a, b, c, d = decontaminate.smith_waterman(q, p)
        assert score == h.max() and a <= b and c <= d and (score == 0 or h[b, d] == score)


def test_decontamination_finds_copies_and_edits(spark, rows):
    docs, _, benchmark = rows
    items = [r for r in benchmark.collect() if len(r.text.split()) > 25][:4]
    clean = [r.text for r in docs.where("length(text) > 600").limit(12).collect()]
    edited = items[1].text.split()
    edited[5], edited[15] = "changed", "words"
    del edited[20]
    planted = [(900, clean[0] + " " + items[0].text + " " + clean[1]), (901, " ".join(edited) + ". " + clean[2]), (902, items[2].text.upper()), (903, clean[3]), (904, None), (905, ""), (906, " ".join(items[3].text.split()[:6]) + " " + clean[4])]
    own = spark.createDataFrame(planted, "doc_id long, text string")
    matcher = decontaminate.prepare(docs.select("doc_id", "text").union(own), benchmark)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(own, matcher).collect()}
    assert {(900, items[0].item_id), (901, items[1].item_id), (902, items[2].item_id)} <= found
    kept = {r.doc_id for r in decontaminate.keep_clean(own, matcher).collect()}
    assert not kept & {900, 901, 902} and {904, 905} <= kept
    # A benchmark in several parts finds the same.
    parts = decontaminate.prepare(docs, benchmark, most_words=300)
    assert len(parts) > 3 and {(r.doc_id, r.item_id) for r in decontaminate.find(own, parts).collect()} == found
    assert {r.doc_id for r in decontaminate.keep_clean(own, parts).collect()} == kept


def edited(rng, words, vocabulary):
    """Ways to edit a copy: every third to eighth word changed, words changed, dropped, put in or swapped at random."""
    for k in range(3, 9):
        at = rng.randrange(k)
        yield [rng.choice(vocabulary) if j % k == at else w for j, w in enumerate(words)]
    yield [rng.choice(vocabulary) if rng.random() < 0.3 else w for w in words]
    yield [w for w in words if rng.random() > 0.2]
    yield [x for w in words for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.5 else [w])]
    swapped = list(words)
    for j in range(0, len(swapped) - 1, 5):
        swapped[j], swapped[j + 1] = swapped[j + 1], swapped[j]
    yield swapped


def test_decontamination_recall_against_all_alignments(rows):
    """What aligning every item with every text finds, for copies in the middle of clean texts."""
    import random

    docs, _, benchmark = rows
    rng = random.Random(6)
    (matcher,) = decontaminate.prepare(docs, benchmark)
    index, clean = matcher.index, [decontaminate.tokens(r.text) for r in docs.where("length(text) > 900").orderBy("doc_id").limit(8).collect()]
    vocabulary = sorted({w for t in clean for w in t})
    texts = [" ".join(rng.choice(clean)[:50] + own + rng.choice(clean)[:50]) for item in benchmark.orderBy("item_id").limit(12).collect() for own in edited(rng, decontaminate.tokens(item.text), vocabulary)]
    expected = {(i, index.ids[k]) for i, t in enumerate(texts) for k, q in enumerate(index.items) if decontaminate.smith_waterman(q, index.numbers(t))[0] >= matcher.least[k]}
    got = {(i, hit[0]) for i, own in enumerate(matcher.find_all(texts)) for hit in own}
    assert got <= expected and len(got) >= 0.98 * len(expected) and len(expected) > 100


def test_short_items_need_a_whole_match():
    index = decontaminate.Index([(1, "the"), (2, "of the"), (3, "alpha beta gamma"), (4, "one two three four five six seven eight nine ten")])
    m = decontaminate.Matcher(index, np.ones(len(index.number), np.int64), 0.5)
    assert index.ids == [3, 4] and m.find("the of the end") == []
    assert [h[0] for h in m.find("x alpha beta gamma y")] == [3] and m.find("x alpha beta y") == []
    assert [h[0] for h in m.find("one two three four five six seven eight")] == [4] and m.find("one two three four five") == []
